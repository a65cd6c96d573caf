"""Test portfolios and how well the model forecasts them. Many portfolios and dates per query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.config import RiskConfig

LEAST_NAMES, LEAST_SIDE, LEAST_INDUSTRY = 100, 10, 15
#: Hexadecimal digits of a hash that random_baskets() counts by: 4,096 cells of each date and basket.
DIGITS = 3


def _hash_order(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))


def simple_portfolios(assets: DataFrame, by: str = "date") -> DataFrame:
    """Market and equal-weighted (by, portfolio, asset, w); dates with few names give none."""
    rows = assets.where("cap > 0").withColumn("_n", F.count("*").over(Window.partitionBy(by))).where(F.col("_n") >= LEAST_NAMES)
    market = rows.select(by, F.lit("market").alias("portfolio"), "asset", (F.col("cap") / F.sum("cap").over(Window.partitionBy(by))).alias("w"))
    return market.unionByName(rows.select(by, F.lit("equal_weight").alias("portfolio"), "asset", (1.0 / F.col("_n")).alias("w")))


def style_portfolios(assets: DataFrame, styles: list[str], by: str = "date") -> DataFrame:
    """For each style the top fifth long and the bottom fifth short, equal weights within a side."""
    rows = assets.where("cap > 0").withColumn("_n", F.count("*").over(Window.partitionBy(by))).where(F.col("_n") >= LEAST_NAMES)
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("style"), F.col(s).cast("double").alias("x")) for s in styles]))
    rows = rows.select(by, "asset", pairs.alias("p")).select(by, "asset", "p.style", "p.x")
    cuts = rows.groupBy(by, "style").agg(F.percentile("x", F.lit(0.2)).alias("low"), F.percentile("x", F.lit(0.8)).alias("high"))
    top, bottom = F.col("x") >= F.col("high"), F.col("x") <= F.col("low")
    rows = rows.join(cuts, [by, "style"]).where(top | bottom)
    sides = rows.groupBy(by, "style").agg(F.count_if(top).alias("up"), F.count_if(bottom).alias("down"))
    rows = rows.join(sides.where((F.col("up") >= LEAST_SIDE) & (F.col("down") >= LEAST_SIDE)), [by, "style"])
    w = F.when(bottom, -1.0 / F.col("down")).otherwise(1.0 / F.col("up"))  # a name on both cuts is short
    return rows.select(by, F.concat(F.lit("style_"), "style").alias("portfolio"), "asset", w.alias("w"))


def industry_portfolios(assets: DataFrame, by: str = "date") -> DataFrame:
    w = Window.partitionBy(by, "industry")
    rows = assets.where("cap > 0 and industry <> 'Other'").withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= LEAST_INDUSTRY)
    return rows.select(by, F.concat(F.lit("industry_"), F.col("industry").cast("string")).alias("portfolio"), "asset", (F.col("cap") / F.sum("cap").over(w)).alias("w"))


def random_baskets(assets: DataFrame, baskets: int, names: int, by: str = "date") -> DataFrame:
    """Equal-weighted baskets drawn by hash order, so every run draws the same.

    Counts by the hashes' first DIGITS digits tell from where on nobody can be among the first; only the rows before that are sorted.
    """
    each = assets.select(by, "asset").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(baskets)))).withColumn("_h", _hash_order(F.col("k"), F.col(by), F.col("asset")))
    each = each.withColumn("_cell", F.substring("_h", 1, DIGITS))
    before = F.sum("_n").over(Window.partitionBy(by, "k").orderBy("_cell")) - F.col("_n")
    cells = each.groupBy(by, "k", "_cell").agg(F.count("*").alias("_n")).withColumn("_before", before)
    # a row a date and basket
    cuts = cells.where(F.col("_before") < names).groupBy(F.col(by).alias("_by"), F.col("k").alias("_k")).agg(F.max("_cell").alias("_last"))
    each = each.join(F.broadcast(cuts), F.col(by).eqNullSafe(F.col("_by")) & (F.col("k") == F.col("_k")) & (F.col("_cell") <= F.col("_last")))
    rank = F.row_number().over(Window.partitionBy(by, "k").orderBy("_h", "asset"))
    rows = each.withColumn("_r", rank).where(F.col("_r") <= names)
    n = F.count("*").over(Window.partitionBy(by, "k"))
    return rows.select(by, F.concat(F.lit("random_"), F.col("k").cast("string")).alias("portfolio"), "asset", (1.0 / n).alias("w"))


def minimum_risk(assets: DataFrame, factors: list[str], cov: np.ndarray, alpha: str = "alpha", names: int = 500) -> DataFrame:
    """(asset, w): weights in proportion to inverse covariance x alpha, unit gross, over the largest names.

    assets (asset, cap, var, alpha, one exposure column per factor). The K x K sums X'D^-1X and X'D^-1 alpha are
    Spark aggregates; only the K x K system is solved on the driver, weights are a projection.
    """
    rows = assets.where("var > 0 and cap > 0").orderBy(F.col("cap").desc(), "asset").limit(names)
    k = len(factors)
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b) / F.col("var")).alias(f"g{i}_{j}") for i, a in enumerate(factors) for j, b in enumerate(factors) if j >= i], *[F.sum(F.col(a) * F.col(alpha) / F.col("var")).alias(f"y{i}") for i, a in enumerate(factors)]).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    inner = np.linalg.inv(cov + 1e-12 * np.eye(k)) + gram
    u = np.linalg.solve((inner + inner.T) / 2, np.array([sums[f"y{i}"] or 0.0 for i in range(k)]))
    tilt = sum((float(u[i]) * F.col(f) for i, f in enumerate(factors)), F.lit(0.0))
    raw = rows.select("asset", ((F.col(alpha) - tilt) / F.col("var")).alias("_w"))
    return raw.select("asset", (F.col("_w") / F.sum(F.abs("_w")).over(Window.partitionBy())).alias("w"))


def optimized_portfolios(assets: DataFrame, exposures: DataFrame, cov: DataFrame, cfg: RiskConfig) -> DataFrame:
    """(date, portfolio, asset, w): of each date the minimum-variance portfolio and those of random alphas, unit gross, over the largest names.

    assets (date, week_index, asset, cap, var), exposures (date, asset, factor, x), cov (date, f1, f2, cov). A group is one date's
    optimized_names names with K exposures each, beside K x K covariances.
    """
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.col("cap").desc(), "asset"))
    rows = assets.where("var > 0 and cap > 0").withColumn("_r", rank).where(F.col("_r") <= cfg.optimized_names)
    held = exposures.join(rows.select("date", "asset"), ["date", "asset"]).groupBy("date", "asset").agg(F.map_from_entries(F.collect_list(F.struct("factor", "x"))).alias("x"))
    rows = rows.join(held, ["date", "asset"])

    def one(names: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        names = names.sort_values("_r")
        out = []
        if len(names) >= LEAST_NAMES and len(pairs):
            factors = sorted(set(pairs["f1"]))
            at = {f: i for i, f in enumerate(factors)}
            m = np.zeros((len(factors), len(factors)))
            m[pairs["f1"].map(at), pairs["f2"].map(at)] = pairs["cov"]
            x = np.array([[(own or {}).get(f, 0.0) or 0.0 for f in factors] for own in (dict(v) for v in names["x"])])
            scaled = x / names["var"].to_numpy()[:, None]
            inner = np.linalg.inv(m + 1e-12 * np.eye(len(m))) + x.T @ scaled
            alphas = {"opt_minvar": np.ones(len(names))}
            for k in range(cfg.random_alphas):
                alphas[f"opt_alpha{k + 1}"] = np.random.default_rng([k + 1, int(names["week_index"].iloc[0])]).standard_normal(len(names))
            for name, alpha in alphas.items():
                w = alpha / names["var"].to_numpy() - scaled @ np.linalg.solve((inner + inner.T) / 2, scaled.T @ alpha)
                if np.isfinite(w).all() and np.abs(w).sum() > 0:
                    out.append(pd.DataFrame({"date": names["date"].iloc[0], "portfolio": name, "asset": names["asset"].astype(str).to_numpy(), "w": w / np.abs(w).sum()}))
        return pd.concat(out) if out else pd.DataFrame({"date": [], "portfolio": [], "asset": [], "w": []}, dtype=object)

    return rows.groupBy("date").cogroup(cov.groupBy("date")).applyInPandas(one, "date date, portfolio string, asset string, w double")


def group_of(portfolio: Column) -> Column:
    return F.split_part(portfolio, F.lit("_"), F.lit(1))


def realized_volatility(weights: DataFrame, returns: DataFrame, by: list[str], weeks_per_year: int = 52, least_days: int = 3) -> DataFrame:
    """weights (by..., asset, w) and returns (by's week, date, asset, r) to (by..., realized_vol_ann): root of the scaled sum
    of squared daily portfolio returns; missing returns count as 0."""
    daily = weights.join(returns, ["week", "asset"]).groupBy(*by, "date").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("rp"))
    own = daily.groupBy(*by).agg(F.count("*").alias("_d"), F.sum(F.col("rp") ** 2).alias("_s"))
    return own.select(*by, F.when(F.col("_d") >= least_days, F.sqrt(weeks_per_year * F.col("_s"))).alias("realized_vol_ann"))


def score(portfolios: DataFrame, exposures: DataFrame, cov: DataFrame, specific: DataFrame, returns: DataFrame, cfg: RiskConfig, by: str = "date") -> DataFrame:
    """(by, portfolio, group, forecast_vol_ann, realized_ret, z): forecasts from daily factor covariance and
    specific variance against the following week's returns. cov may differ by date."""
    x = portfolios.join(exposures, [by, "asset"]).groupBy(by, "portfolio", "factor").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return score_exposed(portfolios, x, cov, specific, returns, cfg, by)


def score_exposed(portfolios: DataFrame, x: DataFrame, cov: DataFrame, specific: DataFrame, returns: DataFrame, cfg: RiskConfig, by: str = "date") -> DataFrame:
    """score() with the portfolios' own exposures x (by, portfolio, factor, x)."""
    other = x.select(by, "portfolio", F.col("factor").alias("f2"), F.col("x").alias("x2"))
    pairs = x.withColumnRenamed("factor", "f1").join(other, [by, "portfolio"]).join(cov, [by, "f1", "f2"] if by in cov.columns else ["f1", "f2"])
    systematic = pairs.groupBy(by, "portfolio").agg(F.sum(F.col("x") * F.col("cov") * F.col("x2")).alias("_f"))
    own = portfolios.join(specific, [by, "asset"]).join(returns, [by, "asset"], "left")
    own = own.groupBy(by, "portfolio").agg(F.sum(F.col("w") ** 2 * F.col("var")).alias("_s"), F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("realized_ret"))
    var = F.greatest(F.coalesce("_f", F.lit(0.0)) + F.col("_s"), F.lit(0.0))
    rows = own.join(systematic, [by, "portfolio"], "left").withColumn("_v", var)
    return rows.select(by, "portfolio", group_of(F.col("portfolio")).alias("group"), F.sqrt(cfg.periods_per_year * F.col("_v")).alias("forecast_vol_ann"), "realized_ret", F.try_divide(F.col("realized_ret"), F.sqrt(cfg.days_per_week * F.col("_v"))).alias("z"))


def summary(scores: DataFrame, least: int = 30) -> DataFrame:
    """Per portfolio: n, bias (deviation of z), share beyond 1.96, mean forecast and realised volatility, their ratio."""
    rms = lambda c: F.sqrt(F.avg(F.col(c) ** 2))
    own = scores.groupBy("portfolio").agg(F.count("z").alias("n"), F.stddev_samp("z").alias("bias"), F.avg((F.abs("z") > 1.96).cast("double")).alias("exceed"), F.avg("forecast_vol_ann").alias("mean_forecast"), F.avg("realized_vol_ann").alias("mean_realized"), F.try_divide(rms("realized_vol_ann"), rms("forecast_vol_ann")).alias("vol_ratio"))
    return own.where(F.col("n") >= least)
