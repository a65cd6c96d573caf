"""Specific risk: EWMA volatilities of residuals, a structural fallback, their blend, shrinkage by size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.config import RiskConfig, decay
from factorlake.functions.scalar import clip
from factorlake.functions.timeseries import Ewma, with_ewmas
from factorlake.operators import rolling
from factorlake.operators.covariance import newey_west
from factorlake.operators.pit import at_dates


def ewma_volatility(residuals: DataFrame, cfg: RiskConfig) -> DataFrame:
    """residuals (asset, date, eps) to (asset, ts_vol, n_obs): annual, over the asset's own observations, so gaps
    don't age; NULL with too few."""
    nw = newey_west(residuals, cfg.specific_half_life, cfg.specific_lags, *cfg.ratio_clip, key="asset", value="eps")
    vol = F.when(F.col("n") >= cfg.least_specific_obs, F.sqrt(F.col("adjusted") * cfg.periods_per_year))
    return nw.select("asset", vol.alias("ts_vol"), F.col("n").alias("n_obs"))


Keep = Callable[[DataFrame, str], DataFrame]
#: Values are ranked by cells of a logarithmic scale; so many of them double a large value, or add 0.7 to a small one.
CELLS = 1024


def _as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def _cells(rows: DataFrame, by: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """rows with _at, the cell of by and value, and per cell: _at, how many rows it has (_c), how many come before it in its group, and the group's _n."""
    v = F.col(value).cast("double")
    # never falls as the value grows; missing values are with the least cell and NaN with the last, where the sort tells them apart
    cell = F.when(F.isnan(v), F.lit(2**63 - 1)).otherwise(F.coalesce(F.floor(F.signum(v) * F.log1p(F.abs(v)) * CELLS), F.lit(-(2**63))))
    rows = rows.withColumn("_at", F.struct(*by, cell.alias("_cell")))
    cells = rows.groupBy("_at").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*[f"_at.{k}" for k in by])
    return rows, cells.withColumn("_before", F.sum("_c").over(group.orderBy("_at._cell")) - F.col("_c")).withColumn("_n", F.sum("_c").over(group))


def ranked(rows: DataFrame, by: list[str], value: str, *ties: str) -> DataFrame:
    """rows with _rank by value and ties among the _n rows of their group: counts of cells tell where a cell begins, so that no
    task sorts a whole group."""
    rows, cells = _cells(rows, by, value)
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_at").orderBy(value, *ties))
    return rows.join(cells, "_at").withColumn("_rank", rank).drop("_at", "_c", "_before")


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): percentile() of each group. Only the cells that hold the rows asked for are sorted."""
    rows, cells = _cells(rows.select(*by, value), by, value)
    at = {name: (F.col("_n") - 1) * p for name, p in shares.items()}
    ends = [f(x) for x in at.values() for f in (F.floor, F.ceil)]
    holds = reduce(Column.__or__, [(F.col("_before") <= x) & (x < F.col("_before") + F.col("_c")) for x in ends])
    # two cells at most for each share and group
    few = rows.join(F.broadcast(cells.where(holds)), "_at")
    few = few.withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy("_at").orderBy(value)) - 1)
    values = {n: [F.max(F.when(F.col("_k") == f(x), F.col(value))) for f in (F.floor, F.ceil)] for n, x in at.items()}
    out = few.groupBy(*by).agg(F.max("_n").alias("_n"), *[v.alias(f"_{end}_{n}") for n, vs in values.items() for end, v in zip(("low", "high"), vs, strict=True)])
    between = {n: F.col(f"_low_{n}") + (x - F.floor(x)) * (F.col(f"_high_{n}") - F.col(f"_low_{n}")) for n, x in at.items()}
    return out.select(*by, *[c.alias(n) for n, c in between.items()])


def structural(assets: DataFrame, cfg: RiskConfig, by: list[str] | None = None, keep: Keep = _as_is) -> DataFrame:
    """assets (by..., asset, ts_vol, industry, size, volatility, liquidity) with `structural`: the volatility that its
    industry and styles suggest, for all groups of `by` (dates) in one plan. keep writes a table that several steps read.

    Log volatilities are regressed within industries: each group's within-industry moments are one row of sums, whose 3 x 3 systems are
    solved in batches; industry intercepts are group means. Smeared back from logs, then clipped; NULL for groups with too few names.
    Groups are summed, not gathered: what rows need of them comes as one row for each industry and one for each group.
    """
    keys, styles = by or ["_all"], ["size", "volatility", "liquidity"]
    names = ["_y", *styles]
    rows = assets if by else assets.withColumn("_all", F.lit(1))
    fit = F.col("ts_vol") > 0
    rows = rows.withColumn("_y", F.when(fit, F.ln("ts_vol")))

    def product(a: str, b: str) -> Column:
        """Sum of both deviations' products, each from the mean of its own column."""
        around = F.regr_count(a, b) * (F.regr_avgy(a, b) - F.avg(a)) * (F.regr_avgx(a, b) - F.avg(b))
        return F.coalesce(F.regr_sxy(a, b) + around, F.lit(0.0))

    pairs = [(a, b) for i, a in enumerate(styles) for b in [*styles[i:], "_y"]]
    means = [F.avg(c).alias(f"_i_{c}") for c in names] + [F.sum(c).alias(f"_s_{c}") for c in names] + [F.count(c).alias(f"_n_{c}") for c in names]
    each = rows.where(fit).withColumns({c: F.col(c).cast("double") for c in names}).groupBy(*keys, "industry").agg(F.count("*").alias("_n"), *means, *[product(a, b).alias(f"_p{i}") for i, (a, b) in enumerate(pairs)])
    each = keep(each, "industry-moments")
    gram = F.array(*[F.sum(f"_p{i}") for i in range(len(pairs))], F.lit(0.0))
    sums = each.groupBy(*keys).agg(F.sum("_n").alias("_n"), gram.alias("gram"), *[F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(f"_g_{c}") for c in names]).where(F.col("_n") >= cfg.least_structural)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                b, _ = rolling.solved(rolling.stacked(pdf["gram"]))
                yield pdf[keys].assign(_b=list(b))

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    slopes = sums.select(*keys, "gram").mapInPandas(solve, f"{kinds}, _b array<double>")
    # a row for each group, and for each date that is three slopes and four means; and one for each of its industries
    rows = rows.join(F.broadcast(sums.drop("_n", "gram").join(slopes, keys)), keys, "left")
    own = each.select(F.struct(*keys, "industry").alias("_at"), *[f"_i_{c}" for c in names])
    rows = rows.withColumn("_at", F.struct(*keys, "industry")).join(F.broadcast(own), "_at", "left")
    mean = {c: F.coalesce(f"_i_{c}", f"_g_{c}") for c in names}
    tilt: Column = F.lit(0.0)
    for k, s in enumerate(styles):
        tilt = tilt + F.col("_b")[k] * (F.col(s) - mean[s])
    rows = rows.withColumn("_guess", F.exp(mean["_y"] + tilt))
    smear = rows.where(fit).groupBy(*keys).agg(F.avg(F.col("ts_vol") / F.col("_guess")).alias("_smear"))
    known = assets if by else assets.withColumn("_all", F.lit(1))
    bounds = smear.join(percentiles(known.where(fit), keys, "ts_vol", {"_low": 0.01, "_high": 0.99}), keys)
    # a row for each group
    rows = rows.join(F.broadcast(keep(bounds, "structural-bounds")), keys, "left")
    value = F.when(F.col("_b").isNotNull(), clip(F.col("_guess") * F.col("_smear"), F.col("_low"), 1.5 * F.col("_high")))
    return rows.select(*assets.columns, value.alias("structural"))


def blended(assets: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Adds blend_weight n / (n + structural_obs), 0 without a volatility of its own, and vol."""
    w = F.when(F.col("ts_vol").isNull(), F.lit(0.0)).otherwise(F.col("n_obs") / (F.col("n_obs") + float(cfg.structural_obs)))
    vol = F.when(F.col("ts_vol").isNull(), F.col("structural")).when(F.col("structural").isNull(), F.col("ts_vol")).otherwise(w * F.col("ts_vol") + (1 - w) * F.col("structural"))
    return assets.withColumn("blend_weight", w).withColumn("vol", vol)


def shrink(assets: DataFrame, cfg: RiskConfig, vol: str = "vol", size: str = "size", by: list[str] | None = None, keep: Keep = _as_is) -> DataFrame:
    """Volatilities drawn to their size bucket's mean, the more the further off; unchanged with few assets. keep writes a table that is read twice."""
    q, n_buckets, keys = cfg.shrink, cfg.shrink_buckets, by or []
    valid = F.col(vol).isNotNull() & F.col(size).isNotNull()
    rows = ranked(assets.withColumn("_ok", valid), [*keys, "_ok"], size, "asset")
    rows = rows.withColumn("_b", F.least(F.floor(F.col("_rank") * n_buckets / F.col("_n")), F.lit(n_buckets - 1)))
    rows = keep(rows, "size-ranks").withColumn("_at", F.struct(*keys, "_ok", "_b"))
    # a row for each bucket of a group
    buckets = rows.where("_ok").groupBy("_at").agg(F.avg(vol).alias("_mean"), F.stddev_pop(vol).alias("_dev"))
    rows = rows.join(F.broadcast(buckets), "_at", "left")
    far = q * F.abs(F.col(vol) - F.col("_mean"))
    v = far / (F.col("_dev") + far)
    drawn = v * F.col("_mean") + (1 - v) * F.col(vol)
    use = F.col("_ok") & (F.col("_n") >= 5 * n_buckets) & (F.col("_dev") > 0)
    return rows.withColumn(vol, F.when(use, drawn).otherwise(F.col(vol))).select(*assets.columns)


def specific_risk(residuals: DataFrame, assets: DataFrame, cfg: RiskConfig, vra: float = 1.0) -> DataFrame:
    """(asset, vol, ts_vol, structural, blend_weight, n_obs): the whole chain for all assets of `assets`
    (asset, industry, size, volatility, liquidity)."""
    rows = assets.join(ewma_volatility(residuals, cfg), "asset", "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))
    rows = shrink(blended(structural(rows, cfg), cfg), cfg)
    return rows.select("asset", (F.col("vol") * vra).alias("vol"), "ts_vol", "structural", "blend_weight", "n_obs")


def ewma_volatility_at(residuals: DataFrame, dates: DataFrame, cfg: RiskConfig) -> DataFrame:
    """(date, asset, ts_vol, n_obs): what ewma_volatility() gives for the rows up to each of dates (date), from running sums."""
    k, w = decay(cfg.specific_half_life), Window.partitionBy("asset").orderBy("date")
    lagged = {f"_s{lag}": Ewma(F.coalesce(F.col("eps") * F.lag("eps", lag).over(w), F.lit(0.0))) for lag in range(1, cfg.specific_lags + 1)}
    rows = with_ewmas(residuals.where("eps is not null"), "asset", "date", k, {"_s0": Ewma(F.col("eps") ** 2), "_w0": Ewma(F.lit(1.0))} | lagged)
    total = F.col("_s0")
    for lag in range(1, cfg.specific_lags + 1):
        total = total + 2.0 * (1.0 - lag / (cfg.specific_lags + 1.0)) * F.col(f"_s{lag}")
    adjusted = F.col("_s0") / F.col("_w0") * F.coalesce(clip(F.try_divide(total, F.col("_s0")), *cfg.ratio_clip), F.lit(1.0))
    n = F.row_number().over(w)
    vol = F.when(n >= cfg.least_specific_obs, F.sqrt(adjusted * cfg.periods_per_year))
    known = rows.select("asset", vol.alias("ts_vol"), n.cast("long").alias("n_obs"), F.col("date").alias("_from"), F.lead("date").over(w).alias("_until"))
    return at_dates(known, dates).withColumnRenamed("as_of", "date")


def specific_risk_at(residuals: DataFrame, snapshots: DataFrame, cfg: RiskConfig, multipliers: DataFrame | None = None, keep: Keep = _as_is) -> DataFrame:
    """(date, asset, vol, ts_vol, structural, blend_weight, n_obs): the whole chain of specific_risk() as of every date of snapshots
    (date, asset, industry, size, volatility, liquidity), in one plan. multipliers (date, multiplier): of the regime, 1 where missing.
    keep writes a table that several steps read."""
    own = ewma_volatility_at(residuals, snapshots, cfg)
    rows = keep(snapshots.join(own, ["date", "asset"], "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0).cast("long"))), "own-volatilities")
    rows = shrink(blended(structural(rows, cfg, ["date"], keep), cfg), cfg, by=["date"], keep=keep)
    if multipliers is not None:
        # a row a date
        rows = rows.join(F.broadcast(multipliers.select("date", "multiplier")), "date", "left").withColumn("vol", F.col("vol") * F.coalesce("multiplier", F.lit(1.0)))
    return rows.select("date", "asset", "vol", "ts_vol", "structural", "blend_weight", "n_obs")
