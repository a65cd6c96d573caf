"""Portfolio analytics for many portfolios per query: weights (portfolio, asset, w) against a model.

A model is exposures (asset, factor, x) long, covariance (f1, f2, cov) annual, specific (asset, vol) annual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlake.config import RiskConfig, decay


def normalised(weights: DataFrame) -> DataFrame:
    """Upper-case tickers, positions of the same ticker added; weights aren't rescaled."""
    return weights.groupBy("portfolio", F.upper(F.trim("asset")).alias("asset")).agg(F.sum("w").alias("w"))


def coverage(weights: DataFrame, assets: DataFrame) -> DataFrame:
    """(portfolio, n, n_covered, gross, coverage): share of the gross weight that the model covers."""
    rows = weights.join(assets.select("asset").distinct().withColumn("_in", F.lit(1)), "asset", "left")
    own = rows.groupBy("portfolio").agg(F.count("*").alias("n"), F.count("_in").alias("n_covered"), F.sum(F.abs("w")).alias("gross"), F.sum(F.when(F.col("_in").isNull(), F.abs("w")).otherwise(0.0)).alias("_out"))
    return own.select("portfolio", "n", "n_covered", "gross", (1 - F.coalesce(F.try_divide(F.col("_out"), F.col("gross")), F.lit(0.0))).alias("coverage"))


def split_coverage(names: DataFrame, assets: DataFrame) -> DataFrame:
    """names (asset) with `covered`."""
    return names.join(assets.select("asset").distinct().withColumn("_in", F.lit(1)), "asset", "left").select("asset", F.col("_in").isNotNull().alias("covered"))


def factor_exposures(weights: DataFrame, exposures: DataFrame) -> DataFrame:
    """(portfolio, factor, x)."""
    return weights.join(exposures, "asset").groupBy("portfolio", "factor").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def factor_contributions(weights: DataFrame, exposures: DataFrame, cov: DataFrame) -> DataFrame:
    """(portfolio, factor, x, marginal (F x), contribution x (F x)): contributions add up to the factor variance."""
    x = factor_exposures(weights, exposures)
    f = cov.select(F.col("f1").alias("factor"), "f2", "cov")
    other = x.select("portfolio", F.col("factor").alias("f2"), F.col("x").alias("x2"))
    marginal = other.join(f, "f2").groupBy("portfolio", "factor").agg(F.sum(F.col("cov") * F.col("x2")).alias("marginal"))
    return x.join(marginal, ["portfolio", "factor"]).withColumn("contribution", F.col("x") * F.col("marginal"))


def risk(weights: DataFrame, exposures: DataFrame, cov: DataFrame, specific: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """(portfolio, factor_var, specific_var, total_vol, factor_share); assets without a specific volatility add none.

    multiplier: scales volatilities, e.g. by `shepard_multiplier` for optimised portfolios.
    """
    systematic = factor_contributions(weights, exposures, cov).groupBy("portfolio").agg(F.sum("contribution").alias("factor_var"))
    own = weights.join(specific, "asset", "left").groupBy("portfolio").agg(F.sum(F.col("w") ** 2 * F.coalesce(F.col("vol") ** 2, F.lit(0.0))).alias("specific_var"))
    rows = own.join(systematic, "portfolio", "left").withColumn("factor_var", F.greatest(F.coalesce("factor_var", F.lit(0.0)), F.lit(0.0)))
    total = F.col("factor_var") + F.col("specific_var")
    m2 = multiplier**2
    return rows.select("portfolio", (F.col("factor_var") * m2).alias("factor_var"), (F.col("specific_var") * m2).alias("specific_var"), (F.sqrt(total) * multiplier).alias("total_vol"), F.coalesce(F.try_divide(F.col("factor_var"), total), F.lit(0.0)).alias("factor_share"))


def asset_contributions(weights: DataFrame, exposures: DataFrame, cov: DataFrame, specific: DataFrame) -> DataFrame:
    """(portfolio, asset, w, contribution): w (Sigma w) / volatility; contributions add up to the volatility."""
    marginal = factor_contributions(weights, exposures, cov).select("portfolio", "factor", "marginal")
    systematic = weights.join(exposures, "asset").join(marginal, ["portfolio", "factor"]).groupBy("portfolio", "asset", "w").agg(F.sum(F.col("x") * F.col("marginal")).alias("_s"))
    rows = weights.join(systematic.drop("w"), ["portfolio", "asset"], "left").join(specific, "asset", "left")
    share = F.col("w") * (F.coalesce("_s", F.lit(0.0)) + F.coalesce(F.col("vol") ** 2, F.lit(0.0)) * F.col("w"))
    rows = rows.withColumn("_c", share)
    return rows.select("portfolio", "asset", "w", F.try_divide(F.col("_c"), F.sqrt(F.sum("_c").over(Window.partitionBy("portfolio")))).alias("contribution"))


def top(rows: DataFrame, value: str, n: int, tie: str, by: str = "portfolio") -> DataFrame:
    """The n rows of each portfolio that are largest in size."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.abs(value).desc(), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def stress(weights: DataFrame, exposures: DataFrame, shocks: DataFrame) -> DataFrame:
    """shocks (scenario, factor, shock) to (scenario, portfolio, impact); a factor that the model lacks is an error."""
    unknown = shocks.join(exposures.select("factor").distinct(), "factor", "left_anti").select("factor").distinct().limit(5).collect()
    if unknown:
        raise ValueError(f"unknown factors: {', '.join(r['factor'] for r in unknown)}")
    return factor_exposures(weights, exposures).join(shocks, "factor").groupBy("scenario", "portfolio").agg(F.sum(F.col("x") * F.col("shock")).alias("impact"))


def asset_risk(exposures: DataFrame, cov: DataFrame, specific: DataFrame) -> DataFrame:
    """(asset, factor_vol, specific_vol, total_vol) of every asset at once."""
    pairs = exposures.select("asset", F.col("factor").alias("f1"), "x").join(cov, "f1").join(exposures.select("asset", F.col("factor").alias("f2"), F.col("x").alias("x2")), ["asset", "f2"])
    systematic = pairs.groupBy("asset").agg(F.greatest(F.sum(F.col("x") * F.col("cov") * F.col("x2")), F.lit(0.0)).alias("v"))
    rows = systematic.join(specific, "asset", "left").withColumn("vol", F.coalesce("vol", F.lit(0.0)))
    return rows.select("asset", F.sqrt("v").alias("factor_vol"), F.col("vol").alias("specific_vol"), F.sqrt(F.col("v") + F.col("vol") ** 2).alias("total_vol"))


def shepard_multiplier(n_factors: int, cfg: RiskConfig) -> float:
    """1 / (1 - K / N): how far optimised portfolios understate risk; N is the weights' effective sample size."""
    k = decay(cfg.vol_half_life)
    n = (1 + k) / (1 - k)
    return cfg.shepard_cap if n_factors >= n else min(cfg.shepard_cap, 1 / (1 - n_factors / n))
