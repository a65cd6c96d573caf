"""The running risk state in closed form: what a day-by-day fold would hold, as windows over the history.

`before` columns are what a day finds before its own update, so forecasts use no later data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlake.config import RiskConfig, decay
from factorlake.functions.scalar import clip
from factorlake.functions.timeseries import Ewma, with_ewma, with_ewmas


def factor_variance(returns: DataFrame, cfg: RiskConfig) -> DataFrame:
    """returns (date, factor, f) with n, var and var_before: the zero-start recursion on squares."""
    k = decay(cfg.vol_half_life)
    square = F.col("f") ** 2
    rows = with_ewmas(returns, "factor", "date", k, {"var": Ewma(square), "var_before": Ewma(square, before=True)})
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("factor").orderBy("date")))


def asset_variance(residuals: DataFrame, cfg: RiskConfig) -> DataFrame:
    """residuals (date, asset, eps) with n, var, var_before (seeded by the first square) and lag (zero-start on
    products of neighbouring residuals): each asset's clock is its own observations."""
    k = decay(cfg.specific_half_life)
    w = Window.partitionBy("asset").orderBy("date")
    square, neighbours = F.col("eps") ** 2, F.coalesce(F.col("eps") * F.lag("eps").over(w), F.lit(0.0))
    recursions = {"var": Ewma(square, seeded=True), "var_before": Ewma(square, seeded=True, before=True), "lag": Ewma(neighbours)}
    rows = with_ewmas(residuals.where("eps is not null"), "asset", "date", k, recursions)
    return rows.withColumn("n", F.row_number().over(w))


def _regime(daily: DataFrame, cfg: RiskConfig) -> DataFrame:
    """daily (date, b) to (date, b, state, multiplier): the EWMA of b from 1, on days that have one."""
    k = decay(cfg.vra_half_life)
    rows = daily.where("b is not null").withColumn("_one", F.lit(1))
    rows = with_ewma(rows, F.col("b"), "_z", "_one", "date", k, seeded=False)
    n = F.row_number().over(Window.partitionBy("_one").orderBy("date"))
    rows = rows.withColumn("state", F.col("_z") + F.pow(F.lit(k), n))
    return rows.select("date", "b", "state", clip(F.sqrt("state"), *cfg.vra_clip).alias("multiplier"))


def vra_factor(returns: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Daily factor regime: mean capped squared z over the factors, once the state has enough days."""
    rows = factor_variance(returns, cfg).where((F.col("n") > int(cfg.vol_half_life)) & (F.col("var_before") > 0))
    b = F.avg(F.least(F.col("f") ** 2 / F.col("var_before"), F.lit(cfg.vra_cap)))
    return _regime(rows.groupBy("date").agg(b.alias("b")), cfg)


def vra_specific(residuals: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Daily specific regime over the names with enough observations; days with too few names are left out."""
    rows = asset_variance(residuals, cfg).where((F.col("n") > cfg.least_specific_obs) & (F.col("var_before") > 0))
    b = F.avg(F.least(F.col("eps") ** 2 / F.col("var_before"), F.lit(cfg.vra_cap)))
    daily = rows.groupBy("date").agg(F.when(F.count("*") >= cfg.vra_names, b).alias("b"))
    return _regime(daily, cfg)


def specific_variance_asof(residuals: DataFrame, as_of: str, cfg: RiskConfig, multiplier: float = 1.0) -> DataFrame:
    """(asset, var): period variance known on a date: own with serial adjustment if observed often enough, else NULL
    (to be filled with the cross-section's median)."""
    rows = asset_variance(residuals.where(F.col("date") <= F.lit(as_of).cast("date")), cfg)
    own = rows.groupBy("asset").agg(F.max(F.struct("date", "var", "lag", "n")).alias("at")).select("asset", "at.var", "at.lag", "at.n")
    adjusted = F.col("var") * F.coalesce(clip(F.try_divide(F.col("var") + F.col("lag"), F.col("var")), *cfg.ratio_clip), F.lit(1.0))
    return own.select("asset", F.when(F.col("n") >= cfg.least_specific_obs, adjusted * multiplier**2).alias("var"), "n")


def fill_median(variances: DataFrame, names: DataFrame) -> DataFrame:
    """(asset, var) for all names: unobserved ones take the median."""
    rows = names.select("asset").distinct().join(variances.select("asset", "var"), "asset", "left")
    middle = rows.agg(F.median("var").alias("_m"))
    # one row
    return rows.join(F.broadcast(middle), F.lit(True)).select("asset", F.coalesce("var", "_m").alias("var"))


def replay(returns: np.ndarray, half_life: float) -> np.ndarray:
    """The zero-start second-moment recursion folded day by day: the check of the windows above, for K x K."""
    k, state = decay(half_life), np.zeros((returns.shape[1], returns.shape[1]))
    for f in returns:
        state = k * state + (1 - k) * np.outer(f, f)
    return state


def weekly_returns(exposures: DataFrame, factors: DataFrame, residuals: DataFrame, weeks: DataFrame) -> DataFrame:
    """(week, asset, r): product over a week's days of (1 + exposures x factor returns + residual), less 1.

    exposures (week, asset, factor, x) long; factors (date, factor, f); residuals (date, asset, eps);
    weeks (date, week): the formation week each day belongs to.
    """
    days = factors.join(weeks, "date")
    systematic = exposures.join(days, ["week", "factor"]).groupBy("week", "date", "asset").agg(F.sum(F.col("x") * F.col("f")).alias("s"))
    both = systematic.join(residuals, ["date", "asset"])
    return both.groupBy("week", "asset").agg((F.product(1 + F.col("s") + F.col("eps")) - 1).alias("r"))
