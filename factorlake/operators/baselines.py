"""Public volatility baselines and scoring protocols, by windows over each portfolio's weeks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlake.config import RiskConfig
from factorlake.functions.scalar import month
from factorlake.functions.timeseries import Ewma, running, scanned, shifted, trailing, with_ewmas
from factorlake.operators import rolling


def trailing_volatility(rows: DataFrame, value: str, name: str, cfg: RiskConfig, key: str = "portfolio", order: str = "date") -> DataFrame:
    """Zero-mean volatility of the weeks before the current one."""
    w = trailing(key, order, cfg.trailing_weeks, 1)
    return rows.withColumn(name, F.when(F.count(value).over(w) >= cfg.trailing_weeks, F.sqrt(cfg.weeks_per_year * F.avg(F.col(value) ** 2).over(w))))


def baseline_forecasts(scores: DataFrame, cfg: RiskConfig) -> DataFrame:
    """scores (date, portfolio, forecast_vol_ann, realized_ret, realized_vol_ann) with ewma, trailing and realized_ewma.

    The EWMAs of squares are as each week found them, as annual volatilities; NULL before enough weeks.
    """
    rows = trailing_volatility(scores, "realized_ret", "trailing", cfg).withColumn("_n", F.row_number().over(Window.partitionBy("portfolio").orderBy("date")) - 1)
    squares = {"_ewma": F.col("realized_ret") ** 2, "_realized": F.col("realized_vol_ann") ** 2 * (1.0 / cfg.weeks_per_year)}
    rows = with_ewmas(rows, "portfolio", "date", cfg.riskmetrics_decay, {n: Ewma(c, seeded=True, before=True) for n, c in squares.items()})
    annual = lambda v: F.when(F.col("_n") >= cfg.trailing_weeks, F.sqrt(cfg.weeks_per_year * F.col(v)))
    return rows.select(*scores.columns, annual("_ewma").alias("ewma"), "trailing", annual("_realized").alias("realized_ewma"))


def french_forecasts(scores: DataFrame, french: DataFrame, cfg: RiskConfig) -> DataFrame:
    """(portfolio, date, ff): rolling regressions on public factor returns, from the weeks before each.

    Forecast: betas' quadratic form in the EWMA factor covariance plus residual variance. One scan of each portfolio's weeks carries the sums
    of its regression and the factors' moments; the rows of a batch are solved at once.
    """
    factors = [c for c in french.columns if c != "date"]
    window, size, k = cfg.french_window, len(factors), cfg.riskmetrics_decay
    i, j = np.triu_indices(size)
    rows = scores.select("portfolio", "date", "realized_ret").join(french, "date").na.drop()

    def make() -> Callable:
        windowed, carried = rolling.Windowed(window, 1), {}

        def each(number: np.ndarray, x: np.ndarray, there: np.ndarray) -> list[pa.Array]:
            moments = running(np.column_stack([x[:, i] * x[:, j], np.ones(len(x))]), number == 1, k, carried.get("m"))
            found = shifted(moments, carried.get("m"))
            carried["m"] = moments[-1]
            gram = windowed(number, rolling.multiplied(x))
            out, ready = np.full(len(x), np.nan), number > window
            if ready.any():
                b, left = rolling.solved(gram[ready])
                cov = np.zeros((len(b), size, size))
                cov[:, i, j] = cov[:, j, i] = found[ready, :-1] / found[ready, -1:]
                var = np.einsum("ni,nij,nj->n", b[:, 1:], cov, b[:, 1:]) + left / max(1, window - size - 1)
                out[ready] = np.sqrt(cfg.weeks_per_year * np.maximum(var, 0))
            return [pa.array(out, mask=~ready)]

        return each

    values = {c: F.col(c) for c in (*factors, "realized_ret")}
    return scanned(rows, "portfolio", "date", values, make, {"ff": "double"}).where("ff is not null").select("portfolio", "date", "ff")


def model_stats(rows: DataFrame, by: list[str], forecast: str = "fc", ret: str = "realized_ret", realized: str = "realized_vol_ann", weeks: int = 52) -> DataFrame:
    """Bias, exceedance, volatility ratio, Mincer-Zarnowitz slope and R2, QLIKE and RMSE of each group."""
    z = F.col(ret) / (F.col(forecast) / F.sqrt(F.lit(float(weeks))))
    f2, r2 = F.col(forecast) ** 2, F.col(realized) ** 2
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.stddev_samp(z).alias("bias"), F.avg((F.abs(z) > 1.96).cast("double")).alias("exceed"), F.sqrt(F.avg(r2) / F.avg(f2)).alias("vol_ratio"),
        F.regr_slope(r2, f2).alias("mz_slope"), F.regr_r2(r2, f2).alias("mz_r2"), F.avg(F.ln(f2) + r2 / f2).alias("qlike"), F.sqrt(F.avg((F.col(forecast) - F.col(realized)) ** 2)).alias("rmse"),
    )


def harness(forecasts: DataFrame, models: list[str]) -> DataFrame:
    """(model, n, statistics...) on the rows that every model forecasts."""
    common = forecasts.na.drop(subset=[*models, "realized_ret", "realized_vol_ann"])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("fc")) for m in models])).alias("m")
    return model_stats(common.select("realized_ret", "realized_vol_ann", each).select("realized_ret", "realized_vol_ann", "m.model", "m.fc"), ["model"])


def monthly_bias(scores: DataFrame, weeks_per_year: int = 52) -> DataFrame:
    """(portfolio, month, b, rolling_bias): monthly standardised returns by the forecast standing at the month's
    start; the outer months, which may be partial, are left out; rolling deviation over 12 adjoining months."""
    own = scores.groupBy("portfolio", month(F.col("date")).alias("month")).agg((F.product(1 + F.col("realized_ret")) - 1).alias("ret"), (F.min_by("forecast_vol_ann", "date") / F.sqrt(F.lit(float(weeks_per_year)))).alias("vol"), F.count("*").alias("weeks"))
    all_of = Window.partitionBy("portfolio")
    own = own.withColumn("_a", F.min("month").over(all_of)).withColumn("_z", F.max("month").over(all_of)).where("month > _a and month < _z").drop("_a", "_z")
    own = own.withColumn("b", F.try_divide(F.col("ret"), F.col("vol") * F.sqrt("weeks")))
    w = trailing("portfolio", "month", 12)
    whole = (F.count("b").over(w) == 12) & (F.months_between("month", F.first("month").over(w)) == 11)
    return own.select("portfolio", "month", "b", F.when(whole, F.stddev_samp("b").over(w)).alias("rolling_bias"))


def rolling_protocol(scores: DataFrame, least: int = 5) -> DataFrame:
    """(n_months, n_windows, mean_bias, mrad) over all portfolios with enough months."""
    rows = monthly_bias(scores)
    enough = rows.withColumn("_n", F.count("*").over(Window.partitionBy("portfolio"))).where("_n >= 13")
    out = enough.agg(F.count_distinct("month").alias("n_months"), F.count("rolling_bias").alias("n_windows"), F.avg("rolling_bias").alias("mean_bias"), F.avg(F.abs(F.col("rolling_bias") - 1)).alias("mrad"))
    return out.where(F.col("n_windows") >= least)


def bias_bands(scores: DataFrame, least: int = 30) -> DataFrame:
    """Per portfolio its bias and whether it lies in the 95 % band 1 +- 1.96 / sqrt(2 n)."""
    own = scores.groupBy("portfolio").agg(F.count("z").alias("n"), F.stddev_samp("z").alias("bias")).where(F.col("n") >= least)
    half = 1.96 / F.sqrt(2.0 * F.col("n"))
    return own.select("portfolio", "n", "bias", (1 - half).alias("low"), (1 + half).alias("high"), (F.abs(F.col("bias") - 1) <= half).alias("inside"))


def factor_significance(t_stats: DataFrame) -> DataFrame:
    """t_stats (date, factor, t) to (factor, n, share beyond 2, mean size)."""
    return t_stats.where("t is not null").groupBy("factor").agg(F.count("*").alias("n"), F.avg((F.abs("t") > 2).cast("double")).alias("share"), F.avg(F.abs("t")).alias("mean_abs_t"))


def returns_based_exposures(factors: DataFrame, returns: DataFrame, names: list[str], cfg: RiskConfig) -> DataFrame:
    """(ticker, factor, beta, n): regressions with an intercept of each fund on the named factors over its last joint days.

    factors wide (date, names...); returns (date, ticker, r). A fund's sums over its window of returns_window days are one row.
    """
    joint = returns.join(factors, "date").na.drop()
    recent = joint.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))).where(F.col("_r") <= cfg.returns_window)
    sums = recent.groupBy("ticker").agg(F.count("*").alias("n"), rolling.gram(names, "r").alias("gram")).where(F.col("n") >= cfg.least_returns)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                b, _ = rolling.solved(rolling.stacked(pdf["gram"]))
                each = pdf.loc[pdf.index.repeat(len(names)), ["ticker", "n"]]
                yield each.assign(factor=names * len(pdf), beta=b[:, 1:].ravel())[["ticker", "factor", "beta", "n"]]

    return sums.mapInPandas(solve, "ticker string, factor string, beta double, n long")


def survivorship(facts: DataFrame, start: str, grace_days: int = 180) -> DataFrame:
    """facts (filer, filed, end, equity) to one row per filer: first and last filing, last equity, status: whether
    it ceased filing within the study window, is active, or ended before it."""
    own = facts.groupBy("filer").agg(F.min("filed").alias("first_filed"), F.max("filed").alias("last_filed"), F.max(F.when(F.col("equity").isNotNull(), F.struct("end", "filed", "equity"))).alias("at"))
    end = facts.agg(F.max("filed").alias("_end"))
    rows = own.join(F.broadcast(end), F.lit(True))
    status = F.when(F.datediff("_end", "last_filed") <= grace_days, "active").when(F.col("last_filed") >= F.lit(start).cast("date"), "ceased").otherwise("before")
    return rows.select("filer", "first_filed", "last_filed", F.col("at.equity").alias("last_equity"), status.alias("status"))


def survivorship_bound(filers: DataFrame) -> DataFrame:
    """(status, n, equity, equity_share): how much equity mass the ceased filers had."""
    own = filers.where("status <> 'before'").groupBy("status").agg(F.count("*").alias("n"), F.sum(F.greatest("last_equity", F.lit(0.0))).alias("equity"))
    return own.withColumn("equity_share", F.try_divide(F.col("equity"), F.sum("equity").over(Window.partitionBy())))
