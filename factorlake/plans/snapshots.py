"""Weekly snapshots of the model: one nested document per formation date, with what the following week brought.

Exposures, specific risk and residuals are arrays along the names, covariances and factor returns arrays along one factor axis. Documents are
written by date with dynamic partition overwrite, so that a rerun over some weeks replaces those dates only.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.config import STYLES, RiskConfig
from factorlake.operators import covariance, state
from factorlake.plans import revalidation
from factorlake.sources import artifacts


def factor_axis(returns: DataFrame) -> list[str]:
    """Market, styles, then industries by name: at most MOST_FACTORS names."""
    names = {r[0] for r in returns.select("factor").distinct().limit(covariance.MOST_FACTORS + 1).collect()}
    if len(names) > covariance.MOST_FACTORS:
        raise ValueError(f"more than {covariance.MOST_FACTORS} factors")
    first = [revalidation.MARKET, *STYLES]
    return [*first, *sorted(names - set(first))]


def _along(axis: list[str], values: Column, missing: Column) -> Column:
    """A map's values along the axis."""
    return F.transform(F.array(*[F.lit(f) for f in axis]), lambda f: F.coalesce(F.element_at(values, f), missing))


def _map(key: str, value: str | Column) -> Column:
    """Aggregate: a map of a group's rows."""
    return F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col(value) if isinstance(value, str) else value)))


def documents(own: dict, cfg: RiskConfig, keep: Callable[[DataFrame, str], DataFrame], last_weeks: int | None = None) -> DataFrame:
    """(date, names, styles, industry, spec, fcov, next): spec and fcov are annual; next has the next formation date, the week's summed
    factor returns f and, for names with a return on each of its days, resid: exposures x f + resid is their weekly return.

    own: a model folder's tables; keep writes a table that several steps read. A document holds one date's names, which are bounded by the market.
    """
    returns, residuals = own["factor_returns"], own["residuals"]
    axis = factor_axis(returns)
    weeks = keep(revalidation.formation_weeks(own, cfg, last_weeks), "weeks")
    days = keep(revalidation.days_of(returns, weeks), "days")
    weeks = weeks.join(days.select("date").distinct(), "date")
    shots = keep(own["exposure_history"].join(F.broadcast(weeks.select("date", "until")), "date").na.fill(0.0, list(STYLES)), "snapshots")

    moves = returns.withColumnRenamed("date", "day").join(F.broadcast(days), "day")
    summed = keep(moves.groupBy("date", "factor").agg(F.sum("f").alias("f")), "weekly-factors")
    weekly = revalidation.weekly_returns(shots, moves, residuals, revalidation.tradable(shots.select("date", "asset"), residuals, days))
    explained = revalidation.explained(shots, summed, ["date"]).select("date", "asset", "s")
    left = weekly.join(explained, ["date", "asset"]).select("date", "asset", F.round(F.col("r") - F.col("s"), 5).alias("resid"))

    spec = revalidation.specific_at(residuals, shots, weeks, cfg, shrunk=False)
    rows = shots.join(spec, ["date", "asset"], "left").join(left, ["date", "asset"], "left")
    one = F.struct("asset", F.array(*[F.round(F.col(s).cast("double"), 3) for s in STYLES]).alias("styles"), F.coalesce("industry", F.lit("Other")).alias("industry"), F.round(F.sqrt(F.col("var") * cfg.periods_per_year), 4).alias("spec"), "resid")
    names = rows.groupBy("date", "until").agg(F.sort_array(F.collect_list(one)).alias("n"))

    regime = keep(revalidation.multipliers_at(state.vra_factor(returns, cfg), weeks), "regime")
    cov = covariance.covariances_at(returns, weeks, cfg, regime, keep)
    zero = F.lit(0.0)
    cov = cov.groupBy("date", "f1").agg(_along(axis, _map("f2", F.round(F.col("cov") * cfg.periods_per_year, 8)), zero).alias("row"))
    cov = cov.groupBy("date").agg(_along(axis, _map("f1", "row"), F.array(*[zero] * len(axis))).alias("fcov"))
    f = summed.groupBy("date").agg(_along(axis, _map("factor", F.round("f", 6)), zero).alias("f"))
    out = names.join(cov, "date").join(f, "date")
    following = F.struct(F.col("until").alias("date"), "f", F.col("n.resid").alias("resid")).alias("next")
    return out.select("date", F.col("n.asset").alias("names"), F.col("n.styles").alias("styles"), F.col("n.industry").alias("industry"), F.col("n.spec").alias("spec"), "fcov", following)


def write(own: dict, cfg: RiskConfig, to: str, last_weeks: int | None = None) -> int:
    """Documents as JSON under to/date=..., and an index of all dates there with the axes; returns the number of dates in the index.

    Only the weeks of this run are replaced.
    """
    spark = own["factor_returns"].sparkSession
    work = f"{to}-work"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    docs = documents(own, cfg, keep, last_weeks)
    # A file per date: its document is one row.
    docs.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").json(to)
    artifacts.remove(spark, work)
    dates = [str(r[0]) for r in spark.read.schema("date date").json(to).select("date").distinct().orderBy("date").collect()]
    index = json.dumps({"dates": dates, "factors": factor_axis(own["factor_returns"]), "style_factors": list(STYLES)}, separators=(",", ":"))
    spark.createDataFrame([(index,)], "value string").coalesce(1).write.mode("overwrite").text(f"{to}-index")
    return len(dates)


def read(spark, to: str) -> DataFrame:
    names = "array<string>"
    return spark.read.schema(f"date date, names {names}, styles array<array<double>>, industry {names}, spec array<double>, fcov array<array<double>>, next struct<date: date, f: array<double>, resid: array<double>>").json(to)


def exploded(docs: DataFrame) -> DataFrame:
    """(date, asset, industry, styles, spec, resid, next_date): the names of each document as rows."""
    each = F.explode(F.arrays_zip("names", "industry", "styles", "spec", F.col("next.resid").alias("resid"))).alias("n")
    return docs.select("date", F.col("next.date").alias("next_date"), each).select("date", F.col("n.names").alias("asset"), "n.industry", "n.styles", "n.spec", "n.resid", "next_date")
