"""Bitemporal look-ups: `end` is when a value holds, `filed` when it became known.

Each takes all as-of dates at once. Running windows of each (asset, field) give every value the interval of days in which it is
the one known; intervals and dates then meet by calendar month, an equality that leaves few dates to compare. So rows come
to the dates they answer, and not every filing to every later date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_dates(known: DataFrame, dates: DataFrame) -> DataFrame:
    """known (..., _from, _until) at each as-of date with _from <= as_of < _until (null: no end), as rows (as_of, ...)."""
    days = dates.select(F.col("date").alias("as_of")).distinct()
    # One row: the first and the last date. Months outside of them are not made.
    ends = days.agg(F.min("as_of").alias("_first"), F.max("as_of").alias("_last"))
    rows = known.crossJoin(F.broadcast(ends)).where("_from <= _last and (_until is null or _until > _first)")
    month = lambda c: F.trunc(c.cast("date"), "month")
    months = F.sequence(month(F.greatest("_from", "_first")), month(F.coalesce(F.least("_until", "_last"), F.col("_last"))), F.expr("interval 1 month"))
    rows = rows.withColumn("_month", F.explode(months)).drop("_first", "_last")
    days = days.withColumn("_month", month(F.col("as_of")))
    # a row a date
    met = rows.join(F.broadcast(days), "_month").where("_from <= as_of and (_until is null or as_of < _until)")
    return met.select("as_of", *[c for c in known.columns if c not in ("_from", "_until")])


def _next(c: Column | str, *by: str) -> Column:
    return F.lead(c).over(Window.partitionBy(*by).orderBy("filed"))


def latest(filings: DataFrame, dates: DataFrame) -> DataFrame:
    """(as_of, asset, field, val, end, filed): of what was known, the latest end, then its latest filing."""
    each = filings.where("filed is not null").groupBy("asset", "field", "filed").agg(F.max(F.struct("end", "filed", "val")).alias("at"))
    run = Window.partitionBy("asset", "field").orderBy("filed").rowsBetween(Window.unboundedPreceding, 0)
    known = each.select("asset", "field", F.max("at").over(run).alias("at"), F.col("filed").alias("_from"), _next("filed", "asset", "field").alias("_until"))
    return at_dates(known, dates).select("as_of", "asset", "field", "at.val", "at.end", "at.filed")


def history(filings: DataFrame, dates: DataFrame, periods: int = 5) -> DataFrame:
    """(as_of, asset, field, end, val, period): the last `periods` ends known, each as last filed; period 0 is the oldest."""
    once = filings.where("filed is not null").groupBy("asset", "field", "end", "filed").agg(F.max("val").alias("val"))
    ends = once.groupBy("asset", "field", "end").agg(F.min("filed").alias("first"))
    # An end is out when `periods` later ones are known. From the last end on, only the `periods` earliest days on which later ones
    # became known are carried.
    kind = once.schema["filed"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("least"), F.array().cast(f"array<struct<end:{once.schema['end'].dataType.simpleString()},_out:{kind}>>").alias("out"))

    def step(carried: Column, e: Column) -> Column:
        least = F.slice(F.sort_array(F.concat(carried["least"], F.array(e["first"]))), F.lit(1), F.lit(periods))
        own = F.struct(e["end"].alias("end"), F.get(carried["least"], F.lit(periods - 1)).alias("_out"))
        return F.struct(least.alias("least"), F.concat(carried["out"], F.array(own)).alias("out"))

    series = ends.groupBy("asset", "field").agg(F.sort_array(F.collect_list(F.struct("end", "first")), asc=False).alias("es"))
    ends = series.select("asset", "field", F.inline(F.aggregate("es", start, step, lambda carried: carried["out"])))
    known = once.withColumn("_next", _next("filed", "asset", "field", "end")).join(ends, ["asset", "field", "end"])
    known = known.select("asset", "field", "end", "val", F.col("filed").alias("_from"), F.least("_next", "_out").alias("_until")).where("_until is null or _from < _until")
    w = Window.partitionBy("as_of", "asset", "field")
    at = at_dates(known, dates)
    return at.select("as_of", "asset", "field", "end", "val", (F.row_number().over(w.orderBy("end")) - 1).cast("int").alias("period"))


def growth(past: DataFrame, least: int = 3) -> DataFrame:
    """(as_of, asset, field, growth): slope of the values over 0, 1, ... relative to their mean size."""
    own = past.groupBy("as_of", "asset", "field").agg(F.count("val").alias("n"), F.regr_slope("val", "period").alias("slope"), F.avg(F.abs("val")).alias("size"))
    return own.select("as_of", "asset", "field", F.when((F.col("n") >= least) & (F.col("size") > 0), F.col("slope") / F.col("size")).alias("growth"))


def wide(values: DataFrame, fields: list[str]) -> DataFrame:
    """(as_of, asset, one column per field)."""
    return values.groupBy("as_of", "asset").agg(*[F.max(F.when(F.col("field") == f, F.col("val"))).alias(f) for f in fields])


def first_concept(facts: DataFrame) -> DataFrame:
    """Of several tags for one field, the first by `priority` that has any rows for the asset; tags aren't merged."""
    w = Window.partitionBy("asset", "field")
    return facts.withColumn("_p", F.min("priority").over(w)).where(F.col("priority") == F.col("_p")).drop("_p")
