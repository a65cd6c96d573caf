"""Filings as a nested store: one row per asset with a map from field to its filings, in the order in which they became known.

Every filing carries the place of the one that was the known value from then on (the latest end, then its latest filing), so that an
as-of look-up is a binary search for the date and one more step. Restatements and late periods are appended, nothing is overwritten.

Defined cases: rows without a date of filing are left out; equal rows are stored once; fields without rows and assets without fields
aren't stored; a look-up before the first filing gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of the binary search: enough for 2^20 filings of one asset's field.
STEPS = 20


def to_store(filings: DataFrame) -> DataFrame:
    """(asset, field, end, filed, val) to (asset, fields map<field, array<struct<filed, end, val, best>>>)."""
    rows = filings.where("filed is not null").select("asset", "field", "filed", "end", "val").distinct()
    order = Window.partitionBy("asset", "field").orderBy("filed", "end", "val")
    rows = rows.withColumn("n", F.row_number().over(order))
    best = F.max(F.struct("end", "filed", "val", "n")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # A group is one asset's filings of one field.
    lists = rows.withColumn("best", best["n"] - 1).groupBy("asset", "field").agg(F.sort_array(F.collect_list(F.struct("n", "filed", "end", "val", "best"))).alias("rows"))
    lists = lists.select("asset", "field", F.transform("rows", lambda r: F.struct(r["filed"].alias("filed"), r["end"].alias("end"), r["val"].alias("val"), r["best"].alias("best"))).alias("rows"))
    return lists.groupBy("asset").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "rows")))).alias("fields"))


def from_store(store: DataFrame) -> DataFrame:
    """The filings of a store, a row each."""
    return store.select("asset", F.explode("fields").alias("field", "rows")).select("asset", "field", F.inline("rows")).select("asset", "field", "end", "filed", "val")


def appended(store: DataFrame, filings: DataFrame) -> DataFrame:
    """The store with more filings: only the assets that have some are built again."""
    names = filings.where("filed is not null").select("asset").distinct()
    again = to_store(from_store(store.join(names, "asset", "left_semi")).unionByName(filings.select("asset", "field", "end", "filed", "val")))
    return store.join(names, "asset", "left_anti").unionByName(again)


def _known(rows: Column, day: Column) -> Column:
    """How many of the rows were filed by the day, by halving."""

    def step(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        by = F.element_at(rows, middle + 1)["filed"] <= day
        low = F.when((at["low"] < at["high"]) & by, middle + 1).otherwise(at["low"])
        high = F.when((at["low"] < at["high"]) & ~by, middle).otherwise(at["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS + 1)), F.struct(F.lit(0).alias("low"), F.size(rows).alias("high")), step, lambda at: at["low"])


def asof(store: DataFrame, dates: DataFrame) -> DataFrame:
    """(as_of, asset, field, val, end, filed): of what was known on each of dates (date), the latest end, then its latest filing.

    The dates asked for are one array, sent to all rows.
    """
    asked = dates.agg(F.sort_array(F.collect_set("date")).alias("_days"))
    rows = store.join(F.broadcast(asked), F.lit(True)).select("asset", "_days", F.explode("fields").alias("field", "rows"))
    rows = rows.select("asset", "field", "rows", F.explode("_days").alias("as_of"))
    rows = rows.withColumn("n", _known(F.col("rows"), F.col("as_of"))).where("n > 0")
    at = F.element_at("rows", F.element_at("rows", F.col("n"))["best"] + 1)
    return rows.select("as_of", "asset", "field", at.alias("at")).select("as_of", "asset", "field", "at.val", "at.end", "at.filed")
