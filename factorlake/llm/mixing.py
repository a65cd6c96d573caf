"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Words are summed by source and leading hash bits; each source's remaining budget falls into one
bucket; only that boundary bucket is summed again on the next bits. A document is then taken by
comparing its own hash with its source's threshold, so no documents are sorted.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own,
last in order; repeated rows tie and are taken or left together; an empty table gives no rows;
sources whose texts are all empty get target 0; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.llm.shared import HASH_BITS, document_hash, mark, release, release_since, unused, written

WEIGHTS, MOST = (5, 2, 1), 3
#: Bits of each histogram; after two the boundary bucket holds about one in 2^24 of a source's documents.
LEVEL_BITS = 12
#: Tables of a row for each source are broadcast up to so many sources and bytes of their names; more are joined by shuffles.
MOST_SOURCES, MOST_SOURCE_BYTES = 100_000, 8 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), document_hash().alias("h"))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights repeat over the sources by code
    point, null last; a target stops at `most` times its source and the excess goes to the others.

    Raising all targets together by weight, the source with the least cap per weight stops first;
    so in that order the first one that need not stop fixes the level of all after it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("place", F.row_number().over(order) - 1).withColumn("w", w)
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most)).withColumn("room", F.col("cap") / F.col("w"))
    ranked = ranked.withColumn("left", F.sum("cap").over(Window.partitionBy()) / most - F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cap"))
    ranked = ranked.withColumn("level", F.col("left") / F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("first", F.min(F.when(F.col("room") > F.col("level"), F.struct("room", "place", "level"))).over(Window.partitionBy()))
    stops = F.col("first").isNull() | (F.struct("room", "place") < F.struct("first.room", "first.place"))
    return ranked.select("source", "source_size", F.round(F.when(stops, F.col("cap")).otherwise(F.col("w") * F.col("first.level")), 6).alias("target"))


def _few(by_source: DataFrame) -> bool:
    n = by_source.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("b")).first()
    return n["n"] <= MOST_SOURCES and n["b"] <= MOST_SOURCE_BYTES


def _sent(by_source: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(by_source) if few else by_source


def _boundary(histogram: DataFrame, budget: DataFrame, key: str) -> DataFrame:
    """Per source the bucket in which its budget ends, and the budget left there: (source, key, rest)."""
    run = Window.partitionBy("source").orderBy(key)
    summed = histogram.withColumn("through", F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    both = summed.join(budget.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    both = both.where(F.col("through") > F.col("rest"))
    return both.groupBy("source").agg(F.min(F.struct(F.col(key), (F.col("rest") - F.col("through") + F.col("words")).alias("rest"))).alias("at")).select("source", f"at.{key}", "at.rest")


def thresholds(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: source_size, target, whole (times every document is taken), threshold (greatest hash
    taken once more). The last document enters if that brings the sum nearer to the target. Broadcast if the sources are few."""
    before, low = mark(), HASH_BITS - LEVEL_BITS
    shift = F.shiftright("h", low)
    first = written(sizes.groupBy("source", shift.alias("b1")).agg(F.sum("size").alias("words")), "mix-histogram")
    goal = targets(first.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long"))
    goal = written(goal.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "mix-targets")
    few = _few(goal)
    at1 = written(_boundary(first, goal.select("source", "rest"), "b1"), "mix-level1")

    def inside(at: DataFrame, *keys: str) -> DataFrame:
        own = at.select(F.col("source").alias("of"), *[F.col(k).alias(f"at_{k}") for k in keys])
        rows = sizes.withColumn("b1", shift).withColumn("b2", F.shiftright("h", low - LEVEL_BITS))
        on = F.col("source").eqNullSafe(F.col("of"))
        for k in keys:
            on = on & (F.col(k) == F.col(f"at_{k}"))
        return rows.join(_sent(own, few), on)

    second = inside(at1, "b1").groupBy("source", "b2").agg(F.sum("size").alias("words"))
    at2 = written(_boundary(second, at1.select("source", "rest"), "b2"), "mix-level2")
    run = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    last = inside(at2, "b2").groupBy("source", "h").agg(F.sum("size").alias("words")).withColumn("through", F.sum("words").over(run))
    last = last.join(_sent(at2, few).select(F.col("source").alias("of"), "rest"), F.col("source").eqNullSafe(F.col("of")))
    nearer = (F.col("through") <= F.col("rest")) | ((F.col("through") - F.col("words") < F.col("rest")) & (F.col("through") - F.col("rest") < F.col("rest") - F.col("through") + F.col("words")))
    cut = last.where(nearer).groupBy("source").agg(F.max("h").alias("cut"))
    below = at2.select("source", (F.shiftleft("b2", low - LEVEL_BITS) - 1).alias("below"))
    out = goal
    for extra, name in ((cut, "cut"), (below, "below")):
        out = out.join(extra.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    # Without a boundary the budget covers all documents of the source, unless it has no words.
    threshold = F.coalesce("cut", "below", F.when(F.col("source_size") > 0, F.lit(2**HASH_BITS)).otherwise(F.lit(-1)))
    plan = written(out.select("source", "source_size", "target", "whole", threshold.cast("long").alias("threshold")), "mix-plan")
    release_since(before, plan)
    return _sent(plan, few)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken; one row per row of docs."""
    sizes = written(sized(docs), "mix-sizes")
    plan = thresholds(sizes, weights, most).withColumnRenamed("source", "of")
    copies = F.col("whole") + (F.col("h") <= F.col("threshold")).cast("long")
    out = sizes.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs."""
    size, h, of, whole, cut, copy = unused(docs, "_size", "_h", "_of", "_whole", "_cut", "_copy")
    sizes = written(sized(docs), "mix-sizes")
    plan = thresholds(sizes, weights, most)
    release(sizes)
    plan = plan.select(F.col("source").alias(of), F.col("whole").alias(whole), F.col("threshold").alias(cut))
    rows = docs.withColumn(size, word_count(F.col("text"))).withColumn(h, document_hash())
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col(of))).where(F.col(size) > 0)
    times = (F.col(whole) + (F.col(h) <= F.col(cut)).cast("long")).cast("int")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)
