"""Sharding by extendible hashing.

A directory over the leading bits of each document's hash. A bucket that exceeds the byte limit splits
on one more bit; others keep their depth. Bytes are first summed for fine prefixes; the sums of all
shorter prefixes follow from those, and a bucket's depth is the least at which its sum fits. Only
prefixes that are still too large at the fine depth are summed again on more bits.

Defined cases: a null text has 0 bytes; rows equal in id and text share all hash bits, so when these
alone exceed the limit they fill numbered overflow pages; a single document over the limit has a page of
its own, marked oversize; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorlake.llm.shared import HASH_BITS, document_hash, mark, release, release_since, unused, written

#: Bytes of text in a shard.
LIMIT = 16 << 20
#: Bits summed beyond the depth at which equal buckets would fit.
SPARE_BITS = 4
#: Rows for which the sums of all further depths are made at once, some 60 of each.
MOST_OPEN = 1_000_000


def _directory(rows: DataFrame, done: int, depth: int, limit: int) -> DataFrame:
    """For each prefix of `depth` bits: the least depth over `done` at which its bucket fits (null: none), and that bucket's bytes and rows."""
    fine = written(rows.groupBy(F.shiftright("h", HASH_BITS - depth).alias("fine")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "shard-fine")
    steps = F.explode(F.sequence(F.lit(done), F.lit(depth))).alias("d")
    sums = fine.select("fine", "b", "n", steps).withColumn("p", F.expr(f"shiftright(fine, {depth} - d)"))
    sums = sums.groupBy("d", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = written(sums.where(F.col("shard_bytes") <= limit), "shard-sums")
    own = fine.select("fine", steps).withColumn("p", F.expr(f"shiftright(fine, {depth} - d)"))
    best = own.join(fits, ["d", "p"]).groupBy("fine").agg(F.min(F.struct("d", "p", "shard_bytes", "shard_docs")).alias("at"))
    return fine.select("fine").join(best, "fine", "left")


def _directories(rows: DataFrame, limit: int) -> tuple[list[tuple[int, DataFrame]], bool]:
    """rows (h, n_bytes), written, to tables (fine, at), each with its depth in bits, that place all rows whose bucket can fit;
    and whether rows are left over, which share all bits. A prefix that is placed in one table is in no other."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    done, open_rows, found = 0, rows, []
    while True:
        before = mark()
        at = written(_directory(open_rows, done, depth, limit), "shard-directory")
        release_since(before, at)
        found.append((depth, at.where("at is not null")))
        placed = at.where("at is null").isEmpty()
        if placed or depth == HASH_BITS:
            if open_rows is not rows:
                release(open_rows)
            return found, not placed
        rest = open_rows.join(at.where("at is null").select("fine"), F.shiftright("h", HASH_BITS - depth) == F.col("fine"), "left_semi")
        rest = written(rest, "shard-open")
        # Around a single row over the limit no bucket fits until it stands alone: few rows, for which all depths are summed at once.
        few = rest.count() <= MOST_OPEN
        if open_rows is not rows:
            release(open_rows)
        open_rows = rest
        done, depth = depth + 1, HASH_BITS if few else min(HASH_BITS, depth + 2 * SPARE_BITS)


def _placed(rows: DataFrame, directories: list[tuple[int, DataFrame]], left_over: bool, limit: int, h: str, n_bytes: str) -> DataFrame:
    """rows with shard, shard_depth, shard_bytes, shard_docs and oversize."""
    own = [c for c in rows.columns if c != h]
    fine, at, *ats = unused(rows, "_fine", "_at", *[f"_at{k}" for k in range(len(directories))])
    for (depth, table), name in zip(directories, ats, strict=True):
        rows = rows.join(table.select(F.col("fine").alias(fine), F.col("at").alias(name)), F.shiftright(h, HASH_BITS - depth) == F.col(fine), "left").drop(fine)
    rows = rows.withColumn(at, F.coalesce(*ats)).drop(*ats)
    bits = F.when(F.col(f"{at}.d") == 0, F.lit("")).otherwise(F.expr(f"lpad(bin(`{at}`.p), `{at}`.d, '0')"))
    made = [F.concat(F.lit("s"), bits).alias("shard"), F.col(f"{at}.d").cast("int").alias("shard_depth"), F.col(f"{at}.shard_bytes"), F.col(f"{at}.shard_docs"), F.lit(False).alias("oversize")]
    out = rows.where(F.col(at).isNotNull()).select(*own, *made)
    return out.unionByName(_overflow(rows.where(F.col(at).isNull()).drop(at), limit, own, h, n_bytes)) if left_over else out


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, shard, shard_depth, shard_bytes, shard_docs, oversize."""
    rows = written(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), document_hash().alias("h")), "shard-sizes")
    return _placed(rows, *_directories(rows, limit), limit, "h", "n_bytes")


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Writes docs with all their columns as Parquet under path, in a folder shard=... for each shard, and returns the table read back.
    A column of docs that is named shard gives way."""
    docs = docs.drop("shard")
    size, h = unused(docs, "_size", "_h")
    before, n_bytes = mark(), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sizes = written(docs.select(n_bytes.alias("n_bytes"), document_hash().alias("h")), "shard-sizes")
    found, left_over = _directories(sizes, limit)
    release(sizes)
    rows = _placed(docs.withColumn(size, n_bytes).withColumn(h, document_hash()), found, left_over, limit, h, size)
    # A shard has at most `limit` bytes (or one document), so it is a small part of a task.
    rows.select(*docs.columns, "shard").repartition("shard").write.partitionBy("shard").parquet(path)
    release_since(before)
    return docs.sparkSession.read.schema(T.StructType([*docs.schema.fields, T.StructField("shard", T.StringType())])).parquet(path)


def shards(written_docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of assign() from what write() wrote: each document with its shard and that shard's bytes and rows."""
    rows = written_docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard")
    sums = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    depth = F.length(F.split_part("shard", F.lit("."), F.lit(1))) - 1
    return rows.join(sums, "shard").select("doc_id", "n_bytes", "shard", depth.cast("int").alias("shard_depth"), "shard_bytes", "shard_docs", (F.col("n_bytes") > limit).alias("oversize"))


def _overflow(rows: DataFrame, limit: int, own: list[str], h: str, n_bytes: str) -> DataFrame:
    """Pages of rows that share all bits: as many of the equal rows to a page as fit, one at least.

    The rows of a group are equal, so any numbering gives the same table: here each partition's rows follow those of the
    partitions before, so that no task sees a whole group.
    """
    at, part, n, first, page = unused(rows, "_row", "_part", "_n", "_first", "_page")
    rows = written(rows.withColumn(at, F.monotonically_increasing_id()), "shard-overflow").withColumn(part, F.shiftright(at, 33))
    parts = rows.groupBy(h, part).agg(F.count("*").alias(n))
    firsts = parts.withColumn(first, F.sum(n).over(Window.partitionBy(h).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n))
    per_page = F.greatest(F.floor(F.lit(limit) / F.greatest(n_bytes, F.lit(1))), F.lit(1)).cast("long")
    number = F.row_number().over(Window.partitionBy(h, part).orderBy(at)) - 1 + F.col(first)
    paged = rows.join(firsts.drop(n), [h, part]).withColumn(page, F.floor(number / per_page).cast("long"))
    sums = paged.groupBy(h, page).agg(F.sum(n_bytes).alias("shard_bytes"), F.count("*").alias("shard_docs"))
    shard = F.concat(F.lit("s"), F.expr(f"lpad(bin(`{h}`), {HASH_BITS}, '0')"), F.lit("."), F.col(page).cast("string"))
    return paged.join(sums, [h, page]).select(*own, shard.alias("shard"), F.lit(HASH_BITS).alias("shard_depth"), "shard_bytes", "shard_docs", (F.col(n_bytes) > limit).alias("oversize"))
