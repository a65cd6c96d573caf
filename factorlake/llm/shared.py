"""Helpers that several operators use: tables, shared folders, word splitting and hashing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bits of the document hash that nested budgets and the extendible directory read from the left.
HASH_BITS = 60
#: Bytes of a batch that goes to Python at once.
BATCH_BYTES = 16 << 20
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one, but only in local mode:
    the executors of a cluster would not see the driver's folders."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='factorlake-')}")
    return spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system layer, so that it works for any scheme."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone; the folder then stays for the cluster's own clean-up
            return


atexit.register(_clean)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/factorlake-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, safe from lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def release(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once all that reads them has run."""
    for df in tables:
        path = getattr(df, "written_at", None)
        if path:
            remove(df.sparkSession, path)
            _written.remove((df.sparkSession, path))


def mark() -> int:
    """The number of tables written so far, for release_since()."""
    return len(_written)


def release_since(before: int, *kept: DataFrame) -> None:
    """Deletes all tables written since mark() gave `before`, but the kept ones. Nothing lazy may still read them."""
    stay = {getattr(df, "written_at", None) for df in kept}
    for spark, path in _written[before:]:
        if path not in stay:
            remove(spark, path)
    _written[before:] = [x for x in _written[before:] if x[1] in stay]
    drop_shuffles()


def drop_shuffles() -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so when objects are collected as garbage."""
    gc.collect()
    if spark := SparkSession.getActiveSession():
        spark.sparkContext._jvm.System.gc()


def sorted_join(df: DataFrame) -> DataFrame:
    """df as a side of a sort-merge join, also where it is small: a broadcast table is built and held by the driver, and
    where many joins follow each other their tables, threads and plans add up there."""
    return df.hint("merge")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as df's own columns make necessary."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def document_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of MD5 over the id and the text, so equal rows tie and equal ids with other texts do not."""
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def ascii_table(keep_apart: str) -> bytes:
    """A byte table for bytes.translate that lower-cases A-Z and makes a blank of each ASCII byte in keep_apart."""
    return bytes(ord(" ") if chr(b) in keep_apart and b < 128 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str | T.StructType) -> DataFrame:
    """df through Python, a batch of rows at a time. make() runs once in each task and gives the function
    from the values of one row to any number of output rows. Integers keep all bits, nulls are None. Sets the session's Arrow batch limits."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            out = [new for row in zip(*[c.to_pylist() for c in batch.columns], strict=True) for new in each(*row)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    # Texts can be long: a batch has at most so many rows and bytes (one row, where that alone is more).
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, fields)
