"""The batch semantics as streams: weekly buckets, upserts by micro-batch, keyed running state, replay.

A stream over landed files with the availableNow trigger replays history; the same code follows new files.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factorlake.functions.timeseries import last_distinct
from factorlake.sources import artifacts


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share; a temporary one only where that is unset in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named}/factorlake-stream-{spark.sql('select uuid()').first()[0]}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='factorlake-stream-')}"


def events(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """(asset, field, ts, val) of a table's files as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).select(F.col("user_id").alias("asset"), F.col("event_type").alias("field"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("val"))


def weekly(stream: DataFrame, late: str = "10 days") -> DataFrame:
    """(week, field, n, total) by Friday weeks; rows later than the watermark allows are left out."""
    # epoch day 0 was a Thursday, so weeks that end on Fridays begin two days later
    window = F.window("ts", "7 days", startTime="2 days")
    own = stream.withWatermark("ts", late).groupBy(window, "field").agg(F.count("*").alias("n"), F.sum("val").alias("total"))
    return own.select(F.date_sub(F.col("window.end").cast("date"), 1).alias("week"), "field", "n", "total")


def running_variance(stream: DataFrame, k: float) -> DataFrame:
    """(asset, n, var): each asset's EWMA of squares, seeded by its first value, carried from batch to batch.

    State is three numbers a key. A key's rows of one micro-batch are held together to fold them in time order: what a
    trigger reads bounds them (files_per_batch). Rows that come in a later micro-batch are folded when they come.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, var = state.get if state.exists else (0, 0.0)
        for v in pd.concat(list(frames)).sort_values(["ts", "val"])["val"]:
            var = v * v if n == 0 else k * var + (1 - k) * v * v
            n += 1
        state.update((n, var))
        yield pd.DataFrame({"asset": [key[0]], "n": [n], "var": [var]})

    return stream.groupBy("asset").applyInPandasWithState(fold, "asset long, n long, var double", "n long, var double", "update", GroupStateTimeout.NoTimeout)


#: The state store that keeps each key's pending rows apart from its other state.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: A pending row and a key's state (none: the key is null), and how many of them are one entry of a list.
_PENDING = np.dtype([("none", "?"), ("asset", "<i8"), ("ts", "<i8"), ("val", "<f8")])
_FOLDED = np.dtype([("none", "?"), ("asset", "<i8"), ("n", "<i8"), ("var", "<f8")])
ENTRY_ROWS = 4096
#: Keys are folded by buckets: a call and its steps to the state store cost far more than the few rows of a key.
KEY_BUCKETS = 1024


def _entries(rows: np.ndarray) -> list[tuple]:
    return [(rows[a : a + ENTRY_ROWS].tobytes(),) for a in range(0, len(rows), ENTRY_ROWS)]


def _packed(state, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(r[0], kind) for r in state.get()]])


class OrderedVariance(StatefulProcessor):
    """Folds each key's rows in event time: a bucket's rows wait in a list until the watermark has passed them; a timer stands at the earliest one."""

    def __init__(self, k: float) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getListState("folded", "rows binary")
        self.pending = handle.getListState("pending", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        for pdf in rows:
            own = np.empty(len(pdf), _PENDING)
            own["none"], own["asset"] = pdf["none"], pdf["asset"]
            own["ts"], own["val"] = pdf["ts"].to_numpy("datetime64[us]").astype("int64"), pdf["val"].to_numpy(float, na_value=np.nan)
            own = own[(own["ts"] >= passed) & pdf["val"].notna().to_numpy()]
            if len(own):
                self.pending.appendList(_entries(own))
                first = own["ts"].min() if first is None else min(own["ts"].min(), first)
        if first is not None:
            standing = list(self.handle.listTimers())
            if not standing or first // 1000 < min(standing):
                for timer in standing:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(int(first // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, rows = timerValues.getCurrentWatermarkInMs(), _packed(self.pending, _PENDING)
        passed = rows["ts"] < now * 1000
        ready, rest = rows[passed], rows[~passed]
        if len(rest):
            self.pending.put(_entries(rest))
            self.handle.registerTimer(max(int(rest["ts"].min() // 1000), now + 1))
        else:
            self.pending.clear()
        if len(ready):
            ready = ready[np.lexsort([ready[c] for c in ("val", "ts", "asset", "none")])]
            state = {(none, asset): (n, var) for none, asset, n, var in _packed(self.folded, _FOLDED).tolist()}
            changed = {}
            for none, asset, _, v in ready.tolist():
                n, var = changed.get((none, asset)) or state.get((none, asset), (0, 0.0))
                changed[none, asset] = n + 1, v * v if n == 0 else self.k * var + (1 - self.k) * v * v
            self.folded.put(_entries(np.array([(*at, *own) for at, own in (state | changed).items()], _FOLDED)))
            new = np.array([(*at, *own) for at, own in changed.items()], _FOLDED)
            yield pd.DataFrame({"asset": pd.arrays.IntegerArray(new["asset"].copy(), new["none"].copy()), "n": new["n"], "var": new["var"]})

    def close(self) -> None:
        pass


def variance_in_order(stream: DataFrame, k: float, late: str = "1 day") -> DataFrame:
    """(asset, n, var): running_variance() over rows in the order of their time, whatever order they come in, up to `late`.

    A row counts once the watermark has passed it; one that comes after that is left out, as is a null value. What waits is what came
    within `late` of the newest row. Sets the session's state store to RocksDB.
    State is kept by KEY_BUCKETS buckets of keys: a call holds the pending rows and the states of one.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.select(F.col("asset").isNull().alias("none"), F.coalesce(F.col("asset").cast("long"), F.lit(0)).alias("asset"), "ts", F.col("val").cast("double").alias("val")).withWatermark("ts", late)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("asset"), F.lit(KEY_BUCKETS))).groupBy("bucket")
    return rows.transformWithStateInPandas(OrderedVariance(k), "asset long, n long, var double", "Update", "EventTime")


# -- upserts as deltas ----------------------------------------------------------------------------------

#: Buckets of a table's keys, and micro-batches between two compactions.
BUCKETS, COMPACT_EVERY = 16, 32


def _manifest(spark: SparkSession, path: str) -> dict:
    """{"through": last batch in the base, "base": {bucket: version}}: the newest of path/manifest, one small file for each compaction."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return {"through": -1, "base": {}}
    newest = spark.read.schema("value string, version long").text(f"{path}/manifest").orderBy(F.col("version").desc()).first()
    return json.loads(newest["value"])


def _bucket(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def _rows(spark: SparkSession, path: str, key: list[str], state: dict, through: int | None = None) -> DataFrame:
    """Base and deltas together: of each key the rows of its newest batch."""
    delta = spark.read.parquet(f"{path}/delta").where(F.col("_batch") > state["through"])
    if through is not None:
        delta = delta.where(F.col("_batch") <= through)
    newest = delta.groupBy("_bucket", *key).agg(F.max("_batch").alias("_newest"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    out = delta.alias("d").join(newest.alias("n"), [F.col("d._bucket") == F.col("n._bucket"), F.col("_batch") == F.col("_newest"), *same], "left_semi").drop("_batch")
    for version in sorted(set(state["base"].values())):
        own = [int(b) for b, v in state["base"].items() if v == version]
        base = spark.read.parquet(f"{path}/base/v{version}").where(F.col("_bucket").isin(own))
        base = base.alias("d").join(newest.alias("n"), [F.col("d._bucket") == F.col("n._bucket"), *same], "left_anti")
        out = out.unionByName(base, allowMissingColumns=True)
    return out


def current(spark: SparkSession, path: str, key: list[str], cap: int | None = None, day: str = "date") -> DataFrame:
    """The table that upserted() keeps, as it stands; of its last `cap` days if given."""
    out = _rows(spark, path, key, _manifest(spark, path)).drop("_bucket")
    return out if cap is None else last_distinct(out, day, cap)


def compact(spark: SparkSession, path: str, key: list[str], through: int) -> None:
    """Writes new base files for the buckets that have had deltas up to batch `through`, then the manifest that names them.

    A repetition writes the same files. Deltas and base files that the manifest before still named stay until the next compaction.
    """
    state = _manifest(spark, path)
    if state["through"] >= through:
        return
    delta = spark.read.parquet(f"{path}/delta").where((F.col("_batch") > state["through"]) & (F.col("_batch") <= through))
    touched = [r[0] for r in delta.select("_bucket").distinct().collect()]  # BUCKETS at most
    rows = _rows(spark, path, key, state, through).where(F.col("_bucket").isin(touched))
    rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/base/v{through}")
    after = {"through": through, "base": state["base"] | {str(b): through for b in touched}}
    text = spark.createDataFrame([(json.dumps(after),)], "value string").coalesce(1)
    text.write.mode("overwrite").text(f"{path}/manifest/version={through}")
    for r in spark.read.parquet(f"{path}/delta").where(F.col("_batch") <= state["through"]).select("_batch").distinct().collect():
        artifacts.remove(spark, f"{path}/delta/_batch={r[0]}")
    for version in set(state["base"].values()) - set(after["base"].values()):
        if version < state["through"]:
            artifacts.remove(spark, f"{path}/base/v{version}")


def upserted(stream: DataFrame, path: str, key: list[str], compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keeps a table at path current: each micro-batch replaces the rows of its keys. Read it with current().

    A batch writes its own rows alone, by bucket of their key; every compact_every batches the buckets touched since are merged. A
    repeated batch writes its own folder again, and a repeated compaction its own version, so retries change nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("_bucket", _bucket(key)).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/delta/_batch={number}")
        if number % compact_every == compact_every - 1:
            compact(spark, path, key, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def replay(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Runs a stream over all files there are, to a Parquet table, and returns that table with its batch number."""

    def write(batch: DataFrame, number: int) -> None:
        each(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/part={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out").drop("part")


def latest_per_key(rows: DataFrame, key: str) -> DataFrame:
    """Of an update-mode output each key's last row."""
    cols = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max(F.struct("batch", *cols)).alias("at")).select(key, *[f"at.{c}" for c in cols])

