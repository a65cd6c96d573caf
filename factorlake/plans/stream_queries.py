"""Streams over the sample tables, replayed to their end; batch SQL gives the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorlake.config import decay
from factorlake.functions.scalar import rounded
from factorlake.streaming import state_stream as ss

HALF_LIFE = 10.0
_K = f"{decay(HALF_LIFE)!r}::double"


def stream_state(spark, sf_dir):
    path = ss.work_folder(spark)
    out = ss.latest_per_key(ss.replay(ss.running_variance(ss.events(spark, sf_dir), decay(HALF_LIFE)), path, "update"), "asset")
    return out.select("asset", "n", rounded(F.col("var"), 4).alias("var"))


def stream_week_bucket(spark, sf_dir):
    path = ss.work_folder(spark)
    rows = ss.replay(ss.weekly(ss.events(spark, sf_dir)), path, "complete")
    last = rows.agg(F.max("batch").alias("_b"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("_b")).select("week", "field", "n", rounded(F.col("total"), 4).alias("total"))


def stream_state_ordered(spark, sf_dir):
    """Rows within a day of the newest still wait."""
    out = ss.latest_per_key(ss.replay(ss.variance_in_order(ss.events(spark, sf_dir), decay(HALF_LIFE), "1 day"), ss.work_folder(spark), "update"), "asset")
    return out.select("asset", "n", rounded(F.col("var"), 4).alias("var"))


def stream_upserts(spark, sf_dir):
    """Events upserted by asset and field, read back from base and deltas: the rows of the last batch that has a key."""
    path = ss.work_folder(spark)
    ss.upserted(ss.events(spark, sf_dir), path, ["asset", "field"], 1).awaitTermination()
    rows = ss.current(spark, path, ["asset", "field"])
    return rows.groupBy("asset", "field").agg(F.count("*").alias("n"), rounded(F.sum("val"), 4).alias("total"))


QUERIES = {f.__name__: f for f in (stream_state, stream_week_bucket, stream_state_ordered, stream_upserts)}
ORACLES = {
    "stream_state_ordered": f"""with e as (select user_id asset, ts, value from events where epoch_us(ts) < (select (epoch_us(max(ts)) - 86400000000) // 1000 * 1000 from events)),
i as (select *, row_number() over (partition by asset order by ts, value) i, count(*) over (partition by asset) n from e)
select asset, max(n) n, round(sum(case when i = 1 then 1 else 1 - {_K} end * value ** 2 * {_K} ** (n - i)), 4) var from i group by asset""",
    "stream_upserts": "select user_id asset, event_type field, count(*) n, round(sum(value), 4) + 0.0 total from events group by all",
    "stream_state": f"""with i as (select user_id asset, value, row_number() over (partition by user_id order by ts, value) i, count(*) over (partition by user_id) n from events)
select asset, max(n) n, round(sum(case when i = 1 then 1 else 1 - {_K} end * value ** 2 * {_K} ** (n - i)), 4) var from i group by asset""",
    "stream_week_bucket": "select ts::date + ((12 - isodow(ts)) % 7)::int as week, event_type field, count(*) n, round(sum(value), 4) total from events group by all",
}
