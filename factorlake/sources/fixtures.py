"""The benchmark's star schema read as market data: panels, filings, holdings, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions.scalar import friday


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by quarter: (asset, date, close, volume, cap, industry)."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("asset"), F.trunc("l_shipdate", "quarter").alias("date")).agg(F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("volume"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset"), "p_retailprice", F.col("p_brand").alias("industry"))
    return line.join(part, "asset").select("asset", "date", (F.col("v") / F.col("volume")).alias("close"), "volume", (F.col("p_retailprice") * F.col("volume")).alias("cap"), "industry")


def panel_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by Friday week: (asset, date, close, volume)."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset"), friday(F.col("l_shipdate").cast("date")).alias("date")).agg(F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("volume"))
    return line.select("asset", "date", (F.col("v") / F.col("volume")).alias("close"), "volume")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as filings: (asset, field, end, filed, val)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("asset"), F.col("event_type").alias("field"), F.trunc(F.col("ts").cast("date"), "week").alias("end"), F.col("ts").alias("filed"), F.col("value").alias("val"))


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' spend as portfolios of parts: (portfolio, asset, w)."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("portfolio"))
    spend = line.join(orders, "l_orderkey").join(customer, "o_custkey").groupBy("portfolio", F.col("l_partkey").alias("asset")).agg(F.sum("l_extendedprice").alias("v"))
    total = spend.groupBy("portfolio").agg(F.sum("v").alias("t"))
    return spend.join(total, "portfolio").select("portfolio", "asset", (F.col("v") / F.col("t")).alias("w"))


def vecx(spark: SparkSession, sf_dir: str, dims: int = 10) -> DataFrame:
    """Embeddings as exposures: (asset, industry, x0, x1, ...)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("asset"), F.col("label").alias("industry"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(dims)])


def long_exposures(wide: DataFrame, names: list[str]) -> DataFrame:
    """(asset, factor, x) from one column per factor."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).cast("double").alias("x")) for n in names])).alias("p")
    return wide.select("asset", pairs).select("asset", "p.factor", "p.x")


#: The same views as DuckDB common table expressions.
DUCK = {
    "panel_q": """panel_q as (select l_partkey asset, date, v / volume as close, volume, p_retailprice * volume cap, p_brand industry from
 (select l_partkey, date_trunc('quarter', l_shipdate)::date date, sum(l_extendedprice) v, sum(l_quantity) volume from lineitem group by all) join part on p_partkey = l_partkey)""",
    "panel_w": """panel_w as (select l_suppkey asset, date, sum(l_extendedprice) / sum(l_quantity) as close, sum(l_quantity) volume from
 (select *, l_shipdate::date + ((12 - isodow(l_shipdate)) % 7)::int date from lineitem) group by all)""",
    "filings": """filings as (select user_id asset, event_type field, date_trunc('week', ts)::date "end", ts filed, value val from events)""",
    "ports": """spend as (select c_nationkey portfolio, l_partkey asset, sum(l_extendedprice) v from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all),
ports as (select portfolio, asset, v / sum(v) over (partition by portfolio) w from spend)""",
    "vecx": "vecx as (select vec_id asset, label industry, " + ", ".join(f"embedding[{i + 1}]::double x{i}" for i in range(10)) + " from embeddings)",
}
