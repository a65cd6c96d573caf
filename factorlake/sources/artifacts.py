"""The model's tables on disk: a folder with one Parquet table each, and a one-row JSON of its settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = {
    "exposures": "date date, asset string, cap double, industry string, in_fit boolean",
    "factor_returns": "date date, factor string, f double",
    "covariance": "f1 string, f2 string, cov double",
    "specific": "asset string, vol double, ts_vol double, structural double, blend_weight double, n_obs long",
}
OPTIONAL = ("residuals", "t_stats", "exposure_history", "validation", "fundamentals", "industries", "asset_meta")
FORMAT = "1"


def save(tables: dict[str, DataFrame], meta: dict, spark: SparkSession, path: str) -> None:
    """All required tables, and optional ones that have rows; the settings come last, so a folder with them is whole."""
    if missing := REQUIRED.keys() - tables.keys():
        raise ValueError(f"missing tables: {', '.join(sorted(missing))}")
    for name, df in tables.items():
        if name in REQUIRED or not df.isEmpty():
            df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    text = json.dumps(meta | {"format": FORMAT}, separators=(",", ":"), default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta.json")


def meta(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/meta.json").collect()))


def load(spark: SparkSession, path: str) -> dict[str, DataFrame | None | dict]:
    """Every table of a folder; optional ones that aren't there are None, another format's folder is an error."""
    own = meta(spark, path)
    if own.get("format") != FORMAT:
        raise ValueError(f"format {own.get('format')!r} isn't {FORMAT!r}")
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda name: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.parquet"))
    out: dict = {name: spark.read.parquet(f"{path}/{name}.parquet") if name in REQUIRED or there(name) else None for name in (*REQUIRED, *OPTIONAL)}
    return out | {"meta": own}


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def compact(df: DataFrame, places: int = 4) -> DataFrame:
    """For the sink only: doubles rounded and as floats."""
    return df.select(*[F.round(c, places).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
