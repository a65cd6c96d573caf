"""Daily bars from landed files: provider formats to (ticker, date, close, volume)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions.scalar import dotless, unix_date

BARS = "ticker string, date date, close double, volume double"


def chart_json(spark: SparkSession, path: str) -> DataFrame:
    """Chart API documents: adjusted closes by unix second, parallel arrays; rows without a close are dropped."""
    schema = "chart struct<result: array<struct<meta: struct<symbol: string>, timestamp: array<long>, indicators: struct<quote: array<struct<close: array<double>, volume: array<double>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j")).select(F.explode("j.chart.result").alias("r"))
    quote = F.col("r.indicators.quote")[0]
    close = F.coalesce(F.col("r.indicators.adjclose")[0]["adjclose"], quote["close"])
    zipped = F.arrays_zip(F.col("r.timestamp").alias("t"), close.alias("c"), quote["volume"].alias("v"))
    rows = rows.select(F.col("r.meta.symbol").alias("ticker"), F.explode(zipped).alias("z"))
    return rows.select(dotless(F.col("ticker")).alias("ticker"), unix_date(F.col("z.t")).alias("date"), F.col("z.c").alias("close"), F.col("z.v").alias("volume")).where("close is not null")


def daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Files Date,Open,High,Low,Close[,Volume], one per ticker, named ticker.us.csv or ticker.csv; a missing volume is NULL."""
    raw = spark.read.csv(path, header=True)
    columns = {c.lower(): c for c in raw.columns}
    volume = F.expr(f"try_cast(`{columns['volume']}` AS DOUBLE)") if "volume" in columns else F.lit(None).cast("double")
    ticker = dotless(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(\.us)?\.csv(\.gz)?$", ""))
    return raw.select(ticker.alias("ticker"), F.try_to_date(F.col(columns["date"])).alias("date"), F.expr(f"try_cast(`{columns['close']}` AS DOUBLE)").alias("close"), volume.alias("volume")).where("date is not null and close is not null")


def adjusted_json(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of {date with time zone, adjClose, adjVolume}, one file per ticker named ticker.json."""
    schema = "date string, adjClose double, adjVolume double"
    ticker = dotless(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", ""))
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select(ticker.alias("ticker"), F.try_to_date(F.substring("date", 1, 10)).alias("date"), F.col("adjClose").alias("close"), F.col("adjVolume").alias("volume")).where("date is not null and close is not null")


def parquet_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("ticker", "date", "close", "volume")


PROVIDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"chart": chart_json, "csv": daily_csv, "adjusted": adjusted_json, "parquet": parquet_bars}


def load_panel(spark: SparkSession, path: str | list[str], provider: str, start: str, end: str, tickers: DataFrame | None = None) -> DataFrame:
    """Bars of a provider's files within dates; tickers (ticker) restricts the assets. Unknown providers are an error."""
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}; one of {', '.join(PROVIDERS)}")
    rows = PROVIDERS[provider](spark, path).where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") <= F.lit(end).cast("date")))
    return rows if tickers is None else rows.join(tickers.select("ticker").distinct(), "ticker", "left_semi")


#: Days for which fetched bars are good.
MAX_AGE_DAYS = 3.0


def cached_panel(spark: SparkSession, cache: str, source: str, provider: str, start: str, end: str, tickers: DataFrame, now: str, max_age_days: float = MAX_AGE_DAYS) -> DataFrame:
    """Bars of the tickers (ticker) within dates, by way of a cache that is read again ticker by ticker when it is too old.

    source: the provider's file of one ticker, with {ticker} in its place. The cache has a manifest of when each ticker was fetched and
    how many bars it had, and a folder per ticker; only tickers without a fresh entry have their files read, and only their folders are
    replaced. A ticker without a file is remembered as one without bars.
    """
    known = _manifest(spark, cache)
    fresh = known.where(F.col("fetched") > F.lit(now).cast("timestamp") - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {max_age_days * 86400})"))
    names = tickers.select("ticker").where("ticker is not null").distinct()
    stale = [r[0] for r in names.join(fresh, "ticker", "left_anti").orderBy("ticker").collect()]  # a name each
    files = [f for f in (source.replace("{ticker}", t) for t in stale) if _exists(spark, f)]
    if stale:
        asked = spark.createDataFrame([(t,) for t in stale], "ticker string")
        if files:
            bars = load_panel(spark, files, provider, "0001-01-01", "9999-12-31", asked)
            bars.repartition("ticker").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(f"{cache}/bars")
            counted = spark.read.parquet(f"{cache}/bars").join(F.broadcast(bars.select("ticker").distinct()), "ticker", "left_semi").groupBy("ticker").agg(F.count("*").alias("n"))
            entries = asked.join(counted, "ticker", "left").select("ticker", F.lit(now).cast("timestamp").alias("fetched"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
        else:
            entries = asked.select("ticker", F.lit(now).cast("timestamp").alias("fetched"), F.lit(0).cast("long").alias("n"))
        entries.coalesce(1).write.mode("append").parquet(f"{cache}/manifest")  # last, so that a failed run fetches again
    if not _exists(spark, f"{cache}/bars"):
        return load_panel(spark, files, provider, start, end, names.limit(0)) if files else spark.createDataFrame([], "ticker string, date date, close double, volume double")
    full = _manifest(spark, cache).where("n > 0").join(names, "ticker", "left_semi").select("ticker")
    rows = spark.read.parquet(f"{cache}/bars").join(F.broadcast(full), "ticker", "left_semi")
    return rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("ticker", "date", "close", "volume")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _manifest(spark: SparkSession, cache: str) -> DataFrame:
    """(ticker, fetched, n): each ticker's newest entry."""
    kind = "ticker string, fetched timestamp, n long"
    if not _exists(spark, f"{cache}/manifest"):
        return spark.createDataFrame([], kind)
    own = spark.read.schema(kind).parquet(f"{cache}/manifest").groupBy("ticker").agg(F.max(F.struct("fetched", "n")).alias("at"))
    return own.select("ticker", "at.fetched", "at.n")


def french_daily(spark: SparkSession, path: str) -> DataFrame:
    """The French library's daily factor CSV (its preamble and footer skipped): (date, one column per factor), as fractions."""
    names = ["mkt_rf", "smb", "hml", "rmw", "cma", "rf"]
    parts = F.split(F.trim("value"), r"\s*,\s*")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d{8}\s*,")).withColumn("p", parts)
    return rows.select(F.to_date(F.element_at("p", 1), "yyyyMMdd").alias("date"), *[(F.expr(f"try_cast(get(p, {i + 1}) AS DOUBLE)") / 100).alias(n) for i, n in enumerate(names)])


def french_weekly(daily: DataFrame) -> DataFrame:
    from factorlake.functions.scalar import friday
    from factorlake.functions.timeseries import compounded

    names = [c for c in daily.columns if c != "date"]
    return daily.groupBy(friday(F.col("date")).alias("date")).agg(*[compounded(F.col(c)).alias(c) for c in names])
