"""Which assets take part: candidates, estimation pool, liquidity and coverage screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlake.config import RiskConfig
from factorlake.functions.scalar import is_ticker


def candidates(registry: DataFrame, most: int | None = None) -> DataFrame:
    """Well-formed tickers, the first listed of each filer, in registry order (`ord`)."""
    first = registry.where(is_ticker(F.col("ticker"))).groupBy("cik").agg(F.min(F.struct("ord", "ticker", "title")).alias("at")).select("at.ord", "at.ticker", "cik", "at.title")
    return first.orderBy("ord").limit(most) if most else first


def estimation_pool(names: DataFrame, size: int) -> DataFrame:
    """The first `size` of names (ord, ...) in registry order; 0 keeps all. A wider coverage leaves the estimation as it is."""
    return names.orderBy("ord").limit(size) if size else names


def liquidity_screen(prices: DataFrame, cfg: RiskConfig) -> DataFrame:
    """(asset, last_date, last_price, n_obs, dollar_volume, passes) at each asset's own last trade."""
    traded = prices.where("close is not null")
    recent = F.row_number().over(Window.partitionBy("asset").orderBy(F.col("date").desc()))
    value = F.when(recent <= cfg.volume_rows, F.col("close") * F.col("volume"))
    own = traded.withColumn("_v", value).groupBy("asset").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_price"), F.count("*").alias("n_obs"), F.median("_v").alias("dollar_volume"))
    passes = (F.col("last_price") >= cfg.least_price) & (F.col("n_obs") >= cfg.least_history_rows) & (F.col("dollar_volume") >= cfg.least_dollar_volume)
    return own.withColumn("passes", F.coalesce(passes, F.lit(False)))


def coverage_screen(prices: DataFrame, cfg: RiskConfig) -> DataFrame:
    """(asset, last_date, last_price, covered): traded near the panel's end at a price that isn't negligible."""
    end = prices.agg(F.max("date").alias("panel_end"))
    own = prices.where("close is not null").groupBy("asset").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_price"))
    # the panel's end is one row
    joined = own.join(F.broadcast(end), F.lit(True))
    covered = (F.col("last_price") >= cfg.coverage_price) & (F.datediff("panel_end", "last_date") <= cfg.coverage_stale_days)
    return joined.select("asset", "last_date", "last_price", covered.alias("covered"))
