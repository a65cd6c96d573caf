"""History kept between runs: upserts, caps, imputed delisting returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.config import RiskConfig
from factorlake.functions.timeseries import last_distinct


def upsert(prior: DataFrame, new: DataFrame, key: list[str], cap: int | None = None, day: str = "date") -> DataFrame:
    """Prior rows whose key isn't in new, and all new rows; columns are united; the last `cap` days stay."""
    old = prior.join(new.select(*key).distinct(), key, "left_anti")
    both = old.unionByName(new, allowMissingColumns=True)
    return both if cap is None else last_distinct(both, day, cap)


def delisting_value(price: Column, cfg: RiskConfig) -> Column:
    """Return imputed after an asset's last trade: a loss at low prices, else nothing."""
    return F.when(price < cfg.delist_price, F.lit(cfg.delist_return)).otherwise(F.lit(0.0))


def delisting_returns(prices: DataFrame, weeks: DataFrame, cfg: RiskConfig) -> DataFrame:
    """(asset, date, r): for assets that stop trading before the panel's last week, the imputed return on the first
    day of the week after their last one. weeks (date, week) maps each day of the calendar to its week."""
    last = prices.where("close is not null").groupBy("asset").agg(F.max("date").alias("_d"), F.max_by("close", "date").alias("_p"))
    firsts = weeks.groupBy("week").agg(F.min("date").alias("first_day"))
    following = firsts.withColumn("next_day", F.lead("first_day").over(Window.orderBy("week"))).where("next_day is not null")
    rows = last.join(weeks, F.col("_d") == weeks["date"]).join(following, "week")
    return rows.select("asset", F.col("next_day").alias("date"), delisting_value(F.col("_p"), cfg).alias("r"))
