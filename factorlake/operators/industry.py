"""Industries from SIC codes: ranges in declared order, the first that matches wins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OTHER, CODES = "Other", 10_000


def parse_ranges(text: str) -> list[tuple[str, int, int]]:
    """(industry, low, high) of a range file: a numbered line names an industry, indented lines give its ranges.

    That is the public format of the French data library, e.g. ` 1 Food   Food Products` over `   0100-0199 Agriculture`.
    """
    out, name = [], OTHER
    for line in text.splitlines():
        if m := re.match(r"\s*\d+\s+([A-Za-z]\w*)\b", line):
            name = m[1]
        elif m := re.match(r"\s*(\d{3,4})\s*-\s*(\d{3,4})", line):
            out.append((name, int(m[1]), int(m[2])))
    return out


def code_table(spark: SparkSession, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """(sic, industry), one row per four-digit code that any range has: at most CODES rows, so a look-up is a hash join."""
    of: dict[int, str] = {}
    for name, low, high in ranges:
        for code in range(max(low, 0), min(high, CODES - 1) + 1):
            of.setdefault(code, name)
    return spark.createDataFrame(sorted(of.items()), "sic int, industry string")


def classify(assets: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds industry; a missing or unknown code is Other. codes has at most CODES rows, so it is broadcast."""
    return assets.join(F.broadcast(codes), "sic", "left").withColumn("industry", F.coalesce("industry", F.lit(OTHER)))


def latest_industry(new: DataFrame, prior: DataFrame) -> DataFrame:
    """(asset, industry): new classifications win over prior ones."""
    both = new.select("asset", F.col("industry").alias("_new")).join(prior.select("asset", F.col("industry").alias("_prior")), "asset", "full")
    return both.select("asset", F.coalesce("_new", "_prior").alias("industry"))
