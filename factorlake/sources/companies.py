"""Company registry, facts and industry codes from landed JSON files.

Ingestion lands the files (any file system Spark reads); these functions parse them in Spark.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.sources import archives

FACT = "array<struct<end:date, filed:date, val:double, fp:string, start:date>>"
FACTS = f"struct<cik:long, facts:map<string, map<string, struct<units:map<string, {FACT}>>>>>"

# For each field the taxonomy tags that may hold it, first choice first.
CONCEPTS: dict[str, list[tuple[str, str]]] = {
    "book_equity": [
        ("us-gaap", "StockholdersEquity"),
        ("us-gaap", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
        ("ifrs-full", "Equity"),
    ],
    "total_assets": [("us-gaap", "Assets"), ("ifrs-full", "Assets")],
    "total_liabilities": [("us-gaap", "Liabilities"), ("ifrs-full", "Liabilities")],
    "net_income": [("us-gaap", "NetIncomeLoss"), ("us-gaap", "ProfitLoss"), ("ifrs-full", "ProfitLoss")],
    "shares_out": [
        ("dei", "EntityCommonStockSharesOutstanding"),
        ("us-gaap", "CommonStockSharesOutstanding"),
        ("ifrs-full", "NumberOfSharesOutstanding"),
    ],
    "op_cashflow": [
        ("us-gaap", "NetCashProvidedByUsedInOperatingActivities"),
        ("us-gaap", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"),
        ("ifrs-full", "CashFlowsFromUsedInOperatingActivities"),
    ],
    "revenues": [
        ("us-gaap", "Revenues"),
        ("us-gaap", "RevenueFromContractWithCustomerExcludingAssessedTax"),
        ("us-gaap", "RevenueFromContractWithCustomerIncludingAssessedTax"),
        ("us-gaap", "SalesRevenueNet"),
        ("ifrs-full", "Revenue"),
    ],
    "gross_profit": [("us-gaap", "GrossProfit"), ("ifrs-full", "GrossProfit")],
    "cost_of_revenue": [
        ("us-gaap", "CostOfRevenue"),
        ("us-gaap", "CostOfGoodsAndServicesSold"),
        ("us-gaap", "CostOfGoodsSold"),
        ("ifrs-full", "CostOfSales"),
    ],
    "dividends_paid": [
        ("us-gaap", "PaymentsOfDividendsCommonStock"),
        ("us-gaap", "PaymentsOfDividends"),
        ("ifrs-full", "DividendsPaidClassifiedAsFinancingActivities"),
    ],
}
# The fields that are flows over a year.
FLOWS = frozenset({"net_income", "op_cashflow", "revenues", "gross_profit", "cost_of_revenue", "dividends_paid"})


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(ord, ticker, cik, title) of a registry file {"0": {"cik_str", "ticker", "title"}, ...} in file order."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, struct<cik_str:long, ticker:string, title:string>>")
    rows = raw.select(F.posexplode(F.map_entries(entries)).alias("ord", "e"))
    return rows.select(F.col("ord").cast("long").alias("ord"), F.upper("e.value.ticker").alias("ticker"), F.col("e.value.cik_str").alias("cik"), F.col("e.value.title").alias("title"))


def facts(files: DataFrame) -> DataFrame:
    """files (value: one company's facts JSON) to (cik, taxonomy, tag, unit, end, filed, val, fp, start).

    All units are kept apart; a document that doesn't parse gives no rows.
    """
    rows = files.select(F.from_json("value", FACTS).alias("f")).select("f.cik", F.explode("f.facts").alias("taxonomy", "tags"))
    rows = rows.select("cik", "taxonomy", F.explode("tags").alias("tag", "t")).select("cik", "taxonomy", "tag", F.explode("t.units").alias("unit", "rows"))
    return rows.select("cik", "taxonomy", "tag", "unit", F.inline("rows"))


def concept_series(raw: DataFrame, annual_only: bool) -> DataFrame:
    """Facts of concepts, one row per (cik, tag, end, filed); annual flows are full years of annual reports."""
    rows = raw.where("end is not null and filed is not null and val is not null")
    if annual_only:
        days = F.datediff("end", "start")
        rows = rows.where((F.col("fp") == "FY") & (days >= 300) & (days <= 400))
    # of equal (end, filed) one stays, by unit and value so that reruns agree
    return rows.groupBy("cik", "taxonomy", "tag", "end", "filed").agg(F.min(F.struct("unit", "val")).alias("at")).select("cik", "taxonomy", "tag", "end", "filed", "at.val")


def fundamentals(raw: DataFrame) -> DataFrame:
    """(asset: cik, field, end, filed, val): per field and company the first concept that has any rows."""
    from factorlake.operators.pit import first_concept

    spark = raw.sparkSession
    wanted = [(field, taxonomy, tag, p, field in FLOWS) for field, tags in CONCEPTS.items() for p, (taxonomy, tag) in enumerate(tags)]
    # a fixed list of a few dozen tags
    tags = F.broadcast(spark.createDataFrame(wanted, "field string, taxonomy string, tag string, priority int, flow boolean"))
    both = concept_series(raw, False).withColumn("annual", F.lit(False)).unionByName(concept_series(raw, True).withColumn("annual", F.lit(True)))
    rows = both.join(tags, ["taxonomy", "tag"]).where("annual = flow").withColumnRenamed("cik", "asset")
    return first_concept(rows).select("asset", "field", "end", "filed", "val")


def sic_codes(files: DataFrame) -> DataFrame:
    """files (value: a submissions JSON) to (cik, sic); codes that are no numbers are NULL."""
    return files.select(F.get_json_object("value", "$.cik").cast("long").alias("cik"), F.expr("try_cast(get_json_object(value, '$.sic') AS INT)").alias("sic"))


#: Keys that are pushed to the archive reader one by one; more are joined.
MOST_KEYS = 10_000
#: A prefetch of fewer companies than this is left to single files.
LEAST_MISSING = 200


def zipped_members(spark: SparkSession, path: str, wanted: DataFrame | None = None, prefix: str = "CIK") -> DataFrame:
    """(cik, value) of zip files whose members are named CIK + ten digits + .json; only those of `wanted` (cik) if given.

    Members are read in byte ranges, one task each; up to MOST_KEYS wanted ones are chosen before any is read.
    """
    rows = archives.members(spark, path, prefix)
    if wanted is None:
        return rows.select(F.col("key").alias("cik"), "value")
    keys = wanted.select(F.col("cik").cast("long").alias("key")).where("key is not null").distinct()
    few = [r[0] for r in keys.limit(MOST_KEYS + 1).collect()]
    rows = rows.where(F.col("key").isin(few)) if len(few) <= MOST_KEYS else rows.join(keys, "key", "left_semi")
    return rows.select(F.col("key").alias("cik"), "value")


def with_prefetch(spark: SparkSession, cached: DataFrame, path: str, wanted: DataFrame, least_missing: int = LEAST_MISSING) -> DataFrame:
    """(cik, value) of the wanted companies: what is cached, and the others from the archives at path if enough are missing.

    cached: (cik, value), landed before. The archive is opened only when at least `least_missing` companies aren't cached.
    """
    names = wanted.select("cik").distinct()
    have = cached.join(names, "cik", "left_semi").select("cik", "value")
    missing = names.join(cached, "cik", "left_anti")
    if missing.count() < least_missing:
        return have
    return have.unionByName(zipped_members(spark, path, missing))
