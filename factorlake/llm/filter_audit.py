"""Filter interaction audit: what each of five filters removes, alone and in every order of all five.

A relational word pipeline: texts are exploded to words, words are counted by (document, word), these by document into
totals and distincts; the flags that need no words, the copies and the labels are joined to that, and every part of the
corpus sums up into 32 conditional counts, one for each set of failed filters. All figures of all 120 orders follow from
those 32 numbers, so no document is looked at twice.

Defined cases: a null text is an empty one; a null source and an empty one are both the part of the empty string; rows with a
null doc_id are nobody's smaller document and copy nothing; repeated rows count each, with their own words only, and don't
copy one another (their doc_ids are equal); a label table may repeat a doc_id (any row with 1 counts) or lack it (neither good
nor toxic); an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: A: least number of words. B: least share of distinct words in percent. C: greatest share of A-Z in percent. D: forbidden characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, FORBIDDEN = 200, 50, 2, "#$%&*|"
BLANKS = r"[\x20\x09-\x0D]+"
#: Number of sets of failed filters.
SETS = 1 << len(FILTERS)


def word_totals(texts: DataFrame) -> DataFrame:
    """(doc_id, k, text) to (doc_id, k, total, distinct_words). A row more, without a word, is exploded from each text: their
    number says how often a document is repeated, and keeps texts without words.

    Texts are dealt out by document before they are exploded: that is less than their words, and both counts then need no other shuffle."""
    words = texts.repartition("doc_id", "k").select("doc_id", "k", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.split("text", BLANKS))).alias("word"))
    words = words.where(~F.col("word").eqNullSafe(""))
    by_word = words.groupBy("doc_id", "k", "word").agg(F.count("*").alias("n"))
    rows = F.sum(F.when(F.col("word").isNull(), F.col("n")))
    total = F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0))
    return by_word.groupBy("doc_id", "k").agg((total / rows).cast("long").alias("total"), F.count("word").alias("distinct_words"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: part, failed (bit f is set if filter f of FILTERS fails), good, toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", F.xxhash64(text).alias("k"), text.alias("text"))
    upper = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    flags = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")).select(
        "doc_id", "part", F.xxhash64("text").alias("k"), F.sha2("text", 256).alias("digest"),
        (100 * upper > MOST_UPPER * F.length("text")).alias("c"), F.col("text").rlike(f"[{FORBIDDEN}]").alias("d"),
    )
    # The join goes by document, not by text: thousands of copies of one text meet in no task.
    firsts = flags.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("k").alias("k")).withColumn("first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )

    def same(other: DataFrame) -> Column:
        return flags["doc_id"].eqNullSafe(other["doc_id"]) & (flags["k"] == other["k"])

    totals = word_totals(texts)
    joined = flags.join(totals, same(totals), "left").join(firsts, same(firsts) & (flags["digest"] == firsts["digest"]), "left").join(known, flags["doc_id"] == known["doc_id"], "left")
    total, distinct = F.coalesce("total", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    fails = [total < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * total, F.col("c"), F.col("d"), flags["doc_id"].isNotNull() & F.col("first").isNull()]
    failed = sum((F.when(x, F.lit(1 << f)).otherwise(F.lit(0)) for f, x in enumerate(fails)), F.lit(0))
    return joined.select("part", failed.cast("int").alias("failed"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def counts(rows: DataFrame) -> DataFrame:
    """failures() to one row per part with the arrays n, good, toxic: 32 conditional counts each."""
    few = rows.groupBy("part", "failed").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    held = [F.coalesce(F.sum(F.when(F.col("failed") == m, F.col(x))), F.lit(0).cast("long")).alias(f"{x}_{m}") for x in ("n", "good", "toxic") for m in range(SETS)]
    return few.groupBy("part").agg(*held).select("part", *[F.array(*[f"{x}_{m}" for m in range(SETS)]).alias(x) for x in ("n", "good", "toxic")])


def _total(counted: str, kept_if: str, times: str = "1") -> Column:
    """Sum of an array's counts over the sets of failed filters m for which kept_if holds."""
    return F.expr(f"aggregate(sequence(0, {SETS - 1}), 0L, (a, m) -> a + if({kept_if}, {counted}[m] * {times}, 0L))")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A filter removes a document in an order if it stands first among those that the document fails; with j of them that are
    5! / j of all orders, whence shapley.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = counts(failures(docs, labels)).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = f"shiftleft(1, ascii(substr(filter_order, {{}}, 1)) - {ord(FILTERS[0])})"
    before = f"aggregate(sequence(1, step), 0, (a, i) -> a | if(i < step, {bit.format('i')}, 0))"
    rows = rows.withColumn("bit", F.expr(bit.format("step"))).withColumn("before", F.expr(before))
    here = "(m & bit) <> 0 and (m & before) = 0"
    return rows.select(
        "part", "filter_order", "step",
        _total("n", "(m & (before | bit)) = 0").alias("kept"),
        _total("n", here).alias("removed"),
        _total("n", "(m & bit) <> 0 and (m & before) <> 0").alias("redundant"),
        F.expr("n[bit]").alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
        _total("n", "(m & bit) <> 0", "cast(120 / bit_count(m) as bigint)").alias("shapley"),
    )
