"""I-Match fingerprints (DataFrame functions only): terms within a band of inverse document frequency, distinct and sorted,
hashed for several randomised subsets of the lexicon.

Level j cuts the lexicon at random into 2^j subsets, of which the first SUBSETS are used; a text with m distinct terms is hashed
on the levels from ceil(log2 m) on, LEVELS of them, so that short and long texts alike have about one term in a subset. Only the terms of
those subsets are looked up in the lexicon, some dozens for a text of any length. Two fingerprints are compared on the
coarsest level that both have: the share of equal hashes among those of non-empty subsets, 2 e / (a + b).

Each text is followed by the next one in descending doc_id. Texts are dealt out by ranges of doc_id, a window in each range
looks ahead by one, and the last text of a range takes the first one of the next range; no task sees all of them.

Defined cases: a null text is an empty one; null doc_ids come last, ties are ordered by their text; the only row of a table is its own next
one; a text without a looked-up term in the band is hashed by all of those terms, and one without terms has the hash of its text as its only
entry; equal fingerprints have likeness 1; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.llm.shared import release, written

#: A term belongs to the band if at least LEAST_DOCS documents and at most this share of them have it.
LEAST_DOCS, MOST_SHARE = 2, 0.02
SUBSETS, LEVELS = 64, 4
#: The terms above the band are at most (mean distinct terms of a document) / MOST_SHARE; they are broadcast up to so many.
MOST_FREQUENT = 1_000_000
#: Ranges of doc_id per shuffle partition, and ranges at most.
RANGES, MOST_RANGES = 4, 4_096
#: Bits of a row's number within its range.
ROW_BITS = 40


def distinct_terms(text: Column) -> Column:
    """Distinct words (runs of letters and digits, lower case) as 64-bit hashes."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): how many documents have the term."""
    return docs.select(F.explode(distinct_terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


# -- next documents -------------------------------------------------------------------------------------


def _range_of(bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most doc_id, found in two steps; one less than none for a null, so that nulls are
    the lowest range."""
    if not bounds:
        return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0))
    step = math.isqrt(len(bounds)) or 1
    coarse, doc = F.array(*[F.lit(b) for b in bounds[::step]]), F.col("doc_id")
    steps = F.size(F.filter(coarse, lambda b: b <= doc))
    block = F.slice(F.array(*[F.lit(b) for b in bounds]), F.greatest(steps - 1, F.lit(0)) * step + 1, step)
    fine = F.greatest(steps - 1, F.lit(0)) * step + F.size(F.filter(block, lambda b: b <= doc))
    return F.when(doc.isNull(), F.lit(-1)).otherwise(fine)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (at, next_at, doc_id, text, next_text): `at` numbers the rows, next_at is the number of the next one."""
    spark = docs.sparkSession
    parts = min(MOST_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []
    bounds = sorted(set(found))
    rows = docs.withColumn("range", _range_of(bounds))
    # One row per range, MOST_RANGES at most: the range that comes after each in descending order, the highest after the lowest.
    full = sorted((r["range"] for r in rows.select("range").distinct().collect()), reverse=True)
    follows = dict(zip(full, full[1:] + full[:1], strict=True))
    within = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    heads = rows.groupBy("range").agg(F.max("doc_id").alias("head"))
    own = heads.select(F.col("range").alias("of"), "head")
    first = rows.join(F.broadcast(own), (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("range").agg(F.min("text").alias("head_text"))
    before = {after: r for r, after in follows.items()}
    if before:
        mapped = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range"))
        first = first.select(mapped.alias("for"), F.col("range").alias("next_range"), "head_text")
    else:
        first = first.select(F.col("range").alias("for"), F.col("range").alias("next_range"), "head_text")
    number = F.row_number().over(within).cast("long")
    rows = rows.withColumn("row", number).withColumn("ahead", F.lead("text").over(within))
    rows = rows.join(first, (F.col("range") == F.col("for")) & F.col("ahead").isNull(), "left")

    def place(of: str, row: Column) -> Column:
        return F.shiftleft(F.col(of).cast("long") + 1, ROW_BITS) + row

    next_at = F.when(F.col("ahead").isNull(), place("next_range", F.lit(1))).otherwise(place("range", F.col("row") + 1))
    return rows.select(place("range", F.col("row")).alias("at"), next_at.alias("next_at"), "doc_id", "text", F.coalesce("ahead", "head_text").alias("next_text"))


def edited(text: Column, n: Column, following: Column) -> Column:
    """text with its last third replaced by the beginning of the following text."""
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


# -- fingerprints ---------------------------------------------------------------------------------------


def _subset(term: Column, level: Column) -> Column:
    """Which of the 2^level subsets of the lexicon the term is in."""
    return term.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1)


def _sample(text: Column) -> tuple[Column, Column]:
    """A text's distinct terms and, of a column `all` that holds them, a struct of the level, the terms in the first subsets of that
    level (hence of all further ones), and a hash of all terms, of the text itself where there are none."""
    terms = distinct_terms(text)
    level = F.ceil(F.log2(F.greatest(F.size("all"), F.lit(1)))).cast("int")
    whole = F.when(F.size("all") > 0, F.xxhash64(F.array_sort("all"))).otherwise(F.xxhash64(text))
    parts = F.struct(level.alias("level"), F.filter("all", lambda t: _subset(t, level) < SUBSETS).alias("terms"), whole.alias("whole"))
    return terms, parts


def samples(docs: DataFrame) -> DataFrame:
    """Per row of with_next(): n_chars, edited_sha256, and level, terms and whole of the text (x) and of the edited text (y)."""
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows).withColumn("n_chars", F.length("text"))
    rows = rows.select("at", "next_at", "doc_id", "n_chars", F.col("text").alias("x"), edited(F.col("text"), F.col("n_chars"), F.col("next_text")).alias("y"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("y").cast("binary"), 256))
    for side in ("x", "y"):
        terms, parts = _sample(F.col(side))
        rows = rows.withColumn("all", terms).withColumn(side, parts).drop("all")
    return rows.select("at", "next_at", "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("x", "y") for c in ("level", "terms", "whole")])


def _entries(side: str) -> Column:
    """The fingerprint's entries: level.subset.hash of the sorted terms, for each non-empty subset of each level."""
    used_terms = F.when(F.size(f"{side}_known") > 0, F.col(f"{side}_known")).otherwise(F.array_sort(f"{side}_terms"))

    def on(level: Column) -> Column:
        held = F.filter(used_terms, lambda t: _subset(t, level) < SUBSETS)
        used = F.array_sort(F.array_distinct(F.transform(held, lambda t: _subset(t, level))))
        return F.transform(used, lambda s: F.concat_ws(".", level.cast("string"), s.cast("string"), F.hex(F.hash(F.filter(held, lambda t: _subset(t, level) == s)).cast("long").bitwiseAND(0xFFFFFFFF))))

    first = F.col(f"{side}_level")
    made = F.concat(*[on(first + k) for k in range(LEVELS)])
    return F.when(F.size(made) > 0, made).otherwise(F.array(F.concat(F.lit("w."), F.hex(f"{side}_whole"))))


def likeness(a: Column, b: Column, a_level: Column, b_level: Column) -> Column:
    """Of two arrays of entries: 1 if they are equal, else 2 e / (a + b) on the coarsest common level, 0 without one."""
    level = F.concat(F.greatest(a_level, b_level).cast("string"), F.lit("."))
    x, y = (F.filter(side, lambda e: e.startswith(level)) for side in (a, b))
    share = 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.when(F.size(x) + F.size(y) > 0, share), F.lit(0.0)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    n_docs = docs.count()
    lexicon = written(document_frequencies(docs).where(F.col("df") >= LEAST_DOCS), "imatch-lexicon")
    frequent = lexicon.where(F.col("df") > MOST_SHARE * n_docs).select("term")
    if frequent.count() <= MOST_FREQUENT:
        frequent = F.broadcast(frequent)
    rows = written(samples(docs), "imatch-samples")
    terms = rows.select("at", F.lit("x").alias("side"), F.explode("x_terms").alias("term")).unionByName(rows.select("at", F.lit("y").alias("side"), F.explode("y_terms").alias("term")))
    # Without the frequent terms none has more than its small share of the rows when both sides meet by term.
    known = terms.join(frequent, "term", "left_anti").join(lexicon.where(F.col("df") <= MOST_SHARE * n_docs).select("term"), "term", "left_semi")
    known = known.groupBy("at").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("term")))).alias(f"{s}_known") for s in ("x", "y")])
    none = F.array().cast("array<bigint>")
    rows = rows.join(known.withColumnRenamed("at", "_at"), F.col("at") == F.col("_at"), "left")
    rows = rows.withColumns({f"{s}_known": F.coalesce(f"{s}_known", none) for s in ("x", "y")})
    prints = written(rows.select("at", "next_at", "doc_id", "n_chars", "edited_sha256", "x_level", "y_level", _entries("x").alias("x"), _entries("y").alias("y")), "imatch-prints")
    release(lexicon)
    following = prints.select(F.col("at").alias("_at"), F.col("x").alias("z"), F.col("x_level").alias("z_level"))
    both = prints.join(following, F.col("next_at") == F.col("_at"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("x", " ").alias("fingerprint"), F.array_join("y", " ").alias("edited_fingerprint"),
        likeness(F.col("x"), F.col("y"), F.col("x_level"), F.col("y_level")).alias("near_edited"),
        likeness(F.col("x"), F.col("z"), F.col("x_level"), F.col("z_level")).alias("near_next"),
    )
