"""The corpus pipeline: toxicity, near duplicates, benchmark passages, source mix, shards.

Every stage takes null, empty and very long texts, nulls in any column, repeated rows, an empty table and further columns; what each
does with them stands with it. Each stage's rows are a table in the shared folder that goes when the next stage's is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factorlake.llm import decontamination, mixing, near_dedup, sharding, toxicity
from factorlake.llm.shared import fresh_path, mark, release, release_since, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts score like any text without words; copies are judged alike;
    without labels of both kinds, or without documents, nothing goes."""
    net = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, net)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id. Texts without words are nobody's copies and
    stay, as do rows without a doc_id; of rows with the same doc_id one stays."""
    return near_dedup.kept_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go. Null and empty texts have none; an empty benchmark leaves all."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, at most three times. Texts without words have no size and go; a
    null source is a source of its own; repeated rows are taken or left together."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix by shards and returns a row for each document read back: its shard, with the shard's bytes and rows.

    The shards stay in the folder that factorlake.corpus.dir names; where that is unset they are in the shared folder and go at the end of the
    process. Null and empty texts have 0 bytes; equal rows beyond a shard's limit fill numbered pages; a document beyond it has a page of its own; no documents give no rows.
    """
    path = spark.conf.get("factorlake.corpus.dir", None) or fresh_path(spark, "corpus")
    return sharding.shards(sharding.write(docs, path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: No SQL can express the classifier; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = mark()
        after = written(stage(spark, docs, sf_dir), f"stage-{name}")
        release_since(before, after)
        release(docs)
        docs = after
    # What the last stage returns reads the shards alone.
    out = STAGES[-1][1](spark, docs, sf_dir)
    release(docs)
    return out
