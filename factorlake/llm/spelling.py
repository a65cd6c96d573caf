"""Spelling variant grouping: words one edit apart, the most frequent one as the form of its variants.

Words are counted by Spark. The vocabulary is cut by code-point order into shards, each a compact trie of bounded size;
shards are broadcast a block of bounded bytes at a time, and each task meets every one of its words with every shard: the
word's distance-one Levenshtein automaton and the trie are walked together, depth first, and each word that both accept is a
neighbour. Counts and best forms are reduced by word; chains of forms are followed by joins that double their reach.

Defined cases: a null text has no words; a null doc_id is written as nothing before the colon; repeated rows count each; ties
of the best form go to the least word; an empty table or one without a word often enough gives no rows; other columns are left alone.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorlake.llm.shared import map_rows, release, written

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 5, 3, 2
#: One run in so many loses a code point, by its hash.
DAMAGED = 97
#: Words of a trie at most, and bytes of the tries that are broadcast at once: packed, some 3 a word, so at most about 3 million words, of
#: which a task holds some 30 bytes each.
SHARD_WORDS, BLOCK_BYTES = 100_000, 8 << 20
#: Words that one task looks up.
TASK_WORDS = 20_000
EXACT, EXTRA, OTHER, SKIPPED = 1, 2, 4, 8


# -- words ----------------------------------------------------------------------------------------------


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH code points with at least LEAST_COUNT occurrences in all texts."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{LETTERS}]+"), 0)).alias("run")).where(F.length("run") >= LEAST_LENGTH)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # lower() knows more letters than A-Z, but not in a run of ASCII alone, where it is the faster one.
    run = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", upper, lower))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))
    words = runs.select("doc_id", run.alias("run")).select("run", h.alias("h")).select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


# -- compact tries --------------------------------------------------------------------------------------


class Trie:
    """Nodes in level order, so that the children of a node are numbered one after another: a label and a first child each. A
    subtree of a single word is a leaf with the rest of the word as its tail, all tails one string. Packed, a node takes a label, the number
    of its children and the length of its tail."""

    def __init__(self, labels: str, first: array, counts: array, tails: str, tail_at: array):
        self.labels, self.first, self.counts, self.tails, self.tail_at = labels, first, counts, tails, tail_at

    @classmethod
    def build(cls, words: list[str], counts: list[int]) -> Trie:
        """Of distinct words in code-point order."""
        labels, first, own, tails, tail_at = ["\0"], array("I"), array("q"), [], array("I", [0])
        level, depth = [(0, len(words))], 0
        made = 1
        while level:
            below = []
            for lo, hi in level:
                first.append(made)
                if hi - lo == 1:
                    own.append(counts[lo])
                    tails.append(words[lo][depth:])
                    tail_at.append(tail_at[-1] + len(tails[-1]))
                    continue
                tail_at.append(tail_at[-1])
                at = lo
                if lo < hi and len(words[lo]) == depth:
                    own.append(counts[lo])
                    at += 1
                else:
                    own.append(0)
                while at < hi:
                    start, label = at, words[at][depth]
                    while at < hi and words[at][depth] == label:
                        at += 1
                    below.append((start, at))
                    labels.append(label)
                    made += 1
            level, depth = below, depth + 1
        first.append(made)
        return cls("".join(labels), first, own, "".join(tails), tail_at)

    def pack(self) -> bytes:
        first, counts, at = np.frombuffer(self.first, np.uint32), np.frombuffer(self.counts, np.int64), np.frombuffer(self.tail_at, np.uint32)
        parts = [self.labels.encode(), np.diff(first).tobytes(), np.packbits(counts > 0).tobytes(), counts[counts > 0].tobytes(), np.diff(at).tobytes(), self.tails.encode()]
        return zlib.compress(struct.pack("<7q", len(counts), *map(len, parts)) + b"".join(parts), 1)

    @classmethod
    def unpack(cls, blob: bytes) -> Trie:
        raw = zlib.decompress(blob)
        nodes, *sizes = struct.unpack_from("<7q", raw)
        at, parts = 56, []
        for size in sizes:
            parts.append(raw[at : at + size])
            at += size
        labels, degrees, ending, counts, lengths, tails = parts
        summed = lambda start, steps: array("I", np.concatenate([[start], start + np.cumsum(np.frombuffer(steps, np.uint32))]).astype(np.uint32).tobytes())
        own = np.zeros(nodes, np.int64)
        own[np.unpackbits(np.frombuffer(ending, np.uint8), count=nodes).astype(bool)] = np.frombuffer(counts, np.int64)
        return cls(labels.decode(), summed(1, degrees), array("q", own.tobytes()), tails.decode(), summed(0, lengths))


def _one_edit(a: str, b: str) -> bool:
    """Do a and b differ by exactly one inserted, deleted or replaced character?"""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def neighbours(trie: Trie, word: str) -> Iterator[tuple[str, int]]:
    """The trie's words one edit from word, and their counts.

    After d characters the automaton is in a set of states: EXACT (no edit, d characters of word read), or one edit made and d - 1
    (EXTRA), d (OTHER) or d + 1 (SKIPPED) characters read. With the edit made only the next characters of word can follow, so
    just those children are looked up; only along EXACT all children are tried.
    """
    labels, first, counts, tails, tail_at = trie.labels, trie.first, trie.counts, trie.tails, trie.tail_at
    size = len(word)
    after = word + "\0\0"  # no label is a zero
    stack = [(0, 0, EXACT, "")]
    while stack:
        node, d, state, path = stack.pop()
        tail = tails[tail_at[node] : tail_at[node + 1]]
        if tail:
            if (state & OTHER and word[d:] == tail) or (state & EXTRA and word[d - 1 :] == tail) or (state & SKIPPED and word[d + 1 :] == tail) or (state & EXACT and _one_edit(word[d:], tail)):
                yield path + tail, counts[node]
            continue
        if counts[node] and ((state & OTHER and d == size) or (state & EXTRA and d == size + 1) or (state & (SKIPPED | EXACT) and d == size - 1)):
            yield path, counts[node]
        lo, hi = first[node], first[node + 1]
        if lo == hi or d > size:
            continue
        now, following = after[d], after[d + 1]
        if state & EXACT:
            for child in range(lo, hi):
                label = labels[child]
                new = EXTRA | (EXACT if label == now else OTHER if d < size else 0) | (SKIPPED if label == following else 0)
                if state & EXTRA and label == after[d - 1]:
                    new |= EXTRA
                if (state & OTHER and label == now) or (state & SKIPPED and label == following):
                    new |= (OTHER if state & OTHER and label == now else 0) | (SKIPPED if state & SKIPPED and label == following else 0)
                stack.append((child, d + 1, new, path + label))
            continue
        for label in {after[d - 1] if state & EXTRA else "\0", now if state & OTHER else "\0", following if state & SKIPPED else "\0"}:
            if label != "\0" and (child := labels.find(label, lo, hi)) >= 0:
                new = (EXTRA if state & EXTRA and label == after[d - 1] else 0) | (OTHER if state & OTHER and label == now else 0) | (SKIPPED if state & SKIPPED and label == following else 0)
                stack.append((child, d + 1, new, path + label))


def tries(words: DataFrame, n_words: int) -> DataFrame:
    """(word, n) to (least, n_words, n_bytes, packed): shards of the vocabulary in code-point order, of SHARD_WORDS words at most."""
    kind = T.StructType.fromDDL("least string, n_words long, n_bytes long, packed binary")

    def shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[str] = []
        counts: list[int] = []

        def full() -> pa.RecordBatch:
            blob = Trie.build(own, counts).pack()
            return pa.RecordBatch.from_pydict({"least": [own[0]], "n_words": [len(own)], "n_bytes": [len(blob)], "packed": [blob]})

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own.append(word)
                counts.append(n)
                if len(own) == SHARD_WORDS:
                    yield full()
                    own, counts = [], []
        if own:
            yield full()

    return words.select("word", "n").repartitionByRange(-(-n_words // SHARD_WORDS) or 1, "word").sortWithinPartitions("word").mapInArrow(shard, kind)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n) to (word, n_near, best): number of near words and the best one (count, word), for words that have any.
    words must be written: each block of shards reads it again."""
    spark = words.sparkSession
    n_words = words.count()
    shards = written(tries(words, n_words), "spelling-tries")
    asked = words.select("word").repartition(max(spark.sparkContext.defaultParallelism, -(-n_words // TASK_WORDS)), "word")
    blocks: list[list[str]] = []
    room = 0
    for row in shards.select("least", "n_bytes").orderBy("least").collect():  # a row for each SHARD_WORDS words
        if not blocks or row["n_bytes"] > room:
            blocks.append([])
            room = BLOCK_BYTES
        blocks[-1].append(row["least"])
        room -= row["n_bytes"]
    found = None
    for block in blocks:
        inside = F.col("least").between(block[0], block[-1])
        sent = spark.sparkContext.broadcast([bytes(r["packed"]) for r in shards.where(inside).select("packed").collect()])

        def search(sent=sent):
            held = [Trie.unpack(x) for x in sent.value]

            def each(word: str):
                near, best = 0, None
                for trie in held:
                    for other, n in neighbours(trie, word):
                        near += 1
                        best = min(best, (-n, other)) if best else (-n, other)
                return [(word, near, -best[0], best[1])] if best else []

            return each

        part = written(map_rows(asked, search, "word string, n_near long, best_n long, best string"), "spelling-near")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    release(shards)
    if found is None:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.struct(F.lit(0).cast("long").alias("n"), F.lit("").alias("word")).alias("best")).limit(0)
    # The least of (-count, word) is the most frequent, and among those the least word.
    least = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("best")).withColumn("best", F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): forms followed to the last. Each round doubles the reach; as counts at least double from
    a word to its form, 63 steps, six rounds, are the most."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not now.where("moved").isEmpty():
        jump = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        after = written(now.join(jump, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        release(now)
        now = after
    return now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n."""
    words = written(vocabulary(docs), "spelling-words")
    near = near_words(words).withColumnRenamed("word", "of")
    kept: Column = F.col("best.n") >= FORM_FACTOR * F.col("n")
    rows = words.join(near, F.col("word") == F.col("of"), "left")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(kept, F.col("best.word")).alias("form"), F.when(kept, F.col("best.n")).alias("form_n")), "spelling-forms")
    last = roots(rows.where("form is not null")).withColumnRenamed("word", "of")
    out = rows.join(last, F.col("word") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
