"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of 10 consecutive words of each benchmark item (an item of fewer words is
one window). For the windows of one length, a shift table over pairs of adjacent words says how far the
search may move when a pair ends at the current position; at shift 0 the bucket of that pair's windows
is compared directly. Most pairs of a document occur in no window, so most positions are never looked at.

Items are dealt by hash to blocks of about BLOCK_BYTES of text, an item whole. Each block is one pass over the
documents, which carry their hits so far along and are written to the shared folder in between, so that driver and
executors hold one block's tables at a time; a benchmark of one block needs one pass and no writing.
Nothing of the documents is shuffled or collected.

Item ids keep their value as strings. Defined cases: a null or empty text has no words and is never contaminated; an item without words has
no window; a null item_id counts as an item but cannot be named in the digest; repeated rows of items
or documents each count as their distinct ids; an empty benchmark or empty documents give 0 hits or
no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.llm.shared import map_rows, release, written

WINDOW = 10
#: Text of the benchmark items whose windows go to the tasks at once.
BLOCK_BYTES = 4 << 20

#: Bytes 0-2F, 3A-60 (A-Z become a-z) and 7B-7F part words; all others, so any UTF-8 beyond ASCII, are in words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Searcher:
    """Wu-Manber tables of windows of one length. patterns: tuple of words to the items that have it."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str | None]]) -> None:
        self.m = len(next(iter(patterns)))
        self.b = min(2, self.m)
        self.longest = self.m - self.b + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.b, self.m + 1):
                block = words[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.longest), self.m - end)
            self.bucket[words[-self.b :]].append((list(words), items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str | None]]]:
        """(first position, items) of every occurrence."""
        m, longest, n = self.m, self.longest, len(words)
        two = self.b == 2
        shift, at = self.shift.get, m - self.b  # at: where the block begins that ends the current window
        while at + self.b <= n:
            block = (words[at], words[at + 1]) if two else (words[at],)
            if step := shift(block, longest):
                at += step
                continue
            first = at + self.b - m
            for pattern, items in self.bucket.get(block, ()):
                if words[first : first + m] == pattern:
                    yield first, items
            at += 1


def windows(items: list[tuple[str | None, list[bytes]]], size: int = WINDOW) -> list[Searcher]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str | None]]] = defaultdict(dict)
    for item, words in items:
        if not words:
            continue
        m = min(size, len(words))
        for i in range(len(words) - m + 1):
            of = by_length[m].setdefault(tuple(words[i : i + m]), [])
            if item not in of:
                of.append(item)
    return [Searcher(x) for _, x in sorted(by_length.items())]


Block = list[tuple[str | None, list[bytes]]]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Block]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], words_of(r[1])) for r in own.distinct().collect()]


def _in_passes(docs: DataFrame, benchmark: DataFrame, block_bytes: int, one: Callable[[DataFrame, Broadcast, bool], DataFrame]) -> DataFrame:
    """one(docs so far, block, whether it is the last) for each block; what all but the last give is written before the next begins."""
    blocks = _blocks(benchmark, block_bytes)
    now, before = next(blocks), None
    while True:
        after = next(blocks, None)
        sent = docs.sparkSession.sparkContext.broadcast(now)
        docs = one(docs, sent, after is None)
        if after is None:
            return docs
        docs = written(docs, "searched")
        sent.destroy()
        if before is not None:
            release(before)
        now, before = after, docs


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (array, sorted): one row per row of docs."""
    last_schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"

    def one(df: DataFrame, sent: Broadcast, last: bool) -> DataFrame:
        return map_rows(df, _pass(sent, size, last), last_schema if last else "doc_id long, text string, hit array<int>, items array<string>")

    return _in_passes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, block_bytes, one)


def _pass(sent: Broadcast, size: int, last: bool) -> Callable:
    def make() -> Callable:
        searchers = windows(sent.value, size)

        def each(doc_id: int | None, text: str | None, hit: list[int] | None = None, items: list[str | None] | None = None) -> list[tuple]:
            words = words_of(text)
            found = set(items or ())
            # +1 where an occurrence begins, -1 after its end: the running sum is over 0 inside any
            edges = np.zeros(len(words) + 1, np.int32)
            for first in hit or ():
                edges[abs(first) - 1] += 1 if first > 0 else -1
            for s in searchers:
                for first, own in s.find(words):
                    edges[first] += 1
                    edges[first + s.m] -= 1
                    found.update(own)
            inside = np.cumsum(edges)[:-1] > 0
            if not last:
                turns = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
                return [(doc_id, text, [int(x + 1) if i % 2 == 0 else -int(x + 1) for i, x in enumerate(turns)], list(found))]
            named = sorted(x for x in found if x is not None)
            digest = hashlib.sha256(",".join(named).encode()).hexdigest()
            n_hit = int(inside.sum())
            return [(doc_id, len(words), n_hit, len(found), digest, n_hit > 0, named)]

        return each

    return make


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without a hit, with all their columns: one pass over them for each block of the benchmark."""
    at, schema = docs.columns.index("text"), docs.schema
    return _in_passes(docs, benchmark, block_bytes, lambda df, sent, last: map_rows(df, _without(sent, size, at), schema))


def _without(sent: Broadcast, size: int, at: int) -> Callable:
    def make() -> Callable:
        searchers = windows(sent.value, size)

        def each(*row) -> list[tuple]:
            words = words_of(row[at])
            return [] if any(next(s.find(words), None) for s in searchers) else [row]

        return each

    return make
