"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Texts with equal shingle sets form one class; only one document of each class goes on.
2. A class posts itself under each (coordinate, value) pair of its MinHash signature. Postings that no other
   class shares are dropped. To reach THRESHOLD equal coordinates, two classes must meet under one of the rarest
   m - THRESHOLD + 1 of a class's m shared postings, so only that prefix stays posted.
3. Classes that meet under a short posting list (at most SHORT) are candidates if their sizes and their collisions
   in FINE further coordinates (1 bit of each) leave 0.75 possible. Candidates are confirmed on their full sets.
4. A longer list is not merged pair by pair: all its members are compared with one pivot p only, a central text. Let r(x) be the symmetric difference of x and p, as a set. x and y are linked only if their own
   symmetric difference, that of r(x) and r(y), has at most (|x| + |y|) / 7 elements. Those linked with p are in one
   component. Of any other pair one end y is not linked with p, so |r(y)| > (|p| + |y|) / 7, and then x and y share
   more than half of x's differences (to within (|x| - |p|) / 14). So each member posts a prefix of its differences to p, the rarest
   first: where their lists are short, step 3 finds the pairs; where not, step 4 goes on with them.

So a group of n near copies and its surroundings make n comparisons with pivots, and pairs only where
texts share what sets them apart from the pivot. Lists that are still long after LEVELS rounds are merged whole; none is capped.

A link of exactly 0.75 is missed with probability P(Binomial(64, 0.75) < 32) < 1e-5, and by the fine coordinates
with P(Binomial(512, 1 / 8) > 102) < 1e-6, others with less; step 4 is exact.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; fewer words than a
shingle make one shingle; rows that repeat a doc_id are one node with the links of all its texts; a null doc_id
has no component (null) and is kept; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.llm.components import connected
from factorlake.llm.shared import drop_shuffles, map_rows, mark, release, release_since, sorted_join, unused, written

WORDS, COORDINATES, THRESHOLD = 5, 64, 32
#: Signatures are kept in so many columns, whose postings are shuffled one after the other: disk holds one part's at a time.
PARTS = 4
#: Links have 100 * intersection >= SHARE * union.
SHARE = 75
#: Posting lists of at most SHORT classes, and lists of differences with at most SHORT_APART near postings, are merged
#: pair by pair, longer ones through pivots, up to LEVELS times.
SHORT, SHORT_APART, LEVELS = 48, 256, 4
#: Ids and keys of classes that may have a partner are broadcast up to so many, at some 60 bytes; more meet the documents by a shuffle.
MOST_MEMBERS = 1_000_000
#: Further coordinates of each class that has a partner, and how many may differ: 5 deviations above those of 0.75.
FINE, FINE_DIFFERENT = 512, 102

_rng = np.random.default_rng(20_240)
_MULTIPLY = _rng.integers(1 << 31, size=(COORDINATES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(1 << 32, size=(COORDINATES, 1), dtype=np.uint32)
_EACH = np.arange(COORDINATES)
_FINE_MULTIPLY = _rng.integers(1 << 31, size=(FINE, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FINE_ADD = _rng.integers(1 << 32, size=(FINE, 1), dtype=np.uint32)
_PLACE = _rng.integers(1 << 62, size=WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, known: dict | None = None) -> np.ndarray:
    """64-bit hashes of the distinct shingles, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if known is None:
        known = _WordHashes()
    elif len(known) > 200_000:
        known.clear()
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(ids))
    sums = np.full(len(ids) - n + 1, n, np.uint64) * _PLACE[WORDS]
    for j in range(n):
        sums += ids[j : len(ids) - n + 1 + j] * _PLACE[j]
    return np.unique(_mixed(sums))


def signature(own: np.ndarray) -> np.ndarray:
    """For each hash function 56 bits of the shingle that has its least value."""
    low, best, at = own.astype(np.uint32), np.full(COORDINATES, np.iinfo(np.uint32).max), np.zeros(COORDINATES, np.int64)
    for a in range(0, len(own), 1 << 12):
        values = low[a : a + (1 << 12)] * _MULTIPLY
        values += _ADD
        where = values.argmin(axis=1)
        least = values[_EACH, where]
        at = np.where(least < best, a + where, at)
        best = np.minimum(least, best)
    return (own[at] >> np.uint64(8)).astype(np.int64)


def fine_codes(own: np.ndarray) -> np.ndarray:
    """A bit of the least value of each of FINE hash functions, packed."""
    low, best = own.astype(np.uint32), np.full(FINE, np.iinfo(np.uint32).max)
    for a in range(0, len(own), 1 << 10):
        values = low[a : a + (1 << 10)] * _FINE_MULTIPLY
        values += _FINE_ADD
        best = np.minimum(values.min(axis=1), best)
    # The leading bits of least values are mostly 0, and the last ones nearly follow the shingle: mixed, any will do.
    return np.packbits((_mixed(best.astype(np.uint64)) & np.uint64(1)).astype(bool)).view("<i8")


def _class_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _described() -> Callable:
    known = _WordHashes()

    def each(doc_id: int | None, text: str | None) -> list[tuple]:
        own = shingles(text, known)
        if not len(own):
            return [(doc_id, 0, None, *[None] * PARTS)]
        return [(doc_id, len(own), _class_of(own), *signature(own).reshape(PARTS, -1).tolist())]

    return each


class _Sets:
    """Shingle sets of texts, the last ones kept: a pivot's many pairs mostly come together."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.words, self.recent, self.kept, self.most = _WordHashes(), {}, 0, most

    def of(self, key: int, text: str) -> np.ndarray:
        if key not in self.recent:
            if self.kept > self.most:
                self.recent.clear()
                self.kept = 0
            self.recent[key] = shingles(text, self.words)
            self.kept += len(self.recent[key])
        return self.recent[key]


def _linked(both: int, either: int) -> bool:
    return 100 * both >= SHARE * either


def _confirmed() -> Callable:
    """Candidates with both texts to those whose full sets are similar enough."""
    sets = _Sets()

    def each(a: int, b: int, text_a: str, text_b: str) -> list[tuple]:
        x, y = sets.of(a, text_a), sets.of(b, text_b)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return [(a, b)] if _linked(both, len(x) + len(y) - both) else []

    return each


def differences(x: np.ndarray, p: np.ndarray) -> tuple[bool, np.ndarray, int, int]:
    """(linked with p, x's differences to p, the lengths of the prefixes that x posts for partners not linked with p and for linked ones).

    With t = (|x| + |y|) / 7 >= |x ^ y|: any partner y leaves at most |x| // 3 of r(x) unshared; a y not linked with p shares
    more than (7 |r(x)| + |p| - |x|) / 14; a y linked with p shares at least (7 |r(x)| - |x| - |p|) / 8, if x isn't linked itself.
    """
    apart = np.setxor1d(x, p, assume_unique=True)
    r = len(apart)
    both = (len(x) + len(p) - r) // 2
    linked, least = _linked(both, both + r), r - len(x) // 3
    short = max(0, r - max(least, (7 * r + len(p) - len(x)) // 14 + 1) + 1)
    # A partner that is linked with p has at most |p| // 3 differences to it.
    share = max(1, least, -((len(x) + len(p) - 7 * r) // 8))
    return linked, apart, short, 0 if linked or share > len(p) // 3 else r - share + 1


def _set_apart() -> Callable:
    """A member x and its pivot to: linked, the keys of its differences, and how long its posted prefixes are."""
    sets = _Sets()

    def each(x: int, pivot: int, text_x: str, text_pivot: str) -> list[tuple]:
        linked, apart, short, wide = differences(sets.of(x, text_x), sets.of(pivot, text_pivot))
        keys = _mixed(apart + _mixed(np.full(1, pivot, np.uint64))).view(np.int64).tolist() if short or wide else []
        return [(x, pivot, linked, keys, short, wide)]

    return each


def _posted_apart(star: DataFrame) -> DataFrame:
    """Lists of the rarest differences, as many as each member must post. Those that no other member has need no list."""
    each = star.where("size(apart) > 0").select("x", "pivot", F.explode("apart").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    shared = each.join(sorted_join(often), "token").groupBy("x", "pivot").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("own"))
    shared = star.select("x", "pivot", "linked", "short", "wide", F.size("apart").alias("r")).join(sorted_join(shared), ["x", "pivot"])
    alone = F.col("r") - F.size("own")
    shared = shared.withColumn("short", F.col("short") - alone).withColumn("wide", F.col("wide") - alone).where("short > 0 or wide > 0")
    posted = shared.select(F.col("x").alias("id"), "linked", "r", "short", F.size("own").alias("m"), F.posexplode(F.slice("own.token", F.lit(1), F.greatest("short", "wide"))).alias("place", "token"))
    return posted.select("token", "id", (~F.col("linked")).alias("far"), (F.col("place") < F.col("short")).alias("near"), "r", (F.col("m") - F.col("place")).alias("room"), F.struct(F.col("linked"), "r", "id").alias("rank"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per row: doc_id, n_shingles, key), (per class: id, key, doc_id), (per class that shares postings: see shared_postings).

    Signatures are written once, beside their rows, and dropped as soon as their postings are written.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = map_rows(texts, _described, "doc_id long, n_shingles long, key binary, " + ", ".join(f"s{i} array<long>" for i in range(PARTS)))
    described = written(made.withColumn("id", F.monotonically_increasing_id()), "shingled")
    rows = written(described.select("doc_id", "n_shingles", "key"), "rows")
    # Only keys and ids meet here; a signature stays where its row is.
    own = described.where("key is not null and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "id")).alias("at"))
    own = written(own.select("at.id", "key", "at.doc_id"), "classes")
    drop_shuffles()
    signatures = described.select("id", *[f"s{i}" for i in range(PARTS)])
    shared = []
    for i in range(PARTS):
        shared.append(written(shared_postings(signatures.select("id", F.col(f"s{i}").alias("signature")).join(own.select("id"), "id", "left_semi"), i * COORDINATES // PARTS), "shared"))
        drop_shuffles()
    release(described)
    posted = written(listed(reduce(DataFrame.unionByName, shared)), "postings")
    release(*shared)
    drop_shuffles()
    return rows, own, posted


def shared_postings(own: DataFrame, first: int) -> DataFrame:
    """(id, often, token): the postings of signatures (id, signature: from coordinate `first` on) that another class has, too."""
    posted = own.select("id", F.posexplode("signature").alias("place", "value"))
    posted = posted.select("id", F.shiftleft("value", COORDINATES.bit_length() - 1).bitwiseOR(F.col("place").cast("long") + first).alias("token"))
    # Counted before the shuffle, so that no task holds a common posting's list.
    often = posted.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    return posted.join(sorted_join(often), "token").select("id", "often", "token")


def listed(shared: DataFrame) -> DataFrame:
    """(id, central, tokens): of each class that can reach THRESHOLD collisions its shared postings, the rarest first, and how common they are in all."""
    # At most COORDINATES postings of a class come together.
    lists = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("own"), F.sum("often").alias("central"))
    return lists.where(F.size("own") >= THRESHOLD).select("id", "central", F.col("own.token").alias("tokens"))


_BITS = [f"fine{i}" for i in range(FINE // 64)]


def _fine_different(x: str, y: str) -> Column:
    """How many bits of the fine coordinates differ."""
    return sum((F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))) for i in range(FINE // 64)), F.lit(0))


def _met(lists: DataFrame, sides: DataFrame) -> DataFrame:
    """Pairs (a, b) that meet in lists (token, id, far, near, r, room): of two components, not both linked with the pivot,
    both posted for such a partner, and with sizes, differences and collisions that leave a link possible.

    Where a pair first meets, it shares no more differences than either has left in its order (room).
    """
    here = lists.join(sorted_join(sides), "id")
    other = here.select(F.col("token").alias("at"), *[F.col(c).alias(f"b_{c}") for c in here.columns if c != "token"])
    size = (F.col("n") * 100 >= F.col("b_n") * SHARE) & (F.col("b_n") * 100 >= F.col("n") * SHARE)
    posted = (F.col("far") | F.col("b_far")) & (F.col("near") | ~F.col("b_far")) & (F.col("b_near") | ~F.col("far"))
    room = F.least("room", "b_room") * 14 >= 7 * (F.col("r") + F.col("b_r")) - F.col("n") - F.col("b_n")
    on = (F.col("token") == F.col("at")) & (F.col("id") < F.col("b_id")) & (F.col("home") != F.col("b_home")) & posted & size & room & (_fine_different("fine", "b_fine") <= FINE_DIFFERENT)
    return here.join(sorted_join(other), on).select(F.col("id").alias("a"), F.col("b_id").alias("b")).distinct()


def _with_texts(pairs: DataFrame, texts: DataFrame, a: str, b: str) -> DataFrame:
    for end in (b, a):
        pairs = pairs.join(texts.select(F.col("id").alias(end), F.col("text").alias(f"text_{end}")), end)
    return pairs.select(a, b, f"text_{a}", f"text_{b}")


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, n, text, fine0, ...) of the classes that may have a partner, once for each row with such a text; a doc_id
    that repeats with another text falls out by its class."""
    few = members.count() <= MOST_MEMBERS
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(members) if few else members, "doc_id")

    def same() -> Callable:
        hashes = _WordHashes()

        def each(number: int, key: bytes, text: str | None) -> list[tuple]:
            own = shingles(text, hashes)
            return [(number, len(own), text, *fine_codes(own).tolist())] if len(own) and _class_of(own) == key else []

        return each

    return map_rows(known.select("id", "key", "text"), same, "id long, n long, text string, " + ", ".join(f"{b} long" for b in _BITS))


def _few_pivots(lists: DataFrame, long: DataFrame) -> DataFrame:
    """long (token, n, pivot) with other pivots, as any text can be one: each member prefers that of its lists' pivots which most
    others have too, and a list takes what most of its members prefer. So the lists of a group of copies and its surroundings share a pivot."""
    here = lists.join(sorted_join(long), "token")
    popular = here.groupBy("pivot").agg(F.count("*").alias("served"))
    prefers = here.join(sorted_join(popular), "pivot").groupBy("id").agg(F.max(F.struct("served", "pivot")).alias("best")).select("id", F.col("best.pivot").alias("prefers"))
    votes = here.select("token", "id").join(sorted_join(prefers), "id").groupBy("token", "prefers").agg(F.count("*").alias("votes"))
    return votes.groupBy("token").agg(F.max(F.struct("votes", "prefers")).alias("at")).join(sorted_join(long), "token").select("token", "n", F.col("at.prefers").alias("pivot"))


def links(docs: DataFrame, own: DataFrame, posted: DataFrame) -> DataFrame:
    """(a, b): links between classes that connect all that are similar, directly or through others."""
    members = written(posted.select("id").join(sorted_join(own.select("id", "key", "doc_id")), "id"), "members")
    described = written(_texts(docs, members), "texts")
    texts = described if described.count() == members.count() else described.groupBy("id").agg(F.min(F.struct("text", "n", *_BITS)).alias("at")).select("id", "at.*")
    # In the first lists, of the prefixes that can still lead to THRESHOLD collisions, every pair counts.
    prefix = posted.select("id", "central", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - THRESHOLD + 1)).alias("token"))
    lists = prefix.select("token", "id", F.lit(True).alias("far"), F.lit(True).alias("near"), F.lit(0).alias("r"), F.lit(0).alias("room"), F.struct(-F.col("central"), "id").alias("rank"), F.col("id").alias("home"))
    sides, met, stars, used = texts.select("id", "n", *_BITS, F.col("id").alias("home")), None, [], [posted, members, described]
    for level in range(LEVELS + 1):
        sizes = lists.groupBy("token").agg(F.count_if("near").alias("near"), F.max("far").alias("any"), F.min("rank").alias("pivot"), (F.min("home") < F.max("home")).alias("open"))
        sizes = written(sizes.where("near > 0 and any and open").select("token", F.col("near").alias("n"), F.col("pivot.id").alias("pivot")), "lists")
        used.append(sizes)
        most = SHORT_APART if level else SHORT
        long = sizes.where(F.col("n") > most)
        if level == 0:
            long = written(_few_pivots(lists.select("token", "id"), long), "long")
            used.append(long)
        last = level == LEVELS or long.isEmpty()
        merged = lists.join(sorted_join(sizes.select("token") if last else sizes.where(F.col("n") <= most).select("token")), "token", "left_semi").drop("rank", "home")
        if not last:
            star = lists.join(sorted_join(long), "token").where("id <> pivot").select(F.col("id").alias("x"), "pivot").distinct()
            star = written(map_rows(_with_texts(star, texts, "x", "pivot"), _set_apart, "x long, pivot long, linked boolean, apart array<long>, short int, wide int"), "pivots")
            stars.append(star)
            if level == 0:
                of = connected(_links_of(star)).select(F.col("node").alias("id"), F.col("component").alias("home"))
                sides = written(texts.select("id", "n", *_BITS).join(sorted_join(of), "id", "left").withColumn("home", F.coalesce("home", "id")), "sides")
                used.append(sides)
            lists = written(_posted_apart(star).join(sorted_join(sides.select("id", "home")), "id"), "apart")
            used += [star, lists]
            drop_shuffles()
        new = written(_met(merged, sides), "met")
        met = new if met is None else met.unionByName(new)
        used.append(new)
        if last:
            break
    direct = map_rows(_with_texts(met.distinct(), texts, "a", "b"), _confirmed, "a long, b long")
    out = written(reduce(DataFrame.unionByName, [_links_of(x) for x in stars], direct), "links")
    release(*used)
    return out


def _links_of(star: DataFrame) -> DataFrame:
    return star.where("linked").select(F.col("x").alias("a"), F.col("pivot").alias("b"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    before = mark()
    rows, own, posted = classes(docs)
    of = connected(links(docs, own, posted)).select(F.col("node").alias("id"), F.col("component").alias("joined"))
    grouped = own.select("id", "key", "doc_id").join(sorted_join(of), "id", "left").withColumn("joined", F.coalesce("joined", "id"))
    least = grouped.groupBy("joined").agg(F.min("doc_id").alias("least"))
    by_class = written(grouped.join(sorted_join(least), "joined").select("key", "least"), "class-components")
    release_since(before, rows, by_class)
    out = rows.join(by_class, "key", "left").withColumn("least", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")))
    # A doc_id that repeats with different texts ties their components together.
    again = written(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    if not again.isEmpty():
        ties = out.join(again, "doc_id").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
        tied = connected(ties).select(F.col("node").alias("least"), F.col("component").alias("tied"))
        out = out.join(tied, "least", "left").withColumn("least", F.coalesce("tied", "least")).drop("tied")
    out = out.withColumnRenamed("least", "component_id")
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of docs; rows without a doc_id all stay."""
    before = mark()
    decided = written(dedup(docs), "dedup")
    release_since(before, decided)
    gone, one = unused(docs, "_gone", "_one")
    out = docs.join(decided.where("not kept").select(F.col("doc_id").alias(gone)).distinct(), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    counted = decided.where("doc_id is not null").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if counted["n"] == counted["d"]:
        return out
    at = Window.partitionBy(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string")))).orderBy("text")
    return out.withColumn(one, F.row_number().over(at)).where(F.col(one) == 1).drop(one)
