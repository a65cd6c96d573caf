"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings: of the whole word and of its beginnings, so that unseen forms of
a known stem still count. Every bucket of the hash table has an embedding. Filters of widths 1, 2 and 3 run over the words
of the whole text; the greatest response of each filter (max pooling) feeds one logistic output. All weights start at
random and are learned by Adagrad, with words and features dropped at random. In the first WARM epochs responses
are averaged instead of pooled, so that every word learns which class it leans to; from then on only those at the maxima do.
Out-of-fold scores calibrate one threshold for each language, which is told from the text's own function words; a score
is the logistic of the distance to its language's threshold.

The fit sees a bounded sample of labelled documents: those with the least hashes, at most MOST_TOXIC and
MOST_CLEAN, of MOST_CHARS characters at most; its networks learn in tasks. All else runs over all documents and whole texts.
Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null and empty texts score as a text without any known word; equal texts have equal
scores; labels other than 0 and 1 and null doc_ids are not learned from; a doc_id labelled twice is
toxic if any of its labels is; of a doc_id with several texts the fit takes the least; with labels of only one class, or
none, all scores are the base rate's side of 0.5; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.llm.shared import drop_shuffles, map_rows

MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 1500, 3000, 100_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 4, (1, 2, 3)
SLOTS = sum(WIDTHS)
BEGINNINGS = (4, 5, 6)
WARM, EPOCHS, BATCH, RATE, DROP, DECAY, FOLDS = 2, 9, 64, 0.05, 0.3, 1e-5, 3
#: Partitions of the copies of the sample that the networks learn from.
PARTITIONS = 7
#: Words of a text that are pooled at once.
SLICE = 1 << 15
#: A language with fewer toxic documents in the sample takes the threshold of all.
LEAST_FOR_LANGUAGE = 12

_WORD = re.compile(r"\w+")
# Function words by which a text's language is told.
_FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on by this from are be at or an have not",
    "de": "der die das und ist nicht ein eine den von zu mit sich auf für im dem des als auch wird",
    "fr": "le les et est une dans pour qui que sur pas du au avec par ce il sont plus ne",
    "es": "el los las y una por con para del se su al lo como más pero sus este son",
}
LANGUAGES = (*_FUNCTION_WORDS, "other")
_LANGUAGE_OF = {w: i for i, words in enumerate(_FUNCTION_WORDS.values()) for w in words.split()}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features_of(word: str) -> list[int]:
    """Hash buckets of the word and of its beginnings; BUCKETS, whose embedding is zero, for those that it is too short for."""
    parts = [f"={word}", *[word[:n] for n in BEGINNINGS if len(word) >= n]]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts] + [BUCKETS] * (1 + len(BEGINNINGS) - len(parts))


def language_of(words: Iterable[str]) -> int:
    n = [0] * len(LANGUAGES)
    for w in words:
        if (k := _LANGUAGE_OF.get(w)) is not None:
            n[k] += 1
    return max(range(len(n)), key=n.__getitem__) if any(n) else len(n) - 1


@dataclass
class Network:
    embed: np.ndarray  # (BUCKETS + 1, DIM), the last one zero
    filters: np.ndarray  # (DIM, SLOTS * FILTERS): the slots of width 1, then 2, then 3
    bias: np.ndarray  # (widths, FILTERS)
    out: np.ndarray  # (widths, FILTERS)
    base: float
    thresholds: dict[int, float] = field(default_factory=dict)

    def slots(self, features: np.ndarray) -> np.ndarray:
        """Per word, of which (words, features) are given: its part in each position of each filter."""
        return (self.embed[features].sum(axis=1) @ self.filters).reshape(-1, SLOTS, FILTERS)

    def logit(self, best: np.ndarray) -> np.ndarray:
        return (np.maximum(best + self.bias, 0) * self.out).sum(axis=(-2, -1)) + self.base


_FIRST_SLOT = np.cumsum([0, *WIDTHS[:-1]])
#: Blank words before each text and after the last, so that every window fits.
_PAD = max(WIDTHS) - 1


def responses(z: np.ndarray, k: int) -> np.ndarray:
    """Of the filters of width k at each word; z: by word, (SLOTS, FILTERS), with _PAD blank words at the end."""
    n, at = len(z) - _PAD, _FIRST_SLOT[k]
    out = z[:n, at].copy()
    for j in range(1, WIDTHS[k]):
        out += z[j : n + j, at + j]
    return out


class Sample:
    """Labelled texts as word numbers from 1 (0 is the blank word); features: per word its hash buckets."""

    def __init__(self, rows: list[tuple[str | None, int]]) -> None:
        number: dict[str, int] = {}
        self.docs, self.labels, self.languages = [], np.array([y for _, y in rows], np.float64), []
        for text, _ in rows:
            words = words_of(text)
            self.languages.append(language_of(words))
            self.docs.append(np.array([number.setdefault(w, len(number) + 1) for w in words], np.int64))
        self.features = np.array([[BUCKETS] * (1 + len(BEGINNINGS)), *map(features_of, number)], np.int64)

    def batch(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[slice]]:
        """(distinct words, each position's place among them, each text's positions with the blanks before it)."""
        blank, parts, spans, at = np.zeros(_PAD, np.int64), [], [], 0
        for i in chosen:
            parts += [blank, self.docs[i]]
            spans.append(slice(at, at := at + _PAD + len(self.docs[i])))
        words, places = np.unique(np.concatenate([*parts, blank]), return_inverse=True)
        return words, places, spans


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of each row number below n."""
    return np.stack([np.bincount(rows, values[:, c], n) for c in range(values.shape[1])], axis=1).astype(np.float32)


def random_network(labels: np.ndarray, rng: np.random.Generator) -> Network:
    toxic, clean = max(1.0, labels.sum()), max(1.0, len(labels) - labels.sum())
    embed = rng.normal(0, 0.01, (BUCKETS + 1, DIM)).astype(np.float32)
    embed[-1] = 0
    # The last filter of each width speaks against toxicity.
    out = rng.uniform(0.3, 0.6, (len(WIDTHS), FILTERS)) * np.where(np.arange(FILTERS) < FILTERS - 1, 1, -1)
    return Network(embed, rng.normal(0, 0.3, (DIM, SLOTS * FILTERS)).astype(np.float32), np.zeros((len(WIDTHS), FILTERS), np.float32), out.astype(np.float32), float(np.log(toxic / clean)))


def train(sample: Sample, chosen: np.ndarray, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    y = sample.labels[chosen]
    net = random_network(y, rng)
    if not 0 < y.sum() < len(y):
        net.out[:] = 0
        return net
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    squares = {k: np.full_like(getattr(net, k), 1e-4) for k in ("embed", "filters", "bias", "out")}
    base_square = 1e-4

    def step(name: str, grad: np.ndarray, at: slice | np.ndarray = slice(None)) -> None:
        squares[name][at] += grad**2
        getattr(net, name)[at] -= RATE * grad / np.sqrt(squares[name][at])

    for epoch in range(EPOCHS):
        order = rng.permutation(len(chosen))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            words, places, spans = sample.batch(chosen[own])
            features = sample.features[words]
            features[rng.random(features.shape) < DROP] = BUCKETS
            features[rng.random(len(features)) < DROP] = BUCKETS
            z = net.slots(features)[places]
            starts, sizes = np.array([x.start for x in spans]), np.array([x.stop - x.start for x in spans])
            best, where = np.empty((len(own), *net.bias.shape), np.float32), np.zeros((len(own), *net.bias.shape), np.int64)
            for k in range(len(WIDTHS)):
                at_each = responses(z, k)
                if epoch < WARM:
                    best[:, k] = np.add.reduceat(at_each, starts, axis=0) / np.sqrt(sizes)[:, None]
                    continue
                for d, span in enumerate(spans):
                    where[d, k] = at_each[span].argmax(axis=0)
                best[:, k] = at_each[starts[:, None] + where[:, k], np.arange(FILTERS)]
            before = best + net.bias
            active = before if epoch < WARM else np.maximum(before, 0)
            logit = (active * net.out).sum(axis=(1, 2)) + net.base
            g = (weight[own] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[own]) / len(own)).astype(np.float32)
            g_best = g[:, None, None] * net.out * (1 if epoch < WARM else before > 0)
            g_slots = np.empty((len(words), SLOTS, FILTERS), np.float32)
            text_of, n = np.repeat(np.arange(len(own)), sizes), len(z) - _PAD
            for k, width in enumerate(WIDTHS):
                for j in range(width):
                    if epoch < WARM:
                        g_slots[:, _FIRST_SLOT[k] + j] = _summed(places[j : n + j], (g_best[:, k] / np.sqrt(sizes)[:, None])[text_of], len(words))
                    else:
                        cells = places[starts[:, None] + where[:, k] + j] * FILTERS + np.arange(FILTERS)
                        g_slots[:, _FIRST_SLOT[k] + j] = np.bincount(cells.ravel(), g_best[:, k].ravel(), len(words) * FILTERS).reshape(-1, FILTERS)
            g_slots = g_slots.reshape(len(words), SLOTS * FILTERS)
            g_words = np.repeat(g_slots @ net.filters.T, features.shape[1], axis=0)
            flat = features.ravel()
            learned = (flat < BUCKETS) & g_words.any(axis=1)
            rows, of = np.unique(flat[learned], return_inverse=True)
            g_embed = DECAY * net.embed[rows] + _summed(of, g_words[learned], len(rows))
            step("filters", net.embed[features].sum(axis=1).T @ g_slots)
            step("embed", g_embed, rows)
            step("bias", g_best.sum(axis=0))
            step("out", (g[:, None, None] * active).sum(axis=0))
            base_square += float(g.sum()) ** 2
            net.base -= RATE * float(g.sum()) / np.sqrt(base_square)
    return net


class Scorer:
    """Scores texts; remembers the filter responses of words it has met, until they are `most`."""

    def __init__(self, net: Network, most: int = 200_000) -> None:
        self.net, self.most = net, most
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.slots = np.zeros((4096, SLOTS, FILTERS), np.float32)
        self.languages = np.full(4096, len(LANGUAGES) - 1)
        self.used = 1  # 0 is the blank word

    def _slots(self, features: np.ndarray) -> np.ndarray:
        """net.slots(), but the last digits of a word's don't depend on the words beside it, as those of a product of matrices do."""
        embedded, out = self.net.embed[features].sum(axis=1), np.zeros((len(features), SLOTS * FILTERS), np.float32)
        for d in range(DIM):
            out += embedded[:, d : d + 1] * self.net.filters[d]
        return out.reshape(-1, SLOTS, FILTERS)

    def _ids(self, words: list[str]) -> np.ndarray:
        if len(self.number) > self.most:
            self.forget()
        known = self.number
        if new := [w for w in dict.fromkeys(words) if w not in known]:
            while self.used + len(new) > len(self.languages):
                self.slots = np.concatenate([self.slots, np.zeros_like(self.slots)])
                self.languages = np.concatenate([self.languages, np.full_like(self.languages, len(LANGUAGES) - 1)])
            to = self.used + np.arange(len(new))
            self.slots[to] = self._slots(np.array([features_of(w) for w in new], np.int64))
            self.languages[to] = [_LANGUAGE_OF.get(w, len(LANGUAGES) - 1) for w in new]
            known.update(zip(new, to.tolist(), strict=True))
            self.used += len(new)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def logit(self, text: str | None) -> tuple[float, int]:
        words, told = words_of(text), np.zeros(len(LANGUAGES), np.int64)
        best = np.full(self.net.bias.shape, -np.inf, np.float32)
        # Slices overlap by the windows that reach over their ends; blanks are before the first and after the last.
        for a in range(0, max(1, len(words)), SLICE):
            ids = self._ids(words[a : a + SLICE + _PAD])
            told += np.bincount(self.languages[ids[:SLICE]], minlength=len(LANGUAGES))
            ids = np.concatenate([np.zeros(_PAD * (a == 0), np.int64), ids, np.zeros(min(_PAD, max(0, a + SLICE + _PAD - len(words))), np.int64)])
            z = self.slots[ids]
            for k in range(len(WIDTHS)):
                best[k] = np.maximum(best[k], responses(z, k).max(axis=0, initial=-np.inf))
        language = int(told[:-1].argmax()) if told[:-1].any() else len(LANGUAGES) - 1
        return float(self.net.logit(best)), language

    def score(self, text: str | None) -> tuple[float, str]:
        value, language = self.logit(text)
        distance = value - self.net.thresholds.get(language, self.net.thresholds.get(-1, 0.0))
        return float(1 / (1 + np.exp(-np.clip(distance, -30, 30)))), LANGUAGES[language]


def best_threshold(values: np.ndarray, labels: np.ndarray) -> float:
    """Midway between two neighbouring values, where the F1 of the toxic class is greatest; of a run of equal ones the middle."""
    order = np.argsort(values)
    v, y = values[order], labels[order]
    hits = y.sum() - np.concatenate([[0], np.cumsum(y)])
    f1 = 2 * hits / np.maximum(1, hits + np.arange(len(v), -1, -1) + 0.0 + y.sum() - hits)
    edges = np.concatenate([[v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]])
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(edges[top[len(top) // 2]])


def fold_logits(sample: Sample, rows: list[tuple[str | None, int]], fold: int) -> list[float]:
    """Of the rows of a fold, by a network that learned from the others."""
    every = np.arange(len(rows))
    scorer = Scorer(train(sample, every[every % FOLDS != fold], seed=11 + fold))
    return [scorer.logit(rows[i][0])[0] for i in every[every % FOLDS == fold]]


def calibrated(net: Network, labels: np.ndarray, languages: np.ndarray, folds: list[list[float]]) -> Network:
    """net with its thresholds, from the logits of each fold."""
    values = np.zeros(len(labels))
    for k, own in enumerate(folds):
        values[k::FOLDS] = own
    net.thresholds[-1] = best_threshold(values, labels)
    for k in set(languages.tolist()):
        if labels[languages == k].sum() >= LEAST_FOR_LANGUAGE and labels[languages == k].min() == 0:
            net.thresholds[k] = best_threshold(values[languages == k], labels[languages == k])
    return net


def fit(rows: list[tuple[str | None, int]]) -> Network:
    """rows: (text, 0 or 1), in an order that depends on neither."""
    sample = Sample(rows)
    net = train(sample, np.arange(len(rows)))
    if not len(rows) or sample.labels.min() == sample.labels.max():
        return net
    return calibrated(net, sample.labels, np.array(sample.languages), [fold_logits(sample, rows, k) for k in range(FOLDS)])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_table(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> DataFrame:
    """(order, doc_id, toxic, text) of at most that many labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    some = [known.where(F.col("toxic") == y).orderBy("order", "doc_id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    chosen = some[0].unionByName(some[1])
    # At most most_toxic + most_clean rows of three numbers: a proven bound. So are as many texts of MOST_CHARS characters.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.where(F.length("text") <= MOST_CHARS).groupBy("order", "doc_id", "toxic").agg(F.min("text").alias("text"))


def _ordered(found: Iterable[tuple]) -> list[tuple[str | None, int]]:
    """(order, doc_id, toxic, text) by their order; equal texts once."""
    out: dict[str, int] = {}
    for _, _, toxic, text in sorted(found, key=lambda r: (r[0], r[1])):
        out.setdefault(text, toxic)
    return list(out.items())


def training_rows(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> list[tuple[str | None, int]]:
    """Texts and labels of training_table(), equal texts once."""
    return _ordered(map(tuple, training_table(docs, labels, most_toxic, most_clean).select("order", "doc_id", "toxic", "text").collect()))


def fitted(docs: DataFrame, labels: DataFrame) -> Network:
    """fit() of training_rows(), as tasks: one for the network and one for each fold. The driver gets the network, but no texts.

    Each task has the whole sample, whose size is bounded.
    """

    def learned(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _ordered(pdf[["order", "doc_id", "toxic", "text"]].itertuples(index=False, name=None))
        sample, (part,) = Sample(rows), key
        both = 0 < sample.labels.sum() < len(rows)
        if part < FOLDS:
            made = None, fold_logits(sample, rows, part) if both else []
        else:
            made = train(sample, np.arange(len(rows))), (sample.labels, np.array(sample.languages), both)
        return pd.DataFrame({"part": [part], "made": [pickle.dumps(made)]})

    sample = training_table(docs, labels).select("order", "doc_id", "toxic", "text", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))).alias("part"))
    # So many partitions that the parts meet in none.
    found = dict(sample.repartition(PARTITIONS, "part").groupBy("part").applyInPandas(learned, "part int, made binary").collect())
    if not found:
        return fit([])
    net, (known, languages, both) = pickle.loads(found.pop(FOLDS))
    drop_shuffles()  # the copies of the sample, and what collecting the network left, go before documents are scored
    return calibrated(net, known, languages, [pickle.loads(found[k])[1] for k in range(FOLDS)]) if both else net


def classify(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted, language: one row per row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def make() -> Callable:
        scorer = Scorer(sent.value)

        def each(doc_id: int | None, out: bool, text: str | None) -> list[tuple]:
            score, language = scorer.score(text)
            return [(doc_id, out, score, int(score >= 0.5), language)]

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int, language string")


def clean_documents(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns and in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def make() -> Callable:
        scorer = Scorer(sent.value)
        return lambda *row: [] if scorer.score(row[at])[0] >= 0.5 else [row]

    return map_rows(docs, make, docs.schema)
