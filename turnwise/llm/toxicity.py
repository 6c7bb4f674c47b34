"""Toxicity of texts: averaged subword embeddings and a linear softmax, trained together in NumPy.

A word is the mean of the vectors of its character n-grams (of ``<word>``, and of the word itself), so
a misspelling that was never seen shares most of its vectors with the word it hides. A text is cut
into windows of words; a window is the mean of its words, and the text gets the class probabilities
of its most toxic window, in training as in scoring. One insult in a long text is therefore not
averaged away. Vectors are kept in hashed buckets.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
ROWS_OUT = 1024
KEPT_WORDS = 500_000
KEPT_LENGTH = 40


@dataclass(frozen=True)
class Settings:
    """How a model is trained. ``rows_per_class`` and ``sample_chars`` bound the labelled sample."""

    rows_per_class: int = 2000
    sample_chars: int = 10_000
    buckets: int = 1 << 18
    dim: int = 8
    grams: tuple[int, ...] = (3, 4, 5)
    window: int = 6
    epochs: int = 6
    batch: int = 32
    rate: float = 1.5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """The trained vectors times the softmax weights: the log odds that a bucket adds, and the bias."""

    odds: np.ndarray
    bias: float
    settings: Settings


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def units(word: str, settings: Settings) -> list[int]:
    """The buckets of a word and of its character n-grams."""
    marked = f"<{word}>"
    grams = {marked, *(marked[i : i + n] for n in settings.grams for i in range(len(marked) - n + 1))}
    return [zlib.crc32(g.encode("utf-8", "replace")) % settings.buckets for g in sorted(grams)]


class _Bags:
    """The words of the sample as numbers, and the buckets of each word one after the other."""

    def __init__(self, texts: Sequence[str], settings: Settings):
        numbers: dict[str, int] = {}
        flat: list[int] = []
        sizes: list[int] = []
        self.docs = []
        for text in texts:
            words = words_of(text)
            for word in words:
                if word not in numbers:
                    numbers[word] = len(numbers)
                    own = units(word, settings)
                    flat.extend(own)
                    sizes.append(len(own))
            self.docs.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        self.flat = np.array(flat, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def buckets(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of ``words`` laid end to end, where each word begins, and how many it has."""
        sizes = self.sizes[words]
        begins = np.cumsum(sizes) - sizes
        within = np.arange(sizes.sum()) - np.repeat(begins, sizes)
        return self.flat[np.repeat(self.starts[words], sizes) + within], begins, sizes


def train(texts: Sequence[str], labels: Sequence[int], settings: Settings) -> Model:
    """Vectors and softmax weights by gradient descent with a falling rate on the cross entropy of each text's most toxic window."""
    bags = _Bags(texts, settings)
    label = np.array(labels, np.int64)
    rng = np.random.default_rng(settings.seed)
    vectors = rng.normal(0, 0.05, (settings.buckets, settings.dim)).astype(np.float32)
    weights = rng.normal(0, 0.5, (settings.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    usable = np.array([i for i, d in enumerate(bags.docs) if len(d)], np.int64)
    step, steps = 0, max(1, settings.epochs * -(-len(usable) // settings.batch))
    for _ in range(settings.epochs):
        shuffled = rng.permutation(usable)
        for at in range(0, len(shuffled), settings.batch):
            chosen = shuffled[at : at + settings.batch]
            windows, owners = [], []
            for own, i in enumerate(chosen):
                doc = bags.docs[i]
                for begin in range(0, len(doc), settings.window):
                    windows.append(doc[begin : begin + settings.window])
                    owners.append(own)
            owner, lengths = np.array(owners), np.array([len(w) for w in windows])
            first = np.cumsum(lengths) - lengths
            distinct, place = np.unique(np.concatenate(windows), return_inverse=True)
            buckets, begins, sizes = bags.buckets(distinct)
            words = np.add.reduceat(vectors[buckets], begins, axis=0) / sizes[:, None]
            means = np.add.reduceat(words[place], first, axis=0) / lengths[:, None]
            logits = means @ weights + bias
            odds = logits[:, 1] - logits[:, 0]
            # The window that speaks for each text: the first of those with the highest odds.
            order = np.lexsort((np.arange(len(odds)), -odds, owner))
            top = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
            shifted = np.exp(logits[top] - logits[top].max(axis=1, keepdims=True))
            error = shifted / shifted.sum(axis=1, keepdims=True)
            error[np.arange(len(top)), label[chosen[owner[top]]]] -= 1
            error /= len(top)
            grad_weights, grad_bias = means[top].T @ error, error.sum(axis=0)
            grad_means = error @ weights.T
            uses = np.concatenate([place[first[w] : first[w] + lengths[w]] for w in top])
            shares = np.repeat(np.arange(len(top)), lengths[top])
            touched, use_of = np.unique(uses, return_inverse=True)
            grad_words = np.zeros((len(touched), settings.dim), np.float32)
            np.add.at(grad_words, use_of, grad_means[shares])
            buckets, _, sizes = bags.buckets(distinct[touched])
            hit, hit_of = np.unique(buckets, return_inverse=True)
            spread = np.repeat(grad_words, sizes, axis=0)
            grad = np.stack([np.bincount(hit_of, spread[:, d]) for d in range(settings.dim)], axis=1)
            rate = settings.rate * (1 - step / steps)
            step += 1
            vectors[hit] -= (rate * grad).astype(np.float32)
            weights -= rate * grad_weights
            bias -= rate * grad_bias
    return Model(vectors @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0]), settings)


class Scorer:
    """Scores texts; the odds of frequent words are kept from text to text."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def _odds(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            value = float(self.model.odds[units(word, self.model.settings)].mean())
            if len(word) <= KEPT_LENGTH:
                if len(self.known) >= KEPT_WORDS:
                    self.known.clear()
                self.known[word] = value
        return value

    def score(self, text: str) -> float:
        words = words_of(text)
        highest = 0.0
        if words:
            known = self.known
            odds = np.array([known[w] if w in known else self._odds(w) for w in words])
            begins = np.arange(0, len(odds), self.model.settings.window)
            highest = float((np.add.reduceat(odds, begins) / np.diff(np.append(begins, len(odds)))).max())
        return float(1 / (1 + np.exp(-np.clip(highest + self.model.bias, -40, 40))))


def held_out(doc_id: Column) -> Column:
    """The rows that training never sees; a row without an id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from: of each class the ``rows_per_class`` ids with the smallest hash.

    Only ids are sorted; texts are fetched for the chosen ids, at most two times ``rows_per_class`` of
    at most ``sample_chars`` characters each (longer ones are left out of the sample, not cut).
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [rows.filter(F.col("toxic") == c).orderBy(*order).limit(settings.rows_per_class) for c in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = (
        texts.filter(F.length("text") <= settings.sample_chars)
        .join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .toArrow()
        .sort_by("doc_id")
    )
    return found["text"].to_pylist(), found["toxic"].to_pylist()


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out.

    Where a class has no rows there is nothing to learn: the model gives every text the share of toxic
    rows, smoothed to stay below one half without any row.
    """
    texts, toxic = labelled_sample(docs, labels, settings)
    if len(set(toxic)) < 2:
        share = (sum(toxic) + 0.5) / (len(toxic) + 2)
        return Model(np.zeros(settings.buckets, np.float32), float(np.log(share / (1 - share))), settings)
    return train(texts, toxic, settings)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text of ``docs``.

    Result: one row per row of ``docs``: doc_id as it is (also null, then held_out is true), held_out,
    score (0 to 1) and predicted (1 from a score of 0.5 on). A text that is null, empty or without letters
    gets the score of the bias alone. Equal texts get equal scores. Other columns are not read; an empty
    table gives an empty result. Memory: the model (1 MB) and one text per task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                rows = whole.slice(at, ROWS_OUT)
                scores = [scorer.score(t or "") for t in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        rows.column(1),
                        pa.array(scores, pa.float64()),
                        pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    ],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, SCHEMA)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they are, whatever their names.

    A score of 0.5 or more is toxic. Null texts stay; an empty text has the score that the model gives to no words.
    Rows that repeat each other stay or go together. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for rows in batches:
            texts = rows.column(at).to_pylist()
            yield rows.filter(pa.array([t is None or scorer.score(t) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
