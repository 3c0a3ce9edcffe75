"""Sparse linear models on hashed text features, fitted by FTRL-proximal.

Features of a text come from numpy over its bytes.  A model is one dense weight
array of fixed size, so it is the same few hundred KB whatever the corpus, and
scoring is a sparse dot product in a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import KEEP, LOWER, SPACE, U, blocks, mix64, span_hashes, spans, text_bytes

BITS = 18
_KIND = np.zeros(256, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[128:] = 16
_KIND[(_KIND == 0) & ~SPACE] = 8
#: Letters and digits in lower case, all else to a space.
_LETTERS = np.where(_KIND == 8, 0x20, LOWER).astype(np.uint8)
_LETTERS[: 0x20] = 0x20

Features = tuple[np.ndarray, np.ndarray]


def _bag(hashes: np.ndarray, bits: int) -> Features:
    index, count = np.unique((hashes >> U(64 - bits)).astype(np.int64), return_counts=True)
    value = np.log1p(count).astype(np.float32)
    return index, value / max(float(np.sqrt((value * value).sum())), 1e-12)


def _grams(h: np.ndarray, width: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(max(0, len(h) - width + 1), salt, U)
        for k in range(width):
            out = mix64(out * U(0x9FB21C651E98DF25) + h[k : len(h) - width + 1 + k])
    return out


def style_features(data: np.ndarray, bits: int = BITS) -> Features:
    """Hashed word n-grams: of words in lower case (1 and 2) and of word classes (1 to 3).

    A word's class says which kinds of characters it has, its first kind, a final
    punctuation mark and whether it repeats the word before, so that n-grams of
    words never seen still tell prose from tables, shouting and noise.  Either
    half of the features has length 1.
    """
    words, shapes = [], []
    for block in blocks(data):
        start, end = spans(block)
        if not len(start):
            continue
        words.append(span_hashes(LOWER[block], start, end))
        kind = _KIND[block]
        last = block[end - 1]
        shape = np.bitwise_or.reduceat(kind, start).astype(np.int64) | kind[start].astype(np.int64) << 5 | np.where(kind[end - 1] == 8, last, 0).astype(np.int64) << 10
        shapes.append(shape)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    word, shape = np.concatenate(words), np.concatenate(shapes)
    shape[1:] |= (word[1:] == word[:-1]).astype(np.int64) << 20
    shape = mix64(shape.astype(U) + U(77))
    a = _bag(np.concatenate([_grams(word, 1, 1), _grams(word, 2, 2)]), bits - 1)
    b = _bag(np.concatenate([_grams(shape, 1, 11), _grams(shape, 2, 12), _grams(shape, 3, 13)]), bits - 1)
    return np.concatenate([a[0], b[0] + (1 << (bits - 1))]), np.concatenate([a[1], b[1]])


#: Lengths of the word beginnings that count as terms, in bytes.
PREFIXES = (4, 5, 6)


def terms(data: np.ndarray) -> np.ndarray:
    """Distinct hashes of the words of a text (letters and digits, lower case) and of their beginnings.

    The lowest bit tells: 0 for whole words, 1 for beginnings.
    """
    out = []
    for block in blocks(data):
        block = _LETTERS[block]
        start, end = spans(block)
        if not len(start):
            continue
        out.append(span_hashes(block, start, end) & ~U(1))
        for k in PREFIXES:
            longer = end - start > k
            out.append(mix64(span_hashes(block, start[longer], start[longer] + k) + U(k)) | U(1))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def word_term(word: str) -> np.uint64:
    """The term that ``terms`` makes of a whole word."""
    data = _LETTERS[text_bytes(word)]
    return span_hashes(data, np.array([0]), np.array([len(data)]))[0] & ~U(1)


def term_features(data: np.ndarray, bits: int = BITS) -> Features:
    """Which terms occur, hashed; each counts once, however long the text."""
    index = np.unique((terms(data) >> U(64 - bits)).astype(np.int64))
    return index, np.ones(len(index), np.float32)


@dataclass
class LinearModel:
    """A bias and a weight for each hashed feature."""

    weights: np.ndarray
    bias: float
    features: Callable[..., Features]
    bits: int = BITS

    def score(self, data: np.ndarray) -> float:
        index, value = self.features(data, self.bits)
        z = self.bias + float(np.dot(self.weights[index], value))
        return 1.0 / (1.0 + float(np.exp(-max(-40.0, min(40.0, z)))))

    def scores(self, df: DataFrame, text: Column) -> Column:
        """Column of scores of whole texts; null is scored as the empty text."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = shared.value
            for batch in batches:
                yield pd.Series([model.score(text_bytes(t)) for t in batch], dtype="float64")

        return score(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, float]], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, float]:
    """Follow the regularised leader, one example after the other."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    z0 = n0 = 0.0
    bias = 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for index, value, label in examples:
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            bias = -z0 / ((beta + np.sqrt(n0)) / alpha)
            p = 1.0 / (1.0 + np.exp(-np.clip(bias + float(np.dot(w, value)), -40, 40)))
            g = (p - label) * value
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[index], n[index] = zi + g - sigma * w, ni + g * g
            g0 = p - label
            s0 = (np.sqrt(n0 + g0 * g0) - np.sqrt(n0)) / alpha
            z0, n0 = z0 + g0 - s0 * bias, n0 + g0 * g0
    return weights(z, n).astype(np.float32), float(-z0 / ((beta + np.sqrt(n0)) / alpha))


def fit(sample: DataFrame, features: Callable[..., Features], label: Callable[[np.ndarray, float], float] | None = None, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0, epochs: int = 2) -> LinearModel:
    """Fit on a bounded sample (order_key, text, y); ``label`` may turn text and y into a soft label.

    Features are made where the texts are; one task then takes the sample's
    features in order of order_key, so reruns agree.
    """

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, y in zip(batch["order_key"], batch["text"], batch["y"], strict=True):
                data = text_bytes(text)
                index, value = features(data, bits)
                rows.append((key, float(y) if label is None else label(data, float(y)), index.astype(np.int32).tobytes(), value.astype(np.float32).tobytes()))
            yield pd.DataFrame(rows, columns=["order_key", "y", "index", "value"])

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        examples = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y) for b in batches for i, v, y in zip(b["index"], b["value"], b["y"], strict=True)]
        w, bias = ftrl(examples, bits, alpha, beta, l1, l2, epochs)
        yield pd.DataFrame({"weights": [w.tobytes()], "bias": [bias]})

    made = sample.select("order_key", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), F.col("y").cast("double").alias("y"))
    made = made.mapInPandas(featurise, "order_key long, y double, index binary, value binary")
    found = made.repartition(1).sortWithinPartitions("order_key", "y", F.xxhash64("index")).mapInPandas(train, "weights binary, bias double").first()
    if found is None:  # no example at all
        return LinearModel(np.zeros(1 << bits, np.float32), 0.0, features, bits)
    return LinearModel(np.frombuffer(bytes(found["weights"]), np.float32).copy(), float(found["bias"]), features, bits)


def known_labels(labels: DataFrame, column: str, learnable: Column) -> DataFrame:
    """(doc_id, y) of the rows that labels may be learned from; of repeated labels the larger counts.

    Rows with a null id or label are no labels.
    """
    return labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & learnable).groupBy("doc_id").agg(F.max(column).cast("double").alias("y"))


def _by_hash(rows: DataFrame, bound: int, seed: int) -> DataFrame:
    """At most ``bound`` rows of the smallest hashes of doc_id, with the hash as order_key."""
    keyed = rows.withColumn("order_key", F.xxhash64(F.lit(seed), F.col("doc_id")))
    # a first cut by hash leaves about twice the bound to be sorted, however many rows there are
    share = min(1.0, (2.0 * bound + 100) / max(1, rows.count()))
    low = F.col("order_key") <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1) * (1 - 1e-9)))
    return (keyed.filter(low) if share < 1 else keyed).orderBy("order_key", "doc_id").limit(bound)


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One text of each chosen id: that of the smallest hash."""
    met = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # repeated ids fall together before they are shuffled: a task hands on one text of each
    one = met.groupBy("order_key", "doc_id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("one"))
    return one.select("order_key", "one.text", "one.y")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, learnable: Column, bound: int, seed: int) -> DataFrame:
    """(order_key, text, y) of at most ``bound`` labelled ids, chosen by hash, one row for each.

    ``learnable`` says from which rows labels may be learned.  Of repeated ids
    the text of the smallest hash is taken.  The chosen labels number at most
    ``bound``, so they are broadcast to the texts.
    """
    return _texts(docs, _by_hash(known_labels(labels, column, learnable), bound, seed))


def unlabelled_sample(docs: DataFrame, labels: DataFrame, column: str, learnable: Column, bound: int, seed: int) -> DataFrame:
    """As ``labelled_sample``, of ids without a known label that ``learnable`` holds for; y is null."""
    free = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & learnable).join(known_labels(labels, column, learnable), "doc_id", "left_anti").distinct()
    return _texts(docs, _by_hash(free, bound, seed).withColumn("y", F.lit(None).cast("double")))


__all__ = ["KEEP", "LinearModel", "fit", "ftrl", "known_labels", "labelled_sample", "style_features", "term_features", "terms", "unlabelled_sample", "word_term"]
