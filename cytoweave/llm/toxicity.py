"""Toxicity by weak supervision.

Many voters (lexicons and patterns) each say "toxic" or stay silent; where a
training label is known it is one more voter, which says "toxic" or "other".  A
generative label model finds, from how often voters fire together over all
documents, each voter's rate among toxic and among other documents, the label's
accuracy too, and which voters depend on each other: within either class voters
form a tree of strongest mutual information, and each counts given its parent, so
voters that always fire together count as one.  The model's posteriors are all
that a linear classifier is trained on, on labelled and unlabelled texts; it
scores every document by the words (and beginnings of words) in it.

Labels are used for three things only: which terms make up the lexicons, the
first guess of the share of toxic rows, and as votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import crc_remainder, materialise
from .hashing import SPACE, U, text_bytes

HELD_OUT = (5, 0)
#: Labelled documents that the lexicons and the classifier are fitted on at most, and further documents without label that the classifier is fitted on at most.
TRAIN_ROWS, MORE_ROWS = 16_000, 8_000
#: Terms of the learned lexicon at most; lexicon voters that its words and its word beginnings are dealt to.
LEXICON_TERMS = 4_000
WORD_VOTERS, BEGINNING_VOTERS = 4, 2
#: Odds of toxic over other that a term of the lexicon has at least.
MIN_ODDS = 30
#: Gain in log likelihood (nats) that a term of the lexicon shows at least: far beyond chance over a million terms.
MIN_GAIN = 15.0
BITS = 20
ACCEPT = 0.5
#: Common English insults: the lexicon that needs no labels.
SEED_LEXICON = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "fool", "imbecile", "filth", "vermin")
VOTERS = (*(f"words_{k}" for k in range(WORD_VOTERS)), *(f"beginnings_{k}" for k in range(BEGINNING_VOTERS)), "seed", "seed_twice", "two_words", "word_and_beginning", "shouting", "exclaiming")


@dataclass
class Lexicon:
    """Sorted term hashes and the voter that each belongs to."""

    terms: np.ndarray
    voter: np.ndarray

    def hits(self, found: np.ndarray) -> np.ndarray:
        """Voters of the terms among ``found``."""
        if not len(self.terms) or not len(found):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, found), len(self.terms) - 1)
        return self.voter[at[self.terms[at] == found]]


def learn_lexicon(sample: DataFrame, limit: int = LEXICON_TERMS) -> Lexicon:
    """Terms that mark labelled toxic texts: MIN_ODDS times the odds, and a gain in log likelihood beyond chance.

    ``sample`` is bounded; each distinct text counts once.  Each task counts its
    own terms first.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(linear.terms(text_bytes(t)), y) for t, y in zip(batch["text"], batch["y"], strict=True)]
            for label in (0, 1):
                all_terms = [h for h, y in found if int(y) == label]
                if all_terms:
                    term, n = np.unique(np.concatenate(all_terms), return_counts=True)
                    yield pd.DataFrame({"term": term.view(np.int64), "toxic": n * label, "other": n * (1 - label)})

    texts = sample.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), "y").dropDuplicates(["text"])
    totals = texts.groupBy().agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    toxic, n = float(totals["t"] or 0), float(totals["n"] or 0)
    if not toxic or toxic == n:
        return Lexicon(np.zeros(0, U), np.zeros(0, np.int64))
    counted = texts.mapInPandas(count, "term long, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = (F.col("toxic") / toxic) / ((F.col("other") + 0.5) / (n - toxic))
    seen, share = F.col("toxic") + F.col("other"), toxic / n
    gain = F.col("toxic") * F.log(F.col("toxic") / (seen * share)) + F.when(F.col("other") > 0, F.col("other") * F.log(F.col("other") / (seen * (1 - share)))).otherwise(0.0)
    rows = counted.filter("toxic >= 4").withColumn("gain", gain).filter((odds >= MIN_ODDS) & (F.col("gain") >= MIN_GAIN)).orderBy(F.desc("gain"), "term").limit(limit).select("term").collect()
    found = np.sort(np.array([r["term"] for r in rows], np.int64).view(U))
    whole = (found & U(1)) == 0
    voter = np.where(whole, (found >> U(1)) % U(WORD_VOTERS), U(WORD_VOTERS) + (found >> U(1)) % U(BEGINNING_VOTERS))
    return Lexicon(found, voter.astype(np.int64))


_SEED = np.sort(np.array([linear.word_term(w) for w in SEED_LEXICON], U))


def votes(data: np.ndarray, lexicon: Lexicon) -> int:
    """Which voters fire on a text, as bits in the order of VOTERS."""
    found = linear.terms(data)
    hit = lexicon.hits(found)
    seeds = int(np.isin(_SEED, found).sum())
    upper = int(((data >= 65) & (data <= 90)).sum())
    lower = int(((data >= 97) & (data <= 122)).sum())
    n_words = max(1, int(SPACE[data].sum()) + 1)
    whole = int((hit < WORD_VOTERS).sum())
    fired = np.isin(np.arange(WORD_VOTERS + BEGINNING_VOTERS), hit).tolist()
    fired += [seeds >= 1, seeds >= 2, whole >= 2, 1 <= whole < len(hit), upper > lower, int((data == 33).sum()) > 0.2 * n_words]
    return sum(1 << k for k, x in enumerate(fired) if x)


#: What a label says: nothing, other, toxic.
UNKNOWN, OTHER, TOXIC = 0, 1, 2


@dataclass
class LabelModel:
    """Posterior of toxic for each pattern of votes (rows) and label (columns), with what it rests on.

    ``label_right`` is how often the label says so: of toxic, of other documents;
    ``parent`` is each voter's parent in the tree (-1: none).
    """

    posterior: np.ndarray
    rate_toxic: np.ndarray
    rate_other: np.ndarray
    label_right: tuple[float, float]
    parent: np.ndarray


def _tree(joint: list[np.ndarray], totals: list[float]) -> np.ndarray:
    """Parents in the spanning tree of most mutual information between voters given the class."""
    m = len(joint[0])
    info = np.zeros((m, m))
    for both, total in zip(joint, totals, strict=True):
        total = max(total, 1e-9)
        one = np.diag(both)
        for vi in (0, 1):
            for vj in (0, 1):
                pi, pj = (one if vi else total - one) / total, (one if vj else total - one) / total
                cell = both if vi and vj else one[:, None] - both if vi else one[None, :] - both if vj else total - one[:, None] - one[None, :] + both
                p = np.clip(cell / total, 0, 1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    info += np.nan_to_num(np.where(p > 1e-12, p * np.log(p / np.maximum(pi[:, None] * pj[None, :], 1e-12)), 0.0)) * total
    parent, inside = np.full(m, -1), [0]
    while len(inside) < m:
        outside = [k for k in range(m) if k not in inside]
        k, p = max(((k, p) for k in outside for p in inside), key=lambda e: (info[e], -e[0], -e[1]))
        parent[k] = p
        inside.append(k)
    return parent


def fit_label_model(patterns: np.ndarray, labels: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 40) -> LabelModel:
    """Expectation maximisation over counts of (vote pattern, label), at most 3 * 2^voters.

    The class-conditional tree is found anew in each round; its tables are
    smoothed towards the voter's own rate.
    """
    m = len(VOTERS)
    bits = lambda p: ((p[:, None] >> np.arange(m)) & 1).astype(float)
    x, n = bits(patterns), counts.astype(float)
    share = min(max(prior, 1e-4), 0.5)
    rates = [np.full(m, 0.02), np.full(m, 0.4)]
    for r in rates:  # style voters: no view before the data
        r[-2:] = 0.1
    parent, given, right = np.full(m, -1), [np.stack([r, r]) for r in rates], [0.9, 0.9]

    def evidence(v: np.ndarray, label: np.ndarray) -> np.ndarray:
        up = np.where(parent >= 0, v[:, parent], 0).astype(int)
        total = np.full(len(v), np.log(share / (1 - share)))
        for sign, tables in ((-1, given[0]), (1, given[1])):
            p = tables[up, np.arange(m)]
            total += sign * (v * np.log(p) + (1 - v) * np.log(1 - p)).sum(axis=1)
        told = np.array([0.0, np.log((1 - right[1]) / right[0]), np.log(right[1] / (1 - right[0]))])
        return np.clip(total + told[label], -30, 30)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-evidence(x, labels)))
        weights = [n * (1 - p), n * p]
        share = min(max(weights[1].sum() / max(n.sum(), 1e-9), 1e-4), 0.5)
        joint = [(x * w[:, None]).T @ x for w in weights]
        parent = _tree(joint, [w.sum() for w in weights])
        for y, w in enumerate(weights):
            rates[y] = np.clip((np.diag(joint[y]) + (0.4 if y else 0.01)) / (w.sum() + 1), 1e-5 if not y else 1e-3, 0.999)
            one, up = np.diag(joint[y]), np.maximum(parent, 0)
            fired = joint[y][np.arange(m), up]
            on, off = (fired + 2 * rates[y]) / (one[up] + 2), (one - fired + 2 * rates[y]) / (w.sum() - one[up] + 2)
            given[y] = np.clip(np.where(parent >= 0, np.stack([off, on]), rates[y]), 1e-5, 0.9999)
            said = (w * (labels == (TOXIC if y else OTHER))).sum()
            right[y] = float(np.clip((said + 9) / ((w * (labels != UNKNOWN)).sum() + 10), 0.5, 0.999))
    everything = bits(np.arange(1 << m))
    post = [1 / (1 + np.exp(-evidence(everything, np.full(len(everything), k)))) for k in (UNKNOWN, OTHER, TOXIC)]
    return LabelModel(np.stack(post, axis=1), rates[1], rates[0], (right[1], right[0]), parent)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    label_model: LabelModel
    classifier: linear.LinearModel


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, more_rows: int = MORE_ROWS) -> ToxicityModel:
    """Fit on labels of rows whose crc32(doc_id) mod 5 is not 0.

    Lexicons come from at most ``train_rows`` labelled documents; votes are
    counted over all documents; the classifier is trained on the posteriors of
    the labelled ones and of at most ``more_rows`` others that aren't held out.
    """
    modulus, held = HELD_OUT
    spark = docs.sparkSession
    learnable = crc_remainder(F.col("doc_id"), modulus) != held
    sample = materialise(linear.labelled_sample(docs, labels, "toxic", learnable, train_rows, 1), "labelled")
    lexicon = learn_lexicon(sample)
    shared = spark.sparkContext.broadcast(lexicon)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "pattern": np.array([votes(text_bytes(t), shared.value) for t in batch["text"]], np.int64)})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    said = linear.known_labels(labels, "toxic", learnable).select(F.col("doc_id").cast("long").alias("_id"), F.when(F.col("y") >= 0.5, TOXIC).otherwise(OTHER).alias("label"))
    voted = texts.mapInPandas(vote, "doc_id long, pattern long")
    counted = voted.join(said, F.col("doc_id") == F.col("_id"), "left").groupBy("pattern", F.coalesce("label", F.lit(UNKNOWN)).alias("label")).agg(F.count("*").alias("n")).orderBy("pattern", "label").toPandas()
    prior = sample.agg(F.avg("y")).first()[0]
    model = fit_label_model(counted["pattern"].to_numpy(np.int64), counted["label"].to_numpy(np.int64), counted["n"].to_numpy(), prior or 1e-4)
    posterior = model.posterior

    def soft(data: np.ndarray, label: float) -> float:
        return float(posterior[votes(data, shared.value), UNKNOWN if label != label else TOXIC if label >= 0.5 else OTHER])

    more = linear.unlabelled_sample(docs, labels, "toxic", learnable, more_rows, 2)
    classifier = linear.fit(sample.unionByName(more), linear.term_features, label=soft, bits=BITS, alpha=0.3, l1=1.0, l2=0.5, epochs=2)
    return ToxicityModel(lexicon, model, classifier)


def score_toxicity(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the toxicity (0 to 1) of its whole text.

    Only the text is an input.  Null and empty texts get the score of no terms;
    equal texts get equal scores; an empty table gives none.  Without any toxic
    label the lexicons are empty but for the seed.
    """
    return docs.withColumn(column, model.classifier.scores(docs, F.col("text")))
