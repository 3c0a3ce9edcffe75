"""Hard negatives against brute force, and the bounds of the summaries."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytoweave.llm import negatives


def vectors(table: np.ndarray, labels=None) -> negatives.Vectors:
    short = negatives.summaries(table.astype(float))
    labels = np.zeros(len(table), int) if labels is None else labels
    rows = pa.table({"vec_id": pa.array(range(len(table)), pa.int64()), "label": pa.array(labels, pa.int64()), "v": [r.astype("<i4").tobytes() for r in table], "s": [r.tobytes() for r in short]})
    return negatives.Vectors(rows, table.shape[1])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(1, 400), st.integers(0, 10**6))
def test_every_level_bounds_the_score(dims, size, seed):
    rng = np.random.default_rng(seed)
    x, y = (vectors(rng.integers(-size, size + 1, (12, dims))) for _ in range(2))
    scores = negatives.exact_scores(x, slice(None), y, slice(None))
    slack = 1 + 1e-4 * x.norms.max() * y.norms.max()
    last = None
    for (am, ad), (bm, bd) in zip(x.levels, y.levels, strict=True):
        middle, width = am @ bm.T, ad @ bd.T
        assert (np.abs(scores - middle) <= width + slack).all()
        if last is not None:
            assert (middle + width <= last + slack).all()  # finer levels bound no worse
        last = middle + width
    for low, high in ((-50.0, 50.0), (float(np.quantile(scores, 0.99)), 1e15)):
        left = negatives._survivors(x, np.arange(12), y, slice(0, 12), np.full(12, low), np.full(12, high))
        kept = set(zip(*np.nonzero(left), strict=True)) if isinstance(left, np.ndarray) else set(zip(*left, strict=True))
        assert kept >= set(zip(*np.nonzero((scores >= low) & (scores <= high)), strict=True))


def test_clustered_rows_are_ruled_out_by_summaries():
    rng = np.random.default_rng(5)
    centres = np.repeat(rng.choice([-150, 150], (32, 16)), 4, axis=1)  # one value per segment of four
    rows = vectors(np.repeat(centres, 32, axis=0) + rng.integers(-3, 4, (1024, 64)))
    left = negatives._survivors(rows, np.arange(8), rows, slice(0, 1024), 0.97 * rows.norms[:8] ** 2, np.full(8, 1e15))
    assert isinstance(left, tuple) and 8 * 32 <= len(left[0]) < 8 * 40


@pytest.mark.parametrize("size", [100, 40_000, 20_000_000])
def test_scores_are_exact_at_every_magnitude(size):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-size, size, (2, 5, 64))
    want = [[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in b] for x in a]
    assert negatives.exact_scores(vectors(a), slice(None), vectors(b), slice(None)).tolist() == want


def brute(rows, positives=5, negatives_=10):
    def part(r):
        return r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])

    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in filter(part, rows)]
    dot = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for a in {(i, lab, tuple(v)) for i, lab, v in rows if i % 3 == 0}:
        near = sorted(((-dot(a, b), b[0], b[1] == a[1]) for b in rows if b[0] != a[0]))
        for s, i, _ in [x for x in near if x[2]][:positives]:
            fits = [x for x in near if not x[2] and -30 * s <= -100 * x[0] <= -90 * s][:negatives_]
            out += [(a[0], i, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def test_matches_brute_force_with_ties_nulls_and_hot_labels(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_SLICES", 3)
    rng = random.Random(3)
    rows = [(i, 1 if i % 3 else rng.choice([0, 1, 2, 10**12]), [rng.choice([-0.5, 0.0, 0.25, 1.0, rng.random()]) for _ in range(6)]) for i in range(240)]
    rows += [(300 + k, k % 3, [0.5] * 6) for k in range(40)]  # one very common vector
    rows += [(600, None, [1.0] * 6), (603, 1, None), (606, 1, [1.0, None] * 3), (609, 1, [float("nan")] * 6), (612, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (615, 1, [0.25, 0.5]), (618, 7, []), rows[3], rows[3]]
    made = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label long, embedding array<double>, slice string, s int")
    got = negatives.mine_negatives(made, F.col("vec_id") % 3 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert negatives.mine_negatives(made.filter("false"), F.col("vec_id") % 3 == 0).count() == 0


def test_huge_components_are_an_error(spark):
    rows = spark.createDataFrame([(0, 1, [1e9])], "vec_id long, label long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        negatives.mine_negatives(rows, F.col("vec_id") % 100 == 0).collect()
