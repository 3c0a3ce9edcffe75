"""Pairs of a table with itself travel packed; same results by brute force."""

import collections
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytoweave import registry
from cytoweave.operators import match, meetings


def test_pairs_are_not_shuffled_as_rows(spark):
    df = spark.createDataFrame([(c, p) for c in range(6) for p in range(c, 6)], "cell long, px int")
    found = match.intersections(df, df, ["px"], (), ordered=True)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 15


@pytest.mark.parametrize("block, chunk", [(1024, 4_000_000), (4, 30)])
def test_pairs_by_frame(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(match, "BLOCK", block)
    monkeypatch.setattr(match, "MEETINGS", 40)
    monkeypatch.setattr(meetings, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    rows = sorted({(int(f), int(c), int(r)) for f in (-3, 2**40) for c in (-(2**62), -7, *range(9), 2**62) for r in range(12) if r == 0 or rng.random() < 0.4})
    df = spark.createDataFrame(rows, "frame_id long, cell long, r int")
    area, at, want = collections.Counter((f, c) for f, c, _ in rows), collections.defaultdict(list), collections.Counter()
    for f, c, r in rows:
        at[f, r].append(c)
    for (f, _), cells in at.items():
        want.update((f, a, b) for a, b in itertools.combinations(sorted(cells), 2))
    found = match.intersections(df, df, ["r"], ordered=True)
    assert found.columns == ["frame_id", "ta", "tb", "n", "area_a", "area_b"]
    got = [tuple(x) for x in found.collect()]
    assert sorted(got) == sorted((f, a, b, n, area[f, a], area[f, b]) for (f, a, b), n in want.items())


def test_objects_told_by_text(spark):
    rows = [("x", "a", 1), ("x", "b", 1), ("x", "b", 2), ("y", "a", 1), ("y", "c", 1)]
    df = spark.createDataFrame(rows, "frame_id string, cell string, r int")
    assert sorted(tuple(x) for x in match.intersections(df, df, ["r"], ordered=True).select("frame_id", "ta", "tb", "n", "area_a", "area_b").collect()) == [("x", "a", "b", 1, 1, 2), ("y", "a", "c", 1, 1, 1)]


def test_a_packed_pair_takes_few_bytes():
    rng, codec = np.random.default_rng(1), pa.Codec("zstd", compression_level=1)
    code = np.unique(rng.integers(0, 400 * 360_000, 5000))
    columns = [code // 360_000, code % 360_000, np.ones(len(code), np.int64), rng.integers(500, 700, 400)[code // 360_000], rng.integers(500, 700, len(code))]
    run = meetings.pack(columns, 2, codec)
    assert len(run) < 5 * len(code)
    for a, b in zip(columns, meetings.unpack(run, 5, 2, codec), strict=True):
        assert (a == b).all()
    ends = [np.array([-(2**63), 2**63 - 1, 0, -1]), np.array([5, -(2**63), 2**63 - 1, 7])]
    for a, b in zip(ends, meetings.unpack(meetings.pack(ends, 1, codec), 2, 1, codec), strict=True):
        assert (a == b).all()


def test_shares_round_as_decimals_do(spark):
    rows = [(n, d) for d in (*range(1, 400), 640, 1280, 2560, 12800, 99_999_999) for n in (1, 2, 3, 7, d // 2, d - 1, d) if 0 < n <= d]
    df = spark.createDataFrame(rows, "n long, d long").select(registry.r6_share(F.col("n"), F.col("d")).alias("a"), registry.r6(F.col("n") / F.col("d")).alias("b"))
    assert df.filter("a <> b").count() == 0 and dict(df.dtypes)["a"] == "double"
