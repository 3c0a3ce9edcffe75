"""Sizes: resized frames against dense arithmetic, size groups against a plain search, curves, grids, labels of masks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoweave.operators import augment, learn, norm, objects, outlines, track, tune


def dense(n, size):
    """Bilinear weights (size, n) of places' middles."""
    out = np.zeros((size, n))
    for k in range(size):
        at = min(max((k + 0.5) * n / size - 0.5, 0), n - 1)
        low = int(at)
        out[k, low] += 1 - (at - low)
        if low + 1 < n:
            out[k, low + 1] += at - low
    return out


def test_resize_equals_dense_weights(spark):
    rng = np.random.default_rng(3)
    sizes = {1: (3, 4), 2: (17, 1), 3: (7, 5), 4: (30, 11)}
    a = {f: rng.normal(size=(7, 5)) for f in sizes}
    px = spark.createDataFrame([(f, r, c, float(a[f][r, c])) for f in a for r in range(7) for c in range(5)], "frame_id long, r int, c int, v double")
    size = lambda k: F.create_map(*[F.lit(x) for f in sizes for x in (f, sizes[f][k])])[F.col("frame_id").cast("int")]
    got = {(x.frame_id, x.r, x.c): x.v for x in norm.resize(px, 7, 5, size(0), size(1)).collect()}
    assert len(got) == sum(x * y for x, y in sizes.values())
    masks = norm.resize_masks(px.filter("v > 0").select("frame_id", F.lit(1).alias("cell"), "r", "c"), 7, 5, size(0), size(1))
    near = {(x.frame_id, x.r, x.c) for x in masks.collect()}
    for f, (h, w) in sizes.items():
        want = dense(7, h) @ a[f] @ dense(5, w).T
        assert np.allclose([[got[f, r, c] for c in range(w)] for r in range(h)], want)
        assert {k for k in near if k[0] == f} == {(f, r, c) for r in range(h) for c in range(w) if a[f][(2 * r + 1) * 7 // (2 * h), (2 * c + 1) * 5 // (2 * w)] > 0}


def test_to_pixel_size_stays_within_its_share(spark):
    px = spark.range(40).select(F.col("id").alias("frame_id"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(1.0).alias("v"))
    image, labels = augment.to_pixel_size(px, px.select("frame_id", F.lit(1).alias("cell"), "r", "c"), 1, 1, 1.0, 0.01, 3)
    tall = [x.h for x in image.groupBy("frame_id").agg((F.max("r") + 1).alias("h")).collect()]
    assert len(tall) == 40 and min(tall) >= 95 and max(tall) <= 105 and 5 < tall.count(100) < 35
    assert labels.count() == image.count()


def plain_groups(pairs, sizes, bins, least, share, padding, root, depth):
    f = np.sqrt if root else np.asarray
    pairs = [(e, f(a), f(b), w) for e, a, b, w in pairs]
    sizes = np.array([[f(n) for n in row] for row in sizes], float)
    least = math.sqrt(least) if root else least
    top = max(b for e, _, b, _ in pairs if e == 0)
    pad = max(padding * top, least)

    def level(s, share):
        good = [e for e in range(depth) if len(s) and s[:, e].min() >= least and np.median(s[:, e]) >= share * np.median(s[:, 0])]
        return max(good, default=0)

    def total(ps, t):
        return round(sum(w for _, _, b, w in ps if b < t + pad), 9), round(sum(w for _, a, _, w in ps if a >= t - pad), 9)

    def cut(ps, trials):
        return min(((round(sum(total(ps, t)), 9), k) for k, t in enumerate(trials)))[1]

    at = lambda ps, s: [p for p in ps if p[0] == level(s, share)]
    trials = np.linspace(pad, top - pad, bins)[1:-1]
    first = trials[cut(at(pairs, sizes), trials)]
    low = at([p for p in pairs if p[2] < first + pad], sizes[sizes[:, 0] < first + pad])
    high = at([p for p in pairs if p[1] >= first - pad], sizes[sizes[:, 0] >= first - pad])
    held = [round(sum(p[3] for p in x), 9) for x in (low, high)]
    if held[0] == held[1]:
        held = total(at(pairs, sizes), first)
    trials, side = (np.linspace(pad, first - pad, bins), low) if held[0] > held[1] else (np.linspace(first + pad, top, bins), high)
    one, two = sorted([first, trials[cut(side, trials)]])
    area = lambda x: round(float(x * x if root else x))
    s0, rest = sizes[sizes[:, 0] < one + pad], sizes[sizes[:, 0] >= one - pad]
    return [("small", None, area(one + pad), level(s0, 0)), ("medium", area(one - pad), area(two + pad), level(rest[rest[:, 0] < two + pad], 0)), ("large", area(two - pad), None, level(rest[rest[:, 0] >= two - pad], 0))]


@pytest.mark.parametrize(("seed", "root", "share"), [(1, False, 0.0), (2, True, 0.3), (3, False, 0.6)])
def test_size_groups_equal_a_plain_search(spark, seed, root, share):
    rng = np.random.default_rng(seed)
    n0 = np.concatenate([rng.integers(12, 60, 30), rng.integers(80, 200, 30), rng.integers(250, 500, 20)])
    sizes = [[int(n), int(n * 0.7), int(n * 0.4)] for n in n0]
    pairs = []
    for _ in range(150):
        i, j = rng.choice(len(n0), 2, replace=False)
        for e in range(3):
            a, b = sorted((sizes[i][e], sizes[j][e]))
            pairs.append((e, a, b, round(float(rng.uniform(0, 1)) * (1 - 0.3 * e), 6)))
    s = spark.createDataFrame([(k, e, n) for k, row in enumerate(sizes) for e, n in enumerate(row)], "cell int, e int, n int")
    got = tune.size_groups(spark.createDataFrame(pairs, "e int, area_lo int, area_hi int, frac double"), s, 20, 8, share, 0.03, root, 33)
    rows = [tuple(x) for x in got.collect()]
    assert [r[:4] for r in rows[:3]] == plain_groups(pairs, sizes, 20, 8, share, 0.03, root, 3)
    assert rows[3] == ("buds", None, 33, 0, True)
    with pytest.raises(ValueError, match="padding"):
        tune.size_groups(got, s, padding=0.3)


def test_curve_of_scores_with_ties_and_missing_ones(spark):
    rows = [("a", 0.9, 1.0), ("a", 0.9, 0.0), ("a", 0.5, 1.0), ("a", 0.1, 0.0), ("a", None, 1.0), ("b", 0.3, 0.0), ("b", 0.2, None)]
    c = learn.precision_recall_curve(spark.createDataFrame(rows, "k string, p double, y double"), "y", ["k"])
    got = {(x.k, x.threshold): (x.tp, x.n, x.precision, x.recall) for x in c.collect()}
    assert got == {("a", 0.9): (1, 2, 0.5, 1 / 3), ("a", 0.5): (2, 3, 2 / 3, 2 / 3), ("a", 0.1): (2, 4, 0.5, 2 / 3), ("b", 0.3): (0, 1, 0.0, None), ("b", 0.2): (0, 2, 0.0, None)}


def test_grid_summary_lists_every_point(spark):
    rows = spark.createDataFrame([(float(k % 7), float(k % 7 > 3)) for k in range(80)], "x double, y double")
    model = learn.explore(rows, ["x"], "y", [2, 3], [1, 2], 2)
    got = learn.grid_summary(model, rows).collect()
    assert [g["rank"] for g in got] == [1, 2, 3, 4] and got[0].score == max(model.avgMetrics)
    assert {(g.params["numTrees"], g.params["maxDepth"]) for g in got} == {(a, b) for a in "23" for b in "12"}


def test_labels_of_stored_masks(spark):
    disc = lambda y, x, q: [(r, c) for r in range(30) for c in range(30) if (r - y) ** 2 + (c - x) ** 2 <= q * q]
    masks, frames = [], []
    for t in range(5):
        frames.append((100 + t, 7, t))
        for cell, (y, x, q) in enumerate([(8 + t, 8, 4), (20, 22 - t, 5)] if t % 2 else [(20, 22 - t, 5), (8 + t, 8, 4)], 1):
            hole = (y, x)
            masks += [(100 + t, cell, r, c) for r, c in disc(y, x, q) if (r, c) != hole or t != 2]
    m = spark.createDataFrame(masks, "frame_id long, cell int, r int, c int")
    got = track.label_masks(m, spark.createDataFrame(frames, "frame_id long, series long, tp int"), 30, 30).collect()
    by = {(x.tp, x.cell): x.label for x in got}
    assert len(by) == 10
    assert {by[t, 1 if t % 2 else 2] for t in range(5)} != {by[t, 2 if t % 2 else 1] for t in range(5)}
    assert all(len({by[t, (1 if t % 2 else 2) if k else (2 if t % 2 else 1)] for t in range(5)}) == 1 for k in (0, 1))


def test_redrawn_outlines_are_as_large_as_the_scale_says(spark):
    disc = [(1, 1, r, c) for r in range(30) for c in range(30) if (r - 14) ** 2 + (c - 15) ** 2 <= 64]
    mask = spark.createDataFrame(disc, "frame_id long, cell int, r int, c int")
    drawn, filled = outlines.redraw(outlines.knots(mask, 30, 30), 3.0, 90, 90)
    f = objects.shape_features(filled).first()
    assert abs(f.area / len(disc) / 9 - 1) < 0.12 and abs(f.centroid_r - 42) < 0.6 and abs(f.centroid_c - 45) < 0.6
    assert 0 < drawn.count() < f.area
