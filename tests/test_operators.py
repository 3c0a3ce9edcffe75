import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoweave.operators import augment, evaluate, growth, match, morph, norm, objects, outlines, sample, segment, tiles, track


def mask(spark, pixels):
    return spark.createDataFrame([(0, cell, r, c) for cell, r, c in pixels], "frame_id long, cell int, r int, c int")


def square(cell, r0, c0, n=3):
    return [(cell, r0 + r, c0 + c) for r in range(n) for c in range(n)]


def places(df):
    return {(x.r, x.c) for x in df.collect()}


def test_two_overlapping_squares(spark):
    m = mask(spark, square(1, 0, 0) + square(2, 1, 1))
    p = match.intersections(m, m, ["r", "c"]).filter("ta < tb").select("n", match.iou().alias("iou"), match.containment().alias("k")).first()
    assert (p.n, round(p.iou, 9), round(p.k, 9)) == (4, round(4 / 14, 9), round(4 / 9, 9))
    f = objects.flatten(m).agg(F.sum("overlap"), F.sum("interior")).first()
    assert tuple(f) == (4, 10)


def test_erosion_counts_outside_as_unset(spark):
    assert places(morph.erode(mask(spark, square(1, 0, 0)))) == {(1, 1)}


def test_holes_and_components(spark):
    ring = [p for p in square(1, 1, 1) if p[1:] != (2, 2)]
    assert (2, 2) in places(morph.fill_holes(mask(spark, ring), 8, 8))
    two = mask(spark, [(1, 0, 0), (1, 1, 1), (1, 5, 5)])
    assert [morph.components(two, k).select("cell").distinct().count() for k in (1, 2)] == [3, 2]


def test_blur_keeps_a_constant(spark):
    px = spark.createDataFrame([(0, r, c, 2.0) for r in range(5) for c in range(6)], "frame_id long, r int, c int, v double")
    v = [x.v for x in morph.blur(px, 5, 6, 1.5).collect()]
    assert len(v) == 30 and max(abs(x - 2) for x in v) < 1e-9


def test_flat_image_normalises_to_zero(spark):
    px = spark.createDataFrame([(0, k, 7.0) for k in range(9)], "frame_id long, c int, v double")
    for out in (norm.robust_norm(px), norm.minmax_norm(px)):
        assert {x.v for x in out.collect()} == {0.0}


def test_disc_features(spark):
    disc = [(1, r, c) for r in range(31) for c in range(31) if (r - 15) ** 2 + (c - 15) ** 2 <= 100]
    f = objects.shape_features(mask(spark, disc)).first()
    assert abs(f.major - 20) < 0.4 and abs(f.minor - 20) < 0.4 and f.eccentricity < 0.1


def test_greedy_differs_from_optimal(spark):
    p = spark.createDataFrame([(0, 0, 0, 0.9), (0, 0, 1, 0.8), (0, 1, 0, 0.85)], "frame_id long, ta long, tb long, iou double")
    assert [(x.ta, x.tb) for x in match.greedy_match(p).collect()] == [(0, 0)]
    assert match.assign(np.array([[0.9, 0.8], [0.85, 0.0]])) == [1, 0]


@pytest.mark.parametrize("seed", range(20))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    s = rng.random((rng.integers(1, 5), rng.integers(1, 5)))
    n, m = s.shape
    best = max(sum(s[i, j] for i, j in zip(rows, cols, strict=True)) for k in [min(n, m)] for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
    got = match.assign(s)
    assert abs(sum(s[i, j] for i, j in enumerate(got) if j >= 0) - best) < 1e-9
    assert len({j for j in got if j >= 0}) == min(n, m)


def test_average_precision_by_hand(spark):
    hits = spark.createDataFrame([(0, 1, 1), (0, 2, 0), (0, 3, 1)], "g int, k int, hit int")
    curve = match.precision_recall(hits, ["g"], F.lit(2), [F.col("k")])
    assert abs(match.average_precision(curve, ["g"]).first().ap - (0.5 + 0.5 * 2 / 3)) < 1e-9


def test_crossing_and_runs(spark):
    rows = [(1, 5 + k, 3, 12, 5.0, 5.0 - d) for k, d in enumerate((9.0, 4.0, 1.0))]
    p = spark.createDataFrame(rows, "series int, tp int, start int, end int, d_gr double, m_gr double")
    assert growth.crossing(p, F.col("d_gr") - F.col("m_gr")).first().birth == 7
    t = spark.createDataFrame([(1, k) for k in (1, 2, 3, 4, 5, 9, 10)], "series int, tp int")
    assert tuple(evaluate.longest_runs(t, ["series"], "tp").first()) == (1, 1, 4)


def test_tracking_rules(spark):
    same = [(1, tp, cell, x, 0.0) for tp in (0, 1) for cell, x in ((1, 0.0), (2, 500.0))]
    got = track.track(spark.createDataFrame(same, "series long, tp int, cell int, x double, y double")).collect()
    assert {(x.tp, x.cell): x.label for x in got} == {(0, 1): 1, (0, 2): 2, (1, 1): 1, (1, 2): 2}
    score = track.gaussian_score((1.0, 1.0))
    empty, three = (np.zeros(0, int), np.zeros((0, 2))), np.zeros((3, 2))
    plain = lambda x: (x[0].tolist(), x[1])
    assert plain(track.link_frames([empty], three, score, 5, 0.5)) == ([6, 7, 8], 8)
    assert plain(track.link_frames([empty], three, score, 5, 0.5, True)) == ([5, 6, 7], 8)
    assert plain(track.link_frames([(np.array([1]), np.zeros((1, 2)))], three[:0], score, 5, 0.5)) == ([], 5)
    # one label seen twice at other places: the better, the worse or the sum of both counts
    window, now = [(np.array([4]), np.array([[0.0, 0.0]])), (np.array([4]), np.array([[3.0, 0.0]]))], np.array([[0.0, 0.0]])
    assert plain(track.link_frames(window, now, score, 4, 0.5)) == ([4], 4)
    assert plain(track.link_frames(window, now, score, 4, 0.5, reduce=np.minimum)) == ([5], 5)


def test_mother_needs_three_frames_and_takes_the_lowest_of_equals(spark):
    pairs = spark.createDataFrame([(1, tp, m, 2, 0.6) for tp in (1, 2, 3) for m in (1, 3)], "series int, tp int, mother int, bud int, p double")
    seen = spark.createDataFrame([(1, tp, k) for tp in (1, 2, 3) for k in (1, 2, 3)], "series int, tp int, label int")
    got = {(x.tp, x.label): x.mother for x in track.assign_mothers(pairs, seen).collect()}
    assert got[(2, 2)] == 0 and got[(3, 2)] == 1 and got[(3, 1)] == 0


def test_channel_balance():
    assert track.balance([100.0], [110.0]) == [(0, 1, 0, 1)]
    assert track.balance([200.0], [110.0, 110.0]) == [(0, 1, 0, 2)]
    # the walk ends where the side that is behind has nothing left
    assert track.balance([10.0], [100.0, 5.0]) == [] and track.balance([10.0, 90.0], [100.0]) == [(0, 2, 0, 1)]


def test_channel_labels_by_hand():
    assert track.channel_labels([], [100.0, 50.0], 0, 0.1, 20.0) == ([1, 2], [0, 0], 2)
    assert track.channel_labels([(1, 100.0), (2, 50.0)], [110.0, 55.0], 2, 0.1, 5.0) == ([1, 2], [0, 0], 2)
    # a division: the first keeps the label, the second is its daughter
    assert track.channel_labels([(1, 100.0)], [55.0, 55.5], 1, 0.1, 5.0) == ([1, 2], [0, 1], 2)
    # one into three is no division: all are new; what is left over is new as well
    assert track.channel_labels([(1, 100.0)], [37.0, 37.0, 36.5, 90.0], 1, 0.1, 5.0) == ([2, 3, 4, 5], [0, 0, 0, 0], 5)


def test_gp_finds_a_slope(spark):
    v = spark.createDataFrame([(1, t, 3.0 + 2.0 * t) for t in range(20)], "series long, tp int, vol double")
    g = [x.gr for x in growth.gp_growth(v).collect() if 4 <= x.tp < 16]
    assert max(abs(x - 2) for x in g) < 0.2
    assert growth.gp_growth(v.filter("tp < 2")).count() == 0


def test_savgol_keeps_cubics(spark):
    f = lambda i: 1 + i - 0.5 * i * i + 0.01 * i**3
    h = spark.createDataFrame([(1, i, float(f(i))) for i in range(30)], "series int, i int, v double")
    assert max(abs(x.smooth - f(x.i)) for x in growth.savgol(h).collect()) < 1e-6


def test_tiles_and_fade(spark):
    px = spark.createDataFrame([(0, r, c, float(r * 20 + c)) for r in range(20) for c in range(20)], "frame_id long, r int, c int, v double")
    back = tiles.stitch(tiles.cut(px, 8, 4, 4, 4), 8, 4, 4, 4).collect()
    assert len(back) == 400 and max(abs(x.v - (x.r * 20 + x.c)) for x in back) < 1e-9
    one = spark.createDataFrame([(1, 100, 100)], "frame_id long, h int, w int")
    assert tiles.plan(one).first().th is None
    with pytest.raises(ValueError):
        tiles.stitch(px, 3, 2, 1, 1)


def test_splits_keep_groups_together(spark):
    rows = spark.createDataFrame([(k, k % 7) for k in range(70)], "id int, g int")
    split = sample.group_split(rows, ["g"])
    assert split.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_augmentation_round_trips(spark):
    px = spark.createDataFrame([(0, r, c, float(r * 4 + c)) for r in range(4) for c in range(4)], "frame_id long, r int, c int, v double")
    same = lambda a: {(x.r, x.c): round(x.v, 6) for x in a.collect()}
    assert same(augment.flip(augment.flip(px, 4, 4, True), 4, 4, True)) == same(px)
    assert same(augment.rotate(px, 0.0, 4, 4)) == same(px)
    quarter = same(augment.rotate(px, 90.0, 4, 4))
    assert sorted(quarter.values()) == sorted(same(px).values()) and quarter != same(px)
    assert len(same(augment.pad(px, 6, 6, 1, 1))) == 36


def test_outline_of_a_circle(spark):
    n = 8
    angles = [2 * math.pi * k / n for k in range(n)]
    o = spark.createDataFrame([(0, 1, 20.0, 20.0, [10.0] * n, angles)], "frame_id long, cell int, centre_r double, centre_c double, radii array<double>, angles array<double>")
    edge = outlines.rasterise(o, 41, 41)
    assert all(abs(math.hypot(x.r - 20, x.c - 20) - 10) <= 1 for x in edge.collect())


def test_segmentation_drops_the_smaller_of_nested_objects(spark):
    big = [(0, "big", r, c, 0.9) for r in range(2, 8) for c in range(2, 8)]
    small = [(0, "small", r, c, 0.9) for r in range(3, 5) for c in range(3, 5)] + [(0, "small", 10, 10, 0.9)]
    preds = spark.createDataFrame(big + small, "frame_id long, target string, r int, c int, p double")
    groups = [segment.GroupParams(("small",)), segment.GroupParams(("big",), lower=5)]
    got = {(x.grp, x.r, x.c) for x in segment.segment(preds, groups, 12, 12).collect()}
    assert got == {(0, 10, 10)} | {(1, r, c) for r in range(2, 8) for c in range(2, 8)}
    alone = mask(spark, square(1, 0, 0) + square(2, 6, 6))
    assert {x.cell for x in segment.unmatched(alone, mask(spark, square(9, 0, 0)), 0.5).collect()} == {2}


def test_claims_go_by_confidence(spark):
    pairs = spark.createDataFrame([(0, 1, 1, 0.9), (0, 1, 2, 0.8), (0, 2, 2, 0.6)], "frame_id long, ta long, tb long, iou double")
    preds = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.9), (0, 3, 0.7)], "frame_id long, tb long, p double")
    got = {x.tb: x.hit for x in match.claim_hits(pairs, preds, 0.5).collect()}
    assert got == {2: 1, 1: 0, 3: 0}


def test_empty_inputs(spark):
    none = mask(spark, [(1, 0, 0)]).filter("false")
    for df in (morph.dilate(none, 8, 8), morph.erode(none), morph.edges(none, 8, 8), objects.areas(none), objects.shape_features(none), objects.flatten(none), morph.components(none)):
        assert df.count() == 0
