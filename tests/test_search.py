"""Parameter sets in one job, and the smoothing sweep."""

import math

import numpy as np
from pyspark.sql import functions as F

from cytoweave.operators import evaluate, sample, segment, smooth, tune


def disc(y, x, q, size=40):
    return [(r, c) for r in range(size) for c in range(size) if (r - y) ** 2 + (c - x) ** 2 <= q * q]


def test_parameter_sets_in_one_job_equal_the_loop(spark):
    rng = np.random.default_rng(1)
    truth_px, pred = [], []
    for f in range(2):
        noise = rng.uniform(0, 0.45, (40, 40))
        for k, (y, x, q) in enumerate([(10, 10, 5), (28, 12, 4), (20, 30, 6)], 1):
            for r, c in disc(y, x, q):
                truth_px.append((f, k, r, c))
                noise[r, c] = max(noise[r, c], rng.choice([0.3, 0.7, 0.8, 0.95]))
            for r, c in set(disc(y, x, q + 1)) - set(disc(y, x, q - 1)):
                pred.append((f, "edge", r, c, 0.6))
        pred += [(f, "in", r, c, float(noise[r, c])) for r in range(40) for c in range(40)]
    preds = spark.createDataFrame(pred, "frame_id long, target string, r int, c int, p double")
    truth = spark.createDataFrame(truth_px, "frame_id long, cell int, r int, c int")
    make = lambda t, closing, opening, grow, low=None: segment.GroupParams(("in",), "edge", t, closing, opening, grow, 3, 400, low)
    sets = [make(0.25, 0, 0, 0), make(0.4, 1, 0, 0), make(0.25, 1, 1, 1, 0.1)]
    found = tune.segment_sets(preds, sets, 40, 40).collect()
    for k, p in enumerate(sets):
        want = sorted((x.frame_id, x.cell, x.r, x.c) for x in segment.segment_group(preds, p, 40, 40).collect())
        assert sorted((x.frame_id, x.cell, x.r, x.c) for x in found if x.base == k) == want and want, k
    filters = spark.createDataFrame([(k, float(lo), 400.0, e, 1.0) for k, (lo, e) in enumerate([(1, 0.0), (20, 0.0), (20, 0.3), (60, 0.0)])], "param int, lower double, upper double, p_edge_min double, max_containment double")
    scores = tune.score_sets(preds, truth, sets, filters, 40, 40).cache()
    assert scores.count() == len(sets) * 4
    got = {(x.base, x.param): (x.tp, x.n, x.f1) for x in scores.collect()}
    best = None
    from cytoweave.operators import morph, objects

    for k, p in enumerate(sets):
        masks = segment.segment_group(preds, p, 40, 40).withColumn("grp", F.lit(0))
        edge = preds.filter("target = 'edge'").select("frame_id", "r", "c", F.col("p").alias("v"))
        masks = masks.cache()
        own = masks.select("frame_id", "cell", "grp").distinct().join(objects.edge_scores(morph.edges(masks, 40, 40), edge, 40, 40), ["frame_id", "cell"], "left").fillna(0.0).withColumnRenamed("edge_score", "p_edge")
        for x in evaluate.trial_scores(tune.stat_table(masks, own, truth), filters, 6).collect():
            assert got[k, x.param][:2] == (x.tp, x.n) and (got[k, x.param][2] or 0) == (x.f1 or 0), (k, x.param)
            if best is None or (x.f1 or -1) > best[2]:
                best = (k, x.param, x.f1)
            elif (x.f1 or -1) == best[2]:
                best = min(best, (k, x.param, x.f1))
    assert tune.best_set(scores) == best


def test_smoothing_sweep_feeds_the_model(spark):
    rows = [(f, k, r, c) for f, sizes in enumerate([(2, 4), (6, 9), (12, 16)]) for k, q in enumerate(sizes, 1) for r, c in disc(20, 20, q)]
    masks = spark.createDataFrame(rows, "frame_id long, cell int, r int, c int")
    stats = smooth.smoothing_stats(masks, sigmas=(0.5, 1.0, 2.0, 4.0)).cache()
    assert stats.count() == 6 * 4 * 3
    one = {(x.frame_id, x.cell, x.sigma): x for x in stats.filter("rotation = 0 and scaling = 1").collect()}
    assert one[2, 2, 0.5].iou > 0.99 and one[0, 1, 4.0].iou < one[0, 1, 0.5].iou and one[2, 2, 4.0].iou > 0.9
    assert one[1, 1, 1.0].area == len(disc(20, 20, 6)) and one[1, 1, 1.0].n_edge > 20
    again = smooth.smoothing_stats(masks.repartition(3), sigmas=(0.5, 1.0, 2.0, 4.0))
    assert stats.exceptAll(again).count() == 0
    best = evaluate.best_per_group(stats, ["frame_id", "cell", "rotation", "scaling"], "edge_iou")
    assert best.count() == 18
    assert all(math.isfinite(x) for x in smooth.smoothing_model(smooth.smoothing_stats(masks)))


def test_transformations_by_hand():
    m = np.zeros((21, 21), bool)
    m[6:15, 8:13] = True
    assert np.allclose(smooth.turned(m.astype(float), 0), m) and np.allclose(smooth.scaled(m.astype(float), 1), m)
    quarter = smooth.turned(m.astype(float), 90) > 0.5
    assert (quarter == m.T).all() and smooth.rim(m).sum() == 2 * 9 + 2 * 3
    assert abs((smooth.scaled(m.astype(float), 0.5) > 0.5).sum() - m.sum() / 4) < 8
    assert np.isclose(smooth.blurred(m, 1.0).sum(), m.sum(), rtol=1e-3)


def test_bootstrap_trials_equal_gathered_resamples(spark):
    rng = np.random.default_rng(9)
    stats = spark.createDataFrame([(e, c, int(rng.integers(1, 20)), float(rng.random()), float(rng.random()), int(rng.integers(0, 3)), float(rng.random())) for e in range(15) for c in range(e % 5)], "example int, cell int, area int, p_edge double, containment double, assignment int, iou double")
    truths = spark.createDataFrame([(e, 1 + e % 4) for e in range(15)], "example int, truths int")
    g = tune.grid(spark, lower=[1, 8], upper=[15, 50], p_edge_min=[0.0, 2.0], max_containment=[0.7])
    got = {x.param: x for x in evaluate.bootstrap_trials(stats, g, truths, 4, 3).collect()}
    drawn = sample.draws(sample.bootstrap(truths, 4, 3, "example")).cache()
    want = {}
    for b in range(1, 5):
        here = drawn.filter(F.col("boot") == b)
        again = stats.join(here.select("example", "draw"), "example").withColumn("example", F.col("example") * 100 + F.col("draw"))
        for x in evaluate.trial_scores(again, g, here.agg(F.sum("truths")).first()[0]).collect():
            want.setdefault(x.param, []).append((x.precision or 0, x.recall, x.f1 or 0, x.mean_iou))
    assert set(got) == set(want) == set(range(8))
    for k, rows in want.items():
        assert np.allclose([got[k].precision, got[k].recall, got[k].f1], np.mean([r[:3] for r in rows], axis=0))
        assert np.isclose(got[k].f1_se, np.std([r[2] for r in rows]) / 2)
        seen = [r[3] for r in rows if r[3] is not None]
        assert (got[k].mean_iou is None) if not seen else np.isclose(got[k].mean_iou, np.mean(seen))
    axes, start = {"lower": [1, 8], "p_edge_min": [0.0, 0.5, 2.0]}, {"lower": 1.0, "upper": 50.0, "p_edge_min": 0.0, "max_containment": 0.7}
    for lazy in (False, True):
        best, top = tune.joint_search(stats, truths, axes, start, lazy=lazy, n_boot=4, seed=3)
        one = tune.grid(spark, **{k: [best[k]] for k in ("lower", "upper", "p_edge_min", "max_containment")})
        assert np.isclose(evaluate.bootstrap_trials(stats, one, truths, 4, 3).first().f1, top)
    assert best["p_edge_min"] < 2.0
