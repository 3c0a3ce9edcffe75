"""Parameter search as grids: all trials of a round are one job."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import match, morph, norm, objects, segment
from .evaluate import bootstrap_trials, trial_scores
from .tables import stored


def grid(spark: SparkSession, **values: list[float]) -> DataFrame:
    """(param, ...) of the product of value lists; params count from 0."""
    rows = [(k, *map(float, v)) for k, v in enumerate(itertools.product(*values.values()))]
    return spark.createDataFrame(rows, "param int, " + ", ".join(f"{n} double" for n in values))


def coordinate_search(stats: DataFrame, truths: int, axes: dict[str, list[float]], start: dict[str, float], rounds: int = 3, score: str = "f1") -> tuple[dict[str, float], float]:
    """One axis after the other, the best value of each kept, until a round changes nothing.

    The columns that trials read are stored once.
    """
    stats = stored(stats.select("example", "area", "p_edge", "containment", "assignment", "iou"))
    spark, best, top = stats.sparkSession, dict(start), -1.0
    for _ in range(rounds):
        before = dict(best)
        for axis, values in axes.items():
            options = [float(v) for v in values]
            trials = [{**best, axis: v} for v in options]
            g = spark.createDataFrame([(k, t["lower"], t["upper"], t["p_edge_min"], t["max_containment"]) for k, t in enumerate(trials)], "param int, lower double, upper double, p_edge_min double, max_containment double")
            rows = trial_scores(stats, g, truths).select("param", score).collect()
            found = max(rows, key=lambda r: (r[score] if r[score] is not None else -1.0, -r["param"]))
            if (found[score] or -1.0) > top:
                best, top = trials[found["param"]], found[score]
        if best == before:
            break
    return best, top


def stat_table(masks: DataFrame, scores: DataFrame, truth: DataFrame) -> DataFrame:
    """(example, grp, cell, area, p_edge, containment, assignment, iou, best_assignment) of unfiltered objects.

    masks: (frame_id, grp, cell, r, c); scores: (frame_id, grp, cell, p_edge);
    truth: (frame_id, cell, r, c).  Of overlapping objects of adjacent groups the
    one of the smaller edge score is contained (the lower group's on ties), by the
    share of the smaller object; the last pair in order of (group, lower, upper)
    counts.  ``assignment`` is the true object of largest IoU (the lowest of
    equals, 0 without any), ``best_assignment`` that of greedy one-to-one matching
    (-1: none).
    """
    key = ["frame_id", "grp", "cell"]
    low, up = masks.select(*key, "r", "c"), masks.select("frame_id", (F.col("grp") - 1).alias("grp"), "cell", "r", "c")
    pairs = match.intersections(low, up, ["r", "c"], ("frame_id", "grp")).withColumn("v", match.containment())
    score = lambda cell, name, shift: scores.select("frame_id", (F.col("grp") - shift).alias("grp"), F.col("cell").alias(cell), F.col("p_edge").alias(name))
    met = pairs.join(score("ta", "_a", 0), ["frame_id", "grp", "ta"]).join(score("tb", "_b", 1), ["frame_id", "grp", "tb"])
    upper = F.col("_a") > F.col("_b")
    lost = met.select("frame_id", F.when(upper, F.col("grp") + 1).otherwise(F.col("grp")).alias("_g"), F.when(upper, F.col("tb")).otherwise(F.col("ta")).alias("cell"), F.struct("grp", "ta", "tb").alias("_o"), "v")
    lost = lost.groupBy("frame_id", F.col("_g").alias("grp"), "cell").agg(F.max_by("v", "_o").alias("containment"))
    # objects of all groups meet the truth under one number of their own
    one = masks.select("frame_id", F.struct("grp", "cell").alias("cell"), "r", "c")
    hits = match.intersections(one, truth, ["r", "c"]).withColumn("iou", match.iou())
    best = hits.groupBy("frame_id", F.col("ta.grp").alias("grp"), F.col("ta.cell").alias("cell")).agg(F.max_by(F.struct(F.col("tb").alias("assignment"), "iou"), F.struct("iou", -F.col("tb"))).alias("_m"))
    number = masks.select(*key).distinct().withColumn("_p", F.row_number().over(Window.partitionBy("frame_id").orderBy("grp", "cell")))
    numbered = hits.select("frame_id", F.col("ta.grp").alias("grp"), F.col("ta.cell").alias("cell"), F.col("tb"), "iou").join(number, key).select("frame_id", F.col("_p").alias("ta"), "tb", "iou")
    greedy = match.greedy_match(numbered).select("frame_id", F.col("ta").cast("int").alias("_p"), F.col("tb").cast("int").alias("best_assignment"))
    out = masks.groupBy(*key).agg(F.count("*").alias("area")).join(scores.select(*key, "p_edge"), key).join(lost, key, "left").join(best, key, "left").join(number, key).join(greedy, ["frame_id", "_p"], "left")
    return out.select(
        F.col("frame_id").alias("example"),
        "grp",
        "cell",
        "area",
        "p_edge",
        F.coalesce("containment", F.lit(0.0)).alias("containment"),
        F.coalesce("_m.assignment", F.lit(0)).alias("assignment"),
        F.coalesce("_m.iou", F.lit(0.0)).alias("iou"),
        F.coalesce("best_assignment", F.lit(-1)).alias("best_assignment"),
    )


_PARAMS = ("lower", "upper", "p_edge_min", "max_containment")


def _values(stats: DataFrame, trials: list[dict[str, float]], truths: int | DataFrame, score: str, n_boot: int, seed: int) -> list[float]:
    """Scores of trials, all made in one job, -1 where undefined; with ``n_boot`` means over resamples."""
    g = stats.sparkSession.createDataFrame([(k, *(float(t[x]) for x in _PARAMS)) for k, t in enumerate(trials)], "param int, " + ", ".join(f"{x} double" for x in _PARAMS))
    scores = bootstrap_trials(stats, g, truths, n_boot, seed) if n_boot else trial_scores(stats, g, truths)
    found = {r["param"]: r[score] for r in scores.select("param", score).collect()}
    return [-1.0 if found.get(k) is None else found[k] for k in range(len(trials))]


def joint_search(stats: DataFrame, truths: int | DataFrame, axes: dict[str, list[float]], start: dict[str, float], score: str = "f1", lazy: bool = False, n_boot: int = 0, seed: int = 1) -> tuple[dict[str, float], float]:
    """Best parameters by three rounds: each axis from ``start``, each pair of axes from these, all mixtures of what was best.

    Every round's trials are one job, whatever the number of axes.  ``lazy`` tries
    each axis once more from the first round's best instead of pairs and mixtures.
    With ``n_boot``, scores are means over so many resamples of the examples, and
    truths is a table (example, truths); else it is the number of true objects.
    """

    def value(trials: list[dict[str, float]]) -> list[float]:
        return _values(stats, trials, truths, score, n_boot, seed)

    def by_axis(base: dict[str, float]) -> dict[str, float]:
        trials = [(k, v) for k, values in axes.items() for v in values]
        got = value([{**base, k: v} for k, v in trials])
        best = {}
        for k, group in itertools.groupby(range(len(trials)), key=lambda i: trials[i][0]):
            best[k] = trials[max(group, key=lambda i: (got[i], -i))][1]
        return {**base, **best}

    base = by_axis(start)
    if lazy:
        base = by_axis(base)
        return base, max(value([base])[0], 0.0)
    kept = {k: [base[k]] for k in axes}
    pairs = [((a, b), (x, y)) for a, b in itertools.combinations(axes, 2) for x in axes[a] for y in axes[b]]
    got = value([{**base, **dict(zip(names, v, strict=True))} for names, v in pairs])
    for names, group in itertools.groupby(range(len(pairs)), key=lambda i: pairs[i][0]):
        for name, v in zip(names, pairs[max(group, key=lambda i: (got[i], -i))][1], strict=True):
            if v not in kept[name]:
                kept[name].append(v)
    trials = [{**base, **dict(zip(kept, v, strict=True))} for v in itertools.product(*kept.values())]
    got = value(trials)
    top = max(range(len(trials)), key=lambda i: (got[i], -i))
    return trials[top], max(got[top], 0.0)


def segment_sets(preds: DataFrame, sets: Sequence[segment.GroupParams], h: int, w: int) -> DataFrame:
    """(base, frame_id, cell, r, c): one group's objects by each of several parameter sets, in one job.

    Parameters are a small table that frames meet once, so a trial is a (set,
    frame) pair like any other frame.  Sets share members, edge map and connectivity.
    """
    first = sets[0]
    if any((p.members, p.edge, p.connectivity) != (first.members, first.edge, first.connectivity) for p in sets):
        raise ValueError("parameter sets must share members, edge map and connectivity")
    table = preds.sparkSession.createDataFrame([(k, float(p.threshold or 0.5), p.closing, p.opening, p.grow, float(p.lower), math.inf if p.upper is None else float(p.upper), p.edge_min) for k, p in enumerate(sets)], "base int, threshold double, closing int, opening int, grow int, lower double, upper double, edge_min double")
    inside = norm.group_prediction(preds, first.members).withColumnRenamed("p", "v")
    edge = preds.filter(F.col("target") == first.edge).select("frame_id", "r", "c", F.col("p").alias("v")) if first.edge else None
    if edge is not None:
        inside = norm.dampen_edges(inside, edge)
    # a trial's frame: the frames of all sets side by side
    trial = (F.col("frame_id") * len(sets) + F.col("base")).alias("frame_id")
    of = lambda df: df.withColumn("base", F.pmod("frame_id", F.lit(len(sets))).cast("int"))
    cells = morph.components(inside.join(F.broadcast(table)).filter(F.col("v") > F.col("threshold")).select(trial, "r", "c"), first.connectivity)
    places = ["frame_id", "cell", "r", "c"]

    def repeat(cells: DataFrame, times: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        for k in range(max(getattr(p, times) for p in sets)):
            told = of(cells).join(F.broadcast(table.select("base", times)), "base")
            cells = step(told.filter(F.col(times) > k).select(*places)).select(*places).union(told.filter(F.col(times) <= k).select(*places))
        return cells

    widen, narrow = (lambda x: morph.dilate(x, h, w)), morph.erode
    for times, steps in (("closing", (widen, narrow)), ("opening", (narrow, widen)), ("grow", (widen,))):
        for step in steps:
            cells = repeat(cells, times, step)
    cells = stored(cells)
    kept = of(objects.areas(cells)).join(F.broadcast(table), "base").filter((F.col("area") >= F.col("lower")) & (F.col("area") < F.col("upper")))
    if edge is not None:
        trials = edge.join(F.broadcast(table.select("base"))).select(trial, "r", "c", "v")
        scores = objects.edge_scores(morph.edges(cells, h, w), trials, h, w)
        kept = kept.join(scores, ["frame_id", "cell"], "left").filter(F.col("edge_min").isNull() | (F.col("edge_score") > F.col("edge_min")))
    found = of(cells.join(kept.select("frame_id", "cell"), ["frame_id", "cell"], "left_semi"))
    return found.select("base", F.expr(f"(frame_id - base) div {len(sets)}").alias("frame_id"), "cell", "r", "c")


def score_sets(preds: DataFrame, truth: DataFrame, sets: Sequence[segment.GroupParams], filters: DataFrame, h: int, w: int) -> DataFrame:
    """(base, param, tp, n, precision, recall, f1, f05, f2, mean_iou) of every filter on every parameter set, in one job.

    truth: (frame_id, cell, r, c); filters: (param, lower, upper, p_edge_min,
    max_containment), a small table.
    """
    found = segment_sets(preds, sets, h, w)
    n = len(sets)
    masks = stored(found.select((F.col("frame_id") * n + F.col("base")).alias("frame_id"), F.lit(0).alias("grp"), "cell", "r", "c"))
    edge = preds.filter(F.col("target") == sets[0].edge).select("frame_id", "r", "c", F.col("p").alias("v")) if sets[0].edge else preds.limit(0).select("frame_id", "r", "c", F.col("p").alias("v"))
    bases = F.broadcast(preds.sparkSession.range(n).select(F.col("id").cast("int").alias("base")))
    every = lambda df, *more: df.join(bases).select((F.col("frame_id") * n + F.col("base")).alias("frame_id"), *more)
    scores = masks.select("frame_id", "grp", "cell").distinct().join(objects.edge_scores(morph.edges(masks, h, w), every(edge, "r", "c", "v"), h, w).withColumnRenamed("edge_score", "p_edge"), ["frame_id", "cell"], "left").fillna(0.0, ["p_edge"])
    stats = stat_table(masks, scores.select("frame_id", "grp", "cell", "p_edge"), every(truth, "cell", "r", "c")).withColumn("base", F.pmod("example", F.lit(n)).cast("int"))
    # a set's filters are parameters of its own, so that one join tries them all
    trials = F.broadcast(filters.join(bases).select("base", "param", "lower", "upper", "p_edge_min", "max_containment"))
    truths = truth.select("frame_id", "cell").distinct().count()
    keyed = trials.withColumn("param", F.struct("base", "param"))
    return trial_scores(stats, keyed, truths, on_base=True).select("param.base", "param.param", "tp", "n", "precision", "recall", "f1", "f05", "f2", "mean_iou")


def best_set(scores: DataFrame, score: str = "f1") -> tuple[int, int, float]:
    """(base, param, score) of the highest score, the lowest base and then the lowest param of equals."""
    top = scores.agg(F.max(F.struct(F.coalesce(F.col(score), F.lit(-1.0)).alias("s"), (-F.col("base")).alias("b"), (-F.col("param")).alias("p"))).alias("t")).first()["t"]
    return -top["b"], -top["p"], top["s"]


def base_grid_search(tables: dict[int, DataFrame], truths: int, axes: dict[str, list[float]], start: dict[str, float], score: str = "f1") -> tuple[int, dict[str, float], float]:
    """Of several base parameter sets, each with its stat table, the one whose filters score best (the first of equals)."""
    best = None
    for k, stats in tables.items():
        found, top = coordinate_search(stats, truths, axes, start, 2, score)
        if best is None or top > best[2]:
            best = (k, found, top)
    return best


def refit(best: DataFrame, tables: DataFrame, truths: int, axes: dict[str, list[float]], start: dict[str, float], score: str = "f1") -> tuple[dict[str, float], float]:
    """Filters searched anew on the objects that each group's best base set gives.

    best: (grp, base); tables: stat tables of all base sets with a column base.
    """
    return joint_search(tables.join(F.broadcast(best), ["grp", "base"], "left_semi"), truths, axes, start, score)


def best_per_base(scores: DataFrame, score: str = "f1") -> DataFrame:
    """(grp, base) of the highest score of each group, the lowest base of equals."""
    return scores.groupBy("grp").agg(F.max_by("base", F.struct(F.col(score), -F.col("base"))).alias("base"))


def size_overlaps(rows: DataFrame, place: Sequence[str]) -> DataFrame:
    """(area_lo, area_hi, frac): overlaps of all pairs of objects by their sizes; rows (cell, place), each once.

    A pair's overlap by its smaller size is a sum over the places that it shares, so
    for sums of it no pair is counted: a place tells how many of its objects have
    each size, and each two sizes of a place make a row.
    """
    sizes = rows.groupBy("cell").agg(F.count("*").alias("_a"))
    here = rows.dropna(subset=list(place)).join(sizes, "cell").groupBy(*place, "_a").agg(F.count("*").alias("_k"))
    small, large = here.withColumnsRenamed({"_a": "area_lo", "_k": "_l"}), here.withColumnsRenamed({"_a": "area_hi", "_k": "_h"})
    met = small.join(large, list(place)).filter("area_lo <= area_hi")
    n = F.when(F.col("area_lo") < F.col("area_hi"), F.col("_l") * F.col("_h")).otherwise(F.col("_l") * (F.col("_l") - 1) / 2)
    return met.select("area_lo", "area_hi", (n / F.col("area_lo")).alias("frac"))


def _by_size(pairs: DataFrame, thresholds: DataFrame, padding: float) -> DataFrame:
    """Pairs summed by the smaller size and by the thresholds that the larger one lies below, before these are tried."""
    below = sum((F.coalesce(F.col("area_hi") < float(x["t"]) + padding, F.lit(False)).cast("int") for x in thresholds.dropna().select("t").distinct().collect()), F.lit(0))
    return pairs.groupBy("area_lo", below.alias("_below")).agg(F.min("area_hi").alias("area_hi"), F.sum("frac").alias("frac"))


def two_cuts(pairs: DataFrame, thresholds: DataFrame, padding: float) -> DataFrame:
    """(lower_cut, upper_cut, cost): the two size thresholds that leave least overlap within three groups.

    pairs: (area_lo, area_hi, frac); thresholds: (t), a small table.  A pair counts
    once for each group that both of its objects fall in, groups being widened by
    the padding.  Of equal costs the lowest cuts win.
    """
    t = thresholds.alias("a").join(thresholds.alias("b"), F.col("a.t") < F.col("b.t")).select(F.col("a.t").alias("lower_cut"), F.col("b.t").alias("upper_cut"))
    lo, hi, a, b = F.col("area_lo"), F.col("area_hi"), F.col("lower_cut"), F.col("upper_cut")
    times = (hi < a + padding).cast("int") + ((lo >= a - padding) & (hi < b + padding)).cast("int") + (lo >= b - padding).cast("int")
    cost = _by_size(pairs, thresholds, padding).crossJoin(F.broadcast(t)).groupBy("lower_cut", "upper_cut").agg(F.round(F.sum(F.col("frac") * times), 6).alias("cost"))
    return cost.agg(F.min(F.struct("cost", "lower_cut", "upper_cut")).alias("b")).select("b.lower_cut", "b.upper_cut", "b.cost")


def best_split(costs: DataFrame) -> DataFrame:
    """(t, cost) of the least cost of ``overlap_threshold``, the lowest t of equals."""
    return costs.agg(F.min(F.struct("cost", "t")).alias("b")).select("b.t", "b.cost")


def best_level(sizes: DataFrame, smallest: float = 1, median_share: float = 0.0) -> DataFrame:
    """(level): the deepest erosion at which every object keeps ``smallest`` pixels and the median ``median_share`` of its first value; 0 if none.

    sizes: (cell, e, n) for the levels e = 0, 1, ...
    """
    by = erosion_level(sizes, smallest)
    first = by.filter("e = 0").select(F.col("median").alias("_first"))
    good = by.crossJoin(F.broadcast(first)).filter(F.col("keeps") & (F.col("median") >= F.col("_first") * median_share))
    return good.agg(F.coalesce(F.max("e"), F.lit(0)).cast("int").alias("level"))


def fit_smoothing(best: DataFrame, size: str = "n_edge", sigma: str = "sigma") -> tuple[float, float, float]:
    """(a, b, c) of sigma = log(max((n - c) / a, 1)) / b, fitted to the best sigmas of objects.

    exp(b sigma) a + c = n is fitted by Gauss-Newton; the sums of its normal
    equations are one aggregate a step, so objects stay where they are.  Starts
    from the straight line through log(n) over sigma.
    """
    line = best.filter(F.col(size) > 1).agg(F.regr_slope(F.log(size), F.col(sigma)).alias("s"), F.regr_intercept(F.log(size), F.col(sigma)).alias("i")).first()
    if line is None or line["s"] is None:
        raise ValueError("too few objects to fit a smoothing model")
    a, b, c = math.exp(line["i"]), max(line["s"], 1e-3), 0.0
    x, y = F.col(sigma), F.col(size)
    for _ in range(30):
        e = F.exp(F.lit(b) * x)
        part = (e, F.lit(a) * x * e, F.lit(1.0))
        off = y - (F.lit(a) * e + F.lit(c))
        sums = best.agg(*[F.sum(p * q).alias(f"h{i}{j}") for i, p in enumerate(part) for j, q in enumerate(part)], *[F.sum(p * off).alias(f"g{i}") for i, p in enumerate(part)]).first()
        h = np.array([[sums[f"h{i}{j}"] for j in range(3)] for i in range(3)], float) + 1e-9 * np.eye(3)
        move = np.linalg.lstsq(h, np.array([sums[f"g{i}"] for i in range(3)], float), rcond=None)[0]
        a, b, c = a + move[0], b + move[1], c + move[2]
        if np.abs(move).max() < 1e-9:
            break
    return float(a), float(b), float(c)


def overlap_threshold(pairs: DataFrame, thresholds: DataFrame, padding: float) -> DataFrame:
    """(t, cost) of each size threshold: summed overlap of pairs that fall in one of its two groups.

    pairs: (area_lo, area_hi, frac); thresholds: (t), a small table.
    """
    t = F.broadcast(thresholds)
    same = (F.col("area_hi") < F.col("t") + padding) | (F.col("area_lo") >= F.col("t") - padding)
    return _by_size(pairs, thresholds, padding).crossJoin(t).groupBy("t").agg(F.round(F.sum(F.when(same, F.col("frac")).otherwise(0.0)), 6).alias("cost"))


def erosion_level(sizes: DataFrame, smallest: float = 1) -> DataFrame:
    """(e, least, median, keeps) of each erosion level: whether every object keeps ``smallest`` pixels; sizes: (cell, e, n)."""
    ok = sizes.groupBy("e").agg(F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"))
    return ok.withColumn("keeps", F.col("least") >= smallest)


def size_groups(pairs: DataFrame, sizes: DataFrame, bins: int = 30, least: float = 10, median_share: float = 0.0, padding: float = 0.03, root: bool = False, bud_limit: int | None = None) -> DataFrame:
    """(grp, lower, upper, erosions, budonly): three groups by size, cut where objects of a group overlap least.

    pairs: (e, area_lo, area_hi, frac), overlapping pairs at erosion levels e = 0, 1,
    ...; sizes: (cell, e, n).  A first cut of ``bins`` - 2 trials over all sizes, then
    one of ``bins`` trials within the side that overlaps more.  Each looks at the
    deepest erosion at which every object keeps ``least`` pixels and the median
    ``median_share`` of its first value.  Groups reach beyond a cut by ``padding``
    times the largest size, or by ``least``.  ``erosions`` is the deepest level that
    leaves each object of the group ``least`` pixels.  ``root`` looks at roots of
    areas; ``bud_limit`` adds a group of buds up to that size.  Of equal trials the
    first counts; a null bound is none.
    """
    if not 0 <= padding <= 0.25:
        raise ValueError("padding must be between 0 and 0.25")
    measure = F.sqrt if root else lambda c: F.col(c).cast("double")
    least = math.sqrt(least) if root else float(least)
    pairs = stored(pairs.select("e", measure("area_lo").alias("area_lo"), measure("area_hi").alias("area_hi"), "frac"))
    whole = F.max(F.when(F.col("e") == 0, F.col("n"))).over(Window.partitionBy("cell"))
    sizes = stored(sizes.select("cell", "e", measure("n").alias("n")).withColumn("n0", whole))
    top = pairs.filter("e = 0").agg(F.max("area_hi")).first()[0]
    if top is None:
        raise ValueError("no objects overlap")
    pad, spark = max(padding * top, least), pairs.sparkSession

    def below(t: float, c: str) -> Column:
        return F.col(c) < t + pad

    def above(t: float, c: str) -> Column:
        return F.col(c) >= t - pad

    def at_depth(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
        return pairs.filter(F.col("e") == best_level(sizes, least, median_share).first()[0])

    def cut(pairs: DataFrame, trials: np.ndarray) -> tuple[float, float, float]:
        """Trial of the least sum of overlaps on both sides, and the two sums."""
        t = spark.createDataFrame([(k, float(x)) for k, x in enumerate(trials)], "k int, t double")
        side = lambda on: F.round(F.coalesce(F.sum(F.when(on, F.col("frac"))), F.lit(0.0)), 9)
        low, high = side(F.col("area_hi") < F.col("t") + pad), side(F.col("area_lo") >= F.col("t") - pad)
        sums = F.broadcast(t).join(pairs, how="left").groupBy("k", "t").agg(low.alias("low"), high.alias("high"))
        best = sums.agg(F.min(F.struct(F.round(F.col("low") + F.col("high"), 9), "k", "t", "low", "high")).alias("b")).first()["b"]
        return best["t"], best["low"], best["high"]

    first, low, high = cut(at_depth(pairs, sizes), np.linspace(pad, top - pad, bins)[1:-1])
    sides = [at_depth(pairs.filter(below(first, "area_hi")), sizes.filter(below(first, "n0"))), at_depth(pairs.filter(above(first, "area_lo")), sizes.filter(above(first, "n0")))]
    held = [round(x.agg(F.sum("frac")).first()[0] or 0.0, 9) for x in sides]
    if held[0] == held[1]:
        held = [low, high]
    trials = np.linspace(pad, first - pad, bins) if held[0] > held[1] else np.linspace(first + pad, top, bins)
    one, two = sorted([first, cut(sides[0] if held[0] > held[1] else sides[1], trials)[0]])
    area = lambda x: round(x * x if root else x)
    level = lambda on: best_level(sizes.filter(on), least).first()[0]
    groups = [
        ("small", None, area(one + pad), level(below(one, "n0")), False),
        ("medium", area(one - pad), area(two + pad), level(above(one, "n0") & below(two, "n0")), False),
        ("large", area(two - pad), None, level(above(one, "n0") & above(two, "n0")), False),
    ]
    if bud_limit is not None:
        groups.append(("buds", None, bud_limit, 0, True))
    return spark.createDataFrame(groups, "grp string, lower int, upper int, erosions int, budonly boolean")
