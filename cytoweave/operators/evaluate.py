"""Scores, runs, rankings and comparisons of links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sample


def confusion_counts(pairs: DataFrame, truth: Column, pred: Column, keys: Sequence[str] = (), rollup: bool = False, compat_swapped: bool = False) -> DataFrame:
    """tp, fp, fn, tn of each group (with subtotals if asked); ``compat_swapped`` exchanges fp and fn."""
    count = lambda x: F.count(F.when(x, 1))
    fp, fn = (truth & ~pred, ~truth & pred) if compat_swapped else (~truth & pred, truth & ~pred)
    grouped = pairs.rollup(*keys) if rollup else pairs.groupBy(*keys)
    return grouped.agg(count(truth & pred).alias("tp"), count(fp).alias("fp"), count(fn).alias("fn"), count(~truth & ~pred).alias("tn"))


def rates(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """precision, recall, tnr, accuracy, balanced accuracy and F; null where undefined."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p, r, s = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("tnr", s).withColumn("accuracy", F.try_divide(tp + tn, tp + fp + fn + tn)).withColumn("balanced", (r + s) / 2).withColumn("f", F.try_divide((1 + beta * beta) * p * r, beta * beta * p + r))


def longest_runs(points: DataFrame, keys: Sequence[str], order: str, min_steps: int = 4) -> DataFrame:
    """(keys, start, n): longest run of consecutive values, the first of equals; its last point is left out.

    A run of n steps of 1 counts n points; it needs ``min_steps``.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    island = F.col(order) - F.row_number().over(w)
    runs = points.select(*keys, order).distinct().withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(order).alias("start"), (F.count("*") - 1).alias("n")).filter(F.col("n") >= min_steps)
    best = runs.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("start")).alias("_s"))).alias("b"))
    return best.select(*keys, (-F.col("b._s")).alias("start"), F.col("b.n").alias("n"))


def top_and_bottom(scored: DataFrame, keys: Sequence[str], score: str, tie: str, k: int = 8) -> DataFrame:
    """The k best and k worst of each group, with their rank and side."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))
    worst = F.row_number().over(Window.partitionBy(*keys).orderBy(score, tie))
    ranked = scored.withColumn("_b", best).withColumn("_w", worst)
    side = lambda r, name: ranked.filter(F.col(r) <= k).select(*scored.columns, F.col(r).alias("rank"), F.lit(name).alias("side"))
    return side("_b", "best").union(side("_w", "worst"))


def best_by_minimum(history: DataFrame, model: str, loss: str) -> DataFrame:
    """The model whose lowest loss is lowest (first name on ties)."""
    lowest = history.groupBy(model).agg(F.min(loss).alias(loss))
    return lowest.agg(F.min(F.struct(loss, model)).alias("b")).select(F.col(f"b.{model}").alias(model), F.col(f"b.{loss}").alias(loss))


def fast_enough(models: DataFrame) -> DataFrame:
    """Of models (name, f1, std, seconds) with f1 above best - 0.1 std of the best, the quickest."""
    top = models.agg(F.max(F.struct("f1", "std")).alias("t"))
    return models.crossJoin(F.broadcast(top)).filter(F.col("f1") > F.col("t.f1") - 0.1 * F.col("t.std")).agg(F.min(F.struct("seconds", "name", "f1")).alias("b")).select("b.name", "b.f1", "b.seconds")


def link_index(labels: DataFrame) -> DataFrame:
    """(series, step, label, pos, prev): place of the label one step before, -1 if absent."""
    before = labels.select("series", (F.col("step") + 1).alias("step"), "label", F.col("pos").alias("prev"))
    return labels.join(before, ["series", "step", "label"], "left").withColumn("prev", F.coalesce("prev", F.lit(-1)))


def adjacency(labels: DataFrame) -> DataFrame:
    """(series, step, a, b): places of equal labels in consecutive steps."""
    return link_index(labels).filter("prev >= 0").select("series", "step", F.col("prev").alias("a"), F.col("pos").alias("b"))


def adjacency_difference(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(series, differing): edges that only one of the two labelings has."""
    p, t = adjacency(pred), adjacency(truth)
    return p.exceptAll(t).union(t.exceptAll(p)).groupBy("series").agg(F.count("*").alias("differing"))


def link_accuracy(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(series, accuracy, wrong): share of objects whose link back is right, and their labels where it isn't."""
    p = link_index(pred).select("series", "step", "pos", F.col("prev").alias("p"), F.col("label"))
    t = link_index(truth).select("series", "step", "pos", F.col("prev").alias("t"))
    met = p.join(t, ["series", "step", "pos"])
    return met.groupBy("series").agg(F.avg((F.col("p") == F.col("t")).cast("double")).alias("accuracy"), F.count(F.when(F.col("p") != F.col("t"), 1)).alias("wrong"))


def link_sweep(labels: DataFrame, truth: DataFrame, params: Sequence[str]) -> DataFrame:
    """(params, accuracy, wrong) of labelings under several parameters against one truth, in one job.

    labels: (params, series, step, label, pos); truth: (series, step, label, pos).
    """
    before = labels.select(*params, "series", (F.col("step") + 1).alias("step"), "label", F.col("pos").alias("_p"))
    p = labels.join(before, [*params, "series", "step", "label"], "left").select(*params, "series", "step", "pos", F.coalesce("_p", F.lit(-1)).alias("_p"))
    t = link_index(truth).select("series", "step", "pos", F.col("prev").alias("_t"))
    return p.join(t, ["series", "step", "pos"]).groupBy(*params).agg(F.avg((F.col("_p") == F.col("_t")).cast("double")).alias("accuracy"), F.count(F.when(F.col("_p") != F.col("_t"), 1)).alias("wrong"))


def histogram(values: DataFrame, column: str, lo: float, hi: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins, the last one closed; what lies outside is left out."""
    k = F.least(F.floor((F.col(column) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return values.filter(F.col(column).between(lo, hi)).groupBy(*keys, k.alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(values: DataFrame, x: str, y: str, weight: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin_x, bin_y, w): summed weights in equal bins of two columns, the last one closed."""
    place = lambda c: F.least(F.floor((F.col(c) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    inside = values.filter(F.col(x).between(lo, hi) & F.col(y).between(lo, hi))
    return inside.groupBy(place(x).alias("bin_x"), place(y).alias("bin_y")).agg(F.sum(weight).alias("w"))


def objects_per_split(pairs: DataFrame, splits: Sequence[str] | DataFrame, split: str = "split", labels: str = "labels") -> DataFrame:
    """(split, n): labels of all pairs of each split; splits without pairs count 0.

    splits: their names, or a table with a column of them.
    """
    n = pairs.groupBy(split).agg(F.sum(F.coalesce(F.when(F.size(labels) >= 0, F.size(labels)), F.lit(0))).alias("n"))
    names = splits.select(split).distinct() if isinstance(splits, DataFrame) else pairs.sparkSession.createDataFrame([(x,) for x in splits], f"{split} string")
    return names.join(n, split, "left").select(split, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def validation_summary(frames: DataFrame, best: DataFrame, ap: DataFrame, split: str = "split") -> DataFrame:
    """(split, iou_mean, iou_min, ap): means over the frames of a split, and over all splits (null).

    frames: (frame_id, split); best: (frame_id, iou), one row for each true object,
    0 if it has no match; ap: (frame_id, ap).  A frame without true objects has a
    least IoU of 1 and no mean.
    """
    each = best.groupBy("frame_id").agg(F.avg("iou").alias("_mean"), F.least(F.min("iou"), F.lit(1.0)).alias("_min"))
    met = frames.select("frame_id", split).join(each, "frame_id", "left").join(ap.select("frame_id", "ap"), "frame_id", "left")
    return met.rollup(split).agg(F.avg("_mean").alias("iou_mean"), F.avg(F.coalesce("_min", F.lit(1.0))).alias("iou_min"), F.avg(F.coalesce("ap", F.lit(0.0))).alias("ap"))


def metrics(scored: DataFrame, truth: Column, pred: Column, split: str = "split") -> DataFrame:
    """accuracy, balanced accuracy, precision, recall, F1, F0.5 and F2 of each split."""
    counts = rates(confusion_counts(scored, truth, pred, [split])).withColumnRenamed("f", "f1")
    p, r = F.col("precision"), F.col("recall")
    f = lambda b: F.try_divide((1 + b * b) * p * r, b * b * p + r)
    return counts.select(split, "accuracy", "balanced", "precision", "recall", "f1", f(0.5).alias("f05"), f(2.0).alias("f2"))


def volume_matrix(volumes: DataFrame, times: Sequence[int], label: str = "label", value: str = "vol") -> DataFrame:
    """One row for each (series, label) and one column for each asked time; null where it isn't seen."""
    return volumes.groupBy("series", label).pivot("tp", list(times)).agg(F.first(value))


def best_per_group(stats: DataFrame, keys: Sequence[str], score: str = "iou", order: str = "sigma") -> DataFrame:
    """The row of the highest score of each group (the lowest ``order`` of equals), all columns."""
    others = [c for c in stats.columns if c not in keys]
    top = stats.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(score), -F.col(order))).alias("b"))
    return top.select(*keys, "b.*")


def search_bounds(stats: DataFrame, group: str = "grp", value: str = "p_edge", best: str = "is_best") -> DataFrame:
    """(group, upper): middle of the others' 0.95 quantile and the best ones' 0.25 quantile; where only one kind exists at all, the mean."""
    q = lambda x, at: F.percentile(F.when(x, F.col(value)), F.lit(at))
    kinds = stats.agg(F.bool_and(best).alias("_all"), F.bool_or(best).alias("_any"))
    by = stats.groupBy(group).agg(q(~F.col(best), 0.95).alias("_lo"), q(F.col(best), 0.25).alias("_hi"), F.avg(value).alias("_mean"))
    mixed = F.col("_any") & ~F.col("_all")
    middle = F.coalesce((F.col("_lo") + F.col("_hi")) / 2, "_lo", "_hi")  # a mean leaves out what is missing
    return by.crossJoin(F.broadcast(kinds)).select(group, F.when(mixed, middle).otherwise(F.col("_mean")).alias("upper"))


def group_order(groups: DataFrame, include_budonly: bool = True) -> DataFrame:
    """(name, place): groups by upper bound, then lower bound, both falling; no upper bound comes first."""
    kept = groups if include_budonly else groups.filter(~F.col("budonly"))
    w = Window.orderBy(F.col("upper").desc_nulls_first(), F.desc("lower"), "position")
    return kept.select("name", F.row_number().over(w).alias("place"))


def main_label(volumes: DataFrame, label: str = "label") -> DataFrame:
    """The label seen longest in each series (the lowest of equals)."""
    return volumes.groupBy("series", label).agg(F.count("*").alias("n")).groupBy("series").agg(F.max(F.struct("n", (-F.col(label)).alias("m"))).alias("b")).select("series", (-F.col("b.m")).alias(label), F.col("b.n").alias("frames"))


def _passes(stats: DataFrame, grid: DataFrame) -> Column:
    """Whether an object passes a trial's filters."""
    return stats["area"].between(grid["lower"], grid["upper"]) & (stats["p_edge"] >= grid["p_edge_min"]) & (stats["containment"] <= grid["max_containment"])


def bootstrap_trials(stats: DataFrame, grid: DataFrame, truths: DataFrame, n_boot: int = 10, seed: int = 1, iou_threshold: float = 0.5) -> DataFrame:
    """(param, precision, recall, f1, f05, f2, mean_iou, f1_se): trials' mean scores over resamples of whole examples, in one job.

    stats and grid as ``trial_scores`` takes them; truths: (example, truths), the
    number of true objects of each example.  A trial is made once: a resample
    weighs each example's counts by the times it drew it, so none is gathered.  A
    trial that keeps or hits nothing in a resample scores 0 there, and has no mean
    IoU.  f1_se is the standard error of f1 over the resamples.
    """
    g = F.broadcast(grid)
    kept = stats.join(g, _passes(stats, g))
    best = kept.filter(F.col("iou") >= iou_threshold).groupBy("param", "example", "assignment").agg(F.max("iou").alias("_best"))
    hits = best.groupBy("param", "example").agg(F.count("*").alias("_tp"), F.sum("_best").alias("_iou"))
    each = kept.groupBy("param", "example").agg(F.count("*").alias("_n")).join(hits, ["param", "example"], "left").fillna(0, ["_tp", "_iou"])
    drawn = sample.bootstrap(truths.select("example", "truths"), n_boot, seed, "example")
    owed = drawn.groupBy("boot").agg(F.sum(F.col("copies") * F.col("truths")).alias("_truths"))
    total = lambda c, name: F.sum(F.col("copies") * F.col(c)).alias(name)
    got = each.join(drawn.select("example", "boot", "copies"), "example").groupBy("param", "boot").agg(total("_n", "n"), total("_tp", "tp"), total("_iou", "iou"))
    # every trial with every resample, both a handful of rows
    s = grid.select("param").join(F.broadcast(owed)).join(got, ["param", "boot"], "left").fillna(0, ["n", "tp"])
    p, r = F.coalesce(F.try_divide("tp", "n"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "_truths"), F.lit(0.0))
    f = lambda b: F.coalesce(F.try_divide((1 + b * b) * F.col("precision") * F.col("recall"), b * b * F.col("precision") + F.col("recall")), F.lit(0.0))
    s = s.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f(1.0)).withColumn("f05", f(0.5)).withColumn("f2", f(2.0)).withColumn("mean_iou", F.try_divide("iou", "tp"))
    means = [F.avg(c).alias(c) for c in ("precision", "recall", "f1", "f05", "f2", "mean_iou")]
    return s.groupBy("param").agg(*means, (F.stddev_pop("f1") / F.sqrt(F.count("f1"))).alias("f1_se"))


def trial_scores(stats: DataFrame, grid: DataFrame, truths: int, iou_threshold: float = 0.5, on_base: bool = False) -> DataFrame:
    """(param, tp, n, precision, recall, f1, f05, f2, mean_iou) of each trial of a parameter grid, in one job.

    stats: (example, cell, area, p_edge, containment, assignment, iou); grid:
    (param, lower, upper, p_edge_min, max_containment), a small table.  A trial
    keeps objects with lower <= area <= upper, p_edge >= p_edge_min and containment
    <= max_containment.  ``on_base``: both have a column base, and a trial is made on
    the objects of its base only.
    """
    g = F.broadcast(grid)
    same = stats["base"] == g["base"] if on_base else F.lit(True)
    kept = stats.join(g, same & _passes(stats, g))
    hit = kept.withColumn("hit", F.col("iou") >= iou_threshold)
    best = hit.filter("hit").groupBy("param", "example", "assignment").agg(F.max("iou").alias("best")).groupBy("param").agg(F.count("*").alias("tp"), F.avg("best").alias("mean_iou"))
    n = kept.groupBy("param").agg(F.count("*").alias("n"))
    s = grid.select("param").join(n, "param", "left").join(best, "param", "left").fillna(0, ["n", "tp"])
    p, r = F.try_divide(F.col("tp"), F.col("n")), F.col("tp") / F.lit(float(truths))
    f = lambda b: F.try_divide((1 + b * b) * F.col("precision") * F.col("recall"), b * b * F.col("precision") + F.col("recall"))
    return s.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f(1.0)).withColumn("f05", f(0.5)).withColumn("f2", f(2.0))


def best_params(scores: DataFrame, score: str = "f1") -> DataFrame:
    """The trial of the highest score, the first of equals."""
    return scores.agg(F.max(F.struct(F.col(score), (-F.col("param")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("param"), F.col(f"b.{score}").alias(score))
