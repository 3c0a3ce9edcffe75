"""Pairing objects: intersections, greedy and optimal matching, precision and recall."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fold, meetings

#: Objects of a place that stand in one list, and meetings that one task counts.
BLOCK, MEETINGS = 1024, 4_000_000


def intersections(a: DataFrame, b: DataFrame, place: Sequence[str], key: Sequence[str] = ("frame_id",), ordered: bool = False) -> DataFrame:
    """(key, ta, tb, n, area_a, area_b): pairs of objects that share places, with counts.

    Only objects that meet in a place make a row; the join is on the place, so no
    pair is enumerated that doesn't share one.  ``ordered`` gives ta < tb only, for
    a table with itself; pairs of objects told by whole numbers are counted by
    ``meetings.counted``.
    """
    if ordered and meetings.countable(a, key):
        return meetings.counted(a, place, key, BLOCK, MEETINGS)
    on = [*key, *place]
    left, right = a.select(*on, F.col("cell").alias("ta")), b.select(*on, F.col("cell").alias("tb"))
    met = left.join(right, on)
    n = (met.filter("ta < tb") if ordered else met).groupBy(*key, "ta", "tb").agg(F.count("*").alias("n"))
    # areas are what a join keeps at hand, never the pairs
    area = lambda df, cell, name: df.groupBy(*key, cell).agg(F.count("*").alias(name)).hint("shuffle_hash")
    return n.join(area(left, "ta", "area_a"), [*key, "ta"]).join(area(right, "tb", "area_b"), [*key, "tb"])


def iou() -> Column:
    return F.col("n") / (F.col("area_a") + F.col("area_b") - F.col("n"))


def containment() -> Column:
    return F.greatest(F.col("n") / F.col("area_a"), F.col("n") / F.col("area_b"))


def box_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of objects of a frame whose bounding boxes (r0, c0, r1, c1, ends exclusive) overlap."""
    x, y = a.alias("x"), b.alias("y")
    meet = (F.col("x.frame_id") == F.col("y.frame_id")) & (F.col("x.r0") < F.col("y.r1")) & (F.col("y.r0") < F.col("x.r1")) & (F.col("x.c0") < F.col("y.c1")) & (F.col("y.c0") < F.col("x.c1"))
    return x.join(y, meet).select("x.frame_id", F.col("x.cell").alias("ta"), F.col("y.cell").alias("tb"))


def greedy_match(pairs: DataFrame, key: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Best pairs first, each side used once: (key, ta, tb, iou); of equals the lowest ta, then tb.

    Pairs of a frame stand in order in one partition and are walked once; only a
    frame's claimed objects are kept at hand.
    """
    names = dict(pairs.dtypes)
    schema = ", ".join(f"{k} {names[k]}" for k in key) + ", ta long, tb long, iou double"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen_a, seen_b = None, set(), set()
        for batch in batches:
            keep = []
            for k, (frame, ta, tb) in enumerate(zip(zip(*[batch[c] for c in key], strict=True), batch["ta"], batch["tb"], strict=True)):
                if frame != now:
                    now, seen_a, seen_b = frame, set(), set()
                if ta not in seen_a and tb not in seen_b:
                    seen_a.add(ta)
                    seen_b.add(tb)
                    keep.append(k)
            yield batch.iloc[keep]

    rows = pairs.select(*key, F.col("ta").cast("long").alias("ta"), F.col("tb").cast("long").alias("tb"), F.col("iou").cast("double").alias("iou")).filter("iou > 0")
    return fold.deal(rows, key, [F.desc("iou"), "ta", "tb"]).mapInPandas(walk, schema)


def mutual_best(pairs: DataFrame, key: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Pairs that are the first choice of both sides (one round of greedy matching)."""
    rank = lambda side: F.row_number().over(Window.partitionBy(*key, side).orderBy(F.desc("iou"), "ta", "tb"))
    return pairs.filter("iou > 0").withColumn("_a", rank("ta")).withColumn("_b", rank("tb")).filter("_a = 1 and _b = 1").drop("_a", "_b")


def drop_adjacent_duplicates(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Objects that lose no pair: of objects of adjacent groups that contain each other the smaller score goes, on ties the upper."""
    lost = pairs.filter(F.col("containment") > threshold).select("frame_id", F.when(F.col("score_a") < F.col("score_b"), F.struct(F.col("grp_a").alias("grp"), F.col("ta").alias("cell"))).otherwise(F.struct(F.col("grp_b").alias("grp"), F.col("tb").alias("cell"))).alias("l"))
    return cells.join(lost.select("frame_id", "l.grp", "l.cell").distinct(), ["frame_id", "grp", "cell"], "left_anti")


def assign(score: np.ndarray) -> list[int]:
    """Column of each row in the one-to-one assignment of largest total; -1: none.

    If the best columns of the rows differ (or the best rows of the columns), they
    are the assignment; only otherwise augmenting paths are searched, over the
    shorter side.
    """
    n, m = score.shape
    if not n or not m:
        return [-1] * n
    if n > m:
        out = [-1] * n
        for col, row in enumerate(assign(score.T)):
            if row >= 0:
                out[row] = col
        return out
    best = score.argmax(axis=1).tolist()
    if len(set(best)) == n:
        return best
    back = score.argmax(axis=0).tolist()
    if n == m and len(set(back)) == n:
        return np.argsort(back).tolist()
    cost = -score
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (reduced < low[1:])
            low[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.where(used[1:], np.inf, low[1:]).argmin()) + 1
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def precision_recall(hits: DataFrame, key: Sequence[str], truths: Column, order: Sequence[Column]) -> DataFrame:
    """Running precision and recall of predictions in order of confidence; hits: 0/1 column ``hit``."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tp = F.sum("hit").over(w)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).withColumn("precision", tp / F.col("rank")).withColumn("recall", F.coalesce(F.try_divide(tp, truths), F.lit(0.0)))


def average_precision(curve: DataFrame, key: Sequence[str]) -> DataFrame:
    """Area under the precision made non-increasing, over steps of recall."""
    before = Window.partitionBy(*key).orderBy("rank")
    step = F.col("recall") - F.lag("recall", 1, 0.0).over(before)
    best = Window.partitionBy(*key).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    return curve.select(*key, (F.max("precision").over(best) * step).alias("_a")).groupBy(*key).agg(F.sum("_a").alias("ap"))


def claim_hits(pairs: DataFrame, predictions: DataFrame, threshold: float) -> DataFrame:
    """(frame_id, tb, hit): predictions by falling confidence take their best unclaimed truth above the threshold.

    Each prediction brings its truths along; a frame's rows are walked in order
    and only the claimed truths are kept at hand.
    """
    met = pairs.filter(F.col("iou") > threshold).select("frame_id", "tb", "ta", "iou")
    rows = predictions.select("frame_id", "tb", "p").join(met, ["frame_id", "tb"], "left").select(F.col("frame_id").cast("long").alias("frame_id"), F.col("tb").cast("long").alias("tb"), "p", F.coalesce(F.col("ta").cast("long"), F.lit(-1)).alias("ta"), "iou")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame, pred, hit, taken = None, None, 0, set()
        for batch in batches:
            out = []
            for f, t, truth in zip(batch["frame_id"], batch["tb"], batch["ta"], strict=True):
                if (f, t) != (frame, pred):
                    if pred is not None:
                        out.append((frame, pred, hit))
                    taken = taken if f == frame else set()
                    frame, pred, hit = f, t, 0
                if not hit and truth >= 0 and truth not in taken:
                    hit = 1
                    taken.add(truth)
            yield pd.DataFrame(out, columns=["frame_id", "tb", "hit"])
        if pred is not None:
            yield pd.DataFrame([(frame, pred, hit)], columns=["frame_id", "tb", "hit"])

    return fold.deal(rows, ["frame_id"], [F.desc("p"), "tb", F.desc("iou"), "ta"]).mapInPandas(walk, "frame_id long, tb long, hit int")


def dice(p: Column, t: Column) -> Column:
    """(2 sum(p t) + 1) / (sum(t <> 0) + sum(p) + 1), an aggregate."""
    return (2 * F.sum(p * t) + 1) / (F.sum((t != 0).cast("double")) + F.sum(p) + 1)


def cross_entropy(p: Column, t: Column, eps: float = 1e-7) -> Column:
    """Mean binary cross-entropy of clipped probabilities, an aggregate."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q)))


def nearest_focus(cells: DataFrame, focuses: Sequence[float], focus: str = "focus") -> DataFrame:
    """Each object with the nearest of a few focus positions (the first of equals) in ``focus``."""
    options = F.array(*[F.struct(F.abs(F.col(focus) - f).alias("d"), F.lit(k).alias("k"), F.lit(f).alias("f")) for k, f in enumerate(focuses)])
    return cells.withColumn(focus, F.array_min(options)["f"])


def mother_lookup(cells: DataFrame, mothers: DataFrame, keys: Sequence[str] = ("position", "trap", "label")) -> DataFrame:
    """Each object with its ``mother``, null where the map (keys, mother) has none for it."""
    return cells.join(mothers.select(*keys, "mother").dropDuplicates(list(keys)), list(keys), "left")
