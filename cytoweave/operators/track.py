"""Linking objects through time and keeping lineages."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fold, morph, objects
from .match import assign
from .tables import stored


def with_steps(objects: DataFrame) -> DataFrame:
    """Adds ``step``: the series' processed frames counted from 1, whatever the gaps in time."""
    return objects.withColumn("step", F.dense_rank().over(Window.partitionBy("series").orderBy("tp")))


def candidate_pairs(objects: DataFrame, features: Sequence[str] = ("x", "y"), depth: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """Every object with every object of the ``depth`` steps before: differences of features.

    Columns to ``carry`` come along from both, those of the earlier object as prev_*.

    An object is sent to the steps ahead that look back at it, so the join is an
    equality on (series, step) and needs no range condition.
    """
    o = with_steps(objects)
    ahead = o.select("series", F.col("step").alias("_s"), F.col("tp").alias("prev_tp"), F.col("cell").alias("prev_cell"), *[F.col(f).alias(f"_{f}") for f in features], *[F.col(c).alias(f"prev_{c}") for c in carry], F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("back"))
    ahead = ahead.withColumn("step", F.col("_s") + F.col("back"))
    diff = [(F.col(f"_{f}") - F.col(f)).alias(f"d_{f}") for f in features]
    return o.join(ahead, ["series", "step"]).select("series", "tp", "step", "cell", "back", "prev_tp", "prev_cell", *diff, *[x for c in carry for x in (c, f"prev_{c}")])


def pair_distance(dx: str = "d_x", dy: str = "d_y") -> Column:
    return F.sqrt(F.col(dx) * F.col(dx) + F.col(dy) * F.col(dy))


def blend(main: Column, backup: Column, low: float = 0.1, high: float = 0.9) -> Column:
    """The main model's probability; where it is undecided, the larger of both."""
    return F.when((main > low) & (main < high), F.greatest(main, backup)).otherwise(main)


Score = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Ways to put a label's scores over several frames together, by name.
REDUCERS = {"max": np.maximum, "min": np.minimum, "sum": np.add}


def link_frames(window: list[tuple[np.ndarray, np.ndarray]], now: np.ndarray, score: Score, max_label: int, threshold: float, compat_restart: bool = False, reduce: np.ufunc = np.maximum) -> tuple[np.ndarray, int]:
    """Labels of the objects of one frame: best total score against the frames of the window.

    ``window``: labels and features of each earlier frame.  A label's score is
    that of its frames put together by ``reduce`` (maximum unless told otherwise;
    np.minimum and np.add are others).  Links above the threshold keep the label,
    all other objects get new ones.
    """
    n = len(now)
    labels = np.zeros(n, np.int64)
    if not n:
        return labels, max_label
    window = [frame for frame in window if len(frame[0])]
    restart = max_label + 1
    if window:
        known, row = np.unique(np.concatenate([frame[0] for frame in window]), return_inverse=True)
        every = score(np.concatenate([frame[1] for frame in window]), now)
        order = np.argsort(row, kind="stable")
        table = reduce.reduceat(every[order], np.searchsorted(row[order], np.arange(len(known))), axis=0)
        for k, col in enumerate(assign(table)):
            if col >= 0 and table[k, col] > threshold:
                labels[col] = known[k]
    elif compat_restart and max_label:
        restart = max_label
    fresh = np.flatnonzero(labels == 0)
    labels[fresh] = restart + np.arange(len(fresh))
    if compat_restart and max_label and not window:
        return labels, restart + len(fresh)
    return labels, max(max_label, restart + len(fresh) - 1)


def gaussian_score(scale: Sequence[float]) -> Score:
    """exp(-half the squared distance in units of ``scale``) of each pair of rows."""
    unit = np.asarray(scale, float)
    return lambda a, b: np.exp(-0.5 * (((a[:, None, :] - b[None, :, :]) / unit) ** 2).sum(axis=2))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by (series, tp), cut so that no frame lies in two of them."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        series, tp = batch["series"].to_numpy(), batch["tp"].to_numpy()
        last = np.flatnonzero((series != series[-1]) | (tp != tp[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        fresh = kept and (kept[-1]["series"].iloc[-1] != series[0] or kept[-1]["tp"].iloc[-1] != tp[0])
        if cut or fresh:
            yield pd.concat([*kept, batch.iloc[:cut]], ignore_index=True)
            kept = []
        kept.append(batch.iloc[cut:])
    if kept:
        yield pd.concat(kept, ignore_index=True)


def _by_frame(batches: Iterator[pd.DataFrame], value: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, list[int]]]:
    """Blocks of whole frames with their values as one array and where each frame begins and ends."""
    for block in _blocks(batches):
        first = fold.starts(block["series"].to_numpy(), block["tp"].to_numpy())
        yield block, block[list(value)].to_numpy(float), [*first.tolist(), len(block)]


def track(objects: DataFrame, features: Sequence[str] = ("x", "y"), scale: Sequence[float] = (50.0, 20000.0), depth: int = 3, threshold: float = 0.5, compat_restart: bool = False, reduce: np.ufunc | str = np.maximum) -> DataFrame:
    """(series, tp, cell, label): objects linked frame by frame; labels count from 1 in each series.

    The rows of a series stand in order of time in one partition and stream
    through; only the frames of the window are kept at hand, however long the
    series is.
    """
    score, names = gaussian_score(scale), list(features)
    reduce = REDUCERS[reduce] if isinstance(reduce, str) else reduce

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, window, top = None, [], 0
        for block, values, first in _by_frame(batches, names):
            series, labels = block["series"].to_numpy(), np.zeros(len(block), np.int64)
            for a, b in zip(first, first[1:], strict=False):
                if series[a] != now:
                    now, window, top = series[a], [], 0
                labels[a:b], top = link_frames(window, values[a:b], score, top, threshold, compat_restart, reduce)
                window = [*window, (labels[a:b], values[a:b])][-depth:]
            yield block[["series", "tp", "cell"]].assign(label=labels)

    rows = objects.select(F.col("series").cast("long").alias("series"), F.col("tp").cast("int").alias("tp"), F.col("cell").cast("int").alias("cell"), *names)
    return fold.deal(rows, ["series"], ["tp", "cell"]).mapInPandas(step, "series long, tp int, cell int, label int")


def label_masks(masks: DataFrame, frames: DataFrame, h: int, w: int, features: Sequence[str] = ("area", "centroid_r", "centroid_c"), scale: Sequence[float] = (10.0, 3.0, 3.0), depth: int = 3, threshold: float = 0.5) -> DataFrame:
    """(series, tp, cell, label) of stored masks: holes filled, shapes measured, series tracked.

    masks: (frame_id, cell, r, c); frames: (frame_id, series, tp).  Features are
    columns of ``objects.shape_features``.
    """
    shapes = objects.shape_features(morph.fill_holes(masks, h, w))
    return track(shapes.join(frames.select("frame_id", "series", "tp"), "frame_id"), features, scale, depth, threshold)


def balance(prev: Sequence[float], now: Sequence[float], growth: float = 0.1, tolerance: float = 20.0) -> list[tuple[int, int, int, int]]:
    """Runs of ``prev`` and ``now`` (start, end, start, end) whose totals balance after growth, in order.

    Objects of both sides are passed in order of the total before them on their own
    side, those of ``now`` first of equals, as far as the other side's total
    reaches.  A run ends at the first point with something on either side where
    the grown total of ``prev`` is within the tolerance of that of ``now``; the
    next run begins there with totals of its own.
    """
    rate, out, a, b = math.exp(growth), [], 0, 0
    while True:
        p, q = (np.concatenate([[0.0], np.cumsum(side)]) for side in (prev[a:], now[b:]))
        before = np.concatenate([q[:-1], p[:-1]])
        from_prev = np.arange(len(before)) >= len(q) - 1
        due = np.where(from_prev, before < q[-1], before <= p[-1])
        passed = from_prev[due][np.argsort(before[due], kind="stable")]
        i, j = np.cumsum(passed), np.cumsum(~passed)
        even = (p[i] > 0) & (q[j] > 0) & (np.abs(p[i] * rate - q[j]) <= tolerance)
        if not even.any():
            return out
        k = int(even.argmax())
        out.append((a, a + int(i[k]), b, b + int(j[k])))
        _, a, _, b = out[-1]


def channel_labels(before: list[tuple[int, float]], sizes: list[float], top: int, growth: float, tolerance: float) -> tuple[list[int], list[int], int]:
    """(labels, mothers, highest label) of one frame's objects in order of place."""
    labels, mothers, done = [0] * len(sizes), [0] * len(sizes), 0
    for a, i, b, j in balance([s for _, s in before], sizes, growth, tolerance):
        new = list(range(b, j))
        if i - a == 1 and j - b in (1, 2):
            labels[b] = before[a][0]
            new = new[1:]
        for k in new:
            top += 1
            labels[k] = top
            if len(new) == 1 and i - a == 1 and j - b == 2:
                mothers[k] = before[a][0]
        done = j
    for k in range(done, len(sizes)):
        top += 1
        labels[k] = top
    return labels, mothers, top


def channel_track(objects: DataFrame, place: str = "y", size: str = "x", growth: float = 0.1, tolerance: float = 20.0) -> DataFrame:
    """(series, tp, cell, label, mother) in a channel: objects keep their order, sizes balance.

    One to one keeps the label; one to two is a division, the first object keeps
    the label and the second is its daughter (mother is told at that frame);
    anything else gets new labels, in order of place.  Rows stream through in
    order; only the frame before is kept at hand.
    """

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, before, top = None, [], 0
        for block, values, first in _by_frame(batches, [size]):
            series, labels, mothers = block["series"].to_numpy(), [], []
            for a, b in zip(first, first[1:], strict=False):
                if series[a] != now:
                    now, before, top = series[a], [], 0
                sizes = values[a:b, 0].tolist()
                own, of, top = channel_labels(before, sizes, top, growth, tolerance)
                before = list(zip(own, sizes, strict=True))
                labels += own
                mothers += of
            yield block[["series", "tp", "cell"]].assign(label=labels, mother=mothers)

    rows = objects.select(F.col("series").cast("long").alias("series"), F.col("tp").cast("int").alias("tp"), F.col("cell").cast("int").alias("cell"), place, size)
    return fold.deal(rows, ["series"], ["tp", F.desc(place), "cell"]).mapInPandas(step, "series long, tp int, cell int, label int, mother int")


def lineage_scores(pairs: DataFrame, presence: DataFrame) -> DataFrame:
    """(series, tp, mother, bud, ba_cum) of each pair seen, from pair probabilities.

    motherness is the running maximum of a label's summed probabilities as mother
    up to and including the frame; a pair's score adds p * (1 - motherness of the bud).
    presence: (series, tp, label) of all labels.
    """
    to_now = lambda *keys: Window.partitionBy(*keys).orderBy("tp").rowsBetween(Window.unboundedPreceding, 0)
    as_mother = pairs.groupBy("series", "tp", F.col("mother").alias("label")).agg(F.sum("p").alias("s"))
    motherness = presence.select("series", "tp", "label").join(as_mother, ["series", "tp", "label"], "left").select("series", "tp", F.col("label").alias("bud"), F.coalesce(F.max("s").over(to_now("series", "label")), F.lit(0.0)).alias("motherness"))
    met = pairs.join(motherness, ["series", "tp", "bud"])
    return met.select("series", "tp", "mother", "bud", F.sum(F.col("p") * (1 - F.col("motherness"))).over(to_now("series", "mother", "bud")).alias("ba_cum"))


def assign_mothers(pairs: DataFrame, presence: DataFrame, min_budness: float = 0.5, min_lifetime: int = 3) -> DataFrame:
    """(series, tp, label, mother) of each label at each frame; 0: none.

    The mother has the highest positive score up to now, the lowest label on
    ties, and is given once the label has been seen ``min_lifetime`` times and its
    probability as bud has exceeded ``min_budness``.  Scores only grow stale
    between frames of a pair, so "best so far by the latest score of each pair"
    is an as-of join: each score holds from its frame to the pair's next.
    """
    scores = lineage_scores(pairs, presence)
    label = Window.partitionBy("series", "label").orderBy("tp")
    seen = presence.select("series", "tp", "label").withColumn("lifetime", F.count("*").over(label.rowsBetween(Window.unboundedPreceding, 0)))
    bud = pairs.groupBy("series", "tp", F.col("bud").alias("label")).agg(F.max("p").alias("pb"))
    seen = seen.join(bud, ["series", "tp", "label"], "left").withColumn("budness", F.max("pb").over(label.rowsBetween(Window.unboundedPreceding, 0)))
    until = F.lead("tp").over(Window.partitionBy("series", "mother", "bud").orderBy("tp"))
    holds = scores.withColumn("until", until).select(F.col("series").alias("_s"), F.col("bud").alias("_b"), F.col("tp").alias("_from"), "until", "mother", "ba_cum")
    ready = seen.filter((F.col("lifetime") >= min_lifetime) & (F.col("budness") > min_budness))
    met = ready.join(holds, (F.col("series") == F.col("_s")) & (F.col("label") == F.col("_b")) & (F.col("tp") >= F.col("_from")) & (F.col("until").isNull() | (F.col("tp") < F.col("until"))) & (F.col("ba_cum") > 0))
    best = met.groupBy("series", "tp", "label").agg(F.max(F.struct(F.col("ba_cum"), (-F.col("mother")).alias("m"))).alias("b")).select("series", "tp", "label", (-F.col("b.m")).alias("mother"))
    return seen.select("series", "tp", "label").join(best, ["series", "tp", "label"], "left").withColumn("mother", F.coalesce("mother", F.lit(0)))


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, label, generation): all descendants of each root over (daughter, mother) edges, to any depth.

    Each generation is written to the checkpoint folder before the next one is
    looked up, so none is made twice.  A label that would be its own ancestor is
    an error.
    """
    level = roots.select(F.col("label").alias("root"), "label").distinct()
    links, found, k = edges.select("daughter", "mother").distinct(), level.withColumn("generation", F.lit(0)), 0
    while True:
        k += 1
        level = stored(level.join(links, F.col("label") == F.col("mother")).select("root", F.col("daughter").alias("label")).distinct())
        if level.isEmpty():
            return found
        if not level.filter("root = label").isEmpty():
            raise ValueError("a label is its own ancestor")
        found = found.union(level.withColumn("generation", F.lit(k)))


def bud_windows(lineage: DataFrame, last_tp: DataFrame) -> DataFrame:
    """(series, mother, label, start, end): from a bud's first frame to its mother's next bud, or the series' end."""
    first = lineage.filter("mother > 0").groupBy("series", "mother", "label").agg(F.min("tp").alias("start"))
    nxt = F.lead("start").over(Window.partitionBy("series", "mother").orderBy("label"))
    return first.withColumn("next", nxt).join(last_tp, "series").select("series", "mother", "label", "start", F.coalesce("next", F.col("last_tp") + 1).alias("end"))
