"""Morphology on sparse masks: a neighbourhood is an explode of offsets, not a join.

A mask is a set of rows (keys, r, c).  Sets of different keys never meet, so all
operators scale with the number of pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fold

CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
SQUARE = tuple((dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1))
KEYS = ("frame_id", "cell")


def _inside(h: int, w: int) -> Column:
    return F.col("r").between(0, h - 1) & F.col("c").between(0, w - 1)


def neighbours(mask: DataFrame, keys: Sequence[str], offsets=CROSS, extra: Sequence[str] = ()) -> DataFrame:
    """Each pixel sent to its neighbours."""
    shifts = F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in offsets])
    return mask.select(*keys, *extra, F.explode(shifts).alias("_p")).select(*keys, *extra, "_p.r", "_p.c")


def dilate(mask: DataFrame, h: int, w: int, n: int = 1, keys: Sequence[str] = KEYS, offsets=CROSS) -> DataFrame:
    """n dilations; pixels outside the frame are dropped."""
    for _ in range(n):
        mask = neighbours(mask, keys, offsets).filter(_inside(h, w)).distinct()
    return mask.select(*keys, "r", "c")


def erode(mask: DataFrame, n: int = 1, keys: Sequence[str] = KEYS, offsets=CROSS) -> DataFrame:
    """n erosions; what lies outside the frame counts as not set."""
    for _ in range(n):
        mask = neighbours(mask, keys, offsets).groupBy(*keys, "r", "c").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(offsets)).drop("_n")
    return mask.select(*keys, "r", "c")


def close(mask: DataFrame, h: int, w: int, n: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    return erode(dilate(mask, h, w, n, keys), n, keys)


def open_(mask: DataFrame, h: int, w: int, n: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    return dilate(erode(mask, n, keys), h, w, n, keys)


def edges(mask: DataFrame, h: int, w: int, keys: Sequence[str] = KEYS, offsets=SQUARE) -> DataFrame:
    """Pixels of the mask with a neighbour inside the frame that is not set."""
    seen = neighbours(mask, keys, offsets).filter(_inside(h, w)).groupBy(*keys, "r", "c").agg(F.count("*").alias("_n"))
    rows = 3 - (F.col("r") == 0).cast("int") - (F.col("r") == h - 1).cast("int")
    cols = 3 - (F.col("c") == 0).cast("int") - (F.col("c") == w - 1).cast("int")
    there = rows * cols if len(offsets) == 9 else rows + cols - 1
    return seen.join(mask.select(*keys, "r", "c"), [*keys, "r", "c"]).filter(F.col("_n") < there).select(*keys, "r", "c")


def fill_gaps(mask: DataFrame, h: int, w: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """One-pixel gaps closed: places with more than one set neighbour, eroded, or set before."""
    near = neighbours(mask, keys, SQUARE).filter(_inside(h, w)).groupBy(*keys, "r", "c").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return erode(near, 1, keys).union(mask.select(*keys, "r", "c")).distinct()


def grey(px: DataFrame, h: int, w: int, largest: bool, n: int = 1, keys: Sequence[str] = ("frame_id",), offsets=CROSS) -> DataFrame:
    """n grey dilations (largest neighbour) or erosions (smallest); borders don't erode."""
    for _ in range(n):
        px = neighbours(px, keys, offsets, ("v",)).filter(_inside(h, w)).groupBy(*keys, "r", "c").agg((F.max if largest else F.min)("v").alias("v"))
    return px


def blur(px: DataFrame, h: int, w: int, sigma: float, keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Separable Gaussian of radius 4 sigma, edges repeated."""
    radius = int(4 * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight /= weight.sum()
    for axis, size in (("r", h), ("c", w)):
        # a place's value goes to each place that reads it; border places also stand for all beyond
        target = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(wt)).alias("wt")) for k, wt in zip(range(-radius, radius + 1), weight, strict=True)]))
        grid = px.select(*keys, "r", "c", "v", target.alias("_t"))
        other = "c" if axis == "r" else "r"
        sent = grid.select(*keys, other, F.col(axis).alias("_s"), "v", F.col("_t.k").alias("_k"), F.col("_t.wt").alias("_w"))
        plain = sent.withColumn(axis, F.col("_s") - F.col("_k")).filter(F.col(axis).between(0, size - 1))
        low = sent.filter(F.col("_s") == 0).withColumn(axis, F.explode(F.expr(f"case when _k < 0 then sequence(0, least(-_k - 1, {size - 1})) else array() end")))
        high = sent.filter(F.col("_s") == size - 1).withColumn(axis, F.explode(F.expr(f"case when _k > 0 then sequence(greatest({size} - _k, 0), {size - 1}) else array() end")))
        parts = [p.select(*keys, other, axis, (F.col("v") * F.col("_w")).alias("v")) for p in (plain, low, high)]
        px = parts[0].union(parts[1]).union(parts[2]).groupBy(*keys, "r", "c").agg(F.sum("v").alias("v"))
    return px.select(*keys, "r", "c", "v")


def border(h: int, w: int) -> Column:
    """Whether a pixel lies on the frame's border."""
    return F.col("r").isin(0, h - 1) | F.col("c").isin(0, w - 1)


def label_pixels(group: np.ndarray, r: np.ndarray, c: np.ndarray, eight: bool) -> np.ndarray:
    """Component of each pixel, counted from 1 in raster order within its group; rows sorted by (group, r, c).

    Pixels are hooked to the smallest neighbour and paths are halved, for all
    groups at once.
    """
    n = len(r)
    if not n:
        return np.zeros(0, np.int32)
    wide, high = int(c.max() - c.min()) + 3, int(r.max() - r.min()) + 3
    code = (group.astype(np.int64) * high + (r - r.min() + 1)) * wide + (c - c.min() + 1)
    left, right = [], []
    for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)) if eight else ((0, 1), (1, 0)):
        at = np.searchsorted(code, code + dr * wide + dc)
        there = code[np.minimum(at, n - 1)] == code + dr * wide + dc
        left.append(np.flatnonzero(there))
        right.append(at[there])
    a, b = np.concatenate(left), np.concatenate(right)
    top = np.arange(n)
    while len(a):
        lo, hi = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        np.minimum.at(top, hi, lo)
        while not np.array_equal(top, above := top[top]):
            top = above
        apart = top[a] != top[b]
        a, b = a[apart], b[apart]
    roots, rank = np.unique(top, return_inverse=True)
    first = np.searchsorted(roots, fold.starts(group))  # the first pixel of a group is a root
    per_group = np.searchsorted(fold.starts(group), np.arange(n), side="right") - 1
    return (rank - first[per_group] + 1).astype(np.int32)


def components(mask: DataFrame, connectivity: int = 2) -> DataFrame:
    """(frame_id, cell, r, c): connected components of each frame (connectivity 1: four, 2: eight neighbours)."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(ignore_index=True)
        group = pd.factorize(pdf["frame_id"])[0]
        return pdf.assign(cell=label_pixels(group, pdf["r"].to_numpy(), pdf["c"].to_numpy(), connectivity == 2))[["frame_id", "cell", "r", "c"]]

    return fold.in_groups(mask.select("frame_id", "r", "c"), ["frame_id"], ["r", "c"], label, "frame_id long, cell int, r int, c int")


def parts(mask: DataFrame) -> DataFrame:
    """(frame_id, cell, part, r, c): connected parts (eight neighbours) of each object, which may overlap others."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(ignore_index=True)
        group = np.searchsorted(fold.starts(pdf["frame_id"].to_numpy(), pdf["cell"].to_numpy()), np.arange(len(pdf)), side="right") - 1
        return pdf.assign(part=label_pixels(group, pdf["r"].to_numpy(), pdf["c"].to_numpy(), True))[["frame_id", "cell", "part", "r", "c"]]

    return fold.in_groups(mask.select("frame_id", "cell", "r", "c"), ["frame_id", "cell"], ["r", "c"], label, "frame_id long, cell int, part int, r int, c int")


def fill_masks(masks: np.ndarray) -> np.ndarray:
    """Masks (object, r, c) with the background parts that don't touch the border filled."""
    g, r, c = np.nonzero(~masks)
    part = label_pixels(g, r, c, False).astype(np.int64)
    code = g * (masks.shape[1] * masks.shape[2] + 1) + part
    rim = (r == 0) | (r == masks.shape[1] - 1) | (c == 0) | (c == masks.shape[2] - 1)
    hole = ~np.isin(code, np.unique(code[rim]))
    out = masks.copy()
    out[g[hole], r[hole], c[hole]] = True
    return out


def by_object(pdf: pd.DataFrame, h: int, w: int, change: Callable[[np.ndarray], np.ndarray]) -> pd.DataFrame:
    """``change`` of the dense masks of a block's objects, some at a time."""
    pdf = pdf.reset_index(drop=True)
    first = fold.starts(pdf["frame_id"].to_numpy(), pdf["cell"].to_numpy())
    which = np.searchsorted(first, np.arange(len(pdf)), side="right") - 1
    step, parts = max(1, (1 << 22) // (h * w)), []
    for k in range(0, len(first), step):
        rows = (which >= k) & (which < k + step)
        masks = np.zeros((min(step, len(first) - k), h, w), bool)
        masks[which[rows] - k, pdf["r"][rows], pdf["c"][rows]] = True
        g, r, c = np.nonzero(change(masks))
        at = first[g + k]
        parts.append(pd.DataFrame({"frame_id": pdf["frame_id"].to_numpy()[at], "cell": pdf["cell"].to_numpy()[at], "r": r.astype(np.int32), "c": c.astype(np.int32)}))
    return pd.concat(parts, ignore_index=True)


def fill_holes(mask: DataFrame, h: int, w: int) -> DataFrame:
    """Each object with its holes: background parts (four neighbours) that don't touch the border."""
    return fold.in_groups(mask.select("frame_id", "cell", "r", "c"), ["frame_id", "cell"], [], lambda pdf: by_object(pdf, h, w, fill_masks), "frame_id long, cell int, r int, c int")


def fill_bordered(mask: DataFrame, h: int, w: int) -> DataFrame:
    """Objects that the frame cuts off, filled: the border acts as an edge.

    No object is taken to meet opposing borders, so holes are filled twice, with
    the top, bottom and left sides set and then with the top, bottom and right.
    """

    def fill(masks: np.ndarray) -> np.ndarray:
        walled = np.pad(masks, ((0, 0), (1, 1), (1, 1)))
        walled[:, [0, -1], :] = True
        walled[:, :, 0] = True
        walled = fill_masks(walled)
        walled[:, :, 0], walled[:, :, -1] = False, True
        return fill_masks(walled)[:, 1:-1, 1:-1]

    return fold.in_groups(mask.select("frame_id", "cell", "r", "c"), ["frame_id", "cell"], [], lambda pdf: by_object(pdf, h, w, fill), "frame_id long, cell int, r int, c int")


def crop_to_box(mask: DataFrame, pad: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Coordinates from the padded bounding box's corner, and the corner (r0, c0)."""
    box = mask.groupBy(*keys).agg((F.min("r") - pad).alias("r0"), (F.min("c") - pad).alias("c0"))
    return mask.join(box, list(keys)).withColumn("r", F.col("r") - F.col("r0")).withColumn("c", F.col("c") - F.col("c0"))


def restore_from_box(cropped: DataFrame) -> DataFrame:
    return cropped.withColumn("r", F.col("r") + F.col("r0")).withColumn("c", F.col("c") + F.col("c0")).drop("r0", "c0")


def composite(mask: DataFrame) -> DataFrame:
    """Label map: the highest label at each pixel."""
    return mask.groupBy("frame_id", "r", "c").agg(F.max("cell").alias("label"))


def confusion(pred: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(frame_id, tp, fp, fn): pixels of p > threshold against a mask."""
    p = pred.filter(F.col("v") > threshold).select("frame_id", "r", "c", F.lit(1).alias("_p"))
    t = truth.select("frame_id", "r", "c").distinct().withColumn("_t", F.lit(1))
    both = p.join(t, ["frame_id", "r", "c"], "full")
    count = lambda x: F.count(F.when(x, 1))
    return both.groupBy("frame_id").agg(count(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("tp"), count(F.col("_t").isNull()).alias("fp"), count(F.col("_p").isNull()).alias("fn"))


def clogged(interior: DataFrame, h: int, w: int, threshold: float = 0.5, share: float = 0.75) -> DataFrame:
    """(frame_id, share, clogging): share of interior pixels above the threshold."""
    return interior.groupBy("frame_id").agg((F.count(F.when(F.col("v") > threshold, 1)) / F.lit(float(h * w))).alias("share")).withColumn("clogging", F.col("share") > share)

