"""Augmentation of training frames as column expressions on pixel tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fold, morph, norm
from .sample import draw
from .tables import stored


def shift(px: DataFrame, dr: int, dc: int, h: int, w: int) -> DataFrame:
    """Pixels moved and cropped to the frame."""
    return px.withColumn("r", F.col("r") + dr).withColumn("c", F.col("c") + dc).filter(F.col("r").between(0, h - 1) & F.col("c").between(0, w - 1))


def flip(px: DataFrame, h: int, w: int, vertical: bool) -> DataFrame:
    return px.withColumn("r", F.lit(h - 1) - F.col("r")) if vertical else px.withColumn("c", F.lit(w - 1) - F.col("c"))


def crop(px: DataFrame, r0: int, c0: int, h: int, w: int) -> DataFrame:
    """The window from (r0, c0), with places from its corner."""
    return px.filter(F.col("r").between(r0, r0 + h - 1) & F.col("c").between(c0, c0 + w - 1)).withColumn("r", F.col("r") - r0).withColumn("c", F.col("c") - c0)


def pad(px: DataFrame, h: int, w: int, dr: int, dc: int) -> DataFrame:
    """Frames placed at (dr, dc) in an h by w grid; other places get the frame's median."""
    median = px.groupBy("frame_id").agg(F.percentile("v", 0.5).alias("_m"))
    grid = median.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    moved = px.select("frame_id", (F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), "v")
    return grid.join(moved, ["frame_id", "r", "c"], "left").select("frame_id", "r", "c", F.coalesce("v", "_m").alias("v"))


def rough_crop(px: DataFrame, labels: DataFrame, h: int, w: int, out_h: int, out_w: int, scaling: float = 1.0, margin: float = 1.7) -> tuple[DataFrame, DataFrame]:
    """(image, labels) about the frame's middle, large enough for a turn and a rescaling to out_h by out_w to stay inside.

    A side is ``margin`` times the asked one by ``scaling``, rounded up.  Where that
    is beyond the frame, places of the image get its median and labels stay empty;
    objects without a pixel in the window are gone.  labels: (frame_id, cell, r, c).
    """
    big_h, big_w = math.ceil(out_h * margin / scaling), math.ceil(out_w * margin / scaling)
    dr, dc = -((h - big_h) // 2), -((w - big_w) // 2)
    return pad(px, big_h, big_w, dr, dc), shift(labels, dr, dc, big_h, big_w)


def move_stacks(px: DataFrame, dz: int, n: int) -> DataFrame:
    """Each section takes the values of the section dz before, edges repeated: rows (frame_id, z, r, c, v)."""
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    want = px.select("frame_id", "r", "c").distinct().withColumn("z", at).withColumn("_s", F.least(F.greatest(F.col("z") - dz, F.lit(0)), F.lit(n - 1)))
    return want.join(px.select("frame_id", "r", "c", F.col("z").alias("_s"), "v"), ["frame_id", "r", "c", "_s"]).drop("_s")


def substack(px: DataFrame, keep: list[int], mean: bool = False) -> DataFrame:
    """Chosen sections, renumbered, or their mean."""
    kept = px.filter(F.col("z").isin(keep))
    if mean:
        return kept.groupBy("frame_id", "r", "c").agg(F.avg("v").alias("v"))
    place = F.array_position(F.array(*[F.lit(z) for z in sorted(keep)]), F.col("z")) - 1
    return kept.withColumn("z", place.cast("int"))


def section_choices(sections: int, keep: int) -> list[list[int]]:
    """All choices of ``keep`` of the sections between any two of which at most one is left out, in order."""
    every = ([z for z in range(sections) if m >> z & 1] for m in range(1, 1 << sections) if m.bit_count() == keep)
    return [zs for zs in every if all(b - a <= 2 for a, b in zip(zs, zs[1:], strict=False))]


def choose_sections(px: DataFrame, sections: int, keep: int, seed: int, mean: bool = False) -> DataFrame:
    """Each frame with ``keep`` of its sections, renumbered, or their mean.

    The choice is told by a hash of seed and frame, so reruns agree.  Fewer
    sections than asked for are an error.
    """
    choices = section_choices(sections, keep)
    if not choices:
        raise ValueError("a frame has fewer sections than asked for")
    listed = F.array(*[F.array(*[F.lit(z) for z in zs]) for zs in choices])
    at = F.conv(F.substring(draw(f"{seed}:sections", F.col("frame_id")), 1, 8), 16, 10).cast("long") % len(choices)
    place = F.array_position(F.get(listed, at.cast("int")), F.col("z"))
    kept = px.withColumn("_p", place).filter("_p > 0")
    if mean:
        return kept.groupBy("frame_id", "r", "c").agg(F.avg("v").alias("v"))
    return kept.withColumn("z", (F.col("_p") - 1).cast("int")).drop("_p")


def gamma(px: DataFrame, g: float, q: float = 0.04) -> DataFrame:
    """Values between the outer quantiles bent by a power, others kept."""
    level = px.groupBy("frame_id").agg(F.percentile("v", F.array(F.lit(q / 2), F.lit(1 - q / 2))).alias("_q"))
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    u = F.try_divide(F.col("v") - lo, hi - lo)
    return px.join(level, "frame_id").withColumn("v", F.when((F.col("v") > lo) & (F.col("v") < hi), lo + F.pow(u, F.lit(g)) * (hi - lo)).otherwise(F.col("v"))).drop("_q")


def noise(px: DataFrame, seed: int, scale: float = 0.003) -> DataFrame:
    """Normal noise by Box-Muller on seeded hashes; its size is exponential for each frame."""
    u = lambda tag, *k: (F.conv(F.substring(draw(f"{seed}:{tag}", *[F.col(x) for x in k]), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    size = -F.lit(scale) * F.log(u("size", "frame_id"))
    normal = F.sqrt(-2 * F.log(u("a", "frame_id", "r", "c"))) * F.cos(2 * 3.141592653589793 * u("b", "frame_id", "r", "c"))
    return px.withColumn("v", F.col("v") + size * normal)


def rotate(px: DataFrame, degrees: float, h: int, w: int) -> DataFrame:
    """Rotation about the centre: each target place reads its four source neighbours, reflected at the border."""
    a = degrees * 3.141592653589793 / 180
    grid = px.sparkSession.range(h * w).select(F.expr(f"cast(id div {w} as int)").alias("r"), (F.col("id") % w).cast("int").alias("c"))
    y, x = F.col("r") - (h - 1) / 2, F.col("c") - (w - 1) / 2
    sy, sx = y * F.cos(F.lit(a)) - x * F.sin(F.lit(a)) + (h - 1) / 2, y * F.sin(F.lit(a)) + x * F.cos(F.lit(a)) + (w - 1) / 2

    def reflect(v, n: int):
        m = F.pmod(v, F.lit(2 * n))
        return F.when(m < n, m).otherwise(2 * n - 1 - m).cast("int")

    taps = []
    for dy in (0, 1):
        for dx in (0, 1):
            wy = F.abs(1 - dy - (sy - F.floor(sy)))
            wx = F.abs(1 - dx - (sx - F.floor(sx)))
            taps.append(F.struct(reflect(F.floor(sy) + dy, h).alias("sr"), reflect(F.floor(sx) + dx, w).alias("sc"), (wy * wx).alias("k")))
    t = grid.select("r", "c", F.explode(F.array(*taps)).alias("t")).select("r", "c", "t.sr", "t.sc", "t.k")
    src = px.select("frame_id", F.col("r").alias("sr"), F.col("c").alias("sc"), "v")
    return src.join(F.broadcast(t), ["sr", "sc"]).groupBy("frame_id", "r", "c").agg(F.sum(F.col("v") * F.col("k")).alias("v"))


Step = Callable[[DataFrame], DataFrame]


def augment(px: DataFrame, steps: Sequence[tuple[str, float | None, Step]], seed: int, p_noop: float = 0.15, draws: int = 1) -> DataFrame:
    """(frame_id, draw, steps, r, c, v): ``draws`` augmented versions of each frame and which steps it went through.

    steps: name, probability and function of a pixel table, in order; a
    probability of None is 1 - p_noop ^ (1 / n), n being the number of these, so a
    version stays as it is with probability p_noop.  Whether a step fires is told
    by a hash of seed, step, frame and draw, so reruns agree.  A version is a frame
    of its own while steps run (frame_id is then a struct); each step's result is
    written, so none is made twice.
    """
    open_ = sum(p is None for _, p, _ in steps)
    versions = px.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select(F.struct("frame_id", "draw").alias("frame_id"), "r", "c", "v")
    log = versions.select("frame_id").distinct().withColumn("steps", F.expr("cast(array() as array<string>)"))
    for name, p, step in steps:
        chance = 1 - p_noop ** (1 / open_) if p is None else p
        u = F.conv(F.substring(draw(f"{seed}:{name}", F.col("frame_id.frame_id"), F.col("frame_id.draw")), 1, 12), 16, 10).cast("double") / float(1 << 48)
        fires = u < chance
        versions = stored(step(versions.filter(fires)).select("frame_id", "r", "c", "v").union(versions.filter(~fires)))
        log = log.withColumn("steps", F.when(fires, F.array_append("steps", name)).otherwise(F.col("steps")))
    return versions.join(log, "frame_id").select("frame_id.frame_id", "frame_id.draw", "steps", "r", "c", "v")


def cell_shift(px: DataFrame, cells: DataFrame, h: int, w: int) -> DataFrame:
    """Frames moved so that the middle of a cell's bounding box comes to the frame's middle, and cropped.

    cells: (frame_id, r0, c0, r1, c1) of one picked cell a frame, ends exclusive;
    frames without one stay.
    """
    move = cells.select("frame_id", (F.lit(h // 2) - F.floor((F.col("r0") + F.col("r1")) / 2)).alias("_dr"), (F.lit(w // 2) - F.floor((F.col("c0") + F.col("c1")) / 2)).alias("_dc"))
    met = px.join(move, "frame_id", "left")
    r, c = (F.col("r") + F.coalesce("_dr", F.lit(0))).cast("int"), (F.col("c") + F.coalesce("_dc", F.lit(0))).cast("int")
    return met.withColumn("r", r).withColumn("c", c).drop("_dr", "_dc").filter(F.col("r").between(0, h - 1) & F.col("c").between(0, w - 1))


def smooth_labels(outlines: DataFrame, h: int, w: int, a: float, b: float, c: float) -> DataFrame:
    """(frame_id, cell, r, c, v): each object's outline filled, blurred and cut at half height; v is 1 on its new edge, else 0.

    The blur's sigma is log(max((n - c) / a, 1)) / b of the n outline pixels.
    """

    def blur(masks: np.ndarray, sigma: np.ndarray) -> np.ndarray:
        out = masks.astype(float)
        for k, s in enumerate(sigma):
            if s > 0:
                for axis, size in ((0, h), (1, w)):
                    at = np.arange(size)
                    weight = np.exp(-0.5 * ((at[:, None] - at[None, :]) / s) ** 2)
                    weight /= np.exp(-0.5 * (np.arange(-4 * size, 4 * size + 1) / s) ** 2).sum()
                    out[k] = np.moveaxis(np.tensordot(weight, out[k], (1, axis)), 0, axis)
        return out

    def change(masks: np.ndarray) -> np.ndarray:
        n = masks.sum(axis=(1, 2))
        smooth = blur(morph.fill_masks(masks), np.log(np.maximum((n - c) / a, 1.0)) / b)
        return smooth > 0.5 * np.maximum(smooth.max(axis=(1, 2), keepdims=True), 1e-12)

    filled = fold.in_groups(outlines.select("frame_id", "cell", "r", "c"), ["frame_id", "cell"], [], lambda pdf: morph.by_object(pdf, h, w, change), "frame_id long, cell int, r int, c int")
    filled = stored(filled)
    return filled.join(morph.edges(filled, h, w).withColumn("_e", F.lit(1)), ["frame_id", "cell", "r", "c"], "left").select("frame_id", "cell", "r", "c", F.coalesce("_e", F.lit(0)).alias("v"))


def _uniform(seed: int, tag: str, *keys: str) -> Column:
    """A number in (0, 1] told by a hash."""
    return (F.conv(F.substring(draw(f"{seed}:{tag}", *[F.col(k) for k in keys]), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)


def hist_scale(px: DataFrame, seed: int, offset: float = 0.25, sigma: float = 0.4) -> DataFrame:
    """(v + offset) * scale, drawn for each frame.

    The offset is even within ``offset`` times the range of the frame's middle 96 %
    on either side; the scale is log-normal, held within a half and 2.
    """
    level = px.groupBy("frame_id").agg(F.percentile("v", F.array(F.lit(0.02), F.lit(0.98))).alias("_q"))
    u = lambda tag: _uniform(seed, tag, "frame_id")
    normal = F.sqrt(-2 * F.log(u("scale_a"))) * F.cos(2 * math.pi * u("scale_b"))
    scale = F.least(F.greatest(F.exp(sigma * normal), F.lit(0.5)), F.lit(2.0))
    move = (2 * u("offset") - 1) * offset * (F.col("_q")[1] - F.col("_q")[0])
    return px.join(level, "frame_id").withColumn("v", (F.col("v") + move) * scale).drop("_q")


def to_pixel_size(px: DataFrame, labels: DataFrame, h: int, w: int, px_size: float, target: float, seed: int, share: float = 0.05, chance: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(image, labels) resized so that a pixel is ``target`` long instead of ``px_size``.

    With probability ``chance`` a frame's factor is off by up to ``share`` of itself,
    told by a hash of seed and frame, so frames come in several sizes.  labels:
    (frame_id, cell, r, c), by nearest places.
    """
    off = share * (2 * _uniform(seed, "size", "frame_id") - 1)
    factor = px_size / target * (1 + F.when(_uniform(seed, "resize", "frame_id") <= chance, off).otherwise(0.0))
    size = lambda n: F.greatest(F.rint(n * factor), F.lit(1.0)).cast("int")
    return norm.resize(px, h, w, size(h), size(w)), norm.resize_masks(labels, h, w, size(h), size(w))
