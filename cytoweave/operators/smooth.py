"""Smoothing statistics: how well blurred objects come back after transformations, for each sigma."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate, tune
from .sample import draw

SIGMAS = tuple(round(0.4 + 0.2 * k, 1) for k in range(23))
ROTATIONS, SCALINGS = (7, 14, 21, 28, 35, 42), (0.5, 0.7, 0.9, 1.1, 1.3, 1.5)
STATS = "frame_id long, cell int, sigma double, rotation int, scaling double, n_edge int, area int, iou double, edge_iou double"


def blurred(mask: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian of radius 4 sigma, edges repeated."""
    radius = int(4 * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight /= weight.sum()
    for axis in (0, 1):
        wide = np.pad(mask.astype(float), [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        mask = sum(w * np.take(wide, np.arange(mask.shape[axis]) + k, axis) for k, w in enumerate(weight))
    return mask


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at places, edges repeated."""
    h, w = image.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    a, b = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    u, v = y - a, x - b
    c, d = np.minimum(a + 1, h - 1), np.minimum(b + 1, w - 1)
    return (1 - u) * ((1 - v) * image[a, b] + v * image[a, d]) + u * ((1 - v) * image[c, b] + v * image[c, d])


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """An image turned about its centre, of the same size."""
    a, (h, w) = np.deg2rad(degrees), image.shape
    r, c = np.indices(image.shape)
    y, x = r - (h - 1) / 2, c - (w - 1) / 2
    return sampled(image, y * np.cos(a) - x * np.sin(a) + (h - 1) / 2, y * np.sin(a) + x * np.cos(a) + (w - 1) / 2)


def scaled(image: np.ndarray, factor: float) -> np.ndarray:
    """An image resampled about its centre, of the same size."""
    (h, w), (r, c) = image.shape, np.indices(image.shape)
    return sampled(image, (r - (h - 1) / 2) / factor + (h - 1) / 2, (c - (w - 1) / 2) / factor + (w - 1) / 2)


def rim(mask: np.ndarray) -> np.ndarray:
    """Pixels with an unset neighbour of four."""
    wide = np.pad(mask, 1)
    return mask & ~(wide[2:, 1:-1] & wide[:-2, 1:-1] & wide[1:-1, 2:] & wide[1:-1, :-2])


def _share(a: np.ndarray, b: np.ndarray) -> float:
    union = np.count_nonzero(a | b)
    return np.count_nonzero(a & b) / union if union else 0.0


def recovered(mask: np.ndarray, sigma: float, rotation: int, scaling: float) -> tuple[float, float]:
    """Intersection over union, of areas and of rims, of an object and what half the height of its blurred image gives back.

    Rotated images are turned back before they are cut; scaled ones are held
    against the scaled object.
    """
    image = blurred(mask, sigma)
    if rotation:
        image = turned(turned(image, rotation), -rotation)
    if scaling != 1:
        image, mask = scaled(image, scaling), scaled(mask.astype(float), scaling) > 0.5
    back = image > 0.5
    return _share(back, mask), _share(rim(back), rim(mask))


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for x in batch.itertuples(index=False):
            r, c = np.array(x.r) - min(x.r), np.array(x.c) - min(x.c)
            # room for the widest blur, the diagonal and the largest scale
            side = int(1.5 * np.hypot(r.max() + 1, c.max() + 1)) + 2 * int(4 * x.sigma + 0.5) + 4
            mask = np.zeros((side, side), bool)
            mask[r + (side - r.max() - 1) // 2, c + (side - c.max() - 1) // 2] = True
            out.append((x.frame_id, x.cell, x.sigma, x.rotation, x.scaling, int(rim(mask).sum()), len(r), *recovered(mask, x.sigma, x.rotation, x.scaling)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STATS.split(", ")])


def smoothing_stats(masks: DataFrame, sigmas: Sequence[float] = SIGMAS, rotations: Sequence[int] = ROTATIONS, scalings: Sequence[float] = SCALINGS, seed: int = 0) -> DataFrame:
    """Recovery of each object (frame_id, cell, r, c; filled) for each sigma: as it is, turned, and scaled.

    One rotation and one scaling of each object are chosen by a hash, so reruns
    agree.  Every (object, sigma, transformation) is a row of one job.
    """
    cells = masks.groupBy("frame_id", "cell").agg(F.array_sort(F.collect_set(F.struct("r", "c"))).alias("_px"))
    pick = lambda tag, of: F.array(*[F.lit(x) for x in of])[(F.conv(F.substring(draw(f"{seed}:{tag}", F.col("frame_id"), F.col("cell")), 1, 8), 16, 10).cast("long") % len(of)).cast("int")]
    kinds = F.array(F.struct(F.lit(0).alias("rotation"), F.lit(1.0).alias("scaling")), F.struct(pick("turn", rotations).alias("rotation"), F.lit(1.0).alias("scaling")), F.struct(F.lit(0).alias("rotation"), pick("scale", [float(x) for x in scalings]).alias("scaling")))
    rows = cells.withColumn("_k", F.explode(kinds)).withColumn("sigma", F.explode(F.array(*[F.lit(float(s)) for s in sigmas])))
    flat = rows.select(F.col("frame_id").cast("long").alias("frame_id"), F.col("cell").cast("int").alias("cell"), "sigma", "_k.rotation", "_k.scaling", F.col("_px.r").alias("r"), F.col("_px.c").alias("c"))
    return flat.mapInPandas(_measure, STATS)


def smoothing_model(stats: DataFrame) -> tuple[float, float, float]:
    """(a, b, c) of sigma = log(max((n_edge - c) / a, 1)) / b, from each object's best sigma by recovered rims."""
    best = evaluate.best_per_group(stats, ["frame_id", "cell", "rotation", "scaling"], "edge_iou")
    return tune.fit_smoothing(best)
