"""Polar outlines of objects: ray hits, periodic splines and refinement to edge maps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import morph, objects
from .tables import stored


def to_polar(px: DataFrame, centres: DataFrame) -> DataFrame:
    """Adds rho and phi of each pixel about its object's centre."""
    dr, dc = F.col("r") - F.col("centre_r"), F.col("c") - F.col("centre_c")
    return px.join(centres, ["frame_id", "cell"]).withColumn("rho", F.hypot(dr, dc)).withColumn("phi", F.atan2(dc, dr))


def ray_radii(outline: DataFrame, centres: DataFrame, rays: int) -> DataFrame:
    """(frame_id, cell, ray, radius): mean distance of outline pixels nearest each of ``rays`` directions.

    A direction without any pixel is interpolated between the next directions with
    one on either side, all the way round.
    """
    p = to_polar(outline, centres).withColumn("ray", F.pmod(F.rint(F.col("phi") / (2 * math.pi / rays)), F.lit(float(rays))).cast("int"))
    hit = p.groupBy("frame_id", "cell", "ray").agg(F.avg("rho").alias("radius"))
    every = hit.select("frame_id", "cell").distinct().withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(rays - 1))))
    return _around(every.join(hit, ["frame_id", "cell", "ray"], "left").withColumn("_n", F.lit(rays)))


#: Rays of an object by its major axis: below the first bound, below the second, beyond.
RAYS, RAY_BOUNDS = (4, 6, 8), (5.0, 20.0)


def with_angles(objects: DataFrame) -> DataFrame:
    """Adds ``angles`` of ``rays`` directions, evenly spaced from the first that the object's orientation gives."""
    step = 2 * math.pi / F.col("rays")
    over = F.pmod(F.col("orientation") + math.pi, step)
    first = F.when(step - over < 1e-9, 0.0).otherwise(over) - math.pi  # a whole step counts as none
    return objects.withColumn("angles", F.transform(F.sequence(F.lit(0), F.col("rays") - 1), lambda k: first + k * step))


def cast_rays(outline: DataFrame, objects: DataFrame, h: int, w: int, blur: float = 0.5, least: float = 0.01) -> DataFrame:
    """(frame_id, cell, ray, radius): where rays from the centres meet the objects' blurred outlines.

    objects: (frame_id, cell, centre_r, centre_c, angles, reach).  A ray is sampled
    each half pixel up to its reach, at the nearest places inside the frame; its
    hit is the mean of the samples whose value exceeds ``least``, weighted by these
    values.  A ray that meets nothing is interpolated between the next ones on
    either side, all the way round; without any hit all radii are 0.1.
    """
    soft = morph.blur(outline.select("frame_id", "cell", "r", "c", F.lit(1.0).alias("v")), h, w, blur, ("frame_id", "cell")).filter(F.col("v") > least)
    rays = objects.select("frame_id", "cell", "centre_r", "centre_c", "reach", F.posexplode("angles").alias("ray", "angle"))
    steps = F.sequence(F.lit(0), F.greatest(F.rint(2 * F.col("reach")).cast("int") - 1, F.lit(0)))
    at = lambda c, f: F.rint(F.round(F.col(c) + 0.5 * F.col("_k") * f("angle"), 9)).cast("int")
    samples = rays.withColumn("_k", F.explode(steps)).select("frame_id", "cell", "ray", at("centre_r", F.cos).alias("r"), at("centre_c", F.sin).alias("c"))
    total = lambda c: F.sum(F.col(c) * F.col("v")) / F.sum("v")
    hit = samples.join(soft, ["frame_id", "cell", "r", "c"]).groupBy("frame_id", "cell", "ray").agg(total("r").alias("_r"), total("c").alias("_c"))
    met = rays.join(hit, ["frame_id", "cell", "ray"], "left").select("frame_id", "cell", "ray", F.hypot(F.col("_r") - F.col("centre_r"), F.col("_c") - F.col("centre_c")).alias("radius"))
    n = F.count("*").over(Window.partitionBy("frame_id", "cell"))
    return _around(met.withColumn("_n", n)).withColumn("radius", F.coalesce("radius", F.lit(0.1)))


def _around(rays: DataFrame) -> DataFrame:
    """(frame_id, cell, ray, radius) with missing radii interpolated round the circle of ``_n`` rays."""
    # the circle is laid out three times, so that each gap has both neighbours
    turns = rays.withColumn("_turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_at", F.col("ray") + F.col("_turn") * F.col("_n"))
    w = Window.partitionBy("frame_id", "cell").orderBy("_at")
    known = F.when(F.col("radius").isNotNull(), F.struct("_at", "radius"))
    turns = turns.withColumn("_b", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_a", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    part = (F.col("_at") - F.col("_b._at")) / (F.col("_a._at") - F.col("_b._at"))
    filled = F.coalesce("radius", F.col("_b.radius") + part * (F.col("_a.radius") - F.col("_b.radius")))
    return turns.filter("_turn = 0").select("frame_id", "cell", "ray", filled.alias("radius"))


def ray_objects(mask: DataFrame) -> DataFrame:
    """(frame_id, cell, centre_r, centre_c, angles, reach) of objects: more rays for longer ones, as far as the box's diagonal."""
    major = F.col("major")
    rays = F.when(major < RAY_BOUNDS[0], RAYS[0]).when(major < RAY_BOUNDS[1], RAYS[1]).otherwise(RAYS[2])
    f = objects.shape_features(mask).withColumn("rays", rays).withColumn("reach", F.hypot(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")))
    return with_angles(f).select("frame_id", "cell", F.col("centroid_r").alias("centre_r"), F.col("centroid_c").alias("centre_c"), "angles", "reach")


def knots(mask: DataFrame, h: int, w: int) -> DataFrame:
    """(frame_id, cell, centre_r, centre_c, radii, angles): outlines of objects through ray hits."""
    edge = morph.edges(mask, h, w).union(mask.filter(morph.border(h, w)).select("frame_id", "cell", "r", "c")).distinct()
    f = stored(ray_objects(mask))
    radii = cast_rays(edge, f, h, w).groupBy("frame_id", "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("ray", "radius"))), lambda x: x["radius"]).alias("radii"))
    return f.join(radii, ["frame_id", "cell"]).select("frame_id", "cell", "centre_r", "centre_c", "radii", "angles")


def spline_basis(angles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at ``at`` of the periodic cubic interpolants of unit vectors at ``angles``."""
    n = len(angles)
    order = np.argsort(angles)
    x = angles[order]
    h = np.diff(np.append(x, x[0] + 2 * np.pi))
    a, b = np.zeros((n, n)), np.zeros((n, n))
    for k in range(n):
        p, q = h[k - 1], h[k]
        a[k, k - 1] += p
        a[k, k] += 2 * (p + q)
        a[k, (k + 1) % n] += q
        b[k, k - 1] += 6 / p
        b[k, k] -= 6 / p + 6 / q
        b[k, (k + 1) % n] += 6 / q
    curve = np.linalg.solve(a, b)
    t = x[0] + np.mod(at - x[0], 2 * np.pi)
    k = np.clip(np.searchsorted(x, t, side="right") - 1, 0, n - 1)
    u, d = t - x[k], h[k]
    nxt, unit = (k + 1) % n, np.eye(n)
    left, right = (1 - u / d)[:, None], (u / d)[:, None]
    bend = (((d - u) ** 3 / (6 * d)) - d * (d - u) / 6)[:, None] * curve[k] + ((u**3 / (6 * d)) - d * u / 6)[:, None] * curve[nxt]
    out = np.zeros((len(at), n))
    out[:, order] = left * unit[k] + right * unit[nxt] + bend
    return out


def rasterise(outlines: DataFrame, h: int, w: int, per_unit: float = 2.5) -> DataFrame:
    """Edge pixels of periodic cubic splines: outlines (frame_id, cell, centre_r, centre_c, radii, angles)."""

    def draw(batches):
        for batch in batches:
            parts = []
            for o in batch.itertuples(index=False):
                radii, angles = np.asarray(o.radii, float), np.asarray(o.angles, float)
                n = max(16, int(2 * np.pi * radii.max() * per_unit))
                phi = np.linspace(0, 2 * np.pi, n, endpoint=False)
                rho = spline_basis(angles, phi) @ radii
                r = np.clip(np.rint(o.centre_r + rho * np.cos(phi)), 0, h - 1).astype(np.int32)
                c = np.clip(np.rint(o.centre_c + rho * np.sin(phi)), 0, w - 1).astype(np.int32)
                parts.append(np.unique(r.astype(np.int64) << 32 | c))
            sizes = [len(p) for p in parts]
            at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pd.DataFrame({"frame_id": np.repeat(batch["frame_id"].to_numpy(), sizes), "cell": np.repeat(batch["cell"].to_numpy(), sizes), "r": (at >> 32).astype(np.int32), "c": (at & 0xFFFFFFFF).astype(np.int32)})

    return outlines.mapInPandas(draw, "frame_id long, cell int, r int, c int")


#: Edge pixels from this probability on count, and of their weights those above the second.
EDGE_MIN, WEIGHT_MIN = 0.2, 0.1
#: Pixels that a fit needs, and the largest change of a radius by its share.
LEAST_PIXELS, RADIUS_CHANGE = 10, 0.3
#: Decay of a pixel's weight outside (squared) and inside of an outline.
OUTSIDE, INSIDE = 5.0, 1.0
#: Pixels beyond an outline at which it weighs nothing (below 1e-8), and the side of the tiles that pixels and objects meet in.
FAR, TILE = 10.0, 32


def curves(radii: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, ...]:
    """Knots by rising angle, their radii, bends and gaps of periodic cubic splines (objects, knots)."""
    order = np.argsort(angles, axis=1)
    x, y = np.take_along_axis(angles, order, 1), np.take_along_axis(radii, order, 1)
    gap = np.diff(x, axis=1, append=x[:, :1] + 2 * np.pi)
    last, n = np.roll(gap, 1, axis=1), x.shape[1]
    system, k = np.zeros((*x.shape, n)), np.arange(n)
    system[:, k, k] += 2 * (last + gap)
    np.add.at(system, (slice(None), k, (k - 1) % n), last)
    np.add.at(system, (slice(None), k, (k + 1) % n), gap)
    slope = (np.roll(y, -1, axis=1) - y) / gap
    bend = np.linalg.solve(system, 6 * (slope - np.roll(slope, 1, axis=1))[..., None])[..., 0]
    return x, y, bend, gap


def on_curve(curve: tuple[np.ndarray, ...], which: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Radius at angle ``phi`` of curve ``which``, for each pair."""
    x, y, bend, gap = curve
    t = x[which, 0] + np.mod(phi - x[which, 0], 2 * np.pi)
    k = (t[:, None] >= x[which]).sum(axis=1) - 1
    nxt = (k + 1) % x.shape[1]
    u, d = t - x[which, k], gap[which, k]
    a = d - u
    return (a * y[which, k] + u * y[which, nxt]) / d + (a**3 / (6 * d) - d * a / 6) * bend[which, k] + (u**3 / (6 * d) - d * u / 6) * bend[which, nxt]


def fit_outlines(radii: np.ndarray, angles: np.ndarray, which: np.ndarray, rho: np.ndarray, phi: np.ndarray, weight: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Radii and angles (objects, knots) fitted to weighted pixels of many objects at once.

    Least squares by damped Gauss-Newton steps, each object with a damping of its
    own.  A radius may change by RADIUS_CHANGE of itself, an angle by a quarter of
    the knots' spacing; what stands at such a bound and would go beyond stays.
    """
    m, n = radii.shape
    moved = np.zeros((m, 2 * n))
    damp = np.full(m, 1e-2)

    def shape(move):
        return radii * (1 + RADIUS_CHANGE * move[:, :n]), angles + move[:, n:] * np.pi / (2 * n)

    def off(move):
        return weight * (rho - on_curve(curves(*shape(move)), which, phi))

    now = off(moved)
    cost = np.bincount(which, now * now, m)
    for _ in range(rounds):
        slopes = np.empty((len(rho), 2 * n))
        for p in range(2 * n):
            at = moved.copy()
            step = np.where(at[:, p] > 0, -1e-5, 1e-5)
            at[:, p] += step
            slopes[:, p] = (off(at) - now) / step[which]
        normal, pull = np.zeros((m, 2 * n, 2 * n)), np.zeros((m, 2 * n))
        np.add.at(normal, which, slopes[:, :, None] * slopes[:, None, :])
        np.add.at(pull, which, slopes * now[:, None])
        stuck = ((moved >= 1) & (pull < 0)) | ((moved <= -1) & (pull > 0))
        normal[stuck] = 0.0
        np.swapaxes(normal, 1, 2)[stuck] = 0.0
        diagonal = np.einsum("mpp->mp", normal)
        diagonal += damp[:, None] * diagonal + 1e-9 + stuck
        trial = np.clip(moved - np.linalg.solve(normal, np.where(stuck, 0.0, pull)[..., None])[..., 0], -1, 1)
        then = off(trial)
        new = np.bincount(which, then * then, m)
        better = new < cost
        gain = np.where(better, cost - new, 0.0)
        moved[better], damp = trial[better], np.where(better, damp * 0.3, damp * 5)
        now = np.where(better[which], then, now)
        done = gain <= 1e-7 * np.maximum(cost, 1e-12)
        cost = np.where(better, new, cost)
        if (done & (better | (damp > 1e6))).all():
            break
    return shape(moved)


def _by_knots(batch: pd.DataFrame) -> Iterator[np.ndarray]:
    """Places of a batch's rows, those with one number of knots at a time."""
    sizes = batch["radii"].map(len).to_numpy()
    for n in np.unique(sizes):
        yield np.flatnonzero(sizes == n)


def _weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weight of each pixel by how far it lies from an object's outline."""
    for batch in batches:
        weight = np.zeros(len(batch))
        for at in _by_knots(batch):
            part = batch.iloc[at]
            _, first, which = np.unique(part[["frame_id", "grp", "cell"]].to_numpy(np.int64), axis=0, return_index=True, return_inverse=True)
            which = which.ravel()
            curve = curves(np.array(part["radii"].iloc[first].tolist(), float), np.array(part["angles"].iloc[first].tolist(), float))
            off = part["rho"].to_numpy() - on_curve(curve, which, part["phi"].to_numpy())
            weight[at] = np.where(off >= 0, np.exp(-(off**2) / OUTSIDE), np.exp(np.minimum(off, 0) / INSIDE))
        yield batch.drop(columns=["radii", "angles"]).assign(w=weight)


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fits of a batch's objects, those with one number of knots together, some thousand pixels at a time."""
    for batch in batches:
        for rows in _by_knots(batch):
            pixels = batch["rho"].iloc[rows].map(len).to_numpy()
            for at in np.split(rows, np.flatnonzero(np.diff(np.cumsum(pixels) // 50_000)) + 1):
                part = batch.iloc[at]
                which = np.repeat(np.arange(len(at)), part["rho"].map(len))
                radii, angles = fit_outlines(*[np.array(part[c].tolist(), float) for c in ("radii", "angles")], which, *[np.concatenate(part[c].tolist()) for c in ("rho", "phi", "weight")])
                yield pd.DataFrame({"frame_id": part["frame_id"], "grp": part["grp"], "cell": part["cell"], "radii": list(radii), "angles": list(angles)})


def refine(edge_px: DataFrame, shapes: DataFrame) -> DataFrame:
    """Outlines (frame_id, grp, cell, centre_r, centre_c, radii, angles) fitted to their groups' edge pixels (frame_id, grp, r, c, p).

    A pixel weighs for an object by its probability, by how near the object's first
    outline it lies, and the less the nearer it lies to others of this and the
    neighbouring groups that have edge pixels (one less the mean of their weights).
    Objects with fewer than LEAST_PIXELS of enough weight keep their outline.
    Pixels and objects meet in tiles of the frame, so only those that are near
    each other make a pair.
    """
    px = edge_px.filter(F.col("p") > EDGE_MIN).select("frame_id", "grp", "r", "c", "p")
    active = px.select("frame_id", "grp").distinct()
    use = shapes.join(active, ["frame_id", "grp"], "left_semi")
    near = use.withColumn("_g", F.explode(F.array(F.col("grp") - 1, F.col("grp"), F.col("grp") + 1)))
    others = near.groupBy("frame_id", F.col("_g").alias("grp")).agg((F.count("*") - 1).alias("_others"))
    reach = F.array_max("radii") * (1 + RADIUS_CHANGE) + FAR
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("_reach")) / TILE), F.floor((F.col(c) + F.col("_reach")) / TILE)))
    tiled = near.withColumn("_reach", reach).withColumn("_tr", span("centre_r")).withColumn("_tc", span("centre_c"))
    own = px.select("frame_id", F.col("grp").alias("_g"), F.floor(F.col("r") / TILE).alias("_tr"), F.floor(F.col("c") / TILE).alias("_tc"), "r", "c", "p")
    dr, dc = F.col("r") - F.col("centre_r"), F.col("c") - F.col("centre_c")
    met = own.join(tiled, ["frame_id", "_g", "_tr", "_tc"]).withColumn("rho", F.hypot(dr, dc)).filter(F.col("rho") <= F.col("_reach"))
    pairs = met.select("frame_id", F.col("_g").cast("int").alias("of"), "r", "c", "p", F.col("grp").cast("int").alias("grp"), F.col("cell").cast("int").alias("cell"), "rho", F.atan2(dc, dr).alias("phi"), "radii", "angles")
    kept = "frame_id long, of int, r int, c int, p double, grp int, cell int, rho double, phi double"
    weighed = pairs.mapInPandas(_weigh, f"{kept}, w double").withColumn("_all", F.sum("w").over(Window.partitionBy("frame_id", "of", "r", "c")))
    mine = weighed.filter("of = grp").join(others, ["frame_id", "grp"])
    rest = F.when(F.col("_others") > 0, (F.col("_all") - F.col("w")) / F.col("_others")).otherwise(0.0)
    weight = mine.withColumn("weight", F.col("p") * F.col("w") * (1 - rest)).filter(F.col("weight") > WEIGHT_MIN)
    lists = weight.groupBy("frame_id", "grp", "cell").agg(*[F.collect_list(c).alias(c) for c in ("rho", "phi", "weight")]).filter(F.size("rho") >= LEAST_PIXELS)
    better = lists.join(use.select("frame_id", "grp", "cell", "radii", "angles"), ["frame_id", "grp", "cell"]).mapInPandas(_fit, "frame_id long, grp int, cell int, radii array<double>, angles array<double>")
    new = better.select("frame_id", "grp", "cell", F.col("radii").alias("_radii"), F.col("angles").alias("_angles"))
    found = shapes.join(new, ["frame_id", "grp", "cell"], "left")
    return found.withColumn("radii", F.coalesce("_radii", "radii")).withColumn("angles", F.coalesce("_angles", "angles")).select(shapes.columns)


def ellipse(features: DataFrame, points: int = 64) -> DataFrame:
    """Pixels of the ellipse of each object's axes (centroid, major, minor, orientation)."""
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: k * (2 * math.pi / points)))
    a, b = F.col("major") / 2 * F.cos("_t"), F.col("minor") / 2 * F.sin("_t")
    r = F.rint(F.col("centroid_r") + a * F.cos("orientation") - b * F.sin("orientation"))
    c = F.rint(F.col("centroid_c") + a * F.sin("orientation") + b * F.cos("orientation"))
    return features.withColumn("_t", t).select("frame_id", "cell", r.cast("int").alias("r"), c.cast("int").alias("c")).distinct()


def redraw(outlines: DataFrame, factor: float, h: int, w: int) -> tuple[DataFrame, DataFrame]:
    """(edges, masks) of outlines in a frame ``factor`` times as large, h by w: drawn anew and filled.

    outlines: (frame_id, cell, centre_r, centre_c, radii, angles).
    """
    large = outlines.withColumns({"centre_r": F.col("centre_r") * factor, "centre_c": F.col("centre_c") * factor, "radii": F.transform("radii", lambda x: x * factor)})
    drawn = stored(rasterise(large, h, w).select("frame_id", "cell", "r", "c"))
    return drawn, morph.fill_holes(drawn, h, w)
