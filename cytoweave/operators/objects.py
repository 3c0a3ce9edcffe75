"""Object features, size groups, flattening and volumes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fold, morph

KEYS = ("frame_id", "cell")


def areas(mask: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return mask.groupBy(*keys).agg(F.count("*").alias("area"))


def area_filter(cells: DataFrame, lower: float, upper: float | None) -> DataFrame:
    """lower <= area < upper."""
    kept = cells.filter(F.col("area") >= lower)
    return kept if upper is None else kept.filter(F.col("area") < upper)


def shape_features(mask: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Area, centroid, bounding box, axes, eccentricity and orientation from second moments.

    Axes are 4 times the root of the eigenvalues of the covariance matrix (each
    pixel a unit square, so 1/12 is added to the variances).  Orientation is the
    angle of the major axis from the row axis, a quarter pi if there is none.
    """
    m = mask.groupBy(*keys).agg(
        F.count("*").alias("area"),
        F.avg("r").alias("centroid_r"),
        F.avg("c").alias("centroid_c"),
        F.min("r").alias("r0"),
        F.min("c").alias("c0"),
        (F.max("r") + 1).alias("r1"),
        (F.max("c") + 1).alias("c1"),
        (F.var_pop("r") + 1 / 12).alias("_vr"),
        (F.var_pop("c") + 1 / 12).alias("_vc"),
        F.covar_pop("r", "c").alias("_rc"),
    )
    # rounded, as what is 0 may come out as a tiny number of either sign
    lean, tall = F.round(2 * F.col("_rc"), 9), F.round(F.col("_vr") - F.col("_vc"), 9)
    half, root = (F.col("_vr") + F.col("_vc")) / 2, F.sqrt(F.pow((F.col("_vr") - F.col("_vc")) / 2, 2) + F.pow(F.col("_rc"), 2))
    m = m.withColumn("bbox_area", (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0"))).withColumn("_a", half + root).withColumn("_b", F.greatest(half - root, F.lit(0.0)))
    return (
        m.withColumn("extent", F.col("area") / F.col("bbox_area"))
        .withColumn("major", 4 * F.sqrt("_a"))
        .withColumn("minor", 4 * F.sqrt("_b"))
        .withColumn("eccentricity", F.when(F.col("_a") > 0, F.sqrt(1 - F.col("_b") / F.col("_a"))).otherwise(0.0))
        .withColumn("orientation", F.when((lean == 0) & (tall == 0), math.pi / 4).otherwise(0.5 * F.atan2(lean, tall)))
        .withColumn("diameter", F.sqrt(4 * F.col("area") / math.pi))
        .drop("_vr", "_vc", "_rc", "_a", "_b")
    )


def perimeters(mask: DataFrame, h: int, w: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Length of the outline: an edge pixel counts by its edge neighbours, 1 for a side, sqrt 2 for a corner, half each."""
    e = morph.edges(mask, h, w, keys)
    sides = morph.neighbours(e, keys, ((-1, 0), (1, 0), (0, -1), (0, 1))).join(e, [*keys, "r", "c"]).groupBy(*keys).agg(F.count("*").alias("_s"))
    corners = morph.neighbours(e, keys, ((-1, -1), (1, 1), (1, -1), (-1, 1))).join(e, [*keys, "r", "c"]).groupBy(*keys).agg(F.count("*").alias("_c"))
    met = e.groupBy(*keys).count().select(*keys).join(sides, list(keys), "left").join(corners, list(keys), "left")
    return met.select(*keys, ((F.coalesce("_s", F.lit(0)) + math.sqrt(2) * F.coalesce("_c", F.lit(0))) / 2).alias("perimeter"))


def _hull_area(r: np.ndarray, c: np.ndarray) -> int:
    """Pixels whose centres lie in the convex hull of the middles of all pixels' sides."""
    points = sorted({(y + dy, x + dx) for y, x in zip(r.tolist(), c.tolist(), strict=True) for dy, dx in ((0.5, 0.0), (-0.5, 0.0), (0.0, 0.5), (0.0, -0.5))})

    def chain(run: list) -> list:
        out: list = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array(chain(points) + chain(points[::-1]))
    y, x = np.mgrid[r.min() : r.max() + 1, c.min() : c.max() + 1]
    inside = np.ones(y.shape, bool)
    for (y0, x0), (y1, x1) in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        inside &= (y1 - y0) * (x - x0) - (x1 - x0) * (y - y0) >= -1e-9
    return int(inside.sum())


def convexity(mask: DataFrame) -> DataFrame:
    """(frame_id, cell, area, convex_area, solidity) of each object; one hull an object, many objects a batch."""

    def hulls(pdf: pd.DataFrame) -> pd.DataFrame:
        first = [*fold.starts(pdf["frame_id"].to_numpy(), pdf["cell"].to_numpy()), len(pdf)]
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        out = pdf.iloc[first[:-1]][["frame_id", "cell"]].reset_index(drop=True)
        out["area"] = [b - a for a, b in zip(first, first[1:], strict=False)]
        out["convex_area"] = [_hull_area(r[a:b], c[a:b]) for a, b in zip(first, first[1:], strict=False)]
        return out.assign(solidity=out["area"] / out["convex_area"])

    return fold.in_groups(mask.select("frame_id", "cell", "r", "c"), KEYS, [], hulls, "frame_id long, cell int, area long, convex_area long, solidity double")


def barycentre(cells: DataFrame, weighted: bool = False) -> DataFrame:
    """Adds the frame's barycentre and each object's distance and angle to it."""
    w = Window.partitionBy("frame_id")
    mean = lambda c: F.sum(F.col("area") * F.col(c)).over(w) / F.sum("area").over(w) if weighted else F.avg(c).over(w)
    out = cells.withColumn("bary_r", mean("centroid_r")).withColumn("bary_c", mean("centroid_c"))
    dr, dc = F.col("centroid_r") - F.col("bary_r"), F.col("centroid_c") - F.col("bary_c")
    return out.withColumn("distance", F.sqrt(dr * dr + dc * dc)).withColumn("angle", F.atan2(dr, dc))


def mean_over(mask: DataFrame, px: DataFrame, keys: Sequence[str] = KEYS, name: str = "score") -> DataFrame:
    """Mean pixel value over each object."""
    return mask.join(px.select("frame_id", "r", "c", "v"), ["frame_id", "r", "c"]).groupBy(*keys).agg(F.avg("v").alias(name))


def edge_scores(outlines: DataFrame, p_edge: DataFrame, h: int, w: int, dilations: int = 2) -> DataFrame:
    """Mean edge probability over outlines dilated ``dilations`` times."""
    return mean_over(morph.dilate(outlines, h, w, dilations), p_edge, name="edge_score")


def size_groups(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each (object, group): area in [lower, upper), null upper unbounded; groups may overlap.

    Where groups have a column budonly, true asks for the object's ``is_bud``;
    where they have a column group_focus, one that isn't null asks for the same
    ``focus`` of the object.  Groups are a table of parameters with a handful of rows.
    """
    g = F.broadcast(groups)
    meet = (cells["area"] >= g["lower"]) & (g["upper"].isNull() | (cells["area"] < g["upper"]))
    if "budonly" in groups.columns:
        meet = meet & (~g["budonly"] | cells["is_bud"])
    if "group_focus" in groups.columns:
        meet = meet & (g["group_focus"].isNull() | (g["group_focus"] == cells["focus"]))
    return cells.join(g, meet)


def flatten_target(stack: DataFrame, prop: str, h: int, w: int, dilations: int = 0, erosions: int = 0, widen_overlaps: int = 0) -> DataFrame:
    """(frame_id, r, c, v) of one target over the objects of a group, pixels of value 0 left out.

    stack: filled masks, or outlines for the property edge; each object is dilated
    and eroded on its own first.  filled and edge: any object; filledsum: their
    number; overlap: more than one, dilated ``widen_overlaps`` times; interior:
    any object but no overlap.
    """
    if dilations:
        stack = morph.dilate(stack, h, w, dilations)
    if erosions:
        stack = morph.erode(stack, erosions)
    n = stack.groupBy("frame_id", "r", "c").agg(F.count("*").cast("int").alias("v"))
    if prop == "filledsum":
        return n
    covered = n.select("frame_id", "r", "c", F.lit(1).alias("v"))
    if prop in ("filled", "edge"):
        return covered
    if prop not in ("overlap", "interior"):
        raise ValueError(f"no such property: {prop}")
    over = n.filter("v > 1").select("frame_id", "r", "c")
    if widen_overlaps:
        over = morph.dilate(over, h, w, widen_overlaps, ("frame_id",))
    return over.withColumn("v", F.lit(1)) if prop == "overlap" else covered.join(over, ["frame_id", "r", "c"], "left_anti")


def object_probabilities(members: DataFrame, preds: DataFrame) -> DataFrame:
    """(frame_id, cell, p): mean over an object's targets of the mean prediction inside its mask of that target.

    members: (frame_id, cell, target, r, c), the masks of each object as each
    target takes them; preds: (frame_id, target, r, c, p).
    """
    each = members.join(preds, ["frame_id", "target", "r", "c"]).groupBy("frame_id", "cell", "target").agg(F.avg("p").alias("p"))
    return each.groupBy("frame_id", "cell").agg(F.avg("p").alias("p"))


def flatten(mask: DataFrame) -> DataFrame:
    """(frame_id, r, c, filled, filledsum, overlap, interior) of each covered pixel."""
    n = mask.groupBy("frame_id", "r", "c").agg(F.count("*").alias("filledsum"))
    return n.select("frame_id", "r", "c", F.lit(1).alias("filled"), "filledsum", (F.col("filledsum") > 1).cast("int").alias("overlap"), (F.col("filledsum") == 1).cast("int").alias("interior"))


def bud_neck(mask: DataFrame, pairs: DataFrame, h: int, w: int, dilations: int = 2) -> DataFrame:
    """Pixels of buds under their dilated mothers; pairs: (frame_id, mother, bud)."""
    m = pairs.join(mask.withColumnRenamed("cell", "mother"), ["frame_id", "mother"])
    wide = morph.dilate(m, h, w, dilations, ("frame_id", "mother", "bud"))
    buds = mask.withColumnRenamed("cell", "bud")
    return wide.join(buds, ["frame_id", "bud", "r", "c"]).select("frame_id", "r", "c").distinct()


def outline_distance(mask: DataFrame, h: int, w: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distance of each pixel of an object to the object's nearest outline pixel (border pixels are outline).

    The squared distance splits into rows and columns: in each row of the object's
    box every column learns its nearest outline pixel by running windows, then
    each pixel meets the rows' answers in its own column.  An object of n pixels
    and height k makes n * k pairs, however long its outline is.
    """
    e = morph.edges(mask, h, w, keys).union(mask.filter(morph.border(h, w)).select(*keys, "r", "c")).distinct().withColumn("_e", F.col("c"))
    box = mask.groupBy(*keys).agg(F.min("r").alias("_r0"), F.max("r").alias("_r1"), F.min("c").alias("_c0"), F.max("c").alias("_c1"))
    grid = box.withColumn("r", F.explode(F.sequence("_r0", "_r1"))).withColumn("c", F.explode(F.sequence("_c0", "_c1"))).select(*keys, "r", "c").join(e, [*keys, "r", "c"], "left")
    line = Window.partitionBy(*keys, "r").orderBy("c")
    before, after = F.last("_e", True).over(line.rowsBetween(Window.unboundedPreceding, 0)), F.first("_e", True).over(line.rowsBetween(0, Window.unboundedFollowing))
    rows = grid.select(*keys, F.col("r").alias("_er"), "c", F.least(F.col("c") - before, after - F.col("c")).alias("_across")).filter("_across is not null")
    gap = F.col("r") - F.col("_er")
    return mask.select(*keys, "r", "c").distinct().join(rows, [*keys, "c"]).groupBy(*keys, "r", "c").agg(F.sqrt(F.min((gap * gap + F.col("_across") * F.col("_across")).cast("double"))).alias("d"))


def conical_volume(mask: DataFrame, h: int, w: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """4 times the sum of distances to the outline, plus the area."""
    return outline_distance(mask, h, w, keys).groupBy(*keys).agg((4 * F.sum("d") + F.count("*")).alias("volume"))


def union_of_spheres(mask: DataFrame, h: int, w: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Voxels covered by balls around each pixel that reach to the outline.

    A ball covers, above each place of its section, a run of voxels centred on the
    plane; runs of one place lie inside the longest, so a place needs the largest
    half height only and no voxel is made.
    """
    d = outline_distance(mask, h, w, keys).withColumn("_k", F.floor("d").cast("int"))
    d = d.withColumn("_x", F.explode(F.sequence(-F.col("_k"), F.col("_k"))))
    reach = F.floor(F.sqrt(F.greatest(F.col("d") * F.col("d") - F.col("_x") * F.col("_x"), F.lit(0.0))) + 1e-9).cast("int")
    d = d.withColumn("_y", F.explode(F.sequence(-reach, reach)))
    half = F.floor(F.sqrt(F.greatest(F.col("d") * F.col("d") - F.col("_x") * F.col("_x") - F.col("_y") * F.col("_y"), F.lit(0.0))) + 1e-9)
    place = d.groupBy(*keys, (F.col("r") + F.col("_x")).alias("_px"), (F.col("c") + F.col("_y")).alias("_py")).agg(F.max(half).alias("_half"))
    return place.groupBy(*keys).agg(F.sum(2 * F.col("_half") + 1).cast("long").alias("volume"))


def area_volume(area: Column) -> Column:
    """Volume of the sphere whose section has the area."""
    return 4 / 3 * math.pi * F.pow(F.sqrt(area / math.pi), 3)


def coordinates(mask: DataFrame) -> DataFrame:
    """Sorted 1-based coordinates of each object."""
    return mask.groupBy("frame_id", "cell").agg(F.to_json(F.array_sort(F.collect_list(F.array(F.col("r") + 1, F.col("c") + 1)))).alias("coords"))


def legacy_targets(mask: DataFrame, pairs: DataFrame, h: int, w: int, small: float = 0.7) -> DataFrame:
    """(target, frame_id, r, c): the older six channels of frames of filled objects.

    edge, filled, interior (filled once, no edge), overlap; budring: edges of a
    mother or its bud in the strip that joins their centres, closed and dilated;
    bud: buds of less than ``small`` of their mother's area.  pairs: (frame_id,
    mother, bud).
    """
    from . import buds

    rim = morph.edges(mask, h, w)
    places = ["frame_id", "r", "c"]
    counts = mask.groupBy(*places).agg(F.count("*").alias("_n"))
    edge = rim.select(*places).distinct()
    f = shape_features(mask).select("frame_id", "cell", "area", "centroid_r", "centroid_c", "minor")
    of = lambda side, tag: f.select("frame_id", F.col("cell").alias(side), F.col("area").alias(f"{tag}_area"), F.col("centroid_r").alias(f"{tag}_r"), F.col("centroid_c").alias(f"{tag}_c"), *(["minor"] if tag == "d" else []))
    met = pairs.join(of("mother", "m"), ["frame_id", "mother"]).join(of("bud", "d"), ["frame_id", "bud"])
    strip = buds.joining_strips(met, h, w, 0.0)
    junction = strip.join(rim, places).filter("cell = mother or cell = bud").select("frame_id", F.struct("mother", "bud").alias("cell"), "r", "c").distinct()
    ring = morph.dilate(morph.close(junction, h, w), h, w).select(*places).distinct()
    young = mask.join(met.filter(F.col("d_area") / F.col("m_area") < small).select("frame_id", F.col("bud").alias("cell")).distinct(), ["frame_id", "cell"], "left_semi").select(*places).distinct()
    parts = {"edge": edge, "filled": counts, "interior": counts.filter("_n = 1").join(edge, places, "left_anti"), "overlap": counts.filter("_n > 1"), "budring": ring, "bud": young}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("target"), *places)
        out = part if out is None else out.union(part)
    return out
