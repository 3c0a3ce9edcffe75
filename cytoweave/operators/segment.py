"""Instances from prediction maps, one size group after the other, and their duplicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fold, match, morph, norm, objects, outlines
from .tables import stored


@dataclass(frozen=True)
class GroupParams:
    """Parameters of one size group; a threshold of 0 means 0.5."""

    members: tuple[str, ...]
    edge: str | None = None
    threshold: float = 0.5
    closing: int = 0
    opening: int = 0
    grow: int = 0
    lower: float = 1.0
    upper: float | None = None
    edge_min: float | None = None
    connectivity: int = 2


def segment_group(preds: DataFrame, p: GroupParams, h: int, w: int) -> DataFrame:
    """(frame_id, cell, r, c) of one group.

    The members' largest map, less the edge map, is cut at the threshold
    (strictly above); its components are closed, opened and grown one by one, then
    kept by area (lower <= a < upper) and mean edge probability over the outline
    dilated twice (strictly above).
    """
    inside = norm.group_prediction(preds, p.members).withColumnRenamed("p", "v")
    edge = preds.filter(F.col("target") == p.edge).select("frame_id", "r", "c", F.col("p").alias("v")) if p.edge else None
    if edge is not None:
        inside = norm.dampen_edges(inside, edge)
    cells = morph.components(inside.filter(F.col("v") > (p.threshold or 0.5)), p.connectivity)
    if p.closing:
        cells = morph.close(cells, h, w, p.closing)
    if p.opening:
        cells = morph.open_(cells, h, w, p.opening)
    if p.grow:
        cells = morph.dilate(cells, h, w, p.grow)
    cells = stored(cells)
    kept = objects.area_filter(objects.areas(cells), p.lower, p.upper).select("frame_id", "cell")
    if edge is not None and p.edge_min is not None:
        scores = objects.edge_scores(morph.edges(cells, h, w), edge, h, w)
        kept = kept.join(scores.filter(F.col("edge_score") > p.edge_min).select("frame_id", "cell"), ["frame_id", "cell"])
    return cells.join(kept, ["frame_id", "cell"], "left_semi")


def segment(preds: DataFrame, groups: Sequence[GroupParams], h: int, w: int, containment: float = 0.8) -> DataFrame:
    """(frame_id, grp, cell, r, c) of all groups, smallest first, without duplicates of adjacent groups."""
    parts = [segment_group(preds, p, h, w).select("frame_id", F.lit(k).alias("grp"), "cell", "r", "c") for k, p in enumerate(groups)]
    masks = parts[0]
    for part in parts[1:]:
        masks = masks.union(part)
    return remove_duplicates(stored(masks), containment)


def padded_size(n: int, least: int = 64, step: int = 16) -> int:
    """The size that a model takes for n rows or columns: at least ``least``, a multiple of ``step``."""
    return max(least, -(-n // step) * step)


def predict(px: DataFrame, predictor: Callable[[np.ndarray], dict[str, np.ndarray]], h: int, w: int, frames_at_once: int = 64) -> DataFrame:
    """(frame_id, target, r, c, p): maps of a user's predictor for frames (frame_id, r, c, v) of h by w.

    The predictor takes frames (n, H, W), normalised by robust range and padded
    with their medians to sizes that its layers take, centred, and gives a map of
    that shape for each target name; the padding is cut off again.
    """
    high, wide = padded_size(h), padded_size(w)
    top, left = (high - h) // 2, (wide - w) // 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = fold.starts(pdf["frame_id"].to_numpy())
        names, which = pdf["frame_id"].to_numpy()[first], np.searchsorted(first, np.arange(len(pdf)), side="right") - 1
        out = []
        for k in range(0, len(first), frames_at_once):
            rows = (which >= k) & (which < k + frames_at_once)
            img = np.zeros((min(frames_at_once, len(first) - k), h, w))
            img[which[rows] - k, pdf["r"][rows], pdf["c"][rows]] = pdf["v"][rows]
            full = np.broadcast_to(np.median(img, axis=(1, 2))[:, None, None], (len(img), high, wide)).copy()
            full[:, top : top + h, left : left + w] = img
            g, r, c = np.indices(img.shape)
            for target, p in predictor(full).items():
                out.append(pd.DataFrame({"frame_id": names[k + g.ravel()], "target": target, "r": r.ravel().astype(np.int32), "c": c.ravel().astype(np.int32), "p": np.asarray(p, float)[:, top : top + h, left : left + w].ravel()}))
        return pd.concat(out, ignore_index=True)

    rows = norm.robust_norm(px.select("frame_id", "r", "c", "v"))
    return fold.in_groups(rows, ["frame_id"], [], run, "frame_id long, target string, r int, c int, p double")


@dataclass(frozen=True)
class Segmented:
    """Objects of all frames: masks (frame_id, cell, r, c), outlines with radii, edge pixels of these, volumes."""

    masks: DataFrame
    outlines: DataFrame
    edges: DataFrame
    volumes: DataFrame | None


def segment_full(preds: DataFrame, groups: Sequence[GroupParams], h: int, w: int, containment: float = 0.8, refine_outlines: bool = False, return_volume: bool = False) -> Segmented:
    """Instances of all groups numbered from 1 in each frame, with outlines, optional refinement and volumes.

    Outlines are periodic splines through ray hits; refinement fits their radii to
    the groups' edge maps; masks then are what the drawn outlines enclose.
    """
    found = segment(preds, groups, h, w, containment)
    number = F.dense_rank().over(Window.partitionBy("frame_id").orderBy("grp", "cell"))
    masks = stored(found.select("frame_id", "grp", number.alias("_n"), "r", "c").withColumnRenamed("_n", "cell"))
    shown = outlines.knots(masks, h, w)
    if refine_outlines:
        shown = stored(shown)
        edge_of = preds.sparkSession.createDataFrame([(k, p.edge) for k, p in enumerate(groups) if p.edge], "grp int, target string")
        edge_px = preds.join(F.broadcast(edge_of), "target").select("frame_id", "grp", "r", "c", "p")
        group = masks.select("frame_id", "cell", "grp").distinct()
        shown = outlines.refine(edge_px, shown.join(group, ["frame_id", "cell"])).select(*shown.columns)
    shown = stored(shown)
    edges = stored(outlines.rasterise(shown, h, w))
    filled = stored(morph.fill_holes(edges, h, w)) if refine_outlines else masks.select("frame_id", "cell", "r", "c")
    return Segmented(filled, shown, edges, objects.conical_volume(filled, h, w) if return_volume else None)


def segment_batch(preds: DataFrame, groups: Sequence[GroupParams], h: int, w: int, containment: float = 0.8) -> DataFrame:
    """The older form: (frame_id, grp, cell, r, c), of each pair of containing objects of adjacent groups the loser goes, all at once."""
    parts = [segment_group(preds, p, h, w).select("frame_id", F.lit(k).alias("grp"), "cell", "r", "c") for k, p in enumerate(groups)]
    masks = parts[0]
    for part in parts[1:]:
        masks = masks.union(part)
    low, up = masks.select("frame_id", "grp", "cell", "r", "c"), masks.select("frame_id", (F.col("grp") - 1).alias("grp"), "cell", "r", "c")
    pairs = match.intersections(low, up, ["r", "c"], ("frame_id", "grp")).withColumn("containment", match.containment())
    scored = pairs.select("frame_id", F.col("grp").alias("grp_a"), (F.col("grp") + 1).alias("grp_b"), "ta", "tb", F.col("area_a").alias("score_a"), F.col("area_b").alias("score_b"), "containment")
    return match.drop_adjacent_duplicates(scored, masks, containment)


def threshold_masks(interior: DataFrame, h: int, w: int, threshold: float = 0.9, overlap: DataFrame | None = None, overlap_threshold: float = 0.9, dilate: bool = True) -> DataFrame:
    """(frame_id, cell, r, c): components above the threshold, each merged with the overlap map where they meet.

    A component (dilated once if asked) and the overlap pixels of its frame are
    closed together; of the connected parts that this gives, the one of largest
    intersection over union with the component takes its place (the first of
    equals; if closing leaves nothing, the component stays).  So objects may share
    overlap pixels.
    """
    seeds = morph.components(interior.filter(F.col("v") > threshold))
    if dilate:
        seeds = morph.dilate(seeds, h, w)
    if overlap is None:
        return seeds
    seeds = stored(seeds)
    shared = overlap.filter(F.col("v") > overlap_threshold).select("frame_id", "r", "c")
    both = seeds.union(seeds.select("frame_id", "cell").distinct().join(shared, "frame_id").select("frame_id", "cell", "r", "c")).distinct()
    found = stored(morph.parts(morph.close(both, h, w)))
    here = found.join(seeds.withColumn("_in", F.lit(1)), ["frame_id", "cell", "r", "c"], "left")
    sizes = here.groupBy("frame_id", "cell", "part").agg(F.count("*").alias("_n"), F.count("_in").alias("_both")).join(objects.areas(seeds).withColumnRenamed("area", "_a"), ["frame_id", "cell"])
    share = F.col("_both") / (F.col("_n") + F.col("_a") - F.col("_both"))
    best = sizes.groupBy("frame_id", "cell").agg(F.max_by("part", F.struct(share, -F.col("part"))).alias("part"))
    merged = found.join(best, ["frame_id", "cell", "part"], "left_semi").select("frame_id", "cell", "r", "c")
    return merged.union(seeds.join(best, ["frame_id", "cell"], "left_anti").select("frame_id", "cell", "r", "c"))


def threshold_segmentation(interior: DataFrame, h: int, w: int, bud: DataFrame | None = None, overlap: DataFrame | None = None, edge: DataFrame | None = None, thresholds: tuple[float, float, float] = (0.9, 0.9, 0.9), bud_overlap: bool = False, is_bud: float | None = 0.5, radial: bool = False) -> DataFrame:
    """(frame_id, cell, r, c): outlines of threshold masks, drawn as splines through ray hits if ``radial``.

    Maps are (frame_id, r, c, v); thresholds are those of interior, overlap and
    buds.  ``edge`` dampens the interior.  Objects that match a bud go: those whose
    containment (IoU if ``radial``) exceeds ``is_bud``, each bud taking one; without ``is_bud`` buds dampen
    the interior instead.  Objects are numbered from 1, interior ones first.
    """
    if bud is not None and is_bud is None:
        interior = norm.dampen_edges(interior, bud)
    if edge is not None:
        interior = norm.dampen_edges(interior, edge)
    masks = threshold_masks(interior, h, w, thresholds[0], overlap, thresholds[1]).withColumn("grp", F.lit(0))
    if bud is not None:
        buds = stored(threshold_masks(bud, h, w, thresholds[2], overlap if bud_overlap else None, thresholds[1], False))
        if is_bud is not None:
            masks = unmatched(masks, buds, is_bud, match.iou() if radial else match.containment()).select("frame_id", "cell", "r", "c", "grp")
        masks = masks.union(buds.withColumn("grp", F.lit(1)))
    number = F.dense_rank().over(Window.partitionBy("frame_id").orderBy("grp", "cell"))
    found = masks.select("frame_id", number.alias("cell"), "r", "c")
    return outlines.rasterise(outlines.knots(found, h, w), h, w) if radial else morph.edges(found, h, w)


def radial_regions(px: DataFrame, threshold: float, h: int, w: int) -> DataFrame:
    """(frame_id, cell, r, c): drawn spline outlines of the components above the threshold."""
    return outlines.rasterise(outlines.knots(stored(morph.components(px.filter(F.col("v") > threshold))), h, w), h, w)


def remove_duplicates(masks: DataFrame, threshold: float) -> DataFrame:
    """Of objects of adjacent groups that contain each other beyond the threshold the smaller goes; on a tie the upper.

    Pairs are walked in order (lower group, lower cell, upper cell) and a pair is
    skipped once one of its objects is gone, so a frame's pairs are one fold; the
    pairs themselves come from an equality join on places.
    """
    low, up = masks.select("frame_id", "grp", "cell", "r", "c"), masks.select("frame_id", (F.col("grp") - 1).alias("grp"), "cell", "r", "c")
    pairs = match.intersections(low, up, ["r", "c"], ("frame_id", "grp")).withColumn("containment", match.containment()).filter(F.col("containment") > threshold)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        gone = set()
        for x in pdf.itertuples(index=False):
            a, b = (x.frame_id, x.grp, x.ta), (x.frame_id, x.grp + 1, x.tb)
            if a not in gone and b not in gone:
                gone.add(a if x.area_a < x.area_b else b)
        return pd.DataFrame(sorted(gone), columns=["frame_id", "grp", "cell"])

    lost = fold.in_groups(pairs.select("frame_id", "grp", "ta", "tb", "area_a", "area_b"), ["frame_id"], ["grp", "ta", "tb"], walk, "frame_id long, grp int, cell int")
    return masks.join(lost, ["frame_id", "grp", "cell"], "left_anti")


def unmatched(masks: DataFrame, reference: DataFrame, threshold: float, measure: Column | None = None) -> DataFrame:
    """Objects that no reference object matches beyond the threshold (IoU unless told otherwise).

    Objects take in order the best reference that is left, so each is used once.
    """
    pairs = match.intersections(masks, reference, ["r", "c"]).withColumn("iou", match.iou() if measure is None else measure).filter(F.col("iou") > threshold)

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        used, found = set(), set()
        for f, a, b in zip(pdf["frame_id"], pdf["ta"], pdf["tb"], strict=True):
            if (f, a) not in found and (f, b) not in used:
                used.add((f, b))
                found.add((f, a))
        return pd.DataFrame(sorted(found), columns=["frame_id", "cell"])

    found = fold.in_groups(pairs.select("frame_id", "ta", "tb", "iou"), ["frame_id"], ["ta", F.desc("iou"), "tb"], claim, "frame_id long, cell int")
    return masks.join(found, ["frame_id", "cell"], "left_anti")


def ranked_regions(px: DataFrame, threshold: float) -> DataFrame:
    """(frame_id, cell, score, rank): components above the threshold by falling mean value."""
    cells = morph.components(px.filter(F.col("v") > threshold))
    scored = objects.mean_over(cells, px)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("score"), "cell")))
