"""SQL surface: sources and operators as temporary views, so that a query may be SQL text only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import match, morph, norm, objects, track
from ..sources import views
from . import generators


def register(spark: SparkSession, sf_dir: str) -> None:
    """Views of the sources (cw_pixels, cw_frames, cw_masks, cw_quadrants, cw_tracks, cw_volumes, cw_sets) and of operators over them.

    Operators: cw_normed (robust norm), cw_cells (shape features), cw_outlines
    (edges), cw_overlaps (intersections of a frame's objects), cw_links (candidate
    pairs), cw_labels (tracks).  Views are plans: nothing runs until they are read.
    """
    generators.register(spark)
    px, q, t = views.pixels(spark, sf_dir), views.quadrants(spark, sf_dir), views.tracks(spark, sf_dir)
    made: dict[str, DataFrame] = {
        "pixels": px,
        "frames": views.frames(spark, sf_dir),
        "masks": views.masks(spark, sf_dir),
        "quadrants": q,
        "tracks": t,
        "volumes": views.volumes(spark, sf_dir),
        "sets": views.sets(spark, sf_dir),
        "normed": norm.robust_norm(px),
        "cells": objects.shape_features(q),
        "outlines": morph.edges(q, views.SIDE, views.SIDE),
        "overlaps": match.intersections(q, q, ["r", "c"], ordered=True),
        "links": track.candidate_pairs(t),
        "labels": track.track(t),
    }
    for name, df in made.items():
        df.createOrReplaceTempView(f"cw_{name}")
