"""Mothers and buds: features of pairs, truth pairs, probabilities, and the whole frame step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learn, objects, track
from .tables import stored

FEATURES = ("p_bud", "size_ratio", "neck_mean", "neck_ratio", "adjacency")


def joining_strips(pairs: DataFrame, h: int, w: int, narrowest: float = 2.0) -> DataFrame:
    """(frame_id, mother, bud, r, c): pixels of the rectangle from each mother's centre to the bud's.

    pairs: (frame_id, mother, bud, m_r, m_c, d_r, d_c, minor).  The rectangle is
    max(``narrowest``, a quarter of the bud's minor axis) wide.  Only the places of its
    bounding box are made; a place is inside if its offset from a corner lies
    within both sides.  Pairs with one centre have none.
    """
    hr, hc = F.col("d_r") - F.col("m_r"), F.col("d_c") - F.col("m_c")
    long = F.sqrt(hr * hr + hc * hc)
    wide = F.greatest(F.lit(narrowest), F.col("minor") * 0.25)
    p = pairs.withColumn("_hr", hr).withColumn("_hc", hc).withColumn("_len", long).filter("_len > 0")
    p = p.withColumn("_wr", F.try_divide(-wide * F.col("_hc"), F.col("_len"))).withColumn("_wc", F.try_divide(wide * F.col("_hr"), F.col("_len")))
    p = p.withColumn("_r0", F.col("m_r") - F.col("_wr") / 2).withColumn("_c0", F.col("m_c") - F.col("_wc") / 2)
    reach = lambda at, a, b, low, size: F.least(F.greatest((F.floor if low else F.ceil)((F.least if low else F.greatest)(F.col(at), F.col(at) + F.col(a), F.col(at) + F.col(b), F.col(at) + F.col(a) + F.col(b))), F.lit(0)), F.lit(size - 1)).cast("int")
    places = lambda at, a, b, size: F.explode(F.sequence(reach(at, a, b, True, size), reach(at, a, b, False, size)))
    p = p.withColumn("r", places("_r0", "_hr", "_wr", h)).withColumn("c", places("_c0", "_hc", "_wc", w))
    dr, dc = F.col("r") - F.col("_r0"), F.col("c") - F.col("_c0")
    along, across = dr * F.col("_hr") + dc * F.col("_hc"), dr * F.col("_wr") + dc * F.col("_wc")
    # rounded, as what lies on a side may come out a tiny bit off it
    within = lambda x, to: F.round(x, 9).between(0.0, F.round(to, 9))
    inside = within(along, F.col("_len") * F.col("_len")) & within(across, F.col("_wr") * F.col("_wr") + F.col("_wc") * F.col("_wc"))
    return p.filter(inside).select("frame_id", "mother", "bud", "r", "c")


def pair_features(masks: DataFrame, maps: DataFrame, h: int, w: int, neck_min: float = 0.2) -> DataFrame:
    """(frame_id, mother, bud, p_bud, size_ratio, neck_mean, neck_ratio, adjacency) of each ordered pair of a frame's objects.

    maps: (frame_id, r, c, p_neck, p_bud).  p_bud: mean over the bud; size_ratio:
    areas, mother by bud; in the strip that joins them: mean of the neck
    probabilities above ``neck_min`` (0 if there is none), their sum by the root
    of the bud's area, and the share of the strip that either object covers.
    Without a strip the last three are null.
    """
    f = objects.shape_features(masks).select("frame_id", "cell", "area", "centroid_r", "centroid_c", "minor")
    m = f.select("frame_id", F.col("cell").alias("mother"), F.col("area").alias("m_area"), F.col("centroid_r").alias("m_r"), F.col("centroid_c").alias("m_c"))
    d = f.select("frame_id", F.col("cell").alias("bud"), F.col("area").alias("d_area"), F.col("centroid_r").alias("d_r"), F.col("centroid_c").alias("d_c"), "minor")
    pairs = m.join(d, "frame_id").filter("mother <> bud")
    strip = joining_strips(pairs, h, w)
    key = ["frame_id", "mother", "bud"]
    above = F.col("p_neck") > neck_min
    neck = strip.join(maps.select("frame_id", "r", "c", "p_neck"), ["frame_id", "r", "c"], "left").groupBy(*key).agg(F.count("*").alias("_n"), F.coalesce(F.avg(F.when(above, F.col("p_neck"))), F.lit(0.0)).alias("neck_mean"), F.coalesce(F.sum(F.when(above, F.col("p_neck"))), F.lit(0.0)).alias("_sum"))
    met = strip.join(masks.select("frame_id", "cell", "r", "c"), ["frame_id", "r", "c"]).filter("cell = mother or cell = bud")
    covered = met.select(*key, "r", "c").distinct().groupBy(*key).agg(F.count("*").alias("_in"))
    buds = objects.mean_over(masks, maps.select("frame_id", "r", "c", F.col("p_bud").alias("v")), name="p_bud").withColumnRenamed("cell", "bud")
    out = pairs.join(buds, ["frame_id", "bud"], "left").join(neck, key, "left").join(covered, key, "left")
    return out.select(
        *key,
        "p_bud",
        (F.col("m_area") / F.col("d_area")).alias("size_ratio"),
        "neck_mean",
        (F.col("_sum") / F.sqrt("d_area")).alias("neck_ratio"),
        F.try_divide(F.coalesce("_in", F.lit(0)), F.col("_n")).alias("adjacency"),
    )


def truth_pairs(frames: DataFrame) -> DataFrame:
    """(frame_id, mother, bud): places (from 1) of mothers and of their buds in the frame.

    frames: (frame_id, labels, buds): buds[i] is the label of the bud of the i-th
    object, 0 if it has none; buds that aren't in the frame are left out.
    """
    one = frames.select("frame_id", F.posexplode(F.arrays_zip("labels", "buds")).alias("_i", "_o")).select("frame_id", (F.col("_i") + 1).alias("place"), "_o.labels", "_o.buds")
    mothers = one.filter("buds > 0").select("frame_id", F.col("place").alias("mother"), F.col("buds").alias("label"))
    return mothers.join(one.select("frame_id", F.col("place").alias("bud"), F.col("labels").alias("label")), ["frame_id", "label"]).select("frame_id", "mother", "bud")


def marked_pairs(features: DataFrame, truth: DataFrame) -> DataFrame:
    """All pairs and whether they are mother and bud (``is_pair``)."""
    marked = features.join(truth.select("frame_id", "mother", "bud").distinct().withColumn("_t", F.lit(1.0)), ["frame_id", "mother", "bud"], "left")
    return marked.withColumn("is_pair", F.coalesce("_t", F.lit(0.0))).drop("_t")


def bud_table(features: DataFrame, truth: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """Training rows: marked pairs with all features."""
    return marked_pairs(features, truth).dropna(subset=list(names))


def lost_pairs(features: DataFrame, truth: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """True pairs that ``bud_table`` leaves out since a feature is missing."""
    return truth.join(features.dropna(subset=list(names)).select("frame_id", "mother", "bud"), ["frame_id", "mother", "bud"], "left_anti")


def pair_probabilities(model: PipelineModel, features: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """(frame_id, mother, bud, p); pairs with a missing feature have probability 0."""
    return learn.probabilities(model, features, list(names)).select("frame_id", "mother", "bud", "p")


def frame_step(cells: DataFrame, pairs: DataFrame, features: Sequence[str] = ("x", "y"), scale: Sequence[float] = (50.0, 20000.0), depth: int = 3, threshold: float = 0.5, min_budness: float = 0.5, min_lifetime: int = 3) -> DataFrame:
    """(series, tp, cell, label, mother) of all frames: objects tracked, pairs told by label, mothers assigned.

    cells: (series, tp, cell, features); pairs: (series, tp, mother, bud, p) by
    cell of the frame.  0: no mother yet.
    """
    labelled = stored(track.track(cells, features, scale, depth, threshold))
    name = lambda c: labelled.select("series", "tp", F.col("cell").alias(c), F.col("label").alias(f"_{c}"))
    by_label = stored(pairs.join(name("mother"), ["series", "tp", "mother"]).join(name("bud"), ["series", "tp", "bud"]).select("series", "tp", F.col("_mother").alias("mother"), F.col("_bud").alias("bud"), "p"))
    mothers = track.assign_mothers(by_label, labelled.select("series", "tp", "label").distinct(), min_budness, min_lifetime)
    return labelled.join(mothers, ["series", "tp", "label"]).select("series", "tp", "cell", "label", "mother")
