"""Tiling of large frames and stitching with a cross-fade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = tuple(range(64, 257, 8))


def plan(frames: DataFrame, overlap: int = 48, sizes=SIZES, fits: int = 256) -> DataFrame:
    """(frame_id, h, w, th, tw, nh, nw): tile size of each axis with least padding for each tile; null if the frame fits."""

    def axis(n: Column) -> Column:
        options = F.array(*[F.struct(_padding(n, s, overlap).alias("cost"), F.lit(s).alias("size"), _count(n, s, overlap).alias("tiles")) for s in sizes if s > overlap + 32])
        return F.array_min(options)

    small = (F.col("h") <= fits) & (F.col("w") <= fits)
    p = frames.withColumn("_h", axis(F.col("h"))).withColumn("_w", axis(F.col("w")))
    pick = lambda c, f: F.when(~small, F.col(f"{c}.{f}")).cast("int")
    return p.select("frame_id", "h", "w", pick("_h", "size").alias("th"), pick("_w", "size").alias("tw"), pick("_h", "tiles").alias("nh"), pick("_w", "tiles").alias("nw"))


def _count(n: Column, size: int, overlap: int) -> Column:
    return F.greatest(F.ceil((n - overlap) / F.lit(float(size - overlap))), F.lit(1)).cast("int")


def _padding(n: Column, size: int, overlap: int) -> Column:
    k = _count(n, size, overlap)
    return (k * (size - overlap) + overlap - n) / k.cast("double")


def cut(px: DataFrame, size: int, overlap: int, nh: int, nw: int) -> DataFrame:
    """Pixels dealt to the tiles that hold them: (frame_id, ti, tj, r, c, v), places within the tile."""
    step = size - overlap
    of = lambda x, n: F.sequence(F.greatest(F.ceil((x - size + 1) / F.lit(float(step))), F.lit(0)).cast("int"), F.least(F.floor(x / F.lit(float(step))), F.lit(n - 1)).cast("int"))
    tiles = px.withColumn("ti", F.explode(of(F.col("r"), nh))).withColumn("tj", F.explode(of(F.col("c"), nw)))
    return tiles.select("frame_id", "ti", "tj", (F.col("r") - F.col("ti") * step).alias("r"), (F.col("c") - F.col("tj") * step).alias("c"), "v")


def fade(place: Column, tile: Column, size: int, overlap: int, n: int) -> Column:
    """Weight of a place in a tile: rising over the overlap with the tile before, falling over that with the next."""
    up = F.when((tile > 0) & (place < overlap), (place + 1) / F.lit(float(overlap + 1))).otherwise(1.0)
    down = F.when((tile < n - 1) & (place >= size - overlap), (F.lit(size) - place) / F.lit(float(overlap + 1))).otherwise(1.0)
    return up * down


def stitch(tiles: DataFrame, size: int, overlap: int, nh: int, nw: int) -> DataFrame:
    """Frames from tiles by weighted sums; weights of overlapping tiles add up to 1 (size >= 2 overlap)."""
    if size < 2 * overlap:
        raise ValueError("tiles are smaller than two overlaps")
    step = size - overlap
    w = fade(F.col("r"), F.col("ti"), size, overlap, nh) * fade(F.col("c"), F.col("tj"), size, overlap, nw)
    return tiles.select("frame_id", (F.col("r") + F.col("ti") * step).alias("r"), (F.col("c") + F.col("tj") * step).alias("c"), (F.col("v") * w).alias("v")).groupBy("frame_id", "r", "c").agg(F.sum("v").alias("v"))


def windows(px: DataFrame, centres: DataFrame, half: int) -> DataFrame:
    """A window round each centre, (frame_id, centre, r, c, v); places outside the frame get the frame's median."""
    grid = centres.withColumn("dr", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("dc", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    grid = grid.select("frame_id", "centre", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), (F.col("dr") + half).alias("wr"), (F.col("dc") + half).alias("wc"))
    median = px.groupBy("frame_id").agg(F.percentile("v", 0.5).alias("_m"))
    met = grid.join(px.select("frame_id", "r", "c", "v"), ["frame_id", "r", "c"], "left").join(median, "frame_id")
    return met.select("frame_id", "centre", F.col("wr").alias("r"), F.col("wc").alias("c"), F.coalesce("v", "_m").alias("v"))
