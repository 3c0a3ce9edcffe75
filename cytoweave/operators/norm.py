"""Normalisation and pixel-wise projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def raw_norm(px: DataFrame, bits: int | None = None) -> DataFrame:
    """Integers of ``bits`` bits scaled to 0..1; other values stay."""
    return px.withColumn("v", F.col("v") / F.lit(float((1 << bits) - 1)) if bits else F.col("v").cast("double"))


def logical_norm(px: DataFrame) -> DataFrame:
    """Pixels above 0."""
    return px.filter(F.col("v") > 0)


def minmax_norm(px: DataFrame, keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """(v - min) / (max - min) of each group; a flat group gives 0."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return px.withColumn("v", F.coalesce(F.try_divide(F.col("v") - lo, hi - lo), F.lit(0.0)))


def _bucket(cuts: str, value: Column, buckets: int) -> Column:
    """How many of the sorted cuts are below the value, by bisection."""
    middle = lambda r: F.shiftright(r["a"] + r["b"], 1)
    halve = lambda r, _: F.when(r["a"] >= r["b"], r).when(F.get(F.col(cuts), middle(r)) < value, F.struct((middle(r) + 1).alias("a"), r["b"].alias("b"))).otherwise(F.struct(r["a"].alias("a"), middle(r).alias("b")))
    steps = F.sequence(F.lit(0), F.lit(buckets.bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("a"), F.size(cuts).alias("b")), halve)["a"]


def quantiles(rows: DataFrame, keys: Sequence[str], levels: Sequence[float], buckets: int = 256) -> DataFrame:
    """(keys, _q): exact quantiles of ``v``, linear between ranks, of groups of any size.

    A sketch of each group cuts its values into buckets of about equal shares;
    counts tell which buckets hold the wanted ranks, and only these are counted by
    value and ranked.  So no task sorts or holds more than such a bucket's distinct
    values, however large the group is and however often a value repeats.
    """
    values = rows.filter(F.col("v").isNotNull()).select(*keys, F.col("v").cast("double").alias("v"))
    cuts = values.groupBy(*keys).agg(F.percentile_approx("v", [k / buckets for k in range(1, buckets)], 10 * buckets).alias("_cuts"))
    placed = values.join(cuts, list(keys)).withColumn("_b", _bucket("_cuts", F.col("v"), buckets)).drop("_cuts")
    sizes = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*keys)
    starts = sizes.withColumn("_end", F.sum("_k").over(w.orderBy("_b"))).withColumn("_n", F.sum("_k").over(w))
    wanted = starts.withColumn("_at", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(levels)]))).withColumn("_pos", F.col("_at.q") * (F.col("_n") - 1))
    wanted = wanted.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
    wanted = wanted.filter((F.col("_rank") >= F.col("_end") - F.col("_k")) & (F.col("_rank") < F.col("_end")))
    asked = wanted.select(*keys, "_b", F.col("_at.i").alias("_i"), "_pos", "_rank", (F.col("_end") - F.col("_k")).alias("_start"))
    counted = placed.join(asked.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi").groupBy(*keys, "_b", "v").agg(F.count("*").alias("_m"))
    upto = counted.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*keys, "_b").orderBy("v")))
    met = asked.join(upto, [*keys, "_b"]).filter((F.col("_rank") >= F.col("_start") + F.col("_upto") - F.col("_m")) & (F.col("_rank") < F.col("_start") + F.col("_upto")))
    weight = F.when(F.floor("_pos") == F.ceil("_pos"), 1.0).when(F.col("_rank") == F.floor("_pos"), F.ceil("_pos") - F.col("_pos")).otherwise(F.col("_pos") - F.floor("_pos"))
    each = met.groupBy(*keys, "_i").agg(F.sum(F.col("v") * weight).alias("_v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("_q"))


def robust_norm(px: DataFrame, keys: Sequence[str] = ("frame_id",), q: float = 0.04, large: bool = False, approximate: bool = False) -> DataFrame:
    """(v - median) * (1 - q) / (range between the q/2 and 1 - q/2 quantiles); a flat group gives 0.

    Quantiles are aggregates that join back on the group's key.  As they stand they
    hold a group's distinct values in one buffer, which suits frames; ``large``
    takes ``quantiles`` for few groups of any size.  ``approximate`` takes sketches of
    fixed size instead, whose quantiles are values of the group.
    """
    levels = (q / 2, 0.5, 1 - q / 2)
    if approximate:
        level = px.groupBy(*keys).agg(F.percentile_approx("v", list(levels), 10_000).alias("_q"))
    else:
        level = quantiles(px, keys, levels) if large else px.groupBy(*keys).agg(F.percentile("v", F.array(*[F.lit(x) for x in levels])).alias("_q"))
    met = px.join(level, list(keys))
    scaled = F.try_divide((F.col("v") - F.col("_q")[1]) * (1 - q), F.col("_q")[2] - F.col("_q")[0])
    return met.withColumn("v", F.coalesce(scaled, F.lit(0.0))).drop("_q")


def dampen_edges(interior: DataFrame, edge: DataFrame) -> DataFrame:
    """interior * (1 - edge) at each pixel; a missing edge is 0."""
    e = edge.select("frame_id", "r", "c", F.col("v").alias("_e"))
    return interior.join(e, ["frame_id", "r", "c"], "left").withColumn("v", F.col("v") * (1 - F.coalesce("_e", F.lit(0.0)))).drop("_e")


def group_prediction(preds: DataFrame, members: Sequence[str]) -> DataFrame:
    """Largest p over the member targets at each pixel; absent targets count 0."""
    return preds.filter(F.col("target").isin(list(members))).groupBy("frame_id", "r", "c").agg(F.max("p").alias("p"))


def group_bounds(members: DataFrame, expansion: float, min_area: int = 1) -> DataFrame:
    """(grp, lower, upper) of each group: range of its members, widened by a share of itself.

    An infinite upper bound (null) widens by a share of the lower bound.
    """
    b = members.groupBy("grp").agg(F.min("lower").alias("lower"), F.when(F.count("upper") == F.count("*"), F.max("upper")).alias("upper"))
    wide = F.coalesce(F.col("upper") - F.col("lower"), F.col("lower")) * expansion
    return b.select("grp", F.greatest(F.col("lower") - wide, F.lit(float(max(1, min_area)))).alias("lower"), (F.col("upper") + wide).alias("upper"))


def clip_round(x: Column, size: int) -> Column:
    """Nearest grid place (half to even), clipped to the grid."""
    return F.least(F.greatest(F.rint(x), F.lit(0.0)), F.lit(float(size - 1))).cast("int")


def smoothing_sigma(n_edge: Column, a: float, b: float, c: float) -> Column:
    """log(max((n - c) / a, 1)) / b."""
    return F.log(F.greatest((n_edge - c) / a, F.lit(1.0))) / b


def unit_norm(cells: DataFrame, px_size: float) -> DataFrame:
    """Lengths divided by the pixel size, areas by its square, volumes by its cube, if present."""
    power = {"area": 2, "volume": 3} | dict.fromkeys(("centroid_r", "centroid_c", "major", "minor", "perimeter", "diameter"), 1)
    return cells.withColumns({n: F.col(n) / px_size**k for n, k in power.items() if n in cells.columns})


def rescale_outlines(outlines: DataFrame, factor: float) -> DataFrame:
    """Centres and radii times ``factor``, volumes times its cube."""
    out = outlines.withColumn("centre", F.struct((F.col("centre.r") * factor).alias("r"), (F.col("centre.c") * factor).alias("c"))).withColumn("radii", F.transform("radii", lambda x: x * factor))
    return out.withColumn("volume", F.col("volume") * factor**3) if "volume" in outlines.columns else out


def resample(px: DataFrame, height: int, width: int, factor: float) -> DataFrame:
    """Bilinear resampling of frames to ``factor`` times their size.

    Each target pixel has four neighbours; frames join their neighbours by place.
    """
    h, w = max(1, round(height * factor)), max(1, round(width * factor))
    sy, sx = (height - 1) / max(1, h - 1), (width - 1) / max(1, w - 1)
    grid = px.sparkSession.range(h * w).select(F.expr(f"cast(id div {w} as int)").alias("r"), (F.col("id") % w).cast("int").alias("c"))
    y, x = F.col("r") * sy, F.col("c") * sx
    corners = []
    for dy in (0, 1):
        for dx in (0, 1):
            wy = 1 - (y - F.floor(y)) if dy == 0 else y - F.floor(y)
            wx = 1 - (x - F.floor(x)) if dx == 0 else x - F.floor(x)
            corners.append(F.struct(F.least(F.floor(y) + dy, F.lit(height - 1)).cast("int").alias("sr"), F.least(F.floor(x) + dx, F.lit(width - 1)).cast("int").alias("sc"), (wy * wx).alias("weight")))
    taps = grid.select("r", "c", F.explode(F.array(*corners)).alias("k")).select("r", "c", "k.sr", "k.sc", "k.weight")
    src = px.select("frame_id", F.col("r").alias("sr"), F.col("c").alias("sc"), "v")
    return src.join(F.broadcast(taps), ["sr", "sc"]).groupBy("frame_id", "r", "c").agg(F.sum(F.col("v") * F.col("weight")).alias("v"))


Size = int | Column


def _taps(place: str, n: int, size: Column) -> Column:
    """Target places in whose bilinear value a place of ``n`` weighs, and how much."""
    scale, p = size / F.lit(float(n)), F.col(place)
    first = F.greatest(F.floor((p - 0.5) * scale - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil((p + 1.5) * scale - 0.5), size - 1).cast("int")
    weight = lambda k: 1 - F.abs(F.least(F.greatest((k + 0.5) / scale - 0.5, F.lit(0.0)), F.lit(float(n - 1))) - p)
    return F.filter(F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("at"), weight(k).alias("k"))), lambda t: t["k"] > 0)


def resize(px: DataFrame, h: int, w: int, height: Size, width: Size) -> DataFrame:
    """(frame_id, r, c, v): frames of h by w places with ``height`` by ``width``, by bilinear weights of places' middles.

    The new size may be a column, so each frame has its own.  A pixel is dealt to
    the target places that it weighs in, so nothing is joined.
    """
    to = px.withColumns({"_h": F.lit(height) if isinstance(height, int) else height, "_w": F.lit(width) if isinstance(width, int) else width})
    rows = to.withColumn("_r", F.explode(_taps("r", h, F.col("_h")))).withColumn("_c", F.explode(_taps("c", w, F.col("_w"))))
    return rows.groupBy("frame_id", F.col("_r.at").alias("r"), F.col("_c.at").alias("c")).agg(F.sum(F.col("v") * F.col("_r.k") * F.col("_c.k")).alias("v"))


def _readers(place: str, n: int, size: Column) -> Column:
    """Target places whose middle falls into a place of ``n``; null without any."""
    first, end = (F.ceil((F.col(place) + k) * size / F.lit(float(n)) - 0.5) for k in (0, 1))
    return F.when(end > first, F.sequence(first.cast("int"), (end - 1).cast("int")))


def resize_masks(mask: DataFrame, h: int, w: int, height: Size, width: Size) -> DataFrame:
    """Masks of h by w places with ``height`` by ``width`` (numbers or columns): each target place is that which holds its middle."""
    to = mask.withColumns({"_h": F.lit(height) if isinstance(height, int) else height, "_w": F.lit(width) if isinstance(width, int) else width})
    rows = to.withColumn("_r", F.explode(_readers("r", h, F.col("_h")))).withColumn("_c", F.explode(_readers("c", w, F.col("_w"))))
    return rows.withColumn("r", F.col("_r")).withColumn("c", F.col("_c")).drop("_h", "_w", "_r", "_c")


def to_units(table: DataFrame, powers: dict[str, int], px_size: float) -> DataFrame:
    """Columns measured in pixels to the power given, in units of which a pixel is ``px_size`` long."""
    return table.withColumns({name: F.col(name) * px_size**k for name, k in powers.items()})
