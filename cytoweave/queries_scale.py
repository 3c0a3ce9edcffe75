"""Queries on sizes: resized frames and masks, units, size groups, labels of stored masks, curves of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import augment, learn, match, morph, norm, objects, outlines, track, tune
from .queries_cells import _u
from .operators.tables import stored
from .registry import query, r6
from .sources import views
from .sources.views import with_views

H = W = views.SIDE


def _places(height: str, width: str) -> str:
    """The places of each frame of ``z`` in its new size, and the source's coordinates of their middles."""
    return f"""g AS (SELECT *, (r + 0.5) * 8 / {height} AS y, (c + 0.5) * 8 / {width} AS x FROM (SELECT z.*, unnest(range(0, {height}))::INT AS r FROM z) a, LATERAL (SELECT unnest(range(0, {width}))::INT AS c) b)"""


_BILINEAR = """k AS (SELECT frame_id, r, c, greatest(least(y - 0.5, 7), 0) AS y, greatest(least(x - 0.5, 7), 0) AS x FROM g),
n AS (SELECT frame_id, r, c, least(floor(y)::INT + a, 7) AS sr, least(floor(x)::INT + b, 7) AS sc, abs(1 - a - (y - floor(y))) * abs(1 - b - (x - floor(x))) AS wt FROM k, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)),
im AS (SELECT n.frame_id, n.r, n.c, sum(v * wt) AS v FROM n JOIN px ON px.frame_id = n.frame_id AND px.r = sr AND px.c = sc GROUP BY ALL)"""


@query(f"""{with_views('px')}, z AS (SELECT DISTINCT frame_id FROM px), {_places('13', '5')}, {_BILINEAR} SELECT frame_id, r, c, round(v, 6) AS v FROM im""")
def resize_frames(spark, d):
    return norm.resize(views.pixels(spark, d), H, W, 13, 5).select("frame_id", "r", "c", r6("v").alias("v"))


@query(f"""{with_views('qd')}, z AS (SELECT DISTINCT frame_id FROM qd), {_places('13', '5')} SELECT g.frame_id, cell, g.r, g.c FROM g JOIN qd ON qd.frame_id = g.frame_id AND qd.r = floor(y)::INT AND qd.c = floor(x)::INT""")
def resize_masks(spark, d):
    return norm.resize_masks(views.quadrants(spark, d), H, W, 13, 5).select("frame_id", "cell", "r", "c")


@query(f"""{with_views('px', 'qd')}, s AS (SELECT frame_id, (8 * 0.25 / 0.2 * (1 + CASE WHEN {_u('resize', 'frame_id')} <= 0.5 THEN 0.2 * (2 * ({_u('size', 'frame_id')}) - 1) ELSE 0 END))::DOUBLE AS s FROM (SELECT DISTINCT frame_id FROM px)),
z AS (SELECT frame_id, greatest(round_even(s, 0), 1)::INT AS h FROM s), {_places('h', 'h')}, {_BILINEAR}
SELECT 'image' AS kind, frame_id, 0 AS cell, r, c, round(v, 6) AS v FROM im UNION ALL SELECT 'label', g.frame_id, cell, g.r, g.c, 1.0 FROM g JOIN qd ON qd.frame_id = g.frame_id AND qd.r = floor(y)::INT AND qd.c = floor(x)::INT""")
def augment_pixel_size(spark, d):
    """From pixels of 0.25 to 0.2, half of the frames off by up to a fifth: each frame has its own size."""
    image, labels = augment.to_pixel_size(views.pixels(spark, d), views.quadrants(spark, d), H, W, 0.25, 0.2, 5, 0.2)
    return image.select(F.lit("image").alias("kind"), "frame_id", F.lit(0).alias("cell"), "r", "c", r6("v").alias("v")).union(labels.select(F.lit("label"), "frame_id", "cell", "r", "c", F.lit(1.0)))


@query(f"""{with_views('px')}, q AS (SELECT frame_id, quantile_cont(v, 0.98) - quantile_cont(v, 0.02) AS q FROM px GROUP BY 1),
m AS (SELECT frame_id, (2 * ({_u('offset', 'frame_id')}) - 1) * 0.25 * q AS o, least(greatest(exp(0.4 * sqrt(-2 * ln({_u('scale_a', 'frame_id')})) * cos(2 * pi() * ({_u('scale_b', 'frame_id')}))), 0.5), 2) AS s FROM q)
SELECT frame_id, r, c, round((v + o) * s, 6) AS v FROM px JOIN m USING (frame_id)""")
def augment_hist_scale(spark, d):
    return augment.hist_scale(views.pixels(spark, d), 5).select("frame_id", "r", "c", r6("v").alias("v"))


@query(f"""{with_views('qd')} SELECT frame_id, cell, round(avg(r) * 0.263, 6) AS centroid_r, round(count(*) * 0.263 ** 2, 6) AS area, round(4 / 3 * pi() * sqrt(count(*) / pi()) ** 3 * 0.263 ** 3, 6) AS volume FROM qd GROUP BY 1, 2""")
def physical_units(spark, d):
    """Lengths, areas and volumes of objects in units of which a pixel is 0.263 long."""
    f = objects.shape_features(views.quadrants(spark, d)).withColumn("volume", objects.area_volume(F.col("area")))
    return norm.to_units(f, {"centroid_r": 1, "area": 2, "volume": 3}, 0.263).select("frame_id", "cell", r6("centroid_r").alias("centroid_r"), r6("area").alias("area"), r6("volume").alias("volume"))


def _levels(spark, d):
    """Overlaps and sizes of the quadrants as they are and eroded once."""
    q = views.quadrants(spark, d)
    objects_ = q.select("frame_id", "cell").distinct()
    pairs, sizes = None, None
    for e, m in enumerate((q, morph.erode(q))):
        met = match.intersections(m, m, ["r", "c"], ordered=True)
        p = met.select(F.lit(e).alias("e"), F.least("area_a", "area_b").alias("area_lo"), F.greatest("area_a", "area_b").alias("area_hi"), match.iou().alias("frac"))
        n = objects_.join(m.groupBy("frame_id", "cell").agg(F.count("*").alias("n")), ["frame_id", "cell"], "left").select(F.struct("frame_id", "cell").alias("cell"), F.lit(e).alias("e"), F.coalesce("n", F.lit(0)).alias("n"))
        pairs, sizes = (p, n) if pairs is None else (pairs.union(p), sizes.union(n))
    return pairs, sizes


@query()
def size_group_cuts(spark, d):
    """Groups by size of the quadrants, by roots of areas."""
    pairs, sizes = _levels(spark, d)
    return tune.size_groups(pairs, sizes, 12, 1, 0.0, 0.05, True, 6)


@query()
def redraw_outlines(spark, d):
    """Outlines drawn anew and filled in frames of twice the size: how many pixels each object then has."""
    drawn, masks = outlines.redraw(outlines.knots(stored(views.quadrants(spark, d)), H, W), 2.0, 2 * H, 2 * W)
    count = lambda df, name: df.groupBy("frame_id", "cell").agg(F.count("*").alias(name))
    return count(drawn, "edge").join(count(masks, "area"), ["frame_id", "cell"])


@query()
def label_masks(spark, d):
    """Labels of all series, from the quadrants as stored masks."""
    return track.label_masks(views.quadrants(spark, d), views.frames(spark, d), H, W)


@query("""WITH k AS (SELECT event_type, floor(value / (value + 50) * 1000) / 1000 AS threshold, count(*) AS n, count(*) FILTER (user_id % 3 = 0) AS t FROM events GROUP BY 1, 2)
SELECT event_type, threshold, (sum(t) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS n, round(sum(t) OVER w / sum(n) OVER w, 6) AS precision, round(sum(t) OVER w / nullif(sum(t) OVER (PARTITION BY event_type), 0), 6) AS recall FROM k WINDOW w AS (PARTITION BY event_type ORDER BY threshold DESC)""")
def score_curve(spark, d):
    """Precision and recall at every score of events, for each kind."""
    e = views.table(spark, d, "events").select("event_type", (F.col("value") / (F.col("value") + 50)).alias("p"), (F.col("user_id") % 3 == 0).cast("double").alias("mine"))
    c = learn.precision_recall_curve(e, "mine", ["event_type"], 3)
    return c.select("event_type", "threshold", "tp", "n", r6("precision").alias("precision"), r6("recall").alias("recall"))
