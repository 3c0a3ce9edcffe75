"""Queries on frames and objects: features, outlines, pairs of mothers and buds, targets, images."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .operators import augment, buds, evaluate, learn, match, morph, norm, objects, outlines, segment
from .operators.tables import stored
from .registry import query, r6
from .sources import views
from .sources.views import with_views

H = W = views.SIDE
_CROSS = "(VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)) o(dr,dc)"
_SQUARE = "(VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) o(dr,dc)"
_GRID = "gr AS (SELECT x.k AS r, y.k AS c FROM (SELECT unnest(range(0, 8))::INT AS k) x, (SELECT unnest(range(0, 8))::INT AS k) y)"
_INSIDE = "r + dr BETWEEN 0 AND 7 AND c + dc BETWEEN 0 AND 7"


def _edges(table: str) -> str:
    """Pixels of a table's objects with an unset neighbour inside the frame."""
    return f"SELECT DISTINCT frame_id, cell, r, c FROM (SELECT m.*, r + dr AS nr, c + dc AS nc FROM {table} m, {_SQUARE}) n WHERE nr BETWEEN 0 AND 7 AND nc BETWEEN 0 AND 7 AND NOT EXISTS (SELECT 1 FROM {table} m WHERE m.frame_id = n.frame_id AND m.cell = n.cell AND m.r = nr AND m.c = nc)"


def _dilated(table: str) -> str:
    return f"SELECT DISTINCT frame_id, cell, r + dr AS r, c + dc AS c FROM {table}, {_CROSS} WHERE {_INSIDE}"


def _eroded(table: str) -> str:
    return f"SELECT frame_id, cell, r + dr AS r, c + dc AS c FROM {table}, {_CROSS} GROUP BY ALL HAVING count(*) = 5"


# -- pixels -----------------------------------------------------------------


@query("SELECT p_partkey, round(p_size / 255.0, 6) AS v FROM part")
def norm_raw(spark, d):
    return norm.raw_norm(views.table(spark, d, "part").select("p_partkey", F.col("p_size").alias("v")), 8).select("p_partkey", r6("v").alias("v"))


@query(f"{with_views('px')} SELECT frame_id, r, c FROM px WHERE v > 0")
def norm_logical(spark, d):
    return norm.logical_norm(views.pixels(spark, d)).select("frame_id", "r", "c")


@query("""WITH g AS (SELECT p_brand AS grp, p_size::DOUBLE AS lower, CASE WHEN p_partkey % 40 > 0 THEN p_size * 1.5 + 3 END AS upper FROM part),
b AS (SELECT grp, min(lower) AS lo, CASE WHEN count(upper) = count(*) THEN max(upper) END AS up FROM g GROUP BY 1)
SELECT grp, round(greatest(lo - 0.1 * coalesce(up - lo, lo), 1.0), 6) AS lower, round(up + 0.1 * coalesce(up - lo, lo), 6) AS upper FROM b""")
def group_bounds(spark, d):
    p = views.table(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_size").cast("double").alias("lower"), F.when(F.col("p_partkey") % 40 > 0, F.col("p_size") * 1.5 + 3).alias("upper"))
    return norm.group_bounds(p, 0.1).select("grp", r6("lower").alias("lower"), r6("upper").alias("upper"))


@query(f"{with_views('qd')} SELECT frame_id, cell, round(count(*) / 0.0625, 6) AS area, round(avg(r) / 0.25, 6) AS centroid_r, round(avg(c) / 0.25, 6) AS centroid_c FROM qd GROUP BY 1, 2")
def unit_features(spark, d):
    f = norm.unit_norm(objects.shape_features(views.quadrants(spark, d)), 0.25)
    return f.select("frame_id", "cell", *[r6(x).alias(x) for x in ("area", "centroid_r", "centroid_c")])


@query(f"""{with_views('px')}, t AS (SELECT x.k AS r, y.k AS c, x.k * (7 / 15) AS y, y.k * (7 / 15) AS x FROM (SELECT unnest(range(0, 16))::INT AS k) x, (SELECT unnest(range(0, 16))::INT AS k) y),
k AS (SELECT r, c, least(floor(y) + a, 7)::INT AS sr, least(floor(x) + b, 7)::INT AS sc, (CASE a WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE b WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w FROM t, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b))
SELECT frame_id, k.r, k.c, round(sum(v * w), 6) AS v FROM k JOIN px ON px.r = sr AND px.c = sc GROUP BY ALL""")
def resample_frames(spark, d):
    return norm.resample(views.pixels(spark, d).select("frame_id", "r", "c", "v"), H, W, 2.0).select("frame_id", "r", "c", r6("v").alias("v"))


@query(f"{with_views('px')} SELECT frame_id, r, c, least(greatest(round_even(v * 40, 0), 0), 7)::INT AS at, round(ln(greatest((abs(v) * 100 - 2) / 3, 1)) / 0.7, 6) AS sigma FROM px")
def grid_places(spark, d):
    """Values as places on a grid, and the smoothing that a size asks for."""
    px = views.pixels(spark, d)
    return px.select("frame_id", "r", "c", norm.clip_round(F.col("v") * 40, W).alias("at"), r6(norm.smoothing_sigma(F.abs("v") * 100, 3.0, 0.7, 2.0)).alias("sigma"))


@query(f"""{with_views('px')}, w AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS k)),
s AS (SELECT least(greatest(t.r + a.k, 0), 7) AS sr, t.r, sum(w) AS w FROM (SELECT unnest(range(0, 8))::INT AS r) t, w a GROUP BY ALL)
SELECT frame_id, y.r, x.r AS c, round(sum(v * y.w * x.w), 6) AS v FROM px JOIN s y ON px.r = y.sr JOIN s x ON px.c = x.sr GROUP BY ALL""")
def gaussian_blur(spark, d):
    return morph.blur(views.pixels(spark, d).select("frame_id", "r", "c", "v"), H, W, 1.0).select("frame_id", "r", "c", r6("v").alias("v"))


@query(f"""{with_views('px')} SELECT frame_id, round(count(*) FILTER (v > 0.01) / 64, 6) AS share, count(*) FILTER (v > 0.01) / 64 > 0.5 AS clogging FROM px GROUP BY 1""")
def clogging(spark, d):
    return morph.clogged(views.pixels(spark, d), H, W, 0.01, 0.5).select("frame_id", r6("share").alias("share"), "clogging")


@query(f"{with_views('mk')} SELECT frame_id, r, c FROM mk UNION SELECT frame_id, r, c FROM (SELECT DISTINCT frame_id FROM mk), (SELECT x.k AS r, y.k AS c FROM (SELECT unnest(range(0, 8))::INT AS k) x, (SELECT unnest(range(0, 8))::INT AS k) y) WHERE r IN (0, 7) OR c IN (0, 7)")
def border_rectangle(spark, d):
    """Masks with the frame's border set."""
    from .operators import sets

    px = views.pixels(spark, d)
    m = views.masks(spark, d)
    return sets.union(m, px.filter(morph.border(H, W)).join(m.select("frame_id").distinct(), "frame_id", "left_semi"))


@query(f"""{with_views('qd')}, b AS (SELECT frame_id, cell, min(r) - 1 AS r0, min(c) - 1 AS c0 FROM qd GROUP BY 1, 2) SELECT frame_id, cell, r - r0 AS r, c - c0 AS c, r0, c0 FROM qd JOIN b USING (frame_id, cell)""")
def box_crop(spark, d):
    return morph.crop_to_box(views.quadrants(spark, d), 1).select("frame_id", "cell", "r", "c", "r0", "c0")


# -- objects ----------------------------------------------------------------


@query(f"""{with_views('mk')}, {_GRID}, f AS (SELECT DISTINCT frame_id FROM mk), bg AS (SELECT frame_id, r, c FROM f, gr EXCEPT SELECT frame_id, r, c FROM mk),
fl AS (SELECT frame_id, r, c FROM bg WHERE r IN (0, 7) OR c IN (0, 7) UNION SELECT bg.frame_id, bg.r, bg.c FROM fl JOIN bg ON bg.frame_id = fl.frame_id AND abs(bg.r - fl.r) + abs(bg.c - fl.c) = 1)
SELECT f.frame_id, 1 AS cell, r, c FROM f, gr WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.frame_id = f.frame_id AND fl.r = gr.r AND fl.c = gr.c)""")
def fill_holes(spark, d):
    return morph.fill_holes(views.masks(spark, d), H, W)


_BG = f"{_GRID}, f AS (SELECT DISTINCT frame_id FROM mk), bg AS (SELECT frame_id, r, c FROM f, gr EXCEPT SELECT frame_id, r, c FROM mk)"


# walls on three sides leave the fourth to come in from: first the right, then the left side
@query(f"""{with_views('mk')}, {_BG}, o1 AS (SELECT frame_id, r, c FROM bg WHERE c = 7 UNION SELECT bg.frame_id, bg.r, bg.c FROM o1 JOIN bg ON bg.frame_id = o1.frame_id AND abs(bg.r - o1.r) + abs(bg.c - o1.c) = 1),
e1 AS MATERIALIZED (SELECT * FROM o1), o2 AS (SELECT frame_id, r, c FROM e1 WHERE c = 0 UNION SELECT e1.frame_id, e1.r, e1.c FROM o2 JOIN e1 ON e1.frame_id = o2.frame_id AND abs(e1.r - o2.r) + abs(e1.c - o2.c) = 1)
SELECT f.frame_id, 1 AS cell, r, c FROM f, gr WHERE NOT EXISTS (SELECT 1 FROM o2 WHERE o2.frame_id = f.frame_id AND o2.r = gr.r AND o2.c = gr.c)""")
def fill_bordered(spark, d):
    return morph.fill_bordered(views.masks(spark, d), H, W)


@query(f"""{with_views('qd')}, m AS (SELECT frame_id, cell, round(var_pop(r) - var_pop(c), 9) AS tall, round(2 * covar_pop(r, c), 9) AS lean, count(*) AS area FROM qd GROUP BY 1, 2)
SELECT frame_id, cell, round(abs(CASE WHEN lean = 0 AND tall = 0 THEN pi() / 4 ELSE 0.5 * atan2(lean, tall) END), 6) AS tilt, round(4 / 3 * pi() * sqrt(area / pi()) ** 3, 6) AS volume FROM m""")
def orientation(spark, d):
    f = objects.shape_features(views.quadrants(spark, d))
    return f.select("frame_id", "cell", r6(F.abs("orientation")).alias("tilt"), r6(objects.area_volume(F.col("area"))).alias("volume"))


@query(f"""{with_views('qd')}, e AS ({_edges('qd')}), n AS (SELECT a.frame_id, a.cell, abs(a.r - b.r) + abs(a.c - b.c) AS k FROM e a JOIN e b ON a.frame_id = b.frame_id AND a.cell = b.cell AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1)
SELECT frame_id, cell, round((count(*) FILTER (k = 1) + sqrt(2) * count(*) FILTER (k = 2)) / 2, 6) AS perimeter FROM n GROUP BY 1, 2""")
def perimeter(spark, d):
    return objects.perimeters(views.quadrants(spark, d), H, W).select("frame_id", "cell", r6("perimeter").alias("perimeter"))


# doubled places are whole numbers; a hull's sides run between corners at most 10 apart in each axis
@query(f"""{with_views('qd')}, di AS (SELECT x.k AS dy, y.k AS dx FROM (SELECT unnest(range(-10, 11))::INT AS k) x, (SELECT unnest(range(-10, 11))::INT AS k) y WHERE gcd(x.k, y.k) = 1),
su AS (SELECT frame_id, cell, dy, dx, max(2 * r * dy + 2 * c * dx) + greatest(abs(dy), abs(dx)) AS far FROM qd, di GROUP BY frame_id, cell, dy, dx),
bo AS (SELECT frame_id, cell, count(*) AS area, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM qd GROUP BY 1, 2),
ca AS (SELECT frame_id, cell, area, x.k AS r, y.k AS c FROM bo JOIN (SELECT unnest(range(0, 8))::INT AS k) x ON x.k BETWEEN r0 AND r1 JOIN (SELECT unnest(range(0, 8))::INT AS k) y ON y.k BETWEEN c0 AND c1),
ou AS (SELECT DISTINCT frame_id, cell, r, c FROM ca JOIN su USING (frame_id, cell) WHERE 2 * r * dy + 2 * c * dx > far)
SELECT ca.frame_id, ca.cell, area, count(*) - count(ou.r) AS convex_area, round(area / (count(*) - count(ou.r)), 6) AS solidity FROM ca LEFT JOIN ou ON ou.frame_id = ca.frame_id AND ou.cell = ca.cell AND ou.r = ca.r AND ou.c = ca.c GROUP BY 1, 2, 3""")
def convexity(spark, d):
    return objects.convexity(views.quadrants(spark, d)).select("frame_id", "cell", "area", "convex_area", r6("solidity").alias("solidity"))


@query(f"""{with_views('qd')}, e AS ({_edges('qd')}), d1 AS ({_dilated('e')}), d2 AS ({_dilated('d1')}), p0 AS (SELECT frame_id, cell, avg(v) AS p FROM e JOIN px USING (frame_id, r, c) GROUP BY 1, 2), p2 AS (SELECT frame_id, cell, avg(v) AS p FROM d2 JOIN px USING (frame_id, r, c) GROUP BY 1, 2)
SELECT frame_id, cell, round(p2.p, 6) AS edge_score, round(p0.p, 6) AS edge_p FROM p2 JOIN p0 USING (frame_id, cell)""")
def edge_scores(spark, d):
    px, e = views.pixels(spark, d), morph.edges(views.quadrants(spark, d), H, W)
    wide, thin = objects.edge_scores(e, px, H, W), objects.mean_over(e, px, name="edge_p")
    return wide.join(thin, ["frame_id", "cell"]).select("frame_id", "cell", r6("edge_score").alias("edge_score"), r6("edge_p").alias("edge_p"))


@query(f"""{with_views('qd')}, a AS (SELECT frame_id, cell, count(*) AS area, cell % 2 = 0 AS is_bud, cell // 2 AS focus FROM qd GROUP BY 1, 2)
SELECT frame_id, cell, name FROM a JOIN (VALUES ('small', 1, 8, true, NULL), ('sharp', 2, 20, false, 1), ('any', 1, NULL, false, NULL)) g(name, lower, upper, budonly, gf) ON area >= lower AND (upper IS NULL OR area < upper) AND (NOT budonly OR is_bud) AND (gf IS NULL OR gf = focus)""")
def group_membership(spark, d):
    cells = objects.areas(views.quadrants(spark, d)).withColumn("is_bud", F.col("cell") % 2 == 0).withColumn("focus", F.floor(F.col("cell") / 2).cast("int"))
    groups = spark.createDataFrame([("small", 1.0, 8.0, True, None), ("sharp", 2.0, 20.0, False, 1), ("any", 1.0, None, False, None)], "name string, lower double, upper double, budonly boolean, group_focus int")
    return objects.size_groups(cells, groups).select("frame_id", "cell", "name")


@query(f"""{with_views('qd')}, e AS ({_edges('qd')}), d1 AS ({_dilated('e')}), n AS (SELECT frame_id, r, c, count(*) AS n FROM qd GROUP BY ALL), o AS (SELECT frame_id, 1 AS cell, r, c FROM n WHERE n > 1), od AS ({_dilated('o')})
SELECT 'edge' AS target, frame_id, r, c, 1 AS v FROM d1 GROUP BY ALL UNION ALL SELECT 'interior', frame_id, r, c, 1 FROM n WHERE NOT EXISTS (SELECT 1 FROM od WHERE od.frame_id = n.frame_id AND od.r = n.r AND od.c = n.c) UNION ALL SELECT 'overlap', frame_id, r, c, 1 FROM od UNION ALL SELECT 'filledsum', frame_id, r, c, n::INT FROM n""")
def target_maps(spark, d):
    q = views.quadrants(spark, d)
    e = morph.edges(q, H, W)
    maps = {"edge": objects.flatten_target(e, "edge", H, W, dilations=1), "interior": objects.flatten_target(q, "interior", H, W, widen_overlaps=1), "overlap": objects.flatten_target(q, "overlap", H, W, widen_overlaps=1), "filledsum": objects.flatten_target(q, "filledsum", H, W)}
    out = None
    for name, m in maps.items():
        part = m.select(F.lit(name).alias("target"), "frame_id", "r", "c", "v")
        out = part if out is None else out.union(part)
    return out


@query(f"""{with_views('qd')}, er AS ({_eroded('qd')}), t AS (SELECT frame_id, cell, avg(v) AS p FROM qd JOIN px USING (frame_id, r, c) GROUP BY 1, 2 UNION ALL SELECT frame_id, cell, avg(v * v) FROM er JOIN px USING (frame_id, r, c) GROUP BY 1, 2)
SELECT frame_id, cell, round(avg(p), 6) AS p FROM t GROUP BY 1, 2""")
def object_probability(spark, d):
    q, px = views.quadrants(spark, d), views.pixels(spark, d)
    members = q.withColumn("target", F.lit("filled")).unionByName(morph.erode(q).withColumn("target", F.lit("inner")))
    preds = px.select("frame_id", F.lit("filled").alias("target"), "r", "c", F.col("v").alias("p")).unionByName(px.select("frame_id", F.lit("inner").alias("target"), "r", "c", (F.col("v") * F.col("v")).alias("p")))
    return objects.object_probabilities(members, preds).select("frame_id", "cell", r6("p").alias("p"))


@query(f"""{with_views('qd')}, b AS (SELECT frame_id, cell, min(r) AS r0, max(r) + 1 AS r1, min(c) AS c0, max(c) + 1 AS c1 FROM qd GROUP BY 1, 2)
SELECT x.frame_id, x.cell AS ta, y.cell AS tb FROM b x JOIN b y ON x.frame_id = y.frame_id AND x.r0 < y.r1 AND y.r0 < x.r1 AND x.c0 < y.c1 AND y.c0 < x.c1""")
def box_overlaps(spark, d):
    f = objects.shape_features(views.quadrants(spark, d)).select("frame_id", "cell", "r0", "r1", "c0", "c1")
    return match.box_overlaps(f, f)


_PAIRED = "p AS (SELECT a.frame_id, a.cell AS ta, b.cell AS tb, count(*) AS n FROM qd a JOIN qd b ON a.frame_id = b.frame_id AND a.r = b.{0} AND a.c = b.{1} GROUP BY 1, 2, 3), s AS (SELECT frame_id, cell, count(*) AS area FROM qd GROUP BY 1, 2), j AS (SELECT p.*, x.area AS area_a, y.area AS area_b, n / (x.area + y.area - n) AS iou FROM p JOIN s x ON x.frame_id = p.frame_id AND x.cell = ta JOIN s y ON y.frame_id = p.frame_id AND y.cell = tb)"


@query(f"""{with_views('qd')}, {_PAIRED.format('r', 'c')}, l AS (SELECT frame_id, CASE WHEN area_a < area_b THEN ta ELSE tb END AS cell FROM j WHERE tb = ta + 1 AND greatest(n / area_a, n / area_b) > 0.4)
SELECT frame_id, cell FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.frame_id = s.frame_id AND l.cell = s.cell)""")
def drop_duplicates_at_once(spark, d):
    """Objects as groups of their own; of adjacent ones that contain each other the loser goes."""
    q = views.quadrants(spark, d)
    p = match.intersections(q, q, ["r", "c"], ordered=True).filter("tb = ta + 1").withColumn("containment", match.containment())
    pairs = p.select("frame_id", F.col("ta").alias("grp_a"), F.col("tb").alias("grp_b"), "ta", "tb", F.col("area_a").alias("score_a"), F.col("area_b").alias("score_b"), "containment")
    cells = q.select("frame_id", F.col("cell").alias("grp"), "cell").distinct()
    return match.drop_adjacent_duplicates(pairs, cells, 0.4).select("frame_id", "cell")


def _greedy_rounds(n: int) -> str:
    """Best pairs of what is left, n times: q0 are all pairs, m1..mn what each round matches."""
    out = []
    for k in range(n):
        out.append(f"m{k} AS (SELECT * FROM q{k} QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY iou DESC, ta, tb) = 1)")
        out.append(f"q{k + 1} AS (SELECT q{k}.* FROM q{k} LEFT JOIN m{k} USING (frame_id) WHERE m{k}.ta IS NULL OR (q{k}.ta <> m{k}.ta AND q{k}.tb <> m{k}.tb))")
    return ", ".join(out)


@query(f"{with_views('qd')}, {_PAIRED.format('c', 'r')}, q0 AS (SELECT frame_id, ta, tb, iou FROM j WHERE iou > 0), {_greedy_rounds(4)} " + " UNION ALL ".join(f"SELECT frame_id, ta, tb, round(iou, 6) AS iou FROM m{k}" for k in range(4)))
def greedy_match(spark, d):
    q = views.quadrants(spark, d)
    flipped = q.select("frame_id", "cell", F.col("c").alias("r"), F.col("r").alias("c"))
    p = match.intersections(q, flipped, ["r", "c"]).withColumn("iou", match.iou())
    return match.greedy_match(p).select("frame_id", "ta", "tb", r6("iou").alias("iou"))


def _claims(by: str, order: str, n: int = 4) -> str:
    """Each of n sides in turn takes the first partner in order that none before it took: t1..tn."""
    out = []
    for k in range(1, n + 1):
        free = "".join(f" AND NOT EXISTS (SELECT 1 FROM t{i} WHERE t{i}.frame_id = ca.frame_id AND t{i}.other = ca.other)" for i in range(1, k))
        out.append(f"t{k} AS (SELECT frame_id, {by} AS side, other FROM ca WHERE {by} = {k}{free} QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY {order}) = 1)")
    return ", ".join(out) + ", tk AS (" + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(1, n + 1)) + ")"


@query(f"""{with_views('qd')}, {_PAIRED.format('c', 'r')}, ca AS (SELECT frame_id, ta, tb AS other, iou FROM j WHERE iou > 0.4), {_claims('ta', 'iou DESC, other')}
SELECT frame_id, cell FROM s WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.frame_id = s.frame_id AND tk.side = s.cell)""")
def unmatched_objects(spark, d):
    q = views.quadrants(spark, d)
    flipped = q.select("frame_id", "cell", F.col("c").alias("r"), F.col("r").alias("c"))
    return segment.unmatched(q, flipped, 0.4).select("frame_id", "cell").distinct()


@query(f"""{with_views('qd')}, {_PAIRED.format('c', 'r')}, pr AS (SELECT qd.frame_id, cell AS tb, avg(v) AS p FROM qd JOIN px ON px.frame_id = qd.frame_id AND px.r = qd.c AND px.c = qd.r GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY p DESC, tb) AS rk FROM pr), ca AS (SELECT frame_id, rk, ta AS other, iou FROM j JOIN rk USING (frame_id, tb) WHERE iou > 0.3), {_claims('rk', 'iou DESC, other')},
cu AS (SELECT rk.frame_id, rk.rk, sum((tk.other IS NOT NULL)::INT) OVER w AS tp FROM rk LEFT JOIN tk ON tk.frame_id = rk.frame_id AND tk.side = rk.rk WINDOW w AS (PARTITION BY rk.frame_id ORDER BY rk.rk ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT frame_id, max(tp / rk) OVER (PARTITION BY frame_id ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * (tp - coalesce(lag(tp) OVER (PARTITION BY frame_id ORDER BY rk), 0)) / 4 AS a FROM cu)
SELECT frame_id, round(sum(a), 6) AS ap FROM ap GROUP BY 1""")
def claim_walk(spark, d):
    """Precision and recall where predictions claim truths by falling confidence."""
    q = views.quadrants(spark, d)
    flipped = q.select("frame_id", "cell", F.col("c").alias("r"), F.col("r").alias("c"))
    pairs = match.intersections(q, flipped, ["r", "c"]).withColumn("iou", match.iou())
    preds = objects.mean_over(flipped, views.pixels(spark, d), name="p").select("frame_id", F.col("cell").alias("tb"), "p")
    hits = match.claim_hits(pairs, preds, 0.3).join(preds, ["frame_id", "tb"])
    curve = match.precision_recall(hits, ["frame_id"], F.lit(4), [F.desc("p"), F.col("tb")])
    return match.average_precision(curve, ["frame_id"]).select("frame_id", r6("ap").alias("ap"))


_COMPONENTS = """l AS (SELECT frame_id, r, c, r * 8 + c AS id FROM mk UNION SELECT m.frame_id, m.r, m.c, l.id FROM l JOIN mk m ON m.frame_id = l.frame_id AND abs(m.r - l.r) <= 1 AND abs(m.c - l.c) <= 1 AND l.id < m.r * 8 + m.c),
m AS (SELECT frame_id, r, c, min(id) AS id FROM l GROUP BY ALL), cp AS (SELECT frame_id, r, c, (dense_rank() OVER (PARTITION BY frame_id ORDER BY id))::INT AS cell FROM m)"""


@query(f"""{with_views('px', 'mk')}, {_COMPONENTS}, s AS (SELECT frame_id, cell, avg(v) AS score FROM cp JOIN px USING (frame_id, r, c) GROUP BY 1, 2)
SELECT frame_id, cell, round(score, 6) AS score, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, cell)::INT AS rank FROM s""")
def ranked_regions(spark, d):
    return segment.ranked_regions(views.pixels(spark, d).select("frame_id", "r", "c", "v"), views.THRESHOLD).select("frame_id", "cell", r6("score").alias("score"), "rank")


@query(f"""{with_views('px', 'mk')}, {_COMPONENTS}, a AS (SELECT frame_id, cell, count(*) AS n FROM cp GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) < 12)
SELECT frame_id, cell, r, c FROM cp JOIN a USING (frame_id, cell)""")
def segment_group(spark, d):
    """One group: pixel values cut at the threshold, components kept by area."""
    preds = views.pixels(spark, d).select("frame_id", F.lit("small").alias("target"), "r", "c", F.col("v").alias("p"))
    return segment.segment_group(preds, segment.GroupParams(("small",), None, views.THRESHOLD, lower=3, upper=12), H, W)


@query()
def segment_full(spark, d):
    """Two groups with outlines, refinement and volumes."""
    px = views.pixels(spark, d)
    one = px.select("frame_id", F.lit("small").alias("target"), "r", "c", F.col("v").alias("p"))
    two = px.select("frame_id", F.lit("large").alias("target"), "r", "c", (F.col("v") + 0.05).alias("p"))
    groups = [segment.GroupParams(("small",), None, 0.05, lower=1, upper=6), segment.GroupParams(("large", "small"), "small", 0.05, lower=3, edge_min=0.0)]
    found = segment.segment_full(one.union(two), groups, H, W, 0.5, refine_outlines=True, return_volume=True)
    return found.volumes.join(found.outlines, ["frame_id", "cell"]).select("frame_id", "cell", r6("volume").alias("volume"), F.size("radii").alias("rays"))


@query(f"""{with_views('px')}, q AS (SELECT frame_id, quantile_cont(v, [0.02, 0.5, 0.98]) AS q FROM px GROUP BY 1), n AS (SELECT frame_id, r, c, coalesce((v - q[2]) * 0.96 / nullif(q[3] - q[1], 0), 0) AS v FROM px JOIN q USING (frame_id))
SELECT frame_id, 'up' AS target, r, c, round(greatest(v, 0), 6) AS p FROM n UNION ALL SELECT frame_id, 'down', r, c, round(greatest(-v, 0), 6) FROM n""")
def predictor_maps(spark, d):
    """A predictor of two targets over padded, normalised frames."""
    px = views.pixels(spark, d).select("frame_id", "r", "c", "v")
    return segment.predict(px, lambda x: {"up": x.clip(min=0), "down": (-x).clip(min=0)}, H, W).select("frame_id", "target", "r", "c", r6("p").alias("p"))


# -- outlines ---------------------------------------------------------------


@query(f"""{with_views('qd')}, c AS (SELECT frame_id, cell, avg(r) AS cr, avg(c) AS cc FROM qd GROUP BY 1, 2) SELECT frame_id, cell, r, c, round(sqrt((r - cr) ** 2 + (c - cc) ** 2), 6) AS rho, round(abs(atan2(c - cc, r - cr)), 6) AS phi FROM qd JOIN c USING (frame_id, cell)""")
def polar_pixels(spark, d):
    q = views.quadrants(spark, d)
    centres = objects.shape_features(q).select("frame_id", "cell", F.col("centroid_r").alias("centre_r"), F.col("centroid_c").alias("centre_c"))
    return outlines.to_polar(q, centres).select("frame_id", "cell", "r", "c", r6("rho").alias("rho"), r6(F.abs("phi")).alias("phi"))


_RAYS = f"""e AS ({_edges('mk')}), ce AS (SELECT frame_id, avg(r) AS cr, avg(c) AS cc FROM mk GROUP BY 1),
p AS (SELECT frame_id, sqrt((r - cr) ** 2 + (c - cc) ** 2) AS rho, (round_even(atan2(c - cc, r - cr) / {2 * math.pi / 8}, 0) + 8)::INT % 8 AS ray FROM e JOIN ce USING (frame_id)),
h AS (SELECT frame_id, ray, avg(rho) AS radius FROM p GROUP BY 1, 2), ev AS (SELECT frame_id, ray, radius FROM (SELECT frame_id, unnest(range(0, 8))::INT AS ray FROM (SELECT DISTINCT frame_id FROM h)) LEFT JOIN h USING (frame_id, ray)),
tu AS (SELECT frame_id, ray, radius, ray + 8 * k AS place FROM ev, (SELECT unnest([-1, 0, 1]) AS k)),
ne AS (SELECT *, last_value(CASE WHEN radius IS NOT NULL THEN place END IGNORE NULLS) OVER b AS a0, last_value(radius IGNORE NULLS) OVER b AS r0, first_value(CASE WHEN radius IS NOT NULL THEN place END IGNORE NULLS) OVER a AS a1, first_value(radius IGNORE NULLS) OVER a AS r1
  FROM tu WINDOW b AS (PARTITION BY frame_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY frame_id ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"{with_views('mk')}, {_RAYS} SELECT frame_id, ray, round(coalesce(radius, r0 + (place - a0) / (a1 - a0) * (r1 - r0)), 6) AS radius FROM ne WHERE place BETWEEN 0 AND 7")
def outline_rays(spark, d):
    m = views.masks(spark, d)
    centres = objects.shape_features(m).select("frame_id", "cell", F.col("centroid_r").alias("centre_r"), F.col("centroid_c").alias("centre_c"))
    rays = outlines.ray_radii(morph.edges(m, H, W), centres, 8)
    return rays.select("frame_id", "ray", r6("radius").alias("radius"))


_CAST = f"""e AS ({_edges('qd')}), b5 AS (SELECT k, exp(-2 * k * k) / sum(exp(-2 * k * k)) OVER () AS w FROM (SELECT unnest(range(-2, 3)) AS k)),
sm AS (SELECT least(greatest(t.r + a.k, 0), 7) AS s, t.r AS t, sum(w) AS w FROM (SELECT unnest(range(0, 8))::INT AS r) t, b5 a GROUP BY ALL),
so AS (SELECT frame_id, cell, y.t AS r, x.t AS c, sum(y.w * x.w) AS v FROM e JOIN sm y ON e.r = y.s JOIN sm x ON e.c = x.s GROUP BY ALL HAVING sum(y.w * x.w) > 0.01),
m AS (SELECT frame_id, cell, avg(r) AS cr, avg(c) AS cc, round(2 * covar_pop(r, c), 9) AS lean, round(var_pop(r) - var_pop(c), 9) AS tall, (var_pop(r) + var_pop(c)) / 2 + 1/12 AS hf, sqrt(((var_pop(r) - var_pop(c)) / 2) ** 2 + covar_pop(r, c) ** 2) AS rt, sqrt((max(r) + 1 - min(r)) ** 2 + (max(c) + 1 - min(c)) ** 2) AS reach FROM qd GROUP BY 1, 2),
ob AS (SELECT *, CASE WHEN 4 * sqrt(hf + rt) < 5 THEN 4 WHEN 4 * sqrt(hf + rt) < 20 THEN 6 ELSE 8 END AS rays, CASE WHEN lean = 0 AND tall = 0 THEN pi() / 4 ELSE 0.5 * atan2(lean, tall) END + pi() AS turn FROM m),
ov AS (SELECT *, turn - 2 * pi() / rays * floor(turn / (2 * pi() / rays)) AS over FROM ob),
ry AS (SELECT *, unnest(range(0, rays))::INT AS ray, CASE WHEN 2 * pi() / rays - over < 1e-9 THEN 0 ELSE over END - pi() AS first FROM ov),
ra AS (SELECT *, first + ray * 2 * pi() / rays AS angle FROM ry),
ks AS (SELECT frame_id, cell, ray, cr, cc, angle, unnest(range(0, greatest(round_even(2 * reach, 0), 1)::INT)) AS k FROM ra),
pt AS (SELECT frame_id, cell, ray, round_even(round(cr + 0.5 * k * cos(angle), 9), 0)::INT AS r, round_even(round(cc + 0.5 * k * sin(angle), 9), 0)::INT AS c FROM ks),
ht AS (SELECT frame_id, cell, ray, sum(r * v) / sum(v) AS hr, sum(c * v) / sum(v) AS hc FROM pt JOIN so USING (frame_id, cell, r, c) GROUP BY 1, 2, 3),
rd AS (SELECT ra.frame_id, ra.cell, ra.ray, rays, sqrt((hr - cr) ** 2 + (hc - cc) ** 2) AS radius FROM ra LEFT JOIN ht USING (frame_id, cell, ray)),
tu AS (SELECT *, ray + rays * k AS place FROM rd, (SELECT unnest([-1, 0, 1]) AS k)),
ne AS (SELECT *, last_value(CASE WHEN radius IS NOT NULL THEN place END IGNORE NULLS) OVER b AS a0, last_value(radius IGNORE NULLS) OVER b AS r0, first_value(CASE WHEN radius IS NOT NULL THEN place END IGNORE NULLS) OVER a AS a1, first_value(radius IGNORE NULLS) OVER a AS r1
  FROM tu WINDOW b AS (PARTITION BY frame_id, cell ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY frame_id, cell ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"{with_views('qd')}, {_CAST} SELECT frame_id, cell, ray, round(coalesce(radius, r0 + (place - a0) / (a1 - a0) * (r1 - r0), 0.1), 6) AS radius FROM ne WHERE place BETWEEN 0 AND rays - 1")
def ray_casts(spark, d):
    """Rays over the blurred outlines of the objects of each frame."""
    q = views.quadrants(spark, d)
    rays = outlines.cast_rays(morph.edges(q, H, W), outlines.ray_objects(q), H, W)
    return rays.select("frame_id", "cell", "ray", r6("radius").alias("radius"))


_PARTS = """la AS (SELECT frame_id, cell, r, c, r * 8 + c AS id FROM cl UNION SELECT m.frame_id, m.cell, m.r, m.c, la.id FROM la JOIN cl m ON m.frame_id = la.frame_id AND m.cell = la.cell AND abs(m.r - la.r) <= 1 AND abs(m.c - la.c) <= 1 AND la.id < m.r * 8 + m.c),
pa AS (SELECT frame_id, cell, r, c, min(id) AS part FROM la GROUP BY ALL),
sz AS (SELECT pa.frame_id, pa.cell, part, count(*) AS n, count(sd.r) AS shared FROM pa LEFT JOIN sd ON sd.frame_id = pa.frame_id AND sd.cell = pa.cell AND sd.r = pa.r AND sd.c = pa.c GROUP BY 1, 2, 3),
be AS (SELECT frame_id, cell, part FROM sz JOIN (SELECT frame_id, cell, count(*) AS a FROM sd GROUP BY 1, 2) USING (frame_id, cell) QUALIFY row_number() OVER (PARTITION BY frame_id, cell ORDER BY shared / (n + a - shared) DESC, part) = 1),
tm AS (SELECT frame_id, cell, r, c FROM pa JOIN be USING (frame_id, cell, part) UNION ALL SELECT frame_id, cell, r, c FROM sd ANTI JOIN be USING (frame_id, cell))"""
_MERGED = f"""hi AS (SELECT frame_id, r, c FROM px WHERE v > 0.18), l AS (SELECT frame_id, r, c, r * 8 + c AS id FROM hi UNION SELECT m.frame_id, m.r, m.c, l.id FROM l JOIN hi m ON m.frame_id = l.frame_id AND abs(m.r - l.r) <= 1 AND abs(m.c - l.c) <= 1 AND l.id < m.r * 8 + m.c),
m AS (SELECT frame_id, r, c, min(id) AS id FROM l GROUP BY ALL), s0 AS (SELECT frame_id, r, c, (dense_rank() OVER (PARTITION BY frame_id ORDER BY id))::INT AS cell FROM m), sd AS ({_dilated('s0')}),
ot AS (SELECT frame_id, c AS r, r AS c FROM px WHERE v > 0.2), bt AS (SELECT frame_id, cell, r, c FROM sd UNION SELECT x.frame_id, x.cell, ot.r, ot.c FROM (SELECT DISTINCT frame_id, cell FROM sd) x JOIN ot USING (frame_id)),
bd AS ({_dilated('bt')}), cl AS MATERIALIZED ({_eroded('bd')}), {_PARTS}"""


@query(f"{with_views('px')}, {_MERGED} SELECT * FROM tm")
def threshold_masks(spark, d):
    """Components of pixel values, merged with the mirror image as overlap map."""
    px = views.pixels(spark, d).select("frame_id", "r", "c", "v")
    over = px.select("frame_id", F.col("c").alias("r"), F.col("r").alias("c"), "v")
    return segment.threshold_masks(px, H, W, 0.18, over, 0.2).select("frame_id", "cell", "r", "c")


@query(f"{with_views('px')}, {_MERGED}, e AS ({_edges('tm')}) SELECT frame_id, (dense_rank() OVER (PARTITION BY frame_id ORDER BY cell))::INT AS cell, r, c FROM e")
def threshold_outlines(spark, d):
    px = views.pixels(spark, d).select("frame_id", "r", "c", "v")
    over = px.select("frame_id", F.col("c").alias("r"), F.col("r").alias("c"), "v")
    return segment.threshold_segmentation(px, H, W, overlap=over, thresholds=(0.18, 0.2, 0.9))


@query()
def radial_regions(spark, d):
    return segment.radial_regions(views.pixels(spark, d).select("frame_id", "r", "c", "v"), views.THRESHOLD, H, W)


# -- mothers and buds -------------------------------------------------------


def _maps(spark, d):
    return views.pixels(spark, d).select("frame_id", "r", "c", F.abs("v").alias("p_bud"), F.least(F.abs("v") * 3, F.lit(1.0)).alias("p_neck"))


_FEATURES = """f AS (SELECT frame_id, cell, count(*) AS area, avg(r) AS y, avg(c) AS x, var_pop(r) + 1/12 AS vr, var_pop(c) + 1/12 AS vc, covar_pop(r, c) AS rc FROM qd GROUP BY 1, 2),
g AS (SELECT *, 4 * sqrt(greatest((vr + vc) / 2 - sqrt(((vr - vc) / 2) ** 2 + rc ** 2), 0)) AS minor FROM f),
pb AS (SELECT frame_id, cell, avg(abs(v)) AS p_bud FROM qd JOIN px USING (frame_id, r, c) GROUP BY 1, 2),
pr AS (SELECT m.frame_id, m.cell AS mother, d.cell AS bud, m.area AS ma, d.area AS da, m.y AS my, m.x AS mx, d.y - m.y AS hr, d.x - m.x AS hc, greatest(2, d.minor * 0.25) AS wide, p_bud FROM g m JOIN g d ON m.frame_id = d.frame_id AND m.cell <> d.cell JOIN pb ON pb.frame_id = d.frame_id AND pb.cell = d.cell),
pw AS (SELECT *, sqrt(hr * hr + hc * hc) AS len FROM pr), px2 AS (SELECT *, -wide * hc / len AS wr, wide * hr / len AS wc FROM pw WHERE len > 0),
st AS (SELECT p.frame_id, mother, bud, gr.r, gr.c FROM px2 p, gr WHERE round((gr.r - (my - wr / 2)) * hr + (gr.c - (mx - wc / 2)) * hc, 9) BETWEEN 0 AND round(len * len, 9) AND round((gr.r - (my - wr / 2)) * wr + (gr.c - (mx - wc / 2)) * wc, 9) BETWEEN 0 AND round(wr * wr + wc * wc, 9)),
nk AS (SELECT st.frame_id, mother, bud, count(*) AS n, coalesce(avg(least(abs(v) * 3, 1)) FILTER (least(abs(v) * 3, 1) > 0.2), 0) AS neck_mean, coalesce(sum(least(abs(v) * 3, 1)) FILTER (least(abs(v) * 3, 1) > 0.2), 0) AS s FROM st JOIN px USING (frame_id, r, c) GROUP BY 1, 2, 3),
co AS (SELECT frame_id, mother, bud, count(*) AS k FROM (SELECT DISTINCT st.* FROM st JOIN qd ON qd.frame_id = st.frame_id AND qd.r = st.r AND qd.c = st.c AND qd.cell IN (mother, bud)) GROUP BY 1, 2, 3),
ft AS (SELECT frame_id, mother, bud, round(p_bud, 6) AS p_bud, round(ma / da, 6) AS size_ratio, round(neck_mean, 6) AS neck_mean, round(s / sqrt(da), 6) AS neck_ratio, round(coalesce(k, 0) / n, 6) AS adjacency FROM pr LEFT JOIN nk USING (frame_id, mother, bud) LEFT JOIN co USING (frame_id, mother, bud))"""
_LABELS = "la AS (SELECT frame_id, list(DISTINCT cell ORDER BY cell) AS labels FROM qd GROUP BY 1), lb AS (SELECT frame_id, labels, list_transform(labels, lambda k: CASE k WHEN 1 THEN 2 WHEN 3 THEN 4 ELSE 0 END) AS buds FROM la), one AS (SELECT frame_id, unnest(range(1, len(labels) + 1))::INT AS place, unnest(labels) AS label, unnest(buds) AS bud FROM lb), tp AS (SELECT m.frame_id, m.place AS mother, b.place AS bud FROM one m JOIN one b ON m.frame_id = b.frame_id AND m.bud = b.label AND m.bud > 0)"


def _pair_features(spark, d):
    f = buds.pair_features(views.quadrants(spark, d), _maps(spark, d), H, W)
    return f.select("frame_id", "mother", "bud", *[r6(x).alias(x) for x in buds.FEATURES])


def _labelled(spark, d):
    labels = views.quadrants(spark, d).groupBy("frame_id").agg(F.array_sort(F.collect_set("cell")).alias("labels"))
    return labels.withColumn("buds", F.transform("labels", lambda k: F.when(k == 1, 2).when(k == 3, 4).otherwise(0)))


@query(f"{with_views('qd')}, {_GRID}, {_FEATURES} SELECT * FROM ft")
def mother_bud_features(spark, d):
    return _pair_features(spark, d)


@query(f"{with_views('qd')}, {_LABELS} SELECT * FROM tp")
def mother_bud_truth(spark, d):
    return buds.truth_pairs(_labelled(spark, d))


@query(f"{with_views('qd')}, {_GRID}, {_FEATURES}, {_LABELS} SELECT ft.*, (tp.bud IS NOT NULL)::INT::DOUBLE AS is_pair FROM ft LEFT JOIN tp USING (frame_id, mother, bud) WHERE neck_mean IS NOT NULL AND adjacency IS NOT NULL")
def mother_bud_table(spark, d):
    return buds.bud_table(_pair_features(spark, d), buds.truth_pairs(_labelled(spark, d)))


@query()
def bud_classifier(spark, d):
    """Forest on pair features; frames are dealt to splits by number.

    As in the trainer that it rebuilds, it learns from validation frames, and all
    splits are scored.  Pairs with a missing feature can't be learned from, but are
    scored: they have probability 0, so a true one is missed.
    """
    rows = buds.marked_pairs(_pair_features(spark, d), buds.truth_pairs(_labelled(spark, d)))
    rows = rows.withColumn("split", F.when(F.col("frame_id") % 5 < 3, "train").when(F.col("frame_id") % 5 == 3, "validation").otherwise("test"))
    rows = stored(rows.select("split", "is_pair", *buds.FEATURES))  # the fit reads them many times
    learned = rows.filter("split = 'validation'").dropna(subset=list(buds.FEATURES))
    model = learn.forest(buds.FEATURES, "is_pair", 20, 5).fit(learn.with_balance(learned, "is_pair"))
    scored = learn.probabilities(model, rows, buds.FEATURES)
    return evaluate.metrics(scored, F.col("is_pair") == 1, F.col("p") > 0.5).select("split", *[r6(x).alias(x) for x in ("accuracy", "balanced", "precision", "recall", "f1", "f05", "f2")])


@query()
def frame_step(spark, d):
    """Events as objects; of two objects of a frame the larger value is likelier the mother."""
    t = views.tracks(spark, d)
    pairs = t.alias("a").join(t.alias("b"), ["series", "tp"]).filter("a.cell <> b.cell").select("series", "tp", F.col("a.cell").alias("mother"), F.col("b.cell").alias("bud"), (F.col("a.x") / (F.col("a.x") + F.col("b.x") + 1)).alias("p"))
    return buds.frame_step(t, pairs)


# -- augmentation -----------------------------------------------------------


@query(f"""{with_views('px')}, m AS (SELECT frame_id, quantile_cont(v, 0.5) AS m FROM px GROUP BY 1), g AS (SELECT x.k AS r, y.k AS c FROM (SELECT unnest(range(0, 12))::INT AS k) x, (SELECT unnest(range(0, 12))::INT AS k) y)
SELECT m.frame_id, g.r, g.c, round(coalesce(v, m), 6) AS v FROM m CROSS JOIN g LEFT JOIN px ON px.frame_id = m.frame_id AND px.r + 2 = g.r AND px.c + 2 = g.c""")
def augment_pad(spark, d):
    return augment.pad(views.pixels(spark, d), 12, 12, 2, 2).select("frame_id", "r", "c", r6("v").alias("v"))


@query(f"""{with_views('px', 'qd')}, m AS (SELECT frame_id, quantile_cont(v, 0.5) AS m FROM px GROUP BY 1), g AS (SELECT x.k AS r, y.k AS c FROM (SELECT unnest(range(0, 6))::INT AS k) x, (SELECT unnest(range(0, 9))::INT AS k) y)
SELECT 'image' AS kind, m.frame_id, 0 AS cell, g.r, g.c, round(coalesce(v, m), 6) AS v FROM m CROSS JOIN g LEFT JOIN px ON px.frame_id = m.frame_id AND px.r - 1 = g.r AND px.c + 1 = g.c UNION ALL SELECT 'label', frame_id, cell, r - 1, c + 1, 1.0 FROM qd WHERE r BETWEEN 1 AND 6""")
def augment_rough_crop(spark, d):
    """Room for 3 by 5 places: 6 rows of the frame's 8, 9 columns of which the first is padded."""
    image, labels = augment.rough_crop(views.pixels(spark, d), views.quadrants(spark, d), H, W, 3, 5)
    return image.select(F.lit("image").alias("kind"), "frame_id", F.lit(0).alias("cell"), "r", "c", r6("v").alias("v")).union(labels.select(F.lit("label"), "frame_id", "cell", "r", "c", F.lit(1.0)))


def _stack(spark, d):
    px = views.pixels(spark, d)
    return px.withColumn("z", F.explode(F.array(*[F.lit(k) for k in range(3)]))).select("frame_id", "z", "r", "c", (F.col("v") * (F.col("z") + 1)).alias("v"))


@query(f"{with_views('px')} SELECT frame_id, z, r, c, round(v * (least(greatest(z - 1, 0), 2) + 1), 6) AS v FROM px, (SELECT unnest(range(0, 3))::INT AS z)")
def augment_move_stacks(spark, d):
    return augment.move_stacks(_stack(spark, d), 1, 3).select("frame_id", "z", "r", "c", r6("v").alias("v"))


@query(f"{with_views('px')} SELECT frame_id, r, c, round((v * 1 + v * 3) / 2, 6) AS v FROM px")
def augment_substack(spark, d):
    return augment.substack(_stack(spark, d), [0, 2], mean=True).select("frame_id", "r", "c", r6("v").alias("v"))


@query(f"""{with_views('px')}, q AS (SELECT frame_id, quantile_cont(v, [0.02, 0.98]) AS q FROM px GROUP BY 1)
SELECT frame_id, r, c, round(CASE WHEN v > q[1] AND v < q[2] THEN q[1] + ((v - q[1]) / (q[2] - q[1])) ** 1.7 * (q[2] - q[1]) ELSE v END, 6) AS v FROM px JOIN q USING (frame_id)""")
def augment_gamma(spark, d):
    return augment.gamma(views.pixels(spark, d), 1.7).select("frame_id", "r", "c", r6("v").alias("v"))


def _u(tag: str, *keys: str) -> str:
    return f"(('0x' || substr(md5('5:{tag}:' || {' || chr(58) || '.join(keys)}), 1, 12))::BIGINT + 1) / 281474976710656.0::DOUBLE"


@query(f"""{with_views('px')} SELECT frame_id, r, c, round(v + (-0.003 * ln({_u('size', 'frame_id')})) * sqrt(-2 * ln({_u('a', 'frame_id', 'r', 'c')})) * cos(2 * 3.141592653589793 * {_u('b', 'frame_id', 'r', 'c')}), 6) AS v FROM px""")
def augment_noise(spark, d):
    return augment.noise(views.pixels(spark, d), 5).select("frame_id", "r", "c", r6("v").alias("v"))


@query(f"{with_views('px')} SELECT frame_id, c AS r, (7 - r)::INT AS c, round(v, 6) AS v FROM px")
def augment_rotate(spark, d):
    """A quarter turn: target (r, c) reads (7 - c, r)."""
    got = augment.rotate(views.pixels(spark, d).select("frame_id", "r", "c", "v"), 90.0, H, W)
    return got.select("frame_id", "r", "c", r6("v").alias("v"))


@query(f"""{with_views('px')}, t AS (SELECT x.k AS r, y.k AS c, (x.k - 3.5) * cos(pi() / 6) - (y.k - 3.5) * sin(pi() / 6) + 3.5 AS sy, (x.k - 3.5) * sin(pi() / 6) + (y.k - 3.5) * cos(pi() / 6) + 3.5 AS sx FROM (SELECT unnest(range(0, 8))::INT AS k) x, (SELECT unnest(range(0, 8))::INT AS k) y),
k AS (SELECT r, c, (floor(sy)::INT + a + 16) % 16 AS ny, (floor(sx)::INT + b + 16) % 16 AS nx, abs(1 - a - (sy - floor(sy))) * abs(1 - b - (sx - floor(sx))) AS w FROM t, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)),
n AS (SELECT r, c, w, least(ny, 15 - ny) AS sr, least(nx, 15 - nx) AS sc FROM k)
SELECT frame_id, n.r, n.c, round(sum(v * w), 6) AS v FROM n JOIN px ON px.r = sr AND px.c = sc GROUP BY ALL""")
def augment_turn(spark, d):
    """A turn by 30 degrees, between places and beyond the border."""
    return augment.rotate(views.pixels(spark, d).select("frame_id", "r", "c", "v"), 30.0, H, W).select("frame_id", "r", "c", r6("v").alias("v"))


@query(f"""{with_views('qd')}, b AS (SELECT frame_id, 4 -(min(r) + max(r) + 1) // 2 AS dr, 4 - (min(c) + max(c) + 1) // 2 AS dc FROM qd WHERE cell = 1 GROUP BY 1)
SELECT frame_id, (r + coalesce(dr, 0))::INT AS r, (c + coalesce(dc, 0))::INT AS c, round(v, 6) AS v FROM px LEFT JOIN b USING (frame_id) WHERE r + coalesce(dr, 0) BETWEEN 0 AND 7 AND c + coalesce(dc, 0) BETWEEN 0 AND 7""")
def augment_cell_shift(spark, d):
    boxes = objects.shape_features(views.quadrants(spark, d).filter("cell = 1")).select("frame_id", "r0", "c0", "r1", "c1")
    return augment.cell_shift(views.pixels(spark, d).select("frame_id", "r", "c", "v"), boxes, H, W).select("frame_id", "r", "c", r6("v").alias("v"))


def _fires(step: str, chance: float) -> str:
    return f"('0x' || substr(md5('11:{step}:' || frame_id || ':' || draw), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < {chance!r}::DOUBLE"


@query(f"""{with_views('px')}, f AS (SELECT frame_id, draw, {_fires('vflip', 0.5)} AS a, {_fires('hflip', 1 - 0.15**0.5)} AS b, {_fires('shift', 1 - 0.15**0.5)} AS s FROM (SELECT DISTINCT frame_id FROM px), (VALUES (1), (2)) v(draw))
SELECT frame_id, draw, concat_ws(',', CASE WHEN a THEN 'vflip' END, CASE WHEN b THEN 'hflip' END, CASE WHEN s THEN 'shift' END) AS steps, count(*) AS n, round(sum(v), 6) AS total FROM f JOIN px USING (frame_id) WHERE NOT s OR CASE WHEN a THEN 7 - r ELSE r END < 7 GROUP BY 1, 2, 3""")
def augment_frames(spark, d):
    """Two versions of each frame through three steps."""
    steps = [("vflip", 0.5, lambda p: augment.flip(p, H, W, True)), ("hflip", None, lambda p: augment.flip(p, H, W, False)), ("shift", None, lambda p: augment.shift(p, 1, 0, H, W))]
    done = augment.augment(views.pixels(spark, d), steps, 11, draws=2)
    return done.groupBy("frame_id", "draw", F.array_join("steps", ",").alias("steps")).agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"))


@query(f"""{with_views('qd')}, {_GRID}, ed AS ({_edges('qd')}), o AS (SELECT frame_id, cell, ln(greatest((count(*) - 1) / 2, 1)) / 1.5 AS s FROM ed GROUP BY 1, 2), bg AS (SELECT frame_id, cell, r, c FROM o, gr EXCEPT SELECT frame_id, cell, r, c FROM ed),
fl AS (SELECT frame_id, cell, r, c FROM bg WHERE r IN (0, 7) OR c IN (0, 7) UNION SELECT bg.frame_id, bg.cell, bg.r, bg.c FROM fl JOIN bg ON bg.frame_id = fl.frame_id AND bg.cell = fl.cell AND abs(bg.r - fl.r) + abs(bg.c - fl.c) = 1),
fi AS (SELECT frame_id, cell, r, c, s FROM o, gr ANTI JOIN fl ON fl.frame_id = o.frame_id AND fl.cell = o.cell AND fl.r = gr.r AND fl.c = gr.c),
sm AS (SELECT frame_id, cell, gr.r, gr.c, sum(CASE WHEN s > 0 THEN exp(-0.5 * ((gr.r - fi.r) ** 2 + (gr.c - fi.c) ** 2) / s ** 2) ELSE (gr.r = fi.r AND gr.c = fi.c)::INT END) AS v FROM fi, gr GROUP BY ALL),
ne AS MATERIALIZED (SELECT frame_id, cell, r, c FROM sm QUALIFY v > 0.5 * max(v) OVER (PARTITION BY frame_id, cell)), nd AS ({_edges('ne')})
SELECT ne.*, (nd.r IS NOT NULL)::INT AS v FROM ne LEFT JOIN nd USING (frame_id, cell, r, c)""")
def smooth_labels(spark, d):
    return augment.smooth_labels(morph.edges(views.quadrants(spark, d), H, W), H, W, 2.0, 1.5, 1.0)
