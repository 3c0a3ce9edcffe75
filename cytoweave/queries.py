"""The registered queries over the supplied tables and their DuckDB twins.

Each entry applies operators to the views of ``sources.views``; floats are
rounded to 6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import augment, evaluate, growth, learn, match, morph, norm, objects, outlines, sample, segment, tiles, track, tune
from .operators.tables import stored
from .registry import QUERIES, SQL, Query, query, r6, r6_share
from .sources import images, views
from .sources.views import with_views
from .streaming import live

H = W = views.SIDE
# -- normalisation ----------------------------------------------------------


@query(f"""{with_views('px')} SELECT frame_id, r, c, round(coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0), 6) AS v FROM px WINDOW w AS (PARTITION BY frame_id)""")
def norm_minmax(spark, d):
    return norm.minmax_norm(views.pixels(spark, d)).select("frame_id", "r", "c", r6("v").alias("v"))


@query(f"""{with_views('px')}, q AS (SELECT frame_id, quantile_cont(v, [0.02, 0.5, 0.98]) AS q FROM px GROUP BY 1)
SELECT frame_id, r, c, round(coalesce((v - q[2]) * 0.96 / nullif(q[3] - q[1], 0), 0), 6) AS v FROM px JOIN q USING (frame_id)""")
def norm_robust(spark, d):
    return norm.robust_norm(views.pixels(spark, d)).select("frame_id", "r", "c", r6("v").alias("v"))


@query("""WITH q AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, [0.02, 0.5, 0.98]) AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_returnflag, l_linestatus, l_extendedprice, round((l_extendedprice - q[2]) * 0.96 / nullif(q[3] - q[1], 0), 6) AS v FROM lineitem JOIN q USING (l_returnflag, l_linestatus)""")
def norm_robust_group(spark, d):
    rows = views.table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_extendedprice", F.col("l_extendedprice").alias("v"))
    return norm.robust_norm(rows, ("l_returnflag", "l_linestatus"), large=True).select("l_orderkey", "l_returnflag", "l_linestatus", "l_extendedprice", r6("v").alias("v"))


@query(f"""{with_views('px')} SELECT a.frame_id, a.r, a.c, round(greatest(a.v, 0) * (1 - greatest(coalesce(b.v, 0), 0)), 6) AS v FROM px a LEFT JOIN px b ON a.frame_id = b.frame_id AND a.r = b.c AND a.c = b.r""")
def edge_dampen(spark, d):
    px = views.pixels(spark, d).withColumn("v", F.greatest("v", F.lit(0.0)))
    edge = px.select("frame_id", F.col("c").alias("r"), F.col("r").alias("c"), "v")
    return norm.dampen_edges(px, edge).select("frame_id", "r", "c", r6("v").alias("v"))


# -- objects and morphology -------------------------------------------------


@query(f"""{with_views('mk')} SELECT frame_id, count(*) AS area FROM mk GROUP BY 1 HAVING count(*) >= 10 AND count(*) < 30""")
def pixel_threshold_area(spark, d):
    return objects.area_filter(objects.areas(views.masks(spark, d)), 10, 30).select("frame_id", "area")


_CROSS = "(VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)) o(dr,dc)"
_SQUARE = "(VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) o(dr,dc)"
_DILATE = f"SELECT DISTINCT frame_id, r + dr AS r, c + dc AS c FROM {{0}}, {_CROSS} WHERE r + dr BETWEEN 0 AND 7 AND c + dc BETWEEN 0 AND 7"
_ERODE = f"SELECT frame_id, r + dr AS r, c + dc AS c FROM {{0}}, {_CROSS} GROUP BY ALL HAVING count(*) = 5"


@query(f"{with_views('mk')} {_DILATE.format('mk')}")
def dilate(spark, d):
    return morph.dilate(views.masks(spark, d), H, W).select("frame_id", "r", "c")


@query(f"{with_views('mk')} {_ERODE.format('mk')}")
def erode(spark, d):
    return morph.erode(views.masks(spark, d)).select("frame_id", "r", "c")


@query(f"{with_views('mk')}, d AS ({_DILATE.format('mk')}), cl AS ({_ERODE.format('d')}), e AS ({_ERODE.format('mk')}), op AS ({_DILATE.format('e')}) SELECT 'closed' AS kind, * FROM cl UNION ALL SELECT 'opened', * FROM op")
def open_close(spark, d):
    m = views.masks(spark, d)
    out = lambda x, k: x.select(F.lit(k).alias("kind"), "frame_id", "r", "c")
    return out(morph.close(m, H, W), "closed").union(out(morph.open_(m, H, W), "opened"))


@query(f"""{with_views('mk')} SELECT DISTINCT frame_id, r, c FROM (SELECT mk.*, r + dr AS nr, c + dc AS nc FROM mk, {_SQUARE}) n
WHERE nr BETWEEN 0 AND 7 AND nc BETWEEN 0 AND 7 AND NOT EXISTS (SELECT 1 FROM mk m WHERE m.frame_id = n.frame_id AND m.r = nr AND m.c = nc)""")
def edges(spark, d):
    return morph.edges(views.masks(spark, d), H, W).select("frame_id", "r", "c")


@query(f"""{with_views('mk')}, n AS (SELECT frame_id, r + dr AS r, c + dc AS c FROM mk, {_SQUARE} WHERE r + dr BETWEEN 0 AND 7 AND c + dc BETWEEN 0 AND 7 GROUP BY ALL HAVING count(*) > 1), e AS ({_ERODE.format('n')})
SELECT * FROM e UNION SELECT frame_id, r, c FROM mk""")
def gap_close(spark, d):
    return morph.fill_gaps(views.masks(spark, d), H, W).select("frame_id", "r", "c")


@query(f"""{with_views('px')}, n AS (SELECT frame_id, r + dr AS r, c + dc AS c, v FROM px, {_CROSS} WHERE r + dr BETWEEN 0 AND 7 AND c + dc BETWEEN 0 AND 7)
SELECT frame_id, r, c, round(max(v), 6) AS hi, round(min(v), 6) AS lo FROM n GROUP BY ALL""")
def grey_dilate(spark, d):
    px = views.pixels(spark, d).select("frame_id", "r", "c", "v")
    hi, lo = morph.grey(px, H, W, True), morph.grey(px, H, W, False)
    return hi.select("frame_id", "r", "c", r6("v").alias("hi")).join(lo.select("frame_id", "r", "c", r6("v").alias("lo")), ["frame_id", "r", "c"])


@query(f"""{with_views('mk')}, l AS (SELECT frame_id, r, c, r * 8 + c AS id FROM mk UNION SELECT m.frame_id, m.r, m.c, l.id FROM l JOIN mk m ON m.frame_id = l.frame_id AND abs(m.r - l.r) <= 1 AND abs(m.c - l.c) <= 1 AND l.id < m.r * 8 + m.c),
m AS (SELECT frame_id, r, c, min(id) AS id FROM l GROUP BY ALL)
SELECT frame_id, r, c, (dense_rank() OVER (PARTITION BY frame_id ORDER BY id))::INT AS cell FROM m""")
def components(spark, d):
    return morph.components(views.masks(spark, d))


@query(f"""{with_views('mk')}, m AS (SELECT frame_id, count(*) AS area, avg(r) AS mr, avg(c) AS mc, var_pop(r) + 1/12 AS vr, var_pop(c) + 1/12 AS vc, covar_pop(r, c) AS rc, (max(r) + 1 - min(r)) * (max(c) + 1 - min(c)) AS box FROM mk GROUP BY 1),
e AS (SELECT *, (vr + vc) / 2 AS h, sqrt(((vr - vc) / 2) ** 2 + rc ** 2) AS q FROM m)
SELECT frame_id, area, round(mr, 6) AS centroid_r, round(mc, 6) AS centroid_c, box AS bbox_area, round(4 * sqrt(h + q), 6) AS major, round(4 * sqrt(greatest(h - q, 0)), 6) AS minor FROM e""")
def moments(spark, d):
    f = objects.shape_features(views.masks(spark, d))
    return f.select("frame_id", "area", r6("centroid_r").alias("centroid_r"), r6("centroid_c").alias("centroid_c"), "bbox_area", r6("major").alias("major"), r6("minor").alias("minor"))


@query(f"""{with_views('qd')}, f AS (SELECT frame_id, cell, count(*) AS area, avg(r) AS y, avg(c) AS x FROM qd GROUP BY 1, 2), b AS (SELECT *, avg(y) OVER w AS by_, avg(x) OVER w AS bx FROM f WINDOW w AS (PARTITION BY frame_id))
SELECT frame_id, cell, round(by_, 6) AS bary_r, round(bx, 6) AS bary_c, round(sqrt((y - by_) ** 2 + (x - bx) ** 2), 6) AS distance FROM b""")
def barycentre(spark, d):
    cells = objects.shape_features(views.quadrants(spark, d))
    return objects.barycentre(cells).select("frame_id", "cell", r6("bary_r").alias("bary_r"), r6("bary_c").alias("bary_c"), r6("distance").alias("distance"))


@query(f"""{with_views('qd')}, a AS (SELECT frame_id, cell, count(*) AS area FROM qd GROUP BY 1, 2)
SELECT frame_id, cell, area, name FROM a JOIN (VALUES ('small', 1, 8), ('medium', 6, 12), ('large', 10, NULL)) g(name, lower, upper) ON area >= lower AND (upper IS NULL OR area < upper)""")
def size_groups(spark, d):
    groups = spark.createDataFrame([("small", 1.0, 8.0), ("medium", 6.0, 12.0), ("large", 10.0, None)], "name string, lower double, upper double")
    return objects.size_groups(objects.areas(views.quadrants(spark, d)), groups).select("frame_id", "cell", "area", "name")


@query(f"""{with_views('qd')} SELECT frame_id, r, c, 1 AS filled, count(*) AS filledsum, (count(*) > 1)::INT AS overlap, (count(*) = 1)::INT AS interior FROM qd GROUP BY 1, 2, 3""")
def flatten_targets(spark, d):
    return objects.flatten(views.quadrants(spark, d))


@query(f"""{with_views('qd')}, d AS (SELECT DISTINCT frame_id, cell, r + dr AS r, c + dc AS c FROM qd, (SELECT x.k AS dr, y.k AS dc FROM (SELECT unnest(range(-2, 3)) AS k) x, (SELECT unnest(range(-2, 3)) AS k) y WHERE abs(x.k) + abs(y.k) <= 2) WHERE r + dr BETWEEN 0 AND 7 AND c + dc BETWEEN 0 AND 7)
SELECT DISTINCT d.frame_id, d.r, d.c FROM d JOIN qd b ON b.frame_id = d.frame_id AND b.r = d.r AND b.c = d.c AND b.cell > d.cell""")
def bud_neck(spark, d):
    """Each object is the mother of all with a higher number."""
    q = views.quadrants(spark, d)
    cells = q.select("frame_id", "cell").distinct()
    pairs = cells.select("frame_id", F.col("cell").alias("mother")).join(cells.select("frame_id", F.col("cell").alias("bud")), "frame_id").filter("mother < bud")
    return objects.bud_neck(q, pairs, H, W)


_EDGE = "e AS (SELECT DISTINCT frame_id, cell, r, c FROM (SELECT mk.*, r + dr AS nr, c + dc AS nc FROM mk, " + _SQUARE + ") n WHERE r IN (0, 7) OR c IN (0, 7) OR NOT EXISTS (SELECT 1 FROM mk m WHERE m.frame_id = n.frame_id AND m.r = nr AND m.c = nc)), ds AS (SELECT m.frame_id, m.r, m.c, min(sqrt((m.r - e.r) ** 2 + (m.c - e.c) ** 2)) AS d FROM mk m JOIN e USING (frame_id) GROUP BY ALL)"


@query(f"{with_views('mk')}, {_EDGE} SELECT frame_id, round(4 * sum(d) + count(*), 6) AS volume FROM ds GROUP BY 1")
def conical_volume(spark, d):
    return objects.conical_volume(views.masks(spark, d), H, W).select("frame_id", r6("volume").alias("volume"))


@query(f"""{with_views('mk')}, {_EDGE}, b AS (SELECT unnest(range(-7, 8)) AS k)
SELECT frame_id, count(DISTINCT (ds.r + x.k, ds.c + y.k, z.k)) AS volume FROM ds JOIN b x ON abs(x.k) <= d JOIN b y ON abs(y.k) <= d JOIN b z ON x.k * x.k + y.k * y.k + z.k * z.k <= d * d GROUP BY 1""")
def sphere_union_volume(spark, d):
    return objects.union_of_spheres(views.masks(spark, d), H, W).select("frame_id", "volume")


@query(f"""{with_views('qd')}, a AS (SELECT frame_id, r, c, max(cell) AS label FROM qd GROUP BY 1, 2, 3) SELECT * FROM a""")
def label_map(spark, d):
    return morph.composite(views.quadrants(spark, d))


@query(f"""{with_views('px', 'mk')}, p AS (SELECT frame_id, r, c FROM px WHERE v > 0.02), t AS (SELECT frame_id, c AS r, r AS c FROM mk)
SELECT coalesce(p.frame_id, t.frame_id) AS frame_id, count(*) FILTER (p.r IS NOT NULL AND t.r IS NOT NULL) AS tp, count(*) FILTER (t.r IS NULL) AS fp, count(*) FILTER (p.r IS NULL) AS fn FROM p FULL JOIN t ON p.frame_id = t.frame_id AND p.r = t.r AND p.c = t.c GROUP BY 1""")
def pixel_confusion(spark, d):
    truth = views.masks(spark, d).select("frame_id", F.col("c").alias("r"), F.col("r").alias("c"))
    return morph.confusion(views.pixels(spark, d), truth, 0.02)


@query(f"""{with_views('qd')} SELECT frame_id, cell, '[' || string_agg('[' || (r + 1) || ',' || (c + 1) || ']', ',' ORDER BY r, c) || ']' AS coords FROM qd GROUP BY 1, 2""")
def coords_json(spark, d):
    return objects.coordinates(views.quadrants(spark, d))


@query(f"""{with_views('px')}, m AS (SELECT frame_id, quantile_cont(v, 0.5) AS m FROM px GROUP BY 1), t AS (SELECT frame_id, r, c FROM px QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY v DESC, r, c) = 1), g AS (SELECT m.frame_id, m, t.r AS tr, t.c AS tc, dr, dc FROM m JOIN t USING (frame_id), (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc))
SELECT g.frame_id, 0 AS centre, (dr + 2)::INT AS r, (dc + 2)::INT AS c, round(coalesce(v, m), 6) AS v FROM g LEFT JOIN px ON px.frame_id = g.frame_id AND px.r = tr + dr AND px.c = tc + dc""")
def trap_tiles(spark, d):
    px = views.pixels(spark, d)
    top = px.groupBy("frame_id").agg(F.max(F.struct("v", (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))).alias("t"))
    centres = top.select("frame_id", F.lit(0).alias("centre"), (-F.col("t.r")).alias("r"), (-F.col("t.c")).alias("c"))
    return tiles.windows(px, centres, 2).select("frame_id", "centre", "r", "c", r6("v").alias("v"))


@query("""WITH f AS (SELECT o_orderkey AS frame_id, (64 + o_orderkey % 700)::INT AS h, (64 + o_custkey % 900)::INT AS w FROM orders),
s AS (SELECT unnest(range(88, 257, 8)) AS s),
a AS (SELECT frame_id, h, w, s, greatest(ceil((h - 48) / (s - 48)::DOUBLE), 1)::INT AS nh, greatest(ceil((w - 48) / (s - 48)::DOUBLE), 1)::INT AS nw FROM f, s),
p AS (SELECT frame_id, any_value(h) AS h, any_value(w) AS w, min({'c': (nh * (s - 48) + 48 - h)::DOUBLE / nh, 's': s, 'n': nh}) AS bh, min({'c': (nw * (s - 48) + 48 - w)::DOUBLE / nw, 's': s, 'n': nw}) AS bw FROM a GROUP BY 1)
SELECT frame_id, h, w, CASE WHEN h > 256 OR w > 256 THEN bh.s END::INT AS th, CASE WHEN h > 256 OR w > 256 THEN bw.s END::INT AS tw, CASE WHEN h > 256 OR w > 256 THEN bh.n END::INT AS nh, CASE WHEN h > 256 OR w > 256 THEN bw.n END::INT AS nw FROM p""")
def tile_plan(spark, d):
    o = views.table(spark, d, "orders")
    return tiles.plan(o.select(F.col("o_orderkey").alias("frame_id"), (64 + F.col("o_orderkey") % 700).cast("int").alias("h"), (64 + F.col("o_custkey") % 900).cast("int").alias("w")).dropDuplicates(["frame_id"]))


@query(f"""{with_views('px')} SELECT frame_id, r, c, round(v, 6) AS v FROM px""")
def tile_stitch(spark, d):
    cut = tiles.cut(views.pixels(spark, d).select("frame_id", "r", "c", "v"), 4, 2, 3, 3)
    return tiles.stitch(cut, 4, 2, 3, 3).select("frame_id", "r", "c", r6("v").alias("v"))


@query(f"""{with_views('px')} SELECT frame_id, (7 - r - 1)::INT AS r, (7 - c - 2)::INT AS c, round(v, 6) AS v FROM px WHERE r + 1 <= 7 AND c + 2 <= 7""")
def augment_flip_shift_crop(spark, d):
    px = augment.shift(views.pixels(spark, d).select("frame_id", "r", "c", "v"), 1, 2, H, W)
    px = augment.flip(augment.flip(px, H, W, True), H, W, False)
    return augment.crop(px, 0, 0, H, W).select("frame_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), r6("v").alias("v"))


@query()
def segment_cells(spark, d):
    """Two groups on the pixel values and their mirror image as prediction maps."""
    px = views.pixels(spark, d)
    one = px.select("frame_id", F.lit("small").alias("target"), "r", "c", F.col("v").alias("p"))
    two = px.select("frame_id", F.lit("large").alias("target"), "r", "c", (F.col("v") + 0.05).alias("p"))
    groups = [segment.GroupParams(("small",), None, 0.05, 0, 0, 0, 1, 6), segment.GroupParams(("large", "small"), "small", 0.05, 0, 0, 0, 3, None, 0.0)]
    return segment.segment(one.union(two), groups, H, W, 0.5)





# -- pairing and evaluation -------------------------------------------------


@query(f"""{with_views('st')}, n AS (SELECT a.obj AS ta, b.obj AS tb, count(*) AS n FROM st a JOIN st b ON a.px = b.px AND a.obj < b.obj GROUP BY 1, 2), s AS (SELECT obj, count(*) AS area FROM st GROUP BY 1)
SELECT ta, tb, n, round(n / (x.area + y.area - n), 6) AS iou, round(greatest(n / x.area, n / y.area), 6) AS containment FROM n JOIN s x ON ta = x.obj JOIN s y ON tb = y.obj""")
def iou_matrix(spark, d):
    s = views.sets(spark, d).select(F.col("obj").alias("cell"), "px")
    p = match.intersections(s, s, ["px"], (), ordered=True)
    n, a, b = F.col("n"), F.col("area_a"), F.col("area_b")
    return p.select("ta", "tb", "n", r6_share(n, a + b - n).alias("iou"), r6_share(n, F.least(a, b)).alias("containment"))


_QP = "p AS (SELECT a.frame_id, a.cell AS ta, b.cell AS tb, count(*) AS n FROM qd a JOIN qd b ON a.frame_id = b.frame_id AND a.r = b.r AND a.c = b.c GROUP BY 1, 2, 3), s AS (SELECT frame_id, cell, count(*) AS area FROM qd GROUP BY 1, 2), j AS (SELECT p.*, x.area AS area_a, y.area AS area_b FROM p JOIN s x ON x.frame_id = p.frame_id AND x.cell = ta JOIN s y ON y.frame_id = p.frame_id AND y.cell = tb)"


@query(f"{with_views('qd')}, {_QP} SELECT frame_id, ta, tb, round(greatest(n / area_a, n / area_b), 6) AS containment FROM j WHERE tb = ta + 1 AND greatest(n / area_a, n / area_b) > 0.3")
def containment_adjacent(spark, d):
    q = views.quadrants(spark, d)
    p = match.intersections(q, q, ["r", "c"]).filter("tb = ta + 1").withColumn("containment", match.containment())
    return p.filter("containment > 0.3").select("frame_id", "ta", "tb", r6("containment").alias("containment"))



@query(f"""{with_views('qd')}, p AS (SELECT a.frame_id, a.cell AS ta, b.cell AS tb, count(*) AS n FROM qd a JOIN qd b ON a.frame_id = b.frame_id AND a.r = b.c AND a.c = b.r GROUP BY 1, 2, 3), s AS (SELECT frame_id, cell, count(*) AS area FROM qd GROUP BY 1, 2),
j AS (SELECT p.frame_id, ta, tb, n / (x.area + y.area - n) AS iou FROM p JOIN s x ON x.frame_id = p.frame_id AND x.cell = ta JOIN s y ON y.frame_id = p.frame_id AND y.cell = tb)
SELECT frame_id, ta, tb, round(iou, 6) AS iou FROM j QUALIFY row_number() OVER (PARTITION BY frame_id, ta ORDER BY iou DESC, ta, tb) = 1 AND row_number() OVER (PARTITION BY frame_id, tb ORDER BY iou DESC, ta, tb) = 1""")
def mutual_best(spark, d):
    q = views.quadrants(spark, d)
    flipped = q.select("frame_id", "cell", F.col("c").alias("r"), F.col("r").alias("c"))
    p = match.intersections(q, flipped, ["r", "c"]).withColumn("iou", match.iou())
    return match.mutual_best(p).select("frame_id", "ta", "tb", r6("iou").alias("iou"))


_CURVE = """WITH h AS (SELECT source, doc_id, n_chars, quality AS hit FROM documents JOIN labels USING (doc_id)),
w AS (SELECT *, row_number() OVER o AS rank, sum(hit) OVER o AS tp, sum(hit) OVER (PARTITION BY source) AS truths FROM h WINDOW o AS (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, tp / rank AS precision, coalesce(tp / nullif(truths, 0), 0) AS recall FROM w)"""


def _curve(spark, d):
    docs, labels = views.table(spark, d, "documents").select("doc_id", "source", "n_chars"), views.table(spark, d, "labels")
    hits = docs.join(labels, "doc_id").withColumn("hit", F.col("quality")).withColumn("truths", F.sum("quality").over(Window.partitionBy("source")))
    return match.precision_recall(hits, ["source"], F.col("truths"), [F.desc("n_chars"), F.col("doc_id")])


@query(f"{_CURVE} SELECT source, doc_id, rank, round(precision, 6) AS precision, round(recall, 6) AS recall FROM k")
def pr_curve(spark, d):
    return _curve(spark, d).select("source", "doc_id", "rank", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(f"{_CURVE}, m AS (SELECT source, max(precision) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * (recall - coalesce(lag(recall) OVER (PARTITION BY source ORDER BY rank), 0)) AS a FROM k) SELECT source, round(sum(a), 6) AS ap FROM m GROUP BY 1")
def average_precision(spark, d):
    return match.average_precision(_curve(spark, d), ["source"]).select("source", r6("ap").alias("ap"))


@query("""WITH j AS (SELECT lang, toxic::DOUBLE AS t, n_chars / (n_chars + 3000.0) AS p FROM documents JOIN labels USING (doc_id)), q AS (SELECT *, least(greatest(p, 1e-7), 1 - 1e-7) AS q FROM j)
SELECT lang, round((2 * sum(p * t) + 1) / (count(*) FILTER (t <> 0) + sum(p) + 1), 6) AS dice, round(avg(-(t * ln(q) + (1 - t) * ln(1 - q))), 6) AS bce FROM q GROUP BY 1""")
def dice_bce(spark, d):
    j = views.table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(views.table(spark, d, "labels"), "doc_id")
    p, t = F.col("n_chars") / (F.col("n_chars") + 3000.0), F.col("toxic").cast("double")
    return j.groupBy("lang").agg(r6(match.dice(p, t)).alias("dice"), r6(match.cross_entropy(p, t)).alias("bce"))


@query("""WITH j AS (SELECT lang, source, toxic = 1 AS t, n_chars > 3000 AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, source, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM j GROUP BY ROLLUP (lang, source))
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS tnr FROM c""")
def link_confusion(spark, d):
    j = views.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(views.table(spark, d, "labels"), "doc_id")
    counts = evaluate.confusion_counts(j, F.col("toxic") == 1, F.col("n_chars") > 3000, ["lang", "source"], rollup=True)
    return evaluate.rates(counts).select("lang", "source", "tp", "fp", "fn", "tn", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("tnr").alias("tnr"))


@query("""WITH j AS (SELECT source, doc_id, n_chars FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS b, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS w FROM j)
SELECT source, doc_id, n_chars, b AS rank, 'best' AS side FROM b WHERE b <= 8 UNION ALL SELECT source, doc_id, n_chars, w, 'worst' FROM b WHERE w <= 8""")
def topk_best_worst(spark, d):
    return evaluate.top_and_bottom(views.table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "n_chars", "doc_id")


@query("""SELECT event_type, loss FROM (SELECT event_type, min(value) AS loss FROM events GROUP BY 1) ORDER BY loss, event_type LIMIT 1""")
def best_model(spark, d):
    return evaluate.best_by_minimum(views.table(spark, d, "events").withColumn("loss", F.col("value")), "event_type", "loss")


# -- tracks, lineages, growth -----------------------------------------------

_PAIRS = """s AS (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY tp) AS step FROM tr),
cp AS (SELECT n.series, n.tp, n.cell, n.step - p.step AS back, p.tp AS prev_tp, p.cell AS prev_cell, p.x - n.x AS d_x, p.y - n.y AS d_y FROM s n JOIN s p ON n.series = p.series AND p.step BETWEEN n.step - 3 AND n.step - 1)"""


@query(f"{with_views('tr')}, {_PAIRS} SELECT series, tp, cell, back::INT AS back, prev_cell, round(d_x, 6) AS d_x, round(d_y, 6) AS d_y FROM cp")
def candidate_pairs(spark, d):
    return track.candidate_pairs(views.tracks(spark, d)).select("series", "tp", "cell", "back", "prev_cell", r6("d_x").alias("d_x"), r6("d_y").alias("d_y"))


@query(f"{with_views('tr')}, {_PAIRS} SELECT series, tp, cell, round(min(sqrt(d_x * d_x + d_y * d_y)), 6) AS nearest, count(*) AS n FROM cp GROUP BY 1, 2, 3")
def pair_distance(spark, d):
    p = track.candidate_pairs(views.tracks(spark, d)).withColumn("distance", track.pair_distance())
    return p.groupBy("series", "tp", "cell").agg(r6(F.min("distance")).alias("nearest"), F.count("*").alias("n"))


@query()
def track_series(spark, d):
    return track.track(views.tracks(spark, d))


@query()
def channel_track(spark, d):
    return track.channel_track(views.tracks(spark, d).withColumn("x", F.abs("x") + 1))


def _lineage_inputs(spark, d):
    """Event types of a user as labels; a daily share of values as pair probability."""
    e = _labelled(spark, d)
    presence = e.select("series", "tp", "label").distinct()
    p = e.groupBy("series", "tp", "label").agg(F.avg("y").alias("m"))
    pairs = p.alias("a").join(p.alias("b"), ["series", "tp"]).filter("a.label <> b.label").select("series", "tp", F.col("a.label").alias("mother"), F.col("b.label").alias("bud"), (F.col("a.m") / (F.col("a.m") + F.col("b.m") + 1)).alias("p"))
    return pairs, presence


def _labelled(spark, d):
    t = views.tracks(spark, d)
    return t.withColumn("label", (F.conv(F.substring(F.md5(F.col("kind").cast("binary")), 1, 2), 16, 10).cast("int") + 1))


_LIN = """lb AS (SELECT series, tp, ('0x' || substr(md5(kind), 1, 2))::INT + 1 AS label, y FROM tr),
pr AS (SELECT DISTINCT series, tp, label FROM lb),
mm AS (SELECT series, tp, label, avg(y) AS m FROM lb GROUP BY ALL),
pp AS (SELECT a.series, a.tp, a.label AS mother, b.label AS bud, a.m / (a.m + b.m + 1) AS p FROM mm a JOIN mm b ON a.series = b.series AND a.tp = b.tp AND a.label <> b.label),
am AS (SELECT series, tp, mother AS label, sum(p) AS s FROM pp GROUP BY ALL),
mo AS (SELECT pr.series, pr.tp, pr.label AS bud, coalesce(max(s) OVER (PARTITION BY pr.series, pr.label ORDER BY pr.tp ROWS UNBOUNDED PRECEDING), 0) AS motherness FROM pr LEFT JOIN am ON am.series = pr.series AND am.tp = pr.tp AND am.label = pr.label),
sc AS (SELECT pp.series, pp.tp, mother, pp.bud, sum(p * (1 - motherness)) OVER (PARTITION BY pp.series, mother, pp.bud ORDER BY pp.tp ROWS UNBOUNDED PRECEDING) AS ba FROM pp JOIN mo ON mo.series = pp.series AND mo.tp = pp.tp AND mo.bud = pp.bud)"""


@query(f"{with_views('tr')}, {_LIN} SELECT series, tp, mother, bud, round(ba, 6) AS ba_cum FROM sc")
def lineage_scores(spark, d):
    pairs, presence = _lineage_inputs(spark, d)
    return track.lineage_scores(pairs, presence).select("series", "tp", "mother", "bud", r6("ba_cum").alias("ba_cum"))


@query(f"""{with_views('tr')}, {_LIN},
li AS (SELECT series, tp, label, count(*) OVER w AS life, max(pb) OVER w AS budness FROM (SELECT pr.*, b.pb FROM pr LEFT JOIN (SELECT series, tp, bud AS label, max(p) AS pb FROM pp GROUP BY ALL) b USING (series, tp, label)) WINDOW w AS (PARTITION BY series, label ORDER BY tp ROWS UNBOUNDED PRECEDING)),
la AS (SELECT li.series, li.tp, li.label, sc.mother, arg_max(sc.ba, sc.tp) AS ba FROM li JOIN sc ON sc.series = li.series AND sc.bud = li.label AND sc.tp <= li.tp WHERE life >= 3 AND budness > 0.5 GROUP BY ALL),
be AS (SELECT series, tp, label, mother FROM la WHERE ba > 0 QUALIFY row_number() OVER (PARTITION BY series, tp, label ORDER BY ba DESC, mother) = 1)
SELECT li.series, li.tp, li.label, coalesce(be.mother, 0) AS mother FROM li LEFT JOIN be USING (series, tp, label)""")
def mother_assign(spark, d):
    return track.assign_mothers(*_lineage_inputs(spark, d))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS daughter, c_custkey // 3 AS mother FROM customer WHERE c_custkey // 3 > 0), t AS (SELECT c_custkey AS root, c_custkey AS label, 0 AS generation FROM customer WHERE c_custkey // 3 = 0 UNION ALL SELECT t.root, e.daughter, generation + 1 FROM t JOIN e ON e.mother = t.label) SELECT * FROM t""")
def lineage_descendants(spark, d):
    c = views.table(spark, d, "customer").select("c_custkey")
    edges_ = c.select(F.col("c_custkey").alias("daughter"), F.expr("c_custkey div 3").alias("mother")).filter("mother > 0")
    return track.descendants(edges_, c.filter("c_custkey div 3 = 0").select(F.col("c_custkey").alias("label")))


_SLOPE = "sl AS (SELECT *, CASE WHEN count(vol) OVER w >= 3 THEN regr_slope(vol, tp) OVER w END AS gr FROM vo WINDOW w AS (PARTITION BY series ORDER BY tp ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"


@query(f"{with_views('vo')}, {_SLOPE} SELECT series, tp, vol, round(gr, 4) AS gr FROM sl")
def growth_slope(spark, d):
    return growth.local_slope(views.volumes(spark, d)).select("series", "tp", "vol", F.round("gr", 4).alias("gr"))


@query()
def growth_gp(spark, d):
    return growth.gp_growth(views.volumes(spark, d)).select("series", "tp", r6("svol").alias("svol"), r6("gr").alias("gr"), r6("gr_std").alias("gr_std"))


def _rates(spark, d):
    v = views.volumes(spark, d)
    bounds = v.groupBy("series").agg(F.min("tp").alias("start"), F.max("tp").alias("end"))
    mother = v.select((F.col("series") - 1).alias("series"), "tp", F.round(F.col("vol") / 100, 4).alias("m_gr"))
    return v.select("series", "tp", F.round(F.col("vol") / 100, 4).alias("d_gr")).join(mother, ["series", "tp"]).join(bounds, "series")


_RATE = "b AS (SELECT series, min(tp) AS s, max(tp) AS e FROM vo GROUP BY 1), j AS (SELECT x.series, x.tp, s, e, round(x.vol / 100, 4) AS d, round(y.vol / 100, 4) AS m FROM vo x JOIN vo y ON y.series = x.series + 1 AND y.tp = x.tp JOIN b ON b.series = x.series WHERE x.tp >= s + 2 AND x.tp < e - 2)"


@query(f"{with_views('vo')}, {_RATE}, h AS (SELECT series, tp, t FROM j, (SELECT unnest(range(2, 16)) AS t) WHERE abs(d - m) <= t AND d >= t) SELECT series, min({{'t': t, 'tp': tp}}).tp AS birth, min(t)::INT AS tolerance FROM h GROUP BY 1")
def birth_crossing(spark, d):
    return growth.crossing(_rates(spark, d), F.col("d_gr") - F.col("m_gr"))


@query(f"{with_views('vo')}, {_RATE}, h AS (SELECT series, tp, t FROM j, (SELECT unnest(range(2, 16)) AS t) WHERE sqrt(1 + d * d / 100 + (d - m) ** 2) <= t AND d >= t) SELECT series, min({{'t': t, 'tp': tp}}).tp AS birth, min(t)::INT AS tolerance FROM h GROUP BY 1")
def birth_crossing_noisy(spark, d):
    p = _rates(spark, d)
    return growth.crossing(p, F.sqrt(1 + F.col("d_gr") * F.col("d_gr") / 100 + F.pow(F.col("d_gr") - F.col("m_gr"), 2)))


@query("""WITH f AS (SELECT c_nationkey AS series, c_custkey AS label, c_custkey // 7 AS mother, (c_custkey % 40)::INT AS start FROM customer WHERE c_custkey // 7 > 0), l AS (SELECT series, max(start) + 5 AS last FROM f GROUP BY 1)
SELECT f.series, mother, label, start, coalesce(lead(start) OVER (PARTITION BY f.series, mother ORDER BY label), last + 1)::INT AS "end" FROM f JOIN l ON f.series = l.series""")
def bud_window(spark, d):
    c = views.table(spark, d, "customer")
    lin = c.select(F.col("c_nationkey").alias("series"), F.col("c_custkey").alias("label"), F.expr("c_custkey div 7").alias("mother"), (F.col("c_custkey") % 40).cast("int").alias("tp")).filter("mother > 0")
    return track.bud_windows(lin, lin.groupBy("series").agg((F.max("tp") + 5).alias("last_tp")))


@query(f"""{with_views('vo')}, b AS (SELECT (series - 1) // 2 AS series, min(tp) AS birth, series AS daughter FROM vo WHERE series > 0 GROUP BY 3),
k AS (SELECT vo.series, vo.tp, (SELECT count(*) FROM b WHERE b.series = vo.series AND b.birth <= vo.tp) AS k, (SELECT max({{'birth': b.birth, 'd': b.daughter}}).d FROM b WHERE b.series = vo.series AND b.birth <= vo.tp) AS dd FROM vo)
SELECT k.series, k.tp, CASE WHEN k > 0 AND NOT EXISTS (SELECT 1 FROM vo v WHERE v.series = dd AND v.tp = k.tp) THEN k - 1 ELSE k END::INT AS segment FROM k""")
def split_at_birth(spark, d):
    v = views.volumes(spark, d)
    births = v.filter("series > 0").groupBy(F.col("series").alias("daughter")).agg(F.min("tp").alias("birth")).withColumn("series", F.expr("(daughter - 1) div 2"))
    return growth.split_at_births(v.select("series", "tp"), births.select("series", "birth", "daughter"), v.select(F.col("series").alias("daughter"), "tp"))


_LAB = "s AS (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY tp) AS step FROM tr), l AS (SELECT series, step, min(cell) AS pos, floor(abs(x) / 20)::INT AS label FROM s GROUP BY ALL)"


@query(f"{with_views('tr')}, {_LAB} SELECT a.series, a.step, a.label, a.pos, coalesce(b.pos, -1) AS prev FROM l a LEFT JOIN l b ON a.series = b.series AND a.step = b.step + 1 AND a.label = b.label")
def link_truth(spark, d):
    return evaluate.link_index(_labels(spark, d, 20)).select("series", "step", "label", "pos", "prev")


def _labels(spark, d, width: int):
    t = track.with_steps(views.tracks(spark, d))
    return t.groupBy("series", "step", F.floor(F.abs("x") / width).cast("int").alias("label")).agg(F.min("cell").alias("pos"))


_LAB2 = "s AS (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY tp) AS step FROM tr), l AS (SELECT series, step, min(cell) AS pos, floor(abs(x) / 20)::INT AS label FROM s GROUP BY ALL), m AS (SELECT series, step, min(cell) AS pos, floor(abs(x) / 30)::INT AS label FROM s GROUP BY ALL), li AS (SELECT a.series, a.step, a.pos, coalesce(b.pos, -1) AS prev FROM l a LEFT JOIN l b ON a.series = b.series AND a.step = b.step + 1 AND a.label = b.label), mi AS (SELECT a.series, a.step, a.pos, coalesce(b.pos, -1) AS prev FROM m a LEFT JOIN m b ON a.series = b.series AND a.step = b.step + 1 AND a.label = b.label)"


@query(f"{with_views('tr')}, {_LAB2} SELECT series, round(avg((li.prev = mi.prev)::INT), 6) AS accuracy, count(*) FILTER (li.prev <> mi.prev) AS wrong FROM li JOIN mi USING (series, step, pos) GROUP BY 1")
def link_accuracy(spark, d):
    return evaluate.link_accuracy(_labels(spark, d, 20), _labels(spark, d, 30)).select("series", r6("accuracy").alias("accuracy"), "wrong")


@query(f"{with_views('tr')}, {_LAB2}, x AS (SELECT series, step, prev, pos FROM li WHERE prev >= 0), y AS (SELECT series, step, prev, pos FROM mi WHERE prev >= 0), z AS ((SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL (SELECT * FROM y EXCEPT ALL SELECT * FROM x)) SELECT series, count(*) AS differing FROM z GROUP BY 1")
def adjacency_diff(spark, d):
    return evaluate.adjacency_difference(_labels(spark, d, 20), _labels(spark, d, 30))


@query(f"""{with_views('vo')}, i AS (SELECT series, tp, tp - row_number() OVER (PARTITION BY series ORDER BY tp) AS i FROM vo), g AS (SELECT series, i, min(tp) AS start, count(*) - 1 AS n FROM i GROUP BY 1, 2 HAVING count(*) - 1 >= 4)
SELECT series, start, n FROM g QUALIFY row_number() OVER (PARTITION BY series ORDER BY n DESC, start) = 1""")
def consecutive_runs(spark, d):
    return evaluate.longest_runs(views.volumes(spark, d), ["series"], "tp")


@query(f"""{with_views('tr')}, k AS (SELECT series, kind, count(*) AS n FROM tr GROUP BY 1, 2) SELECT kind, least(floor(n / 5.0), 25)::INT AS bin, count(*) AS n FROM k WHERE n BETWEEN 0 AND 130 GROUP BY 1, 2""")
def count_histogram(spark, d):
    k = views.tracks(spark, d).groupBy("series", "kind").agg(F.count("*").alias("k"))
    return evaluate.histogram(k, "k", 0, 130, 26, ["kind"])


# -- sources as tables, samples, tuning -------------------------------------


@query("""WITH f AS (SELECT '/img/' || (page_id // 3) AS prefix, CASE page_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS kind, '/img/' || (page_id // 3) || '_' || CASE page_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'b' ELSE 'other' END || '.png' AS path FROM pages)
SELECT prefix, max(path) FILTER (kind = 'a') AS a, max(path) FILTER (kind = 'b') AS b FROM f GROUP BY 1 HAVING count(*) FILTER (kind = 'a') = 1 AND count(*) FILTER (kind = 'b') = 1""")
def pair_images(spark, d):
    """Files named after pages; two of three kinds make a pair."""
    k = F.col("page_id")
    side = F.when(k % 3 == 0, "A").when(k % 3 == 1, "b").otherwise("other")
    files = views.table(spark, d, "pages").select(F.concat(F.lit("/img/"), F.floor(k / 3).cast("string"), F.lit("_"), side, F.lit(".png")).alias("path"))
    return images.pair_files(files, ["a", "b"], strict=False)


@query("""SELECT doc_id::VARCHAR AS prefix, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def new_pairs(spark, d):
    found = views.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("prefix"), "source")
    return images.new_pairs(found, views.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("prefix")))


@query("""WITH g AS (SELECT DISTINCT source, lang FROM documents), k AS (SELECT *, row_number() OVER (ORDER BY md5('1:' || source || ':' || lang), source, lang) AS k, count(*) OVER () AS n FROM g)
SELECT doc_id, d.source, d.lang, CASE WHEN k <= floor(n * (1 - 0.2 - 0.2)) THEN 'train' WHEN k <= floor(n * (1 - 0.2)) THEN 'validation' ELSE 'test' END AS split FROM documents d JOIN k USING (source, lang)""")
def group_split(spark, d):
    return sample.group_split(views.table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"]).select("doc_id", "source", "lang", "split")


@query("""SELECT p_partkey, unnest(range(1, (greatest(p_size // 10, 1) * greatest(length(p_name) // 8, 1))::INT + 1))::INT AS draw FROM part""")
def balanced_repeat(spark, d):
    p = views.table(spark, d, "part")
    return sample.balanced_repeat(p.select("p_partkey", "p_size", "p_name"), F.col("p_size"), F.length("p_name"), 10, 8).select("p_partkey", "draw")


@query("""SELECT doc_id, source FROM documents QUALIFY (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 3 = 0""")
def systematic_sample(spark, d):
    return sample.every_kth(views.table(spark, d, "documents").select("doc_id", "source"), 0.3, ["source"], ["doc_id"])


@query(f"""WITH b AS (SELECT doc_id, n_chars, b AS boot, ('0x' || substr(md5('7:' || b || ':' || doc_id), 1, 7))::BIGINT AS u FROM documents, range(1, 11) t(b)), c AS (SELECT *, {" + ".join(f"(u >= {cut})::INT" for cut in sample.poisson_cuts(0.9, 1 << 28))} AS copies FROM b), m AS (SELECT boot, sum(copies * n_chars) / sum(copies) AS m FROM c WHERE copies > 0 GROUP BY 1)
SELECT 'n_chars' AS name, round(avg(m), 4) AS mean, round(stddev_pop(m) / sqrt(count(m)), 4) AS se FROM m""")
def bootstrap_score(spark, d):
    b = sample.bootstrap(views.table(spark, d, "documents").select("doc_id", "n_chars"), 10, 7, "doc_id")
    m = b.groupBy("boot").agg((F.sum(F.col("copies") * F.col("n_chars")) / F.sum("copies")).alias("m")).withColumn("name", F.lit("n_chars"))
    return sample.standard_error(m, "name", "m").select("name", F.round("mean", 4).alias("mean"), F.round("se", 4).alias("se"))


def _stats(spark, d):
    """Objects as predictions against the mirrored objects as truth."""
    q = views.quadrants(spark, d)
    flipped = q.select("frame_id", "cell", F.col("c").alias("r"), F.col("r").alias("c"))
    p = match.intersections(q, flipped, ["r", "c"]).withColumn("iou", match.iou())
    best = p.groupBy("frame_id", "ta").agg(F.max(F.struct("iou", (-F.col("tb")).alias("m"))).alias("b"))
    score = objects.mean_over(q, views.pixels(spark, d), name="p_edge")
    inside = match.intersections(q, q, ["r", "c"]).filter("ta <> tb").withColumn("containment", match.containment()).groupBy("frame_id", F.col("ta").alias("cell")).agg(F.max("containment").alias("containment"))
    cells = objects.areas(q).join(score, ["frame_id", "cell"]).join(inside, ["frame_id", "cell"], "left").fillna(0.0, ["containment"])
    cells = cells.join(best.select("frame_id", F.col("ta").alias("cell"), F.col("b.iou").alias("iou"), (-F.col("b.m")).alias("assignment")), ["frame_id", "cell"], "left").fillna(0.0, ["iou"])
    return cells.withColumnRenamed("frame_id", "example").withColumn("p_edge", F.round("p_edge", 9))


_STAT = """p AS (SELECT a.frame_id, a.cell AS ta, b.cell AS tb, count(*) AS n FROM qd a JOIN qd b ON a.frame_id = b.frame_id AND a.r = b.c AND a.c = b.r GROUP BY 1, 2, 3), s AS (SELECT frame_id, cell, count(*) AS area FROM qd GROUP BY 1, 2),
j AS (SELECT p.frame_id, ta, tb, n / (x.area + y.area - n) AS iou FROM p JOIN s x ON x.frame_id = p.frame_id AND x.cell = ta JOIN s y ON y.frame_id = p.frame_id AND y.cell = tb),
b AS (SELECT frame_id, ta AS cell, iou, tb AS assignment FROM j QUALIFY row_number() OVER (PARTITION BY frame_id, ta ORDER BY iou DESC, tb) = 1),
e AS (SELECT frame_id, cell, round(avg(v), 9) AS p_edge FROM qd JOIN px USING (frame_id, r, c) GROUP BY 1, 2),
o AS (SELECT a.frame_id, a.cell, b.cell AS other, count(*) AS n FROM qd a JOIN qd b ON a.frame_id = b.frame_id AND a.r = b.r AND a.c = b.c AND a.cell <> b.cell GROUP BY 1, 2, 3),
k AS (SELECT o.frame_id, o.cell, max(greatest(n / x.area, n / y.area)) AS containment FROM o JOIN s x ON x.frame_id = o.frame_id AND x.cell = o.cell JOIN s y ON y.frame_id = o.frame_id AND y.cell = o.other GROUP BY 1, 2),
t AS (SELECT s.frame_id AS example, s.cell, area, p_edge, coalesce(containment, 0) AS containment, coalesce(iou, 0) AS iou, assignment FROM s JOIN e USING (frame_id, cell) LEFT JOIN k USING (frame_id, cell) LEFT JOIN b USING (frame_id, cell)),
g AS (SELECT row_number() OVER (ORDER BY lower, upper, pe, mc) - 1 AS param, * FROM (VALUES (3.0), (6.0)) a(lower), (VALUES (15.0), (25.0)) b(upper), (VALUES (0.08), (0.1)) c(pe), (VALUES (0.2), (0.5)) d(mc)),
f AS (SELECT g.param, t.* FROM t JOIN g ON area BETWEEN lower AND upper AND p_edge >= pe AND containment <= mc),
h AS (SELECT param, example, assignment, max(iou) AS best FROM f WHERE iou >= 0.5 GROUP BY ALL),
u AS (SELECT g.param::INT AS param, coalesce(a.n, 0) AS n, coalesce(c.tp, 0) AS tp, c.m FROM g LEFT JOIN (SELECT param, count(*) AS n FROM f GROUP BY 1) a USING (param) LEFT JOIN (SELECT param, count(*) AS tp, avg(best) AS m FROM h GROUP BY 1) c USING (param)),
z AS (SELECT *, tp / nullif(n, 0) AS pr, tp / 1000.0 AS re FROM u)"""


def _grid(spark):
    return tune.grid(spark, lower=[3, 6], upper=[15, 25], p_edge_min=[0.08, 0.1], max_containment=[0.2, 0.5])


@query(f"{with_views('qd')}, {_STAT} SELECT param, n, tp, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / nullif(pr + re, 0), 6) AS f1, round(m, 6) AS mean_iou FROM z")
def filter_trials(spark, d):
    s = evaluate.trial_scores(_stats(spark, d), _grid(spark), 1000)
    return s.select("param", "n", "tp", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), r6("mean_iou").alias("mean_iou"))


@query(f"{with_views('qd')}, {_STAT} SELECT param, round(2 * pr * re / nullif(pr + re, 0), 6) AS f1 FROM z ORDER BY f1 DESC NULLS LAST, param LIMIT 1")
def best_trial(spark, d):
    return evaluate.best_params(evaluate.trial_scores(_stats(spark, d), _grid(spark), 1000)).select("param", r6("f1").alias("f1"))


_BOOT = f"""ex AS (SELECT frame_id AS example, count(DISTINCT cell) AS truths FROM qd GROUP BY 1), bu AS (SELECT ex.*, b AS boot, ('0x' || substr(md5('5:' || b || ':' || example), 1, 7))::BIGINT AS u FROM ex, range(1, 7) y(b)),
bd AS (SELECT example, truths, boot, copies FROM (SELECT *, {" + ".join(f"(u >= {cut})::INT" for cut in sample.poisson_cuts(0.9, 1 << 28))} AS copies FROM bu) WHERE copies > 0), ow AS (SELECT boot, sum(copies * truths) AS owed FROM bd GROUP BY 1),
fe AS (SELECT param, example, count(*) AS n FROM f GROUP BY 1, 2), he AS (SELECT param, example, count(*) AS tp, sum(best) AS iou FROM h GROUP BY 1, 2),
gt AS (SELECT param, boot, sum(copies * n) AS n, coalesce(sum(copies * tp), 0) AS tp, sum(copies * iou) AS iou FROM fe LEFT JOIN he USING (param, example) JOIN bd USING (example) GROUP BY 1, 2),
sc AS (SELECT g.param::INT AS param, coalesce(tp / nullif(n, 0), 0) AS pr, coalesce(tp, 0) / owed AS re, iou / nullif(tp, 0) AS mi FROM g CROSS JOIN ow LEFT JOIN gt ON gt.param = g.param AND gt.boot = ow.boot), sf AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM sc)"""


@query(f"{with_views('qd')}, {_STAT}, {_BOOT} SELECT param, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(mi), 6) AS mean_iou, round(stddev_pop(f1) / sqrt(count(*)), 6) AS f1_se FROM sf GROUP BY 1")
def bootstrap_trials(spark, d):
    """Filter trials over resamples of the frames."""
    truths = views.quadrants(spark, d).groupBy(F.col("frame_id").alias("example")).agg(F.countDistinct("cell").alias("truths"))
    s = evaluate.bootstrap_trials(_stats(spark, d), _grid(spark), truths, 6, 5)
    return s.select("param", *[r6(x).alias(x) for x in ("precision", "recall", "f1", "mean_iou", "f1_se")])


def _walk(axes: list[tuple[str, str]]) -> str:
    """Steps w0, w1, ... of a search by one axis after the other, each from the best so far."""
    names, out = ("lower", "upper", "p_edge_min", "max_containment"), []
    for k, (axis, values) in enumerate(axes):
        trial = ", ".join("v AS " + x if x == axis else x for x in names)
        out.append(f"a{k} AS (SELECT i, {trial} FROM w{k}, (VALUES {values}) x(i, v))")
        out.append(f"n{k} AS (SELECT i, {', '.join('a.' + x for x in names)}, count(t.cell) AS n, count(DISTINCT CASE WHEN iou >= 0.5 THEN {{'e': example, 'a': assignment}} END) AS tp FROM a{k} a LEFT JOIN t ON area BETWEEN lower AND upper AND t.p_edge >= p_edge_min AND t.containment <= max_containment GROUP BY ALL)")
        out.append(f"m{k} AS (SELECT *, coalesce(2 * (tp / nullif(n, 0)) * (tp / 1000) / nullif(tp / nullif(n, 0) + tp / 1000, 0), -1) AS f FROM n{k} ORDER BY f DESC, i LIMIT 1)")
        out.append(f"w{k + 1} AS (SELECT {', '.join(f'CASE WHEN f > top THEN m.{x} ELSE w.{x} END AS {x}' for x in names)}, greatest(f, top) AS top FROM w{k} w, m{k} m)")
    return ", ".join(out)


_AXES = [("lower", "(0, 1.0), (1, 3.0), (2, 6.0), (3, 9.0)"), ("p_edge_min", "(0, 0.0), (1, 0.08), (2, 0.1)"), ("max_containment", "(0, 0.2), (1, 0.5), (2, 1.0)")]
_OBJECTS = _STAT[: _STAT.index(",\ng AS")].replace("t AS (SELECT s.frame_id", "t AS MATERIALIZED (SELECT s.frame_id")


@query(f"""{with_views('qd')}, {_OBJECTS}, w0 AS (SELECT 1.0::DOUBLE AS lower, 25.0::DOUBLE AS upper, 0.0::DOUBLE AS p_edge_min, 1.0::DOUBLE AS max_containment, -1.0::DOUBLE AS top), {_walk(_AXES * 2)}
SELECT lower, upper, p_edge_min, max_containment, round(top, 6) AS f1 FROM w6""")
def coord_search(spark, d):
    stats = _stats(spark, d)
    best, top = tune.coordinate_search(stats, 1000, {"lower": [1, 3, 6, 9], "p_edge_min": [0.0, 0.08, 0.1], "max_containment": [0.2, 0.5, 1.0]}, {"lower": 1.0, "upper": 25.0, "p_edge_min": 0.0, "max_containment": 1.0}, rounds=2)
    return spark.createDataFrame([(*[float(best[k]) for k in ("lower", "upper", "p_edge_min", "max_containment")], round(float(top), 6))], "lower double, upper double, p_edge_min double, max_containment double, f1 double")


@query(f"""{with_views('st')}, n AS (SELECT a.obj AS ta, b.obj AS tb, count(*) AS n FROM st a JOIN st b ON a.px = b.px AND a.obj < b.obj GROUP BY 1, 2), s AS (SELECT obj, count(*) AS area FROM st GROUP BY 1),
p AS (SELECT least(x.area, y.area) AS lo, greatest(x.area, y.area) AS hi, n / least(x.area, y.area) AS frac FROM n JOIN s x ON ta = x.obj JOIN s y ON tb = y.obj)
SELECT t::DOUBLE AS t, round(sum(CASE WHEN hi < t + 5 OR lo >= t - 5 THEN frac ELSE 0 END), 6) AS cost FROM p, range(400, 800, 20) g(t) GROUP BY 1""")
def threshold_split_search(spark, d):
    s = views.sets(spark, d).select(F.col("obj").alias("cell"), "px")
    return tune.overlap_threshold(tune.size_overlaps(s, ["px"]), spark.range(400, 800, 20).select(F.col("id").cast("double").alias("t")), 5)


@query(f"""{with_views('mk')}, e1 AS ({_ERODE.format('mk')}), e2 AS ({_ERODE.format('e1')}), f AS (SELECT DISTINCT frame_id FROM mk),
n AS (SELECT 0 AS e, frame_id, count(*) AS n FROM mk GROUP BY 2 UNION ALL SELECT 1, f.frame_id, count(e1.r) FROM f LEFT JOIN e1 USING (frame_id) GROUP BY 2 UNION ALL SELECT 2, f.frame_id, count(e2.r) FROM f LEFT JOIN e2 USING (frame_id) GROUP BY 2)
SELECT e, min(n) AS least, quantile_cont(n, 0.5)::DOUBLE AS median, min(n) >= 1 AS keeps FROM n GROUP BY 1""")
def erosion_level(spark, d):
    m = views.masks(spark, d)
    every = m.select("frame_id").distinct()
    sizes, level = None, m
    for e in range(3):
        level = level if e == 0 else morph.erode(level)
        n = every.join(level.groupBy("frame_id").agg(F.count("*").alias("n")), "frame_id", "left").select(F.lit(e).alias("e"), F.col("frame_id").alias("cell"), F.coalesce("n", F.lit(0)).alias("n"))
        sizes = n if sizes is None else sizes.union(n)
    return tune.erosion_level(sizes)



@query("""SELECT user_id AS series, date_trunc('day', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def activity_windows(spark, d):
    e = views.table(spark, d, "events").withColumn("series", F.col("user_id"))
    return live.activity(e).select("series", "start", "n", r6("mean").alias("mean"))


@query("""WITH e AS (SELECT user_id AS series, ts, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) >= 6 * 3600 * 1000000::BIGINT, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT series, ts, sum(fresh) OVER (PARTITION BY series ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM e)
SELECT series, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM g GROUP BY series, g""")
def activity_sessions(spark, d):
    return live.sessions(views.table(spark, d, "events").withColumn("series", F.col("user_id")))


def _link_rows(spark, d):
    """Events of one user on consecutive days; the same kind of event is the same object."""
    rows = learn.link_rows(views.tracks(spark, d).withColumnRenamed("kind", "label"))
    u = F.conv(F.substring(sample.draw(3, F.col("series"), F.col("tp")), 1, 2), 16, 10).cast("int")
    return rows.withColumn("gap", track.pair_distance()).withColumn("split", F.when(u < 154, "train").when(u < 205, "validation").otherwise("test"))


@query()
def link_classifier(spark, d):
    names = ["d_x", "d_y", "gap"]
    rows = stored(_link_rows(spark, d).select("split", "same", *names))  # the fit reads them many times
    model = learn.forest(names, "same", 10, 4).fit(learn.with_balance(rows.filter("split = 'train'"), "same"))
    return learn.performance(learn.probabilities(model, rows, names), "same").select("split", "tp", "fp", "fn", "tn", r6("balanced").alias("balanced"))


from . import queries_cells, queries_scale, queries_sql, queries_tables  # noqa: E402, F401  (they register their own)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
