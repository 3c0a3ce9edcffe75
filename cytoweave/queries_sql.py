"""Queries that are SQL text over registered views and table functions, legacy targets, and section choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import generators, surface
from .operators import augment, norm, objects
from .registry import query, r6
from .sources import views
from .sources.views import with_views

H = W = views.SIDE
_CROSS = "(VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)) o(dr,dc)"
_SQUARE = "(VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) o(dr,dc)"


@query(f"""{with_views('qd')}, p AS (SELECT a.frame_id, a.cell AS ta, b.cell AS tb, count(*) AS n FROM qd a JOIN qd b ON a.frame_id = b.frame_id AND a.r = b.r AND a.c = b.c AND a.cell < b.cell GROUP BY 1, 2, 3), s AS (SELECT frame_id, cell, count(*) AS area FROM qd GROUP BY 1, 2)
SELECT p.frame_id, ta, tb, round(n / (x.area + y.area - n), 6) AS iou, round(greatest(n / x.area, n / y.area), 6) AS containment FROM p JOIN s x ON x.frame_id = p.frame_id AND x.cell = ta JOIN s y ON y.frame_id = p.frame_id AND y.cell = tb WHERE n / (x.area + y.area - n) > 0.1""")
def sql_overlaps(spark, d):
    """SQL text only: overlaps of a frame's objects by the registered functions."""
    surface.register(spark, d)
    return spark.sql("SELECT frame_id, ta, tb, round(iou(n, area_a, area_b), 6) AS iou, round(containment(n, area_a, area_b), 6) AS containment FROM cw_overlaps WHERE iou(n, area_a, area_b) > 0.1")


@query(f"""{with_views('mk')}, l AS (SELECT frame_id, r, c, r * 8 + c AS id FROM mk UNION SELECT m.frame_id, m.r, m.c, l.id FROM l JOIN mk m ON m.frame_id = l.frame_id AND abs(m.r - l.r) <= 1 AND abs(m.c - l.c) <= 1 AND l.id < m.r * 8 + m.c), m AS (SELECT frame_id, r, c, min(id) AS id FROM l GROUP BY ALL),
cp AS (SELECT frame_id, r, c, (dense_rank() OVER (PARTITION BY frame_id ORDER BY id))::INT AS cell FROM m) SELECT frame_id, cell, count(*) AS area, round(avg(r), 6) AS y, round(avg(c), 6) AS x FROM cp GROUP BY 1, 2""")
def sql_masks_of(spark, d):
    """SQL text only: a table function makes each frame's objects."""
    generators.register(spark)
    views.table(spark, d, "embeddings").createOrReplaceTempView("cw_embeddings")
    return spark.sql("SELECT vec_id AS frame_id, m.cell, count(*) AS area, round(avg(m.r), 6) AS y, round(avg(m.c), 6) AS x FROM cw_embeddings e, LATERAL masks_of(e.embedding, 8, 0.05D) m GROUP BY 1, 2")


_CANDIDATES = "s AS (SELECT unnest(range(88, 257, 8)) AS s)"


@query(f"""WITH f AS (SELECT DISTINCT o_orderkey AS frame_id, (64 + o_orderkey % 700)::INT AS h, (64 + o_custkey % 900)::INT AS w FROM orders), {_CANDIDATES},
a AS (SELECT frame_id, h, w, s, greatest(ceil((h - 48) / (s - 48)::DOUBLE), 1)::INT AS nh, greatest(ceil((w - 48) / (s - 48)::DOUBLE), 1)::INT AS nw FROM f, s),
p AS (SELECT frame_id, h, w, min({{'c': (nh * (s - 48) + 48 - h)::DOUBLE / nh, 's': s, 'n': nh}}) AS bh, min({{'c': (nw * (s - 48) + 48 - w)::DOUBLE / nw, 's': s, 'n': nw}}) AS bw FROM a GROUP BY ALL),
k AS (SELECT frame_id, h > 256 OR w > 256 AS cut, h, w, bh, bw FROM p)
SELECT frame_id, CASE WHEN cut THEN bh.n * bw.n ELSE 1 END::BIGINT AS tiles, CASE WHEN cut THEN (bh.n - 1) * (bh.s - 48) + bh.s ELSE h END::INT AS height, CASE WHEN cut THEN (bw.n - 1) * (bw.s - 48) + bw.s ELSE w END::INT AS width FROM k""")
def sql_tiles_of(spark, d):
    """SQL text only: tiles of each image and how far they reach."""
    generators.register(spark)
    views.table(spark, d, "orders").createOrReplaceTempView("cw_orders")
    return spark.sql("""SELECT frame_id, count(*) AS tiles, max(t.r0 + t.height) AS height, max(t.c0 + t.width) AS width
        FROM (SELECT DISTINCT o_orderkey AS frame_id, cast(64 + o_orderkey % 700 AS int) AS h, cast(64 + o_custkey % 900 AS int) AS w FROM cw_orders) f, LATERAL tiles_of(f.h, f.w) t GROUP BY frame_id""")


@query(f"""{with_views('px')}, q AS (SELECT frame_id, quantile_disc(v, [0.02, 0.5, 0.98]) AS q FROM px GROUP BY 1)
SELECT frame_id, r, c, round(coalesce((v - q[2]) * 0.96 / nullif(q[3] - q[1], 0), 0), 6) AS v FROM px JOIN q USING (frame_id)""")
def norm_approximate(spark, d):
    """Robust norm by approximate quantiles, which are values of the frame."""
    return norm.robust_norm(views.pixels(spark, d), approximate=True).select("frame_id", "r", "c", r6("v").alias("v"))


_LEGACY = f"""gr AS (SELECT x.k AS r, y.k AS c FROM (SELECT unnest(range(0, 8))::INT AS k) x, (SELECT unnest(range(0, 8))::INT AS k) y),
ed AS (SELECT DISTINCT frame_id, cell, r, c FROM (SELECT m.*, r + dr AS nr, c + dc AS nc FROM qd m, {_SQUARE}) n WHERE nr BETWEEN 0 AND 7 AND nc BETWEEN 0 AND 7 AND NOT EXISTS (SELECT 1 FROM qd m WHERE m.frame_id = n.frame_id AND m.cell = n.cell AND m.r = nr AND m.c = nc)),
f AS (SELECT frame_id, cell, count(*) AS area, avg(r) AS y, avg(c) AS x, var_pop(r) + 1/12 AS vr, var_pop(c) + 1/12 AS vc, covar_pop(r, c) AS rc FROM qd GROUP BY 1, 2),
g AS (SELECT *, 4 * sqrt(greatest((vr + vc) / 2 - sqrt(((vr - vc) / 2) ** 2 + rc ** 2), 0)) AS minor FROM f),
pr AS (SELECT m.frame_id, m.cell AS mother, d.cell AS bud, m.area AS ma, d.area AS da, m.y AS my, m.x AS mx, d.y - m.y AS hr, d.x - m.x AS hc, d.minor * 0.25 AS wide FROM g m JOIN g d ON m.frame_id = d.frame_id AND (m.cell, d.cell) IN ((1, 2), (3, 4))),
pw AS (SELECT *, sqrt(hr * hr + hc * hc) AS len FROM pr), p2 AS (SELECT *, -wide * hc / len AS wr, wide * hr / len AS wc FROM pw WHERE len > 0),
st AS (SELECT p.frame_id, mother, bud, gr.r, gr.c FROM p2 p, gr WHERE round((gr.r - (my - wr / 2)) * hr + (gr.c - (mx - wc / 2)) * hc, 9) BETWEEN 0 AND round(len * len, 9) AND round((gr.r - (my - wr / 2)) * wr + (gr.c - (mx - wc / 2)) * wc, 9) BETWEEN 0 AND round(wr * wr + wc * wc, 9)),
bj AS (SELECT DISTINCT st.frame_id, st.mother AS cell, st.r, st.c FROM st JOIN ed ON ed.frame_id = st.frame_id AND ed.r = st.r AND ed.c = st.c AND ed.cell IN (mother, bud)),
b1 AS (SELECT DISTINCT frame_id, cell, r + dr AS r, c + dc AS c FROM bj, {_CROSS} WHERE r + dr BETWEEN 0 AND 7 AND c + dc BETWEEN 0 AND 7),
b2 AS (SELECT frame_id, cell, r + dr AS r, c + dc AS c FROM b1, {_CROSS} GROUP BY ALL HAVING count(*) = 5),
b3 AS (SELECT DISTINCT frame_id, r + dr AS r, c + dc AS c FROM b2, {_CROSS} WHERE r + dr BETWEEN 0 AND 7 AND c + dc BETWEEN 0 AND 7),
n AS (SELECT frame_id, r, c, count(*) AS n FROM qd GROUP BY ALL), ef AS (SELECT DISTINCT frame_id, r, c FROM ed)"""


@query(f"""{with_views('qd')}, {_LEGACY} SELECT 'edge' AS target, * FROM ef UNION ALL SELECT 'filled', frame_id, r, c FROM n UNION ALL SELECT 'interior', n.frame_id, n.r, n.c FROM n ANTI JOIN ef ON ef.frame_id = n.frame_id AND ef.r = n.r AND ef.c = n.c WHERE n = 1
UNION ALL SELECT 'overlap', frame_id, r, c FROM n WHERE n > 1 UNION ALL SELECT 'budring', * FROM b3 UNION ALL SELECT DISTINCT 'bud', qd.frame_id, r, c FROM qd JOIN pr ON pr.frame_id = qd.frame_id AND pr.bud = qd.cell WHERE da / ma < 0.7""")
def legacy_targets(spark, d):
    """Six channels of each frame; 1 and 3 are the mothers of 2 and 4."""
    q = views.quadrants(spark, d)
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "mother int, bud int")
    cells = q.select("frame_id", "cell").distinct()
    both = cells.withColumnRenamed("cell", "mother").join(F.broadcast(pairs), "mother").join(cells.withColumnRenamed("cell", "bud"), ["frame_id", "bud"])
    return objects.legacy_targets(q, both.select("frame_id", "mother", "bud"), H, W).select("target", "frame_id", "r", "c")


@query(f"""{with_views('px')}, b AS (SELECT unnest(range(1, 32)) AS m), z AS (SELECT m, list_filter(range(0, 5), lambda k: (m >> k) & 1 = 1) AS zs FROM b WHERE bit_count(m) = 3),
o AS (SELECT zs, (row_number() OVER (ORDER BY m) - 1)::INT AS i, count(*) OVER () AS n FROM z WHERE len(list_filter(range(1, 3), lambda k: zs[k + 1] - zs[k] > 2)) = 0),
k AS (SELECT frame_id, ('0x' || substr(md5('7:sections:' || frame_id), 1, 8))::BIGINT AS u FROM (SELECT DISTINCT frame_id FROM px)),
ch AS (SELECT frame_id, zs FROM k JOIN o ON i = u % n)
SELECT px.frame_id, (list_position(zs, r) - 1)::INT AS z, c, round(v, 6) AS v FROM px JOIN ch USING (frame_id) WHERE r < 5 AND list_contains(zs, r)""")
def augment_choose_sections(spark, d):
    """Three of five sections (rows of a frame), chosen for each frame."""
    px = views.pixels(spark, d).filter("r < 5").select("frame_id", F.lit(0).alias("r"), "c", F.col("r").alias("z"), "v")
    return augment.choose_sections(px, 5, 3, 7).select("frame_id", "z", "c", r6("v").alias("v"))
