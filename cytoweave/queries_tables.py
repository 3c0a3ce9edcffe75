"""Queries on catalogues, sets, splits, evaluation and tuning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import evaluate, growth, learn, match, morph, norm, objects, sample, sets, track, tune
from .registry import query, r6
from .sources import catalog, images, views
from .sources.views import with_views

H = W = views.SIDE


# -- catalogues -------------------------------------------------------------


@query("""WITH m AS (SELECT 'train' AS train_val, doc_id, source AS experiment, lang AS position FROM documents WHERE doc_id % 5 < 3 UNION ALL SELECT 'val', doc_id, source, lang FROM documents WHERE doc_id % 5 >= 3) SELECT * FROM m""")
def joined_metadata(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", F.col("source").alias("experiment"), F.col("lang").alias("position"))
    return catalog.joined_metadata({"train": docs.filter("doc_id % 5 < 3"), "val": docs.filter("doc_id % 5 >= 3")}, ("experiment", "position", "doc_id"))


@query("""WITH f AS (SELECT p_partkey, p_size % 5 AS z, 'img' || lpad((p_partkey // 5)::VARCHAR, 6, '0') || '.png' AS name FROM part WHERE p_size % 7 > 0)
SELECT '/data/Z' || z || '/' || name AS path, z::INT AS z, dense_rank() OVER (ORDER BY name)::INT AS tp FROM f""")
def section_table(spark, d):
    p = views.table(spark, d, "part")
    name = F.concat(F.lit("img"), F.lpad(F.expr("p_partkey div 5").cast("string"), 6, "0"), F.lit(".png"))
    folder = F.when(F.col("p_size") % 7 > 0, F.concat(F.lit("/data/Z"), (F.col("p_size") % 5).cast("string"), F.lit("/"))).otherwise("/data/other/")
    return catalog.section_table(p.select(F.concat(folder, name).alias("path")))


@query("""SELECT p_partkey::VARCHAR AS path, (p_size * 2)::INT AS height, p_size::INT AS width, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 4 + 1)::INT ELSE 1 END AS sections, CASE WHEN p_partkey % 2 = 0 THEN 0.25::DOUBLE END AS pixel_size, CASE WHEN p_partkey % 5 = 0 THEN p_size / 10.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM part""")
def size_probe(spark, d):
    """Catalogue entries whose info names some of the sizes."""
    k = F.col("p_partkey")
    entry = lambda name, cond, value: F.when(cond, F.map_from_arrays(F.array(F.lit(name)), F.array(value.cast("string")))).otherwise(F.expr("cast(map() as map<string,string>)"))
    info = F.map_concat(entry("sections", k % 3 == 0, k % 4 + 1), entry("pixel_size", k % 2 == 0, F.lit(0.25)), entry("weight", k % 5 == 0, F.col("p_size") / 10.0))
    meta = views.table(spark, d, "part").select(k.cast("string").alias("path"), (F.col("p_size") * 2).cast("int").alias("height"), F.col("p_size").cast("int").alias("width"), info.alias("info"))
    return catalog.size_probe(meta)


@query(f"""{with_views('px')} SELECT frame_id, 0 AS z, r, c, greatest((v * 100)::INT, 0) AS v FROM px""")
def raw_frames(spark, d):
    """Frames packed to column-major bytes and read back."""
    px = views.pixels(spark, d).select("frame_id", "r", "c", F.greatest(F.rint(F.col("v") * 100), F.lit(0.0)).cast("int").alias("v"))
    packed = px.groupBy("frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "v"))), lambda x: F.lpad(F.hex(x["v"]), 2, "0")), "").alias("h"))
    messages = packed.select(F.col("frame_id").alias("message"), F.unhex("h").alias("content"), F.lit(1).alias("n"), F.lit(W).alias("w"), F.lit(H).alias("h"), F.lit(1).alias("z"), F.lit(8).alias("bits"))
    got = images.frames_from_bytes(messages)
    return got.select(F.col("message").alias("frame_id"), "z", "r", "c", "v")


# -- sets and splits --------------------------------------------------------


@query(f"""{with_views('qd')}, a AS (SELECT DISTINCT frame_id, r, c FROM qd WHERE cell <= 2), b AS (SELECT DISTINCT frame_id, r, c FROM qd WHERE cell >= 2)
SELECT 'union' AS kind, * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersection', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'difference', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def mask_sets(spark, d):
    q = views.quadrants(spark, d)
    a, b = q.filter("cell <= 2"), q.filter("cell >= 2")
    out = lambda m, k: m.select(F.lit(k).alias("kind"), "frame_id", "r", "c")
    return out(sets.union(a, b), "union").union(out(sets.intersection(a, b), "intersection")).union(out(sets.difference(a, b), "difference"))


@query("""SELECT p_brand, list_sort(list_distinct(list(DISTINCT p_type) || list(DISTINCT p_container)))::VARCHAR AS features FROM (SELECT p_brand, substr(p_name, 1, 1) AS p_type, substr(p_name, 2, 1) AS p_container FROM part) GROUP BY 1""")
def feature_union(spark, d):
    p = views.table(spark, d, "part").groupBy("p_brand").agg(F.collect_set(F.substring("p_name", 1, 1)).alias("a"), F.collect_set(F.substring("p_name", 2, 1)).alias("b"))
    return p.select("p_brand", F.concat(F.lit("["), F.array_join(sets.feature_union(F.col("a"), F.col("b")), ", "), F.lit("]")).alias("features"))


@query("""WITH u AS (SELECT 'train' AS split, 0 AS k, doc_id, source FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT 'test', 1, doc_id, lang FROM documents WHERE doc_id % 3 > 0)
SELECT doc_id, source, split FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k, source, split) = 1""")
def concat_splits(spark, d):
    docs = views.table(spark, d, "documents")
    parts = {"train": docs.filter("doc_id % 3 < 2").select("doc_id", "source"), "test": docs.filter("doc_id % 3 > 0").select("doc_id", F.col("lang").alias("source"))}
    return sets.concat_splits(parts, ["doc_id"]).select("doc_id", "source", "split")


@query("""SELECT c_nationkey AS series, list(c_custkey ORDER BY c_custkey) FILTER (c_acctbal > 3000)::VARCHAR AS labels FROM customer GROUP BY 1""")
def drop_empty_labels(spark, d):
    c = views.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("series")).agg(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("k"), F.greatest(F.col("c_acctbal") - 3000, F.lit(0)).alias("n")))).alias("x"))
    kept = sets.drop_empty(F.transform("x", lambda s: s["k"]), F.transform("x", lambda s: s["n"]))
    return c.select("series", F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]"))).alias("labels"))


@query("""WITH g AS (SELECT DISTINCT source FROM documents), k AS (SELECT *, row_number() OVER (ORDER BY md5('3:' || source), source) AS k, count(*) OVER () AS n FROM g)
SELECT doc_id, d.source, CASE WHEN k <= floor(n * (1 - 0.0 - 0.25)) THEN 'train' WHEN k <= floor(n * (1 - 0.25)) THEN 'validation' ELSE 'test' END AS split FROM documents d JOIN k USING (source)""")
def two_way_split(spark, d):
    return sample.group_split(views.table(spark, d, "documents").select("doc_id", "source"), ["source"], 0.0, 0.25, 3).select("doc_id", "source", "split")


@query("""SELECT doc_id, coalesce(quality, 1)::DOUBLE AS weight FROM documents LEFT JOIN labels USING (doc_id)""")
def sample_weights(spark, d):
    rows = views.table(spark, d, "documents").select("doc_id").join(views.table(spark, d, "labels").select("doc_id", F.col("quality").alias("weight")), "doc_id", "left")
    return sample.with_weights(rows).select("doc_id", "weight")


# -- pairing and evaluation -------------------------------------------------


@query("""SELECT doc_id, n_chars, (CASE WHEN abs(n_chars - 500) <= abs(n_chars - 2000) AND abs(n_chars - 500) <= abs(n_chars - 8000) THEN 500 WHEN abs(n_chars - 2000) <= abs(n_chars - 8000) THEN 2000 ELSE 8000 END)::DOUBLE AS focus FROM documents""")
def nearest_focus(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", "n_chars", F.col("n_chars").cast("double").alias("focus"))
    return match.nearest_focus(docs, [500.0, 2000.0, 8000.0])


@query("""WITH c AS (SELECT c_nationkey AS position, c_custkey % 5 AS trap, c_custkey AS label FROM customer), m AS (SELECT position, trap, label, label // 2 AS mother FROM c WHERE label % 7 > 0) SELECT c.*, m.mother FROM c LEFT JOIN m USING (position, trap, label)""")
def mother_lookup(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_nationkey").alias("position"), (F.col("c_custkey") % 5).alias("trap"), F.col("c_custkey").alias("label"))
    mothers = c.filter("label % 7 > 0").withColumn("mother", F.expr("label div 2"))
    return match.mother_lookup(c, mothers).select("position", "trap", "label", "mother")


@query("""SELECT event_id, round(CASE WHEN value / 100 > 0.1 AND value / 100 < 0.9 THEN greatest(value / 100, value / 80) ELSE value / 100 END, 6) AS p FROM events""")
def blended_score(spark, d):
    e = views.table(spark, d, "events")
    return e.select("event_id", r6(track.blend(F.col("value") / 100, F.col("value") / 80)).alias("p"))


@query(f"""{with_views('tr')}, s AS (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY tp) AS step FROM tr)
SELECT n.series, n.tp, count(*) AS n, count(*) FILTER (n.kind = p.kind)::DOUBLE AS same FROM s n JOIN s p ON n.series = p.series AND p.step = n.step - 1 GROUP BY 1, 2""")
def link_rows(spark, d):
    rows = learn.link_rows(views.tracks(spark, d).withColumnRenamed("kind", "label"))
    return rows.groupBy("series", "tp").agg(F.count("*").alias("n"), F.sum("same").alias("same"))


@query("""WITH s AS (SELECT source AS split, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL) SELECT x.split, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT DISTINCT source AS split FROM documents WHERE source IS NOT NULL UNION SELECT 'none') x LEFT JOIN s USING (split) GROUP BY 1""")
def objects_per_split(spark, d):
    """Lines of a document as its labels, sources as splits, and one split without any."""
    docs = views.table(spark, d, "documents").filter("text is not null").select(F.col("source").alias("split"), F.split("text", "\n", -1).alias("labels"))
    names = views.table(spark, d, "documents").select(F.col("source").alias("split")).filter("split is not null")
    return evaluate.objects_per_split(docs, names.union(spark.createDataFrame([("none",)], "split string")))


@query("""WITH j AS (SELECT lang AS split, quality = 1 AS t, n_chars > 2000 AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT split, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM j GROUP BY 1),
r AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r, tn / nullif(tn + fp, 0) AS s FROM c)
SELECT split, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round((r + s) / 2, 6) AS balanced, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1, round(1.25 * p * r / nullif(0.25 * p + r, 0), 6) AS f05, round(5 * p * r / nullif(4 * p + r, 0), 6) AS f2 FROM r""")
def split_metrics(spark, d):
    j = views.table(spark, d, "documents").select("doc_id", F.col("lang").alias("split"), "n_chars").join(views.table(spark, d, "labels"), "doc_id")
    m = evaluate.metrics(j, F.col("quality") == 1, F.col("n_chars") > 2000)
    return m.select("split", *[r6(x).alias(x) for x in ("accuracy", "balanced", "precision", "recall", "f1", "f05", "f2")])


_QD = "p AS (SELECT a.frame_id, a.cell AS ta, b.cell AS tb, count(*) AS n FROM qd a JOIN qd b ON a.frame_id = b.frame_id AND a.r = b.c AND a.c = b.r GROUP BY 1, 2, 3), s AS (SELECT frame_id, cell, count(*) AS area FROM qd GROUP BY 1, 2), j AS (SELECT p.*, n / (x.area + y.area - n) AS iou FROM p JOIN s x ON x.frame_id = p.frame_id AND x.cell = ta JOIN s y ON y.frame_id = p.frame_id AND y.cell = tb)"


def _mirrored(spark, d):
    q = views.quadrants(spark, d)
    flipped = q.select("frame_id", "cell", F.col("c").alias("r"), F.col("r").alias("c"))
    return q, match.intersections(q, flipped, ["r", "c"]).withColumn("iou", match.iou())


@query(f"""{with_views('qd', 'fr')}, {_QD}, b AS (SELECT s.frame_id, s.cell, coalesce(max(iou), 0) AS iou FROM s LEFT JOIN j ON j.frame_id = s.frame_id AND j.ta = s.cell GROUP BY 1, 2), f AS (SELECT frame_id, avg(iou) AS m, least(min(iou), 1) AS lo, max(iou) AS ap FROM b GROUP BY 1)
SELECT CASE fr.series % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, round(avg(m), 6) AS iou_mean, round(avg(coalesce(lo, 1)), 6) AS iou_min, round(avg(coalesce(ap, 0)), 6) AS ap FROM fr LEFT JOIN f USING (frame_id) GROUP BY ROLLUP (1)""")
def validation_summary(spark, d):
    """Best IoU of each object with the mirrored frame; the frame's best stands for its average precision."""
    q, p = _mirrored(spark, d)
    best = q.select("frame_id", "cell").distinct().join(p.groupBy("frame_id", F.col("ta").alias("cell")).agg(F.max("iou").alias("iou")), ["frame_id", "cell"], "left").fillna(0.0, ["iou"])
    frames = views.frames(spark, d).select("frame_id", F.when(F.col("series") % 3 == 0, "train").when(F.col("series") % 3 == 1, "val").otherwise("test").alias("split"))
    s = evaluate.validation_summary(frames, best, best.groupBy("frame_id").agg(F.max("iou").alias("ap")))
    return s.select("split", *[r6(x).alias(x) for x in ("iou_mean", "iou_min", "ap")])


@query(f"""{with_views('qd')}, {_QD} SELECT least(floor(iou / (1 / 26)), 25)::INT AS bin_x, least(floor(n / 26 / (1 / 26)), 25)::INT AS bin_y, round(sum(iou), 6) AS w FROM j WHERE iou BETWEEN 0 AND 1 AND n / 26 BETWEEN 0 AND 1 GROUP BY 1, 2""")
def overlap_histogram(spark, d):
    _, p = _mirrored(spark, d)
    h = evaluate.histogram_2d(p.withColumn("share", F.col("n") / 26), "iou", "share", "iou", 0.0, 1.0, 26)
    return h.select("bin_x", "bin_y", r6("w").alias("w"))


@query(f"""{with_views('vo')} SELECT series, series % 2 AS label, max(vol) FILTER (tp = 1) AS "1", max(vol) FILTER (tp = 5) AS "5", max(vol) FILTER (tp = 9) AS "9" FROM vo GROUP BY 1, 2""")
def volume_matrix(spark, d):
    v = views.volumes(spark, d).withColumn("label", F.col("series") % 2)
    return evaluate.volume_matrix(v, [1, 5, 9])


@query("""WITH t AS (SELECT p_partkey, p_brand, p_container, p_size::DOUBLE AS sigma, round((p_partkey % 97) / 97.0, 4) AS iou FROM (SELECT *, substr(p_name, 1, 1) AS p_container FROM part))
SELECT p_brand, c AS container, sigma, iou FROM (SELECT p_brand, p_container AS c, sigma, iou, row_number() OVER (PARTITION BY p_brand, p_container ORDER BY iou DESC, sigma) AS k FROM t) WHERE k = 1""")
def best_sigma(spark, d):
    p = views.table(spark, d, "part").select("p_brand", F.substring("p_name", 1, 1).alias("container"), F.col("p_size").cast("double").alias("sigma"), F.round((F.col("p_partkey") % 97) / 97.0, 4).alias("iou"))
    return evaluate.best_per_group(p, ["p_brand", "container"]).select("p_brand", "container", "sigma", "iou")


@query("""WITH t AS (SELECT lang AS grp, n_chars::DOUBLE AS v, coalesce(quality, 0) = 1 AS b FROM documents LEFT JOIN labels USING (doc_id))
SELECT grp, round(coalesce((quantile_cont(v, 0.95) FILTER (NOT b) + quantile_cont(v, 0.25) FILTER (b)) / 2, quantile_cont(v, 0.95) FILTER (NOT b), quantile_cont(v, 0.25) FILTER (b)), 6) AS upper FROM t GROUP BY 1""")
def search_bounds(spark, d):
    t = views.table(spark, d, "documents").select("doc_id", F.col("lang").alias("grp"), F.col("n_chars").cast("double").alias("p_edge")).join(views.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return evaluate.search_bounds(t.withColumn("is_best", F.coalesce(F.col("quality") == 1, F.lit(False)))).select("grp", r6("upper").alias("upper"))


@query("""WITH g AS (SELECT p_brand AS name, min(p_size)::DOUBLE AS lower, CASE WHEN max(p_size) < 50 THEN max(p_size)::DOUBLE END AS upper, min(p_partkey) AS position FROM part GROUP BY 1) SELECT name, row_number() OVER (ORDER BY upper DESC NULLS FIRST, lower DESC, position)::INT AS place FROM g""")
def group_order(spark, d):
    g = views.table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_size").cast("double").alias("lower"), F.max("p_size").alias("m"), F.min("p_partkey").alias("position"))
    return evaluate.group_order(g.withColumn("upper", F.when(F.col("m") < 50, F.col("m").cast("double"))))


@query("""WITH m AS (SELECT event_type AS name, round(avg(value) / 1000, 6) AS f1, 0.5::DOUBLE AS std, min(event_id) AS seconds FROM events GROUP BY 1), t AS (SELECT f1, std FROM m ORDER BY f1 DESC, std DESC LIMIT 1) SELECT m.name, m.f1, m.seconds FROM m, t WHERE m.f1 > t.f1 - 0.1 * t.std ORDER BY m.seconds, m.name LIMIT 1""")
def fast_enough(spark, d):
    m = views.table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(r6(F.avg("value") / 1000).alias("f1"), F.lit(0.5).alias("std"), F.min("event_id").alias("seconds"))
    return evaluate.fast_enough(m)


@query(f"""{with_views('tr')}, k AS (SELECT series, ('0x' || substr(md5(kind), 1, 2))::INT AS label, count(*) AS n FROM tr GROUP BY 1, 2) SELECT series, label, n AS frames FROM k QUALIFY row_number() OVER (PARTITION BY series ORDER BY n DESC, label) = 1""")
def main_label(spark, d):
    t = views.tracks(spark, d).withColumn("label", F.conv(F.substring(F.md5(F.col("kind").cast("binary")), 1, 2), 16, 10).cast("int"))
    return evaluate.main_label(t)


_LINKS = "s AS (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY tp) AS step FROM tr), l AS (SELECT w, series, step, min(cell) AS pos, floor(abs(x) / w)::INT AS label FROM s, (VALUES (20), (30), (40)) v(w) GROUP BY ALL), i AS (SELECT a.w, a.series, a.step, a.pos, coalesce(b.pos, -1) AS prev FROM l a LEFT JOIN l b ON a.w = b.w AND a.series = b.series AND a.step = b.step + 1 AND a.label = b.label)"


@query(f"{with_views('tr')}, {_LINKS} SELECT x.w AS width, round(avg((x.prev = y.prev)::INT), 6) AS accuracy, count(*) FILTER (x.prev <> y.prev) AS wrong FROM i x JOIN i y USING (series, step, pos) WHERE y.w = 20 GROUP BY 1")
def link_sweep(spark, d):
    """Accuracy of labelings of three widths against the first, all in one job."""
    t = track.with_steps(views.tracks(spark, d)).withColumn("width", F.explode(F.array(F.lit(20), F.lit(30), F.lit(40))))
    labels = t.groupBy("width", "series", "step", F.floor(F.abs("x") / F.col("width")).cast("int").alias("label")).agg(F.min("cell").alias("pos"))
    return evaluate.link_sweep(labels, labels.filter("width = 20").drop("width"), ["width"]).select("width", r6("accuracy").alias("accuracy"), "wrong")


# -- tuning and growth ------------------------------------------------------


_SPLIT = f"{with_views('st')}, n AS (SELECT a.obj AS ta, b.obj AS tb, count(*) AS n FROM st a JOIN st b ON a.px = b.px AND a.obj < b.obj GROUP BY 1, 2), s AS (SELECT obj, count(*) AS area FROM st GROUP BY 1), p AS (SELECT least(x.area, y.area) AS lo, greatest(x.area, y.area) AS hi, n / least(x.area, y.area) AS frac FROM n JOIN s x ON ta = x.obj JOIN s y ON tb = y.obj)"


def _overlaps(spark, d):
    s = views.sets(spark, d).select(F.col("obj").alias("cell"), "px")
    return tune.size_overlaps(s, ["px"])


def _thresholds(spark, low: int, high: int, step: int):
    return spark.range(low, high, step).select(F.col("id").cast("double").alias("t"))


@query(f"""{_SPLIT} SELECT t::DOUBLE AS t, round(sum(CASE WHEN hi < t + 5 OR lo >= t - 5 THEN frac ELSE 0 END), 6) AS cost FROM p, range(400, 800, 20) g(t) GROUP BY 1 ORDER BY cost, t LIMIT 1""")
def best_split(spark, d):
    return tune.best_split(tune.overlap_threshold(_overlaps(spark, d), _thresholds(spark, 400, 800, 20), 5))


@query(f"""{_SPLIT}, k AS (SELECT a::DOUBLE AS lower_cut, b::DOUBLE AS upper_cut, round(sum(frac * ((hi < a + 5)::INT + (lo >= a - 5 AND hi < b + 5)::INT + (lo >= b - 5)::INT)), 6) AS cost FROM p, range(400, 800, 50) x(a), range(400, 800, 50) y(b) WHERE a < b GROUP BY 1, 2) SELECT * FROM k ORDER BY cost, lower_cut, upper_cut LIMIT 1""")
def two_cuts(spark, d):
    return tune.two_cuts(_overlaps(spark, d), _thresholds(spark, 400, 800, 50), 5)


_ERODE = "SELECT frame_id, cell, r + dr AS r, c + dc AS c FROM {0}, (VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)) o(dr,dc) GROUP BY ALL HAVING count(*) = 5"


@query(f"""{with_views('qd')}, big AS (SELECT frame_id, cell, count(*) AS n FROM qd GROUP BY 1, 2 HAVING count(*) >= 10), q AS (SELECT qd.* FROM qd JOIN big USING (frame_id, cell)), e1 AS ({_ERODE.format('q')}),
z AS (SELECT 0 AS e, n FROM big UNION ALL SELECT 1, count(e1.r) FROM big LEFT JOIN e1 USING (frame_id, cell) GROUP BY frame_id, cell), y AS (SELECT e, min(n) >= 0 AS keeps, quantile_cont(n, 0.5) AS m FROM z GROUP BY 1)
SELECT coalesce(max(y.e), 0)::INT AS level FROM y, (SELECT m AS m0 FROM y WHERE e = 0) WHERE keeps AND m >= m0 * 0.05""")
def best_erosion(spark, d):
    q = views.quadrants(spark, d)
    big = q.groupBy("frame_id", "cell").agg(F.count("*").alias("n")).filter("n >= 10")
    kept = q.join(big.select("frame_id", "cell"), ["frame_id", "cell"], "left_semi")
    one = big.select("frame_id", "cell").join(morph.erode(kept).groupBy("frame_id", "cell").agg(F.count("*").alias("n")), ["frame_id", "cell"], "left").fillna(0, ["n"])
    sizes = big.select(F.lit(0).alias("e"), F.struct("frame_id", "cell").alias("cell"), "n").union(one.select(F.lit(1).alias("e"), F.struct("frame_id", "cell").alias("cell"), "n"))
    return tune.best_level(sizes, 0, 0.05)


def _greedy_rounds(n: int) -> str:
    out = []
    for k in range(n):
        out.append(f"m{k} AS (SELECT * FROM q{k} QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY iou DESC, ta, tb) = 1)")
        out.append(f"q{k + 1} AS (SELECT q{k}.* FROM q{k} LEFT JOIN m{k} USING (frame_id) WHERE m{k}.ta IS NULL OR (q{k}.ta <> m{k}.ta AND q{k}.tb <> m{k}.tb))")
    return ", ".join(out)


_STAT = f"""{_QD.replace("s AS (SELECT", "s AS MATERIALIZED (SELECT")}, e AS (SELECT frame_id, cell, round(avg(v), 9) AS p_edge FROM qd JOIN px USING (frame_id, r, c) GROUP BY 1, 2),
o AS (SELECT a.frame_id, a.cell AS ta, b.cell AS tb, count(*) AS n FROM qd a JOIN qd b ON a.frame_id = b.frame_id AND a.r = b.r AND a.c = b.c AND (a.cell - 1) // 2 = 0 AND (b.cell - 1) // 2 = 1 GROUP BY 1, 2, 3),
w AS (SELECT o.frame_id, CASE WHEN x.p_edge > y.p_edge THEN tb ELSE ta END AS cell, ta, tb, greatest(n / sx.area, n / sy.area) AS v FROM o JOIN e x ON x.frame_id = o.frame_id AND x.cell = ta JOIN e y ON y.frame_id = o.frame_id AND y.cell = tb JOIN s sx ON sx.frame_id = o.frame_id AND sx.cell = ta JOIN s sy ON sy.frame_id = o.frame_id AND sy.cell = tb),
cn AS (SELECT frame_id, cell, v FROM w QUALIFY row_number() OVER (PARTITION BY frame_id, cell ORDER BY ta DESC, tb DESC) = 1),
b AS (SELECT frame_id, ta AS cell, tb, iou FROM j QUALIFY row_number() OVER (PARTITION BY frame_id, ta ORDER BY iou DESC, tb) = 1), q0 AS (SELECT frame_id, ta, tb, iou FROM j), {_greedy_rounds(4)}, g AS ({" UNION ALL ".join(f"SELECT frame_id, ta AS cell, tb FROM m{k}" for k in range(4))})"""


@query(f"""{with_views('qd')}, {_STAT} SELECT s.frame_id AS example, (s.cell - 1) // 2 AS grp, s.cell, s.area, round(p_edge, 6) AS p_edge, round(coalesce(cn.v, 0), 6) AS containment, coalesce(b.tb, 0) AS assignment, round(coalesce(b.iou, 0), 6) AS iou, coalesce(g.tb, -1) AS best_assignment
FROM s JOIN e USING (frame_id, cell) LEFT JOIN cn USING (frame_id, cell) LEFT JOIN b USING (frame_id, cell) LEFT JOIN g USING (frame_id, cell)""")
def stat_table(spark, d):
    """Objects 1 and 2 as the lower group, 3 and 4 as the upper; mirrored objects as truth."""
    q = views.quadrants(spark, d)
    truth = q.select("frame_id", "cell", F.col("c").alias("r"), F.col("r").alias("c"))
    masks = q.select("frame_id", F.expr("cast((cell - 1) div 2 as int)").alias("grp"), "cell", "r", "c")
    scores = objects.mean_over(q, views.pixels(spark, d), name="p_edge").select("frame_id", F.expr("cast((cell - 1) div 2 as int)").alias("grp"), "cell", F.round("p_edge", 9).alias("p_edge"))
    s = tune.stat_table(masks, scores, truth)
    return s.select("example", "grp", "cell", "area", r6("p_edge").alias("p_edge"), r6("containment").alias("containment"), "assignment", r6("iou").alias("iou"), "best_assignment")


@query()
def joint_search(spark, d):
    """Filters of the stat table found by three rounds of trials."""
    q = views.quadrants(spark, d)
    truth = q.select("frame_id", "cell", F.col("c").alias("r"), F.col("r").alias("c"))
    masks = q.select("frame_id", F.expr("cast((cell - 1) div 2 as int)").alias("grp"), "cell", "r", "c")
    scores = objects.mean_over(q, views.pixels(spark, d), name="p_edge").select("frame_id", F.expr("cast((cell - 1) div 2 as int)").alias("grp"), "cell", "p_edge")
    stats = tune.stat_table(masks, scores, truth).cache()
    best, top = tune.joint_search(stats, 4 * stats.select("example").distinct().count(), {"lower": [1, 3, 6, 9], "p_edge_min": [0.0, 0.08, 0.1], "max_containment": [0.2, 0.5, 1.0]}, {"lower": 1.0, "upper": 25.0, "p_edge_min": 0.0, "max_containment": 1.0})
    return spark.createDataFrame([(*[float(best[k]) for k in ("lower", "upper", "p_edge_min", "max_containment")], round(float(top), 6))], "lower double, upper double, p_edge_min double, max_containment double, f1 double")


_WEIGHTS = ", ".join(f"({k}, {i}, {float(x)!r}::DOUBLE)" for k, row in enumerate(growth.savgol_weights(21, 3)) for i, x in enumerate(row))


@query(f"""{with_views('vo')}, h AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY tp) - 1 AS i, vol AS v, count(*) OVER (PARTITION BY series) AS n FROM vo), w(k, j, x) AS (VALUES {_WEIGHTS}),
p AS (SELECT *, CASE WHEN i < 10 THEN i WHEN i >= n - 10 THEN i - n + 21 ELSE 10 END AS k, least(greatest(i - 10, 0), n - 21) AS f FROM h WHERE n >= 21)
SELECT p.series, p.i::INT AS i, round(sum(h.v * w.x), 4) AS smooth FROM p JOIN w ON w.k = p.k JOIN h ON h.series = p.series AND h.i = p.f + w.j GROUP BY 1, 2 UNION ALL SELECT series, i::INT, round(v, 4) FROM h WHERE n < 21""")
def savgol(spark, d):
    v = views.volumes(spark, d).select("series", (F.row_number().over(Window.partitionBy("series").orderBy("tp")) - 1).alias("i"), F.col("vol").alias("v"))
    return growth.savgol(v).select("series", "i", F.round("smooth", 4).alias("smooth"))


@query(f"{with_views('px')} SELECT frame_id, round(1.5 * avg(r), 6) AS centre_r, round(1.5 * avg(c), 6) AS centre_c, round(1.5 * max(v), 6) AS radius, round(3.375 * sum(v), 6) AS volume FROM px GROUP BY 1")
def rescale_outlines(spark, d):
    o = views.pixels(spark, d).groupBy("frame_id").agg(F.struct(F.avg("r").alias("r"), F.avg("c").alias("c")).alias("centre"), F.array(F.max("v")).alias("radii"), F.sum("v").alias("volume"))
    x = norm.rescale_outlines(o, 1.5)
    return x.select("frame_id", r6("centre.r").alias("centre_r"), r6("centre.c").alias("centre_c"), r6(F.col("radii")[0]).alias("radius"), r6("volume").alias("volume"))
