"""The stream that segments, tracks and assigns mothers against the batch operators."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cytoweave.operators import objects, segment, track
from cytoweave.streaming import crawl

H = W = 48
SCHEMA = "series long, tp int, target string, r int, c int, p double"
GROUPS = [segment.GroupParams(("small", "bud"), None, 0.5, lower=4, upper=60), segment.GroupParams(("large",), "edge", 0.4, closing=1, lower=30)]


def disc(y, x, q):
    return [(r, c) for r in range(H) for c in range(W) if (r - y) ** 2 + (c - x) ** 2 <= q * q]


def maps(series, tp):
    """Two mothers that drift; from some time on each has a bud that grows."""
    out = []
    rng = np.random.default_rng(series * 100 + tp)
    for k, (y, x) in enumerate([(14 + tp * 0.5, 14.0), (34.0, 33 - tp * 0.4)]):
        out += [("large", r, c, 0.9) for r, c in disc(y, x, 8)] + [("edge", r, c, 0.3) for r, c in set(disc(y, x, 9)) - set(disc(y, x, 7))]
        if tp >= 2 + k + series % 2:
            q = min(1.5 + 0.4 * tp, 4)
            out += [(t, r, c, 0.8) for t in ("small", "bud") for r, c in disc(y - 8 - q, x + 3, q)]
    out += [("small", int(r), int(c), float(p)) for r, c, p in zip(rng.integers(0, H, 30), rng.integers(0, W, 30), rng.uniform(0, 0.4, 30), strict=True)]
    best = {}
    for t, r, c, p in out:
        best[t, r, c] = max(best.get((t, r, c), 0), p)
    return [(series, tp, t, r, c, p) for (t, r, c), p in best.items()]


def score(pairs: pd.DataFrame) -> np.ndarray:
    near = np.exp(-np.hypot(pairs["m_r"] - pairs["d_r"], pairs["m_c"] - pairs["d_c"]) / 40)
    return (pairs["p_bud"] * near * (pairs["m_area"] > pairs["d_area"])).to_numpy()


def batch(spark, rows):
    preds = spark.createDataFrame([(s * 1000 + tp, *rest) for s, tp, *rest in rows], "frame_id long, target string, r int, c int, p double")
    from pyspark.sql import Window

    found = segment.segment(preds, GROUPS, H, W).select("frame_id", "grp", F.dense_rank().over(Window.partitionBy("frame_id").orderBy("grp", "cell")).alias("cell"), "r", "c")
    found = found.cache()
    f = objects.shape_features(found.select("frame_id", "cell", "r", "c"))
    bud = preds.filter("target = 'bud'").select("frame_id", "r", "c", F.col("p").alias("v"))
    p_bud = found.join(bud, ["frame_id", "r", "c"], "left").groupBy("frame_id", "cell").agg(F.avg(F.coalesce("v", F.lit(0.0))).alias("p_bud"))
    cells = f.join(p_bud, ["frame_id", "cell"]).select(F.expr("frame_id div 1000").alias("series"), (F.col("frame_id") % 1000).cast("int").alias("tp"), "cell", "area", F.col("centroid_r").alias("x"), F.col("centroid_c").alias("y"), "p_bud").cache()
    labels = track.track(cells, ("x", "y"), (10.0, 10.0))
    named = cells.join(labels, ["series", "tp", "cell"]).toPandas()
    pairs = named.merge(named, on=["series", "tp"], suffixes=("_m", "_d"))
    pairs = pairs[pairs["cell_m"] != pairs["cell_d"]]
    p = score(pd.DataFrame({"m_area": pairs["area_m"], "m_r": pairs["x_m"], "m_c": pairs["y_m"], "d_area": pairs["area_d"], "d_r": pairs["x_d"], "d_c": pairs["y_d"], "p_bud": pairs["p_bud_d"]}))
    told = spark.createDataFrame(pd.DataFrame({"series": pairs["series"], "tp": pairs["tp"], "mother": pairs["label_m"], "bud": pairs["label_d"], "p": p}))
    mothers = track.assign_mothers(told, labels.select("series", "tp", "label").distinct())
    return {(x.series, x.tp, x.cell): (x.label, x.mother) for x in labels.join(mothers, ["series", "tp", "label"]).collect()}


def run(stream, out, state):
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_stream_equals_batch_on_labels_and_mothers(spark, tmp_path):
    rows = [x for s in (1, 2, 3) for tp in range(9) for x in maps(s, tp)]
    want = batch(spark, rows)
    assert {m for _, m in want.values()} >= {0, 1, 2}  # both mothers are found
    src = tmp_path / "in"
    src.mkdir()
    stream = crawl.crawl(spark.readStream.schema(SCHEMA).parquet(str(src)), GROUPS, H, W, score)
    bad = [(2, 20, "large", 99, 99, 1.0)]  # a place outside the frame fails
    for steps, more in (((0, 1, 2), []), ((3, 4), bad), ((5, 6, 7, 8), []), ((4,), [])):
        spark.createDataFrame([x for x in rows if x[1] in steps] + more, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        run(stream, tmp_path / "out", tmp_path / "state")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(x.series, x.tp, x.cell): (x.label, x.mother) for x in got if x.error is None} == want
    assert {(x.series, x.tp) for x in got if x.error == "late"} == {(s, 4) for s in (1, 2, 3)}
    assert [(x.series, x.tp) for x in got if (x.error or "").startswith("IndexError")] == [(2, 20)]


def test_idle_series_are_forgotten(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    stream = crawl.crawl(spark.readStream.schema(SCHEMA).parquet(str(src)), GROUPS, H, W, score, ttl_ms=1)
    out = tmp_path / "out"
    # a stream with time to live goes on without new rows, so it is stopped once these are out
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
    try:
        for tp in (5, 6):
            spark.createDataFrame(maps(1, tp), SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
            until = time.time() + 40
            while time.time() < until and q.isActive and not (out.is_dir() and any(out.glob("_spark_metadata/*")) and spark.read.schema(crawl.CRAWLED).parquet(str(out)).filter(F.col("tp") == tp).count()):
                time.sleep(0.5)
    finally:
        q.stop()
    got = spark.read.schema(crawl.CRAWLED).parquet(str(out)).collect()
    # the second frame finds no state: its labels are those of a first frame
    assert {x.tp for x in got} == {5, 6} and all(x.label == x.cell for x in got)


def test_dense_rules_equal_the_relational_ones(spark):
    rows = maps(1, 6)
    table = {}
    for _, _, t, r, c, p in rows:
        table.setdefault(t, np.zeros((H, W)))[r, c] = p
    masks, of = crawl.frame_objects(table, GROUPS, 0.8)
    preds = spark.createDataFrame([(0, *x[2:]) for x in rows], "frame_id long, target string, r int, c int, p double")
    want = {}
    for x in segment.segment(preds, GROUPS, H, W).collect():
        want.setdefault((x.grp, x.cell), set()).add((x.r, x.c))
    assert [want[k] for k in sorted(want)] == [set(zip(*(a.tolist() for a in np.nonzero(m)), strict=True)) for m in masks]
    assert [k for k, _ in sorted(want)] == of.tolist()
