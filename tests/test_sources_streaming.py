import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytoweave.operators import learn, track
from cytoweave.sources import images
from cytoweave.streaming import live


def test_png_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    tiles = rng.integers(0, 65535, (8, 6, 3)).astype(np.uint16)
    px = pd.DataFrame([(0, k, r, c, int(tiles[r, c, k])) for k in range(3) for r in range(8) for c in range(6)], columns=["frame_id", "tile", "r", "c", "v"])
    content = images.encode_tiles(spark.createDataFrame(px)).first().content
    assert images.decode_png(bytes(content)).shape == (8, 18)
    (tmp_path / "a_img.png").write_bytes(content)
    (tmp_path / "b_img.png").write_bytes(b"no image")
    got = images.scan_tiles(spark, str(tmp_path)).toPandas()
    good = got[got["error"].isna()]
    assert all(tiles[x.r, x.c, x.tile] == x.v for x in good.itertuples()) and len(good) == 144
    assert got["error"].notna().sum() == 1
    meta = json.loads(images.scan_metadata(spark, str(tmp_path), "a*.png").first().description)
    assert meta["ntiles"] == 3 and meta["layout"] == [1, 3]


def test_short_last_row():
    out = images.lay_tiles(np.ones((2, 2, 5), np.uint8), fill=9)
    assert images.layout(5) == (2, 3) and out.shape == (4, 6) and (out[2:, 4:] == 9).all()


def test_pairing(spark):
    files = spark.createDataFrame([(p,) for p in ("/x/a_Img.png", "/x/a_lbl.png", "/x/b_img.png", "/x/c.png")], "path string")
    lenient = images.pair_files(files, ["img", "lbl"], strict=False).collect()
    assert [(x.prefix, x.img, x.lbl) for x in lenient] == [("/x/a", "/x/a_Img.png", "/x/a_lbl.png")]
    with pytest.raises(Exception, match="no full set"):
        images.pair_files(files, ["img", "lbl"]).collect()
    known = spark.createDataFrame([("/x/a",)], "prefix string")
    assert images.new_pairs(images.pair_files(files, ["img", "lbl"], False), known).count() == 0


def test_raw_frames(spark):
    img = np.arange(2 * 3 * 4 * 1, dtype=np.uint8).reshape((2, 3, 4, 1))
    rows = [(1, img.tobytes(order="F"), 2, 3, 4, 1, 8), (2, b"short", 2, 3, 4, 1, 8)]
    got = images.frames_from_bytes(spark.createDataFrame(rows, "message long, content binary, n int, w int, h int, z int, bits int")).toPandas()
    ok = got[got["error"].isna()]
    assert len(ok) == 24 and all(img[x.n, x.c, x.r, x.z] == x.v for x in ok.itertuples())
    assert got[got["message"] == 2]["error"].tolist() == ["size"]


def test_stream_equals_batch_and_drops_late_frames(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(s, tp, cell, float(rng.normal(cell * 100, 10)), 0.0) for s in (1, 2) for tp in range(6) for cell in range(1, 4)]
    schema = "series long, tp int, cell int, x double, y double"
    want = {(x.series, x.tp, x.cell): x.label for x in track.track(spark.createDataFrame(rows, schema)).collect()}
    src = tmp_path / "in"
    src.mkdir()
    source = live.track_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
    for k, keep in enumerate(([0, 1], [2, 3], [4, 5], [3])):
        spark.createDataFrame([r for r in rows if r[1] in keep], schema).coalesce(1).write.mode("append").parquet(str(src))
        q = source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None, k
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(x.series, x.tp, x.cell): x.label for x in out if x.error is None} == want
    assert {x.tp for x in out if x.error == "late"} == {3}


def test_states_resume_a_series(spark):
    rng = np.random.default_rng(5)
    rows = [(s, tp, cell, float(cell * 200 + rng.normal(0, 10)), 0.0) for s in (1, 2) for tp in range(8) for cell in range(1, 4)]
    o = spark.createDataFrame(rows, "series long, tp int, cell int, x double, y double")
    key = lambda df: {(x.series, x.tp, x.cell): x.label for x in df.collect() if x.tp is not None}
    first = live.track_with_states(o.filter("tp < 5")).cache()
    rest = live.track_with_states(o.filter("tp >= 5"), start=first.filter("state is not null").select("series", "state"))
    assert key(first) | key(rest) == key(track.track(o))
    bad = o.withColumn("x", F.when((F.col("series") == 2) & (F.col("tp") == 3), F.lit(float("nan"))).otherwise(F.col("x")))
    got = {(x.series, x.tp): x.error for x in live.track_with_states(bad).collect() if x.tp is not None}
    assert "finite" in got[(2, 3)] and [k for k, e in got.items() if e] == [(2, 3)]
    assert {x.label for x in live.track_with_states(bad).filter("series = 2 and tp = 4").collect()} == {1, 2, 3}


def test_pixels_to_tracks_stream(spark, tmp_path):
    rows = [(1, tp, r, c, 1.0 if (r - 2) ** 2 + (c - 2 - tp) ** 2 <= 1 or (r == 8 and c == 8) else 0.0) for tp in range(4) for r in range(10) for c in range(10)]
    px = spark.createDataFrame(rows, "series long, tp int, r int, c int, v double")
    px.coalesce(1).write.parquet(str(tmp_path / "px"))
    s = live.segment_and_track_stream(spark.readStream.schema(px.schema).parquet(str(tmp_path / "px")), least=2)
    q = s.writeStream.format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("cells").collect()
    assert len(got) == 4 * 5 and {x.label for x in got} == {1} and {x.error for x in got} == {None}


def test_watermarked_windows_stream(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:10:00", 1.0), (1, "2024-01-01 23:00:00", 3.0), (1, "2024-01-04 00:00:00", 5.0)], "series int, t string, value double").withColumn("ts", F.to_timestamp("t"))
    e.select("series", "ts", "value").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("series int, ts timestamp, value double").parquet(str(tmp_path / "e"))
    q = live.activity(s, delay="1 hour").writeStream.format("memory").queryName("act").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(x.n, x.mean) for x in spark.table("act").collect()] == [(2, 2.0)]
    assert live.sessions(e).count() == 3


def test_forest_learns_separable_links(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(1, tp, cell, float(rng.normal(cell * 300, 5)), 0.0, cell) for tp in range(30) for cell in range(1, 4)]
    pairs = learn.link_rows(spark.createDataFrame(rows, "series long, tp int, cell int, x double, y double, label int")).withColumn("split", F.lit("all")).withColumn("gap", track.pair_distance())
    model = learn.forest(["gap"], "same", 5, 3).fit(learn.with_balance(pairs, "same"))
    assert learn.performance(learn.probabilities(model, pairs, ["gap"]), "same").first().balanced > 0.99
    model.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    again = PipelineModel.load(str(tmp_path / "m"))
    assert learn.importances(again, ["gap"]) == [("gap", 1.0)]
    missing = pairs.withColumn("gap", F.lit(None).cast("double"))
    assert {x.p for x in learn.probabilities(model, missing, ["gap"]).collect()} == {0.0}
