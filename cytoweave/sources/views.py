"""Readings of the supplied tables as frames, masks, tracks, volumes and sets.

Each view is a plain DataFrame in the layout that the operators take:

* pixels  (frame_id, series, tp, r, c, v)   one row for each pixel
* masks   (frame_id, cell, r, c)            one row for each pixel of an object
* tracks  (series, tp, cell, x, y, size, kind)
* volumes (series, tp, t, vol)
* sets    (obj, px)                         overlapping objects over a wide domain
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 8
THRESHOLD = 0.05
ORIGIN = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding of 64 values is an 8 by 8 frame in row-major order."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("series"), F.posexplode("embedding").alias("i", "v"))
    return e.select("frame_id", "series", F.expr("i div 8").cast("int").alias("r"), (F.col("i") % SIDE).cast("int").alias("c"), F.col("v").cast("double").alias("v"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, series, tp): time points count the frames of a series."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("frame_id"), F.col("label").alias("series"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("tp"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels above the threshold, one object (cell 1) for each frame."""
    return pixels(spark, sf_dir).filter(F.col("v") > THRESHOLD).select("frame_id", F.lit(1).alias("cell"), "r", "c")


def quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping objects of a frame: the thresholded pixels of four 5 by 5 windows, cells 1 to 4."""
    px = pixels(spark, sf_dir).filter(F.col("v") > THRESHOLD)
    window = F.explode(F.expr("filter(array(struct(1 as cell, 0 as r0, 0 as c0), struct(2 as cell, 0 as r0, 3 as c0), struct(3 as cell, 3 as r0, 0 as c0), struct(4 as cell, 3 as r0, 3 as c0)), w -> r between w.r0 and w.r0 + 4 and c between w.c0 and w.c0 + 4)"))
    return px.withColumn("w", window).select("frame_id", F.col("w.cell").alias("cell"), "r", "c")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user on a day are the objects of one time point of a series."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit(ORIGIN))
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    w = Window.partitionBy("user_id", day).orderBy("event_id")
    return e.select(F.col("user_id").alias("series"), day.alias("tp"), F.row_number().over(w).alias("cell"), F.col("value").cast("double").alias("x"), seconds.cast("double").alias("y"), F.col("event_type").alias("kind"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of a user's values are its volume over time."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit(ORIGIN))
    return e.groupBy(F.col("user_id").alias("series"), day.alias("tp")).agg(F.round(F.sum(F.col("value").cast("decimal(30,10)")).cast("double"), 6).alias("vol"))


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as objects, the parts that they deliver as their pixels."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("obj"), F.col("l_partkey").alias("px")).distinct()


# The same views for DuckDB, as WITH items.
SQL = {
    "px": "px AS (SELECT vec_id AS frame_id, label AS series, (i // 8)::INT AS r, (i % 8)::INT AS c, v::DOUBLE AS v FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings))",
    "fr": "fr AS (SELECT vec_id AS frame_id, label AS series, (row_number() OVER (PARTITION BY label ORDER BY vec_id))::INT AS tp FROM embeddings)",
    "mk": "mk AS (SELECT frame_id, 1 AS cell, r, c FROM px WHERE v > 0.05)",
    "qd": "qd AS (SELECT frame_id, w.cell, r, c FROM px JOIN (VALUES (1,0,0),(2,0,3),(3,3,0),(4,3,3)) w(cell,r0,c0) ON r BETWEEN r0 AND r0+4 AND c BETWEEN c0 AND c0+4 WHERE v > 0.05)",
    "tr": "tr AS (SELECT user_id AS series, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS tp, (row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id))::INT AS cell, value::DOUBLE AS x, (hour(ts)*3600+minute(ts)*60+second(ts))::DOUBLE AS y, event_type AS kind FROM events)",
    "vo": "vo AS (SELECT user_id AS series, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS tp, round(sum(value::DECIMAL(30,10))::DOUBLE, 6) AS vol FROM events GROUP BY ALL)",
    "st": "st AS (SELECT DISTINCT l_suppkey AS obj, l_partkey AS px FROM lineitem)",
}


def with_views(*names: str) -> str:
    """A WITH clause of the named views; masks bring the pixels along."""
    wanted = (["px"] if {"mk", "qd"} & set(names) and "px" not in names else []) + list(names)
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in wanted)
