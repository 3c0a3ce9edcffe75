"""Catalogues of image pairs: lists, metadata, sections, size probes and cached tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import numbered

#: Names of the splits in pair lists, with the names that older lists use.
SPLITS = {"train": "train_data", "val": "val_data", "test": "test_data"}


def read_pairs(spark: SparkSession, path: str, base_dir: str = "") -> DataFrame:
    """(split, image, label) of pair lists in JSON: split -> list of [image, label], new or old split names.

    Relative paths are taken from ``base_dir``.
    """
    schema = ", ".join(f"{n} array<array<string>>" for pair in SPLITS.items() for n in pair)
    lists = spark.read.schema(schema).json(path, multiLine=True)
    out = None
    for new, old in SPLITS.items():
        part = lists.select(F.lit(new).alias("split"), F.explode(F.coalesce(new, old)).alias("p")).select("split", F.col("p")[0].alias("image"), F.col("p")[1].alias("label"))
        out = part if out is None else out.union(part)
    place = lambda c: F.when(F.col(c).startswith("/") | F.lit(not base_dir), F.col(c)).otherwise(F.concat(F.lit(base_dir.rstrip("/") + "/"), F.col(c)))
    return out.select("split", place("image").alias("image"), place("label").alias("label"))


def write_pairs(pairs: DataFrame, path: str, base_dir: str = "", per_file: int = 100_000) -> None:
    """JSON objects with a sorted list of pairs for each split; paths under ``base_dir`` become relative.

    A file holds one object of at most ``per_file`` pairs, so lists of up to that
    size are one file; ``read_pairs`` takes all files of the folder together.
    """
    prefix = base_dir.rstrip("/") + "/" if base_dir else ""
    short = lambda c: F.when(F.col(c).startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 20)).otherwise(F.col(c))
    rows = numbered(pairs.select("split", short("image").alias("image"), short("label").alias("label")), "split", "image", "label", name="_k")
    part = F.floor((F.col("_k") - 1) / per_file)
    lists = [F.array_sort(F.collect_list(F.when(F.col("split") == s, F.array("image", "label")))).alias(s) for s in SPLITS]
    rows.groupBy(part.alias("_part")).agg(*lists).drop("_part").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def joined_metadata(splits: dict[str, DataFrame], order=("experiment", "position", "trap", "tp")) -> DataFrame:
    """Metadata of all splits in one table with ``train_val``, sorted."""
    out = None
    for name, rows in splits.items():
        part = rows.withColumn("train_val", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.orderBy(*order)


def section_table(files: DataFrame, folder: str = r"[zZ]_?([0-9]+)") -> DataFrame:
    """(path, z, tp) of image files in section folders: z from the folder's name, tp from the order of file names."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    z = F.regexp_extract(F.element_at(parts, -2), folder, 1)
    kept = files.select("path", z.alias("_z"), name.alias("_name")).filter("_z <> ''")
    order = numbered(kept.select("_name").distinct(), "_name", name="_tp")
    return kept.join(order, "_name").select("path", F.col("_z").cast("int").alias("z"), F.col("_tp").cast("int").alias("tp"))


def size_probe(meta: DataFrame) -> DataFrame:
    """(path, height, width, sections, pixel_size, weight): what a catalogue says of each image; one section and weight 1 unless told.

    meta: path, height, width and a map ``info`` of text values.
    """
    given = lambda k: F.try_element_at("info", F.lit(k))
    return meta.select("path", "height", "width", F.coalesce(given("sections").try_cast("int"), F.lit(1)).alias("sections"), given("pixel_size").try_cast("double").alias("pixel_size"), F.coalesce(given("weight").try_cast("double"), F.lit(1.0)).alias("weight"))


def cached(df: DataFrame, path: str, csv: bool = False) -> DataFrame:
    """``df`` as a written table at ``path``, made anew; as CSV with a header if asked for."""
    writer = df.write.mode("overwrite")
    if csv:
        writer.option("header", True).csv(path)
        return df.sparkSession.read.option("header", True).schema(df.schema).csv(path)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)
