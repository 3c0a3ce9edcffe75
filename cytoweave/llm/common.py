"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of words.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset on a single machine (a local master, as in tests) is a
    temporary folder made and set as checkpoint folder; a cluster must name one.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, in the shared folder."""
    return f"{shared_root(spark)}/cytoweave-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.

    The written table outlives lost executors; ``localCheckpoint`` would not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is hot if it holds at least one in so many rows: so many keys at most are hot.
HOT_SHARE = 2_000


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], size: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and in ``size`` the number of its rows.

    Keys that hold at least one in HOT_SHARE of all rows are at most HOT_SHARE
    many, however large the tables, so their part of ``table`` is broadcast and
    their rows are not dealt by key.  The rest is merge-joined on the keys; hot
    rows and rows with a null key, which meet nothing, are scattered there, so no
    task gets all rows of one key.  ``how`` is inner or left.  Other columns of the
    two must differ.  ``total``, the sum of ``size``, saves a job where it is known;
    ``table`` is read once more for the hot keys.
    """
    if total is None:
        total = table.agg(F.sum(size)).first()[0] or 0
    marked, scatter, there, *copies = free_name(rows.select(*rows.columns, *[F.lit(0).alias(c) for c in table.columns if c not in rows.columns]), "_hot", "_scatter", "_there", *[f"_k{k}" for k in range(len(keys))])
    values = [c for c in table.columns if c not in keys]
    hot = table.filter(F.col(size) * HOT_SHARE >= total)
    near = F.broadcast(hot.select(*[F.col(k).alias(c) for k, c in zip(keys, copies, strict=True)], F.struct(*values).alias(marked)))
    met = rows.join(near, [F.col(k) == F.col(c) for k, c in zip(keys, copies, strict=True)], "left").drop(*copies)
    nowhere = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1
    met = met.withColumn(scatter, F.when(F.col(marked).isNotNull() | nowhere, F.xxhash64(*rows.columns)).otherwise(F.lit(0)))
    # 0 on this side, but no constant: a constant would be folded out of the join's keys, and hot rows be dealt by the others
    zero = F.pmod(F.col(size), F.lit(1)).cast("long")
    cold = table.filter(F.col(size) * HOT_SHARE < total).select(*keys, zero.alias(scatter), F.struct(*values).alias(there))
    found = met.join(cold.hint("merge"), [*keys, scatter], "left")
    value = F.coalesce(F.col(marked), F.col(there))
    if how == "inner":
        found = found.filter(value.isNotNull())
    return found.select(*[F.col(c) for c in rows.columns], *[value[c].alias(c) for c in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Number of words (runs of bytes that are no ASCII white space); null: 0."""
    spaces = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.regexp_count(spaces, F.lit("[^ ]+")), F.lit(0)).cast("long")


def crc_remainder(column: Column, modulus: int) -> Column:
    """crc32 of a value as text, modulo ``modulus``; null like the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't use, one for each wanted."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
