"""Set operations on masks, feature lists, splits and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACE = ("frame_id", "r", "c")


def union(a: DataFrame, b: DataFrame, place: Sequence[str] = PLACE) -> DataFrame:
    """Pixels of either mask."""
    return a.select(*place).unionByName(b.select(*place)).distinct()


def intersection(a: DataFrame, b: DataFrame, place: Sequence[str] = PLACE) -> DataFrame:
    """Pixels of both masks."""
    return a.select(*place).intersect(b.select(*place))


def difference(a: DataFrame, b: DataFrame, place: Sequence[str] = PLACE) -> DataFrame:
    """Pixels of the first mask that the second has not."""
    return a.select(*place).exceptAll(b.select(*place)).distinct() if set(a.columns) == set(place) == set(b.columns) else a.select(*place).distinct().join(b.select(*place).distinct(), list(place), "left_anti")


def feature_union(main: Column, backup: Column) -> Column:
    """Features of two models, each once, sorted."""
    return F.array_sort(F.array_union(main, backup))


def concat_splits(splits: dict[str, DataFrame], keys: Sequence[str], name: str = "split") -> DataFrame:
    """All splits with their name; of rows with equal keys that of the first split stays."""
    out = None
    for k, (split, rows) in enumerate(splits.items()):
        part = rows.withColumn(name, F.lit(split)).withColumn("_k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    first = Window.partitionBy(*keys).orderBy("_k", *[c for c in out.columns if c not in (*keys, "_k")])
    return out.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_k", "_n")


def drop_empty(labels: Column, sizes: Column) -> Column:
    """Labels whose mask has any pixel, in order; arrays in step."""
    kept = F.filter(F.arrays_zip(labels.alias("l"), sizes.alias("n")), lambda x: x["n"] > 0)
    return F.transform(kept, lambda x: x["l"])
