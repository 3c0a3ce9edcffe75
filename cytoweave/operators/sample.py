"""Splits, repeats, subsamples and bootstraps from seeded hashes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import numbered


def draw(seed: int | str, *keys: Column) -> Column:
    """A portable hash of a seed and keys as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def group_split(rows: DataFrame, group: Sequence[str], val_size: float = 0.2, test_size: float = 0.2, seed: int = 1) -> DataFrame:
    """Adds ``split``; all rows of a group fall together.  Distinct groups are shuffled by hash and cut by count."""
    groups = rows.select(*group).distinct().withColumn("_draw", draw(seed, *[F.col(g) for g in group]))
    ranked = numbered(groups, "_draw", *group, name="_k")
    n = F.lit(ranked.count())
    split = F.when(F.col("_k") <= F.floor(n * (1 - val_size - test_size)), "train").when(F.col("_k") <= F.floor(n * (1 - test_size)), "validation").otherwise("test")
    return rows.join(ranked.select(*group, split.alias("split")), list(group))


def missing_as_group(value: Column, row_id: Column, falsy: bool = False) -> Column:
    """Null is a group of its own for each row; ``falsy`` also takes 0 and the empty text so."""
    text = value.cast("string")
    absent = value.isNull() | text.isin("", "0", "0.0") if falsy else value.isNull()
    return F.when(absent, F.concat(F.lit("missing_"), row_id.cast("string"))).otherwise(text)


def balanced_repeat(images: DataFrame, h: Column, w: Column, aug_h: int, aug_w: int) -> DataFrame:
    """Each image once for each crop of the augmented size that fits, at least once."""
    n = F.greatest(F.floor(h / aug_h), F.lit(1)) * F.greatest(F.floor(w / aug_w), F.lit(1))
    return images.withColumn("draw", F.explode(F.sequence(F.lit(1), n.cast("int"))))


def every_kth(rows: DataFrame, fraction: float, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every k-th row of each group, k = max(floor(1 / fraction), 1)."""
    k = max(int(1 / fraction), 1)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter((F.col("_k") - 1) % k == 0).drop("_k")


def poisson_cuts(rate: float, resolution: int) -> list[int]:
    """Distribution of Poisson(rate) in ``resolution``-ths, until the resolution is used up."""
    p, total, out, k = math.exp(-rate), 0.0, [], 0
    while not out or out[-1] < resolution - 1:
        total += p
        out.append(min(int(round(total * resolution)), resolution))
        k += 1
        p *= rate / k
        if p * resolution < 0.25:
            break
    return out


def bootstrap(rows: DataFrame, n_boot: int, seed: int, *keys: str, fraction: float = 0.9) -> DataFrame:
    """Bootstrap by hash: ``fraction`` of the rows drawn with replacement in each of ``n_boot`` resamples.

    Draws are Poisson: the copies of a row are independent of all others, so no
    resample is ever gathered; its size is ``fraction`` of the rows on average.
    ``copies`` counts a row's draws and ``boot`` its resample; each copy is an
    example of its own (``draws``).
    """
    boots = rows.withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    u = F.conv(F.substring(draw(seed, F.col("boot"), *[F.col(k) for k in keys]), 1, 7), 16, 10).cast("long")
    n = sum((F.when(u >= cut, 1).otherwise(0) for cut in poisson_cuts(fraction, 1 << 28)), F.lit(0))
    return boots.withColumn("copies", n.cast("int")).filter("copies > 0")


def draws(resampled: DataFrame) -> DataFrame:
    """One row for each copy, numbered by ``draw``, so that repeats count apart."""
    return resampled.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def with_weights(rows: DataFrame, weight: str = "weight") -> DataFrame:
    """Sample weights; rows without one, or a table without the column, weigh 1."""
    return rows.withColumn(weight, F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight in rows.columns else F.lit(1.0))


def standard_error(values: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and standard error (population deviation by root n) over bootstraps."""
    return values.groupBy(key).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("se"))
