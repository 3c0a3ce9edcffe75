"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key.  Documents are range-sorted by that key
within their source; since keys are uniform, equal key ranges are equal shares,
so a source of any size is dealt over as many key ranges as it needs.  The
running word count of a document is the sum of the ranges before its own plus
the running sum inside its range: a distributed prefix sum.  The source's budget
is then cut at the exact word; budgets above a source's size repeat epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes.
SHARE = 1.5
#: No source gives more than so many times its size.
EPOCHS = 2
#: Hexadecimal digits of the key that name its range: 16^3 ranges of each source.
RANGE_DIGITS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) -> target of each source.

    Water filling: a source whose cap (``epochs`` times its size) lies below its
    share of the level takes the cap, the rest share what is left by weight.
    Sources in order of cap by weight make this a prefix sum: the level is found
    at the first source that the caps before it leave unfilled.  There is one row
    for each source; documents never meet here.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * epochs)
    everything = Window.partitionBy(F.lit(0))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("_all") * F.lit(float(share)) - F.col("_caps")) / (F.col("_ws") - F.col("_taken_w"))
    return (
        ranked.withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_ws", F.sum("_w").over(everything))
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_taken_w", F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_level", level)
        .withColumn("_open", F.col("_cap") > F.col("_level") * F.col("_w"))
        .withColumn("_final", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"), F.col("_level")))).over(everything)["_level"])
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap").cast("double"))))
        .select("source", "source_size", "target")
    )


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Every document with the words that the mix takes from it.

    Adds ``size``, ``source_size``, ``target``, ``taken`` and ``order_key`` to
    doc_id and source.  Null text has size 0; a null source is a source of its
    own, last in order.  Null doc_id is keyed as empty text.  Rows that repeat
    are mixed one by one; rows equal in doc_id and size are alike, so which of
    them is cut makes no difference.  No rows in, no rows out.  Other columns are
    ignored.  Reruns agree, whatever the partitioning.
    """
    text_key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # texts are read and counted once; what follows reads keys and sizes only
    keyed = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_key.alias("order_key")), "keyed").withColumn("_range", F.substring("order_key", 1, RANGE_DIGITS))
    ranges = keyed.groupBy("source", "_range").agg(F.sum("size").alias("_in_range"))
    sizes = ranges.groupBy("source").agg(F.sum("_in_range").alias("source_size"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_start", F.coalesce(F.sum("_in_range").over(before), F.lit(0)))
    bounds = starts.alias("r").join(source_targets(sizes, weights, share, epochs).alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(F.col("r.source").alias("_s"), F.col("_range").alias("_r"), "_start", "source_size", "target")
    inside = Window.partitionBy("source", "_range").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_off", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bounds, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    budget = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - full * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start") - F.col("_off")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (full * F.col("size") + part).cast("long").alias("taken"), "order_key")


ORACLE_SQL = r"""
WITH k AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS order_key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, source_size * 2 AS cap FROM s),
f AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS want, sum(w) OVER () AS ws,
         coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS tw
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (want - caps)::DOUBLE / (ws - tw)::DOUBLE AS level FROM f),
m AS (SELECT min_by(level, cap::DOUBLE / w) AS final FROM l WHERE cap > level * w),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(final * w, cap::DOUBLE)) AS target FROM l, m),
p AS (
  SELECT k.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY order_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken
FROM b
"""
