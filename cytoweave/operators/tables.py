"""Tables that cut a lineage in the shared checkpoint folder, and numbers along a whole order."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder that ``spark.checkpoint.dir`` names.

    Where that is unset on a single machine (a local master, as in tests) a
    temporary folder is made; a cluster must name one.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Adds the number of each row, from 1, in the order of some columns.

    Rows are dealt by ranges of the order and kept, as a second reading could cut
    them elsewhere.  One count for each range tells where it starts, so a task
    orders its own range only.  Equal rows are numbered in any order.
    """
    dealt = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_k"))
    starts = sizes.select("_range", (F.sum("_k").over(Window.orderBy("_range")) - F.col("_k")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    met = dealt.withColumn("_in", inside).join(F.broadcast(starts), "_range")
    return met.select(*rows.columns, (F.col("_start") + F.col("_in")).alias(name))
