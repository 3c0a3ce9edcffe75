"""Stages that must tell on what follows."""

from pyspark.sql import functions as F

from cytoweave import queries as core


def test_pairs_without_a_feature_are_scored(spark, tmp_path):
    """Of the test frames, the first two objects are the same three pixels: no strip joins them, and one of two pairs is true."""
    e = spark.range(40).select(F.col("id").alias("vec_id"), F.lit(1).alias("label"), F.expr("transform(sequence(0, 63), k -> cast(case when id % 5 = 4 then (k in (3, 11, 19)) else (hash(id, k) % 3 = 0) end as float))").alias("embedding"))
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x.split: x for x in core.queries()["bud_classifier"](spark, str(tmp_path)).collect()}
    assert sorted(got) == ["test", "train", "validation"]
    assert (got["test"].accuracy, got["test"].recall) == (0.5, 0.0)
