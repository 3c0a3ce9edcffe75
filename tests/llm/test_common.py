"""Helpers of the training-data operators."""

import pytest
from pyspark.sql import functions as F

from cytoweave.llm import common, linear


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_is_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_SHARE", 5)
    rows = spark.createDataFrame([(k, None if k % 11 == 0 else "hot" if k % 2 else f"k{k % 40}", k % 3) for k in range(300)], "id long, a string, b long")
    table = rows.filter("b < 2 and a is not null").groupBy("a", "b").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    got = common.join_hot(rows, table, ["a", "b"], "size", how)
    want = rows.join(table, ["a", "b"], how).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # hot rows are dealt by more than their key
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_scatter" in next(x for x in plan.splitlines() if "SortMergeJoin" in x)
    assert table.filter(F.col("size") * 5 >= table.agg(F.sum("size")).first()[0]).count() >= 1


def test_samples_are_bounded_by_rows(spark):
    docs = spark.createDataFrame([(7, f"copy {k % 3}") for k in range(500)] + [(k, f"text {k}") for k in range(8, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(40)] * 2, "doc_id long, toxic int")
    got = linear.labelled_sample(docs, labels, "toxic", F.lit(True), 10, 1)
    assert got.count() <= 10
    assert linear.labelled_sample(docs, labels, "toxic", F.lit(True), 100, 1).count() == 33
