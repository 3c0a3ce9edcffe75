"""Link classifiers with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import confusion_counts, rates
from .track import candidate_pairs


def link_rows(objects: DataFrame, features: Sequence[str] = ("x", "y"), truth: str = "label") -> DataFrame:
    """Pairs of objects of consecutive frames: differences of features and whether they are one object."""
    told = objects.withColumn("_truth", F.col(truth)).dropna(subset=["tp", "cell"])
    met = candidate_pairs(told, features, 1, ["_truth"])
    return met.withColumn("same", (F.col("_truth") == F.col("prev__truth")).cast("double")).drop("_truth", "prev__truth")


def with_balance(rows: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: each class has the same total."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    return rows.join(F.broadcast(n), label).withColumn("weight", 1.0 / F.col("_n")).drop("_n")


def forest(features: Sequence[str], label: str, trees: int = 20, depth: int = 4, seed: int = 1) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), RandomForestClassifier(featuresCol="_features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)])


def linear_machine(features: Sequence[str], label: str) -> Pipeline:
    """Linear kernel only: Spark has no distributed kernel machine."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), LinearSVC(featuresCol="_features", labelCol=label, weightCol="weight")])


def explore(rows: DataFrame, features: Sequence[str], label: str, trees: Sequence[int] = (20, 25, 30), depths: Sequence[int] = (3, 4, 5), folds: int = 5, metric: str = "f1", parallelism: int = 4) -> CrossValidatorModel:
    """Cross-validated grid of forests, refitted on all rows with the best parameters."""
    pipe = forest(features, label)
    trees_ = ParamGridBuilder().addGrid(pipe.getStages()[1].numTrees, list(trees)).addGrid(pipe.getStages()[1].maxDepth, list(depths)).build()
    by = MulticlassClassificationEvaluator(labelCol=label, metricName=metric, metricLabel=1.0)
    return CrossValidator(estimator=pipe, estimatorParamMaps=trees_, evaluator=by, numFolds=folds, parallelism=parallelism, seed=1).fit(with_balance(rows, label))


def probabilities(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds ``p``; rows with a missing feature have probability 0."""
    whole = rows.dropna(subset=list(features))
    scored = model.transform(whole).withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")
    missing = " or ".join(f"`{f}` is null" for f in features)
    return scored.union(rows.filter(missing).withColumn("p", F.lit(0.0)))


def performance(scored: DataFrame, label: str, split: str = "split", threshold: float = 0.5) -> DataFrame:
    """Confusion counts and rates of each split."""
    return rates(confusion_counts(scored, F.col(label) == 1, F.col("p") > threshold, [split]))


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def grid_summary(model: CrossValidatorModel, rows: DataFrame) -> DataFrame:
    """(params, score, sd, rank) of each point of a cross-validated grid, the best first; params: name to value.

    rows: any table of the session that is to hold the summary.
    """
    scores = model.avgMetrics
    sd = model.stdMetrics or [None] * len(scores)
    order = sorted(range(len(scores)), key=lambda k: (-scores[k], k))
    listed = [({p.name: str(v) for p, v in model.getEstimatorParamMaps()[k].items()}, float(scores[k]), None if sd[k] is None else float(sd[k]), n) for n, k in enumerate(order, 1)]
    return rows.sparkSession.createDataFrame(listed, "params map<string,string>, score double, sd double, rank int")


def precision_recall_curve(scored: DataFrame, label: str, keys: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """(keys, threshold, tp, n, precision, recall) of p >= threshold at every p that occurs, cut to ``digits`` decimals.

    Rows are counted by threshold first, so a window holds at most 10^digits + 1
    rows of a key.  Recall is null without any true row.  Rows with a null p are
    never taken, but are owed if true.
    """
    at = F.floor(F.col("p") * 10**digits) / 10**digits
    counts = scored.groupBy(*keys, at.alias("threshold")).agg(F.count("*").alias("_n"), F.sum((F.coalesce(F.col(label).cast("double"), F.lit(0.0)) == 1).cast("long")).alias("_t"))
    down = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    tp, n = F.sum("_t").over(down), F.sum("_n").over(down)
    owed = F.sum("_t").over(Window.partitionBy(*keys))
    curve = counts.select(*keys, "threshold", tp.alias("tp"), n.alias("n"), (tp / n).alias("precision"), F.try_divide(tp, owed).alias("recall"))
    return curve.filter(F.col("threshold").isNotNull())
