"""Quality classifier: hashed word n-gram logistic regression fitted by FTRL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import crc_remainder

#: Labelled documents that the fit takes at most.
TRAIN_ROWS = 12_000
#: Scores from here on are accepted.
ACCEPT = 0.7
HELD_OUT = (4, 2)


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> linear.LinearModel:
    """Fit on labels of rows whose crc32(doc_id) mod 4 is not 2; at most ``train_rows``."""
    modulus, held = HELD_OUT
    sample = linear.labelled_sample(docs, labels, "quality", crc_remainder(F.col("doc_id"), modulus) != held, train_rows, 8)
    return linear.fit(sample, linear.style_features, alpha=0.5, l1=0.05, l2=0.1, epochs=3)


def score_quality(docs: DataFrame, model: linear.LinearModel, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1) of its whole text.

    Only the text is an input.  Null and empty texts get the score of no
    features, the same for all; equal texts get equal scores; an empty table
    gives none.  Without any label the model scores 0.5 everywhere.
    """
    return docs.withColumn(column, model.scores(docs, F.col("text")))
