"""The quality query recomputed in plain Python: sample, features, FTRL and scores."""

import math
import zlib

import numpy as np

from cytoweave.llm import linear, quality
from cytoweave.llm import queries as llm
from cytoweave.llm.hashing import text_bytes

SF = "/root/testdata/sf0.001"


def plain_ftrl(examples, bits, alpha, beta, l1, l2, epochs):
    """Per-coordinate follow-the-regularised-leader over dictionaries, one number at a time."""
    z, n = {}, {}

    def weight(i, bias=False):
        a, b = z.get(i, 0.0), n.get(i, 0.0)
        if bias:
            return -a / ((beta + math.sqrt(b)) / alpha)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(b)) / alpha + l2)

    for _ in range(epochs):
        for index, value, y in examples:
            w = {i: weight(i) for i in index}
            bias = weight("bias", True)
            p = 1 / (1 + math.exp(-max(-40, min(40, bias + sum(w[i] * v for i, v in zip(index, value, strict=True))))))
            for i, v, wi in [*((i, v, w[i]) for i, v in zip(index, value, strict=True)), ("bias", 1.0, bias)]:
                g = (p - y) * v
                old = n.get(i, 0.0)
                sigma = (math.sqrt(old + g * g) - math.sqrt(old)) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * wi, old + g * g
    return {i: weight(i) for i in z if i != "bias"}, weight("bias", True)


def test_quality_query_recomputed(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    crc = lambda i: zlib.crc32(str(i).encode()) % 4
    learn = spark.createDataFrame([(i,) for i in labels if i in docs and crc(i) != 2], "doc_id long")
    order = [r.doc_id for r in learn.selectExpr("doc_id", "xxhash64(8, doc_id) as k").orderBy("k", "doc_id").collect()]
    made = {i: linear.style_features(text_bytes(t)) for i, t in docs.items()}
    examples = [(made[i][0].tolist(), made[i][1].tolist(), float(labels[i])) for i in order]
    weights, bias = plain_ftrl(examples, linear.BITS, 0.5, 1.0, 0.05, 0.1, 3)
    got = {r.doc_id: r for r in llm.queries()["op8_quality"](spark, SF).collect()}
    assert set(got) == set(docs) and len(examples) > 20
    for i, r in got.items():
        score = 1 / (1 + math.exp(-max(-40, min(40, bias + sum(weights.get(k, 0.0) * v for k, v in zip(made[i][0].tolist(), made[i][1].tolist(), strict=True))))))
        assert abs(score - r.score) < 1e-4 and r.held_out == (crc(i) == 2), i
        assert r.predicted == int(r.score >= quality.ACCEPT)
    assert np.isfinite([r.score for r in got.values()]).all()
