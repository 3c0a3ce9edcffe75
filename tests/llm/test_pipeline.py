"""Each stage of the pipeline on its own input against brute force."""

import os

import pytest

import corpus_pipeline
from cytoweave.llm import decontam, quality
from cytoweave.llm.common import materialise
from cytoweave.llm.hashing import text_bytes

from .test_native import WORDS, brute_lines
from .test_texts import brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 120 and n_chars < 4000")
    columns = docs.columns
    bench = [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]

    rows = [(x.doc_id, x.text) for x in docs.collect()]
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = [(i, t) for i, t in rows if model.score(text_bytes(t)) >= quality.ACCEPT]
    docs = materialise(stages["quality"](spark, docs, SF), "t")
    assert docs.columns == columns and sorted((x.doc_id, x.text) for x in docs.collect()) == sorted(want)

    docs = docs.filter("n_chars < 1500")
    rows = [(x.doc_id, x.text, "s") for x in docs.collect()]
    gone = brute_lines(rows, 50)
    want = {i: "\n".join(v for k, v in enumerate(t.split("\n")) if k not in set(gone[(i, t)])) for i, t, _ in rows}
    want = {i: t for i, t in want.items() if WORDS.search(t)}
    docs = materialise(stages["line_dedup"](spark, docs, SF), "t")
    assert docs.columns == columns and {x.doc_id: x.text for x in docs.collect()} == want

    rows = sorted(want.items())
    components, _ = brute_components(rows, 5, 80)
    docs = materialise(stages["near_dedup"](spark, docs, SF), "t")
    assert docs.columns == columns and {x.doc_id for x in docs.collect()} == {i for (i, _), c in zip(rows, components, strict=True) if i == c}

    rows = [(x.doc_id, x.text) for x in docs.collect()]
    clean = {i for i, t in rows if not any(decontam.myers_distance(n, decontam.normalise(t)) <= decontam.error_budget(n) for _, s in bench if (n := decontam.normalise(s)))}
    docs = materialise(stages["decontamination"](spark, docs, SF), "t")
    assert docs.columns == columns and {x.doc_id for x in docs.collect()} == clean

    got = stages["mixing"](spark, docs, SF).collect()
    sizes = {x.doc_id: len(WORDS.findall(x.text)) for x in docs.collect()}
    assert all(x.size == sizes[x.doc_id] and 0 < x.taken <= 2 * x.size for x in got)
    taken, target = {}, {x.source: x.target for x in got}
    for x in got:
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(taken[s] == int(target[s] + 1e-9) for s in taken)


def test_stages_of_nothing(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
