"""Near-duplicates, decontamination and classifiers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoweave.llm import decontam, linear, neardup, quality, toxicity
from cytoweave.llm.common import crc_remainder
from cytoweave.llm.hashing import shingle_set, text_bytes, word_hashes

CLASHING = ("class", "component", "taken", "_id", "_hash", "text_hash", "kept", "band", "token", "a", "b", "node")
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *["c"] * len(CLASHING)) for i, t in rows], SCHEMA)


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ")
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in w if x]
        n = min(width, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k][0])
    return [min((i for i in groups[root(k)] if i is not None), default=None) if sets[k] else rows[k][0] for k in range(len(rows))], [len(s) for s in sets]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rng = random.Random(width)
    vocabulary = ["w%d" % k for k in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 80, 200]))]
        for _ in range(rng.randint(1, 25)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + g, rng.choice([" ", "\n"]).join(t)))
    rows += [(9000, ""), (9001, None), (9002, " \t\n"), (9003, "Alone"), (9004, "aLONE"), (None, rows[0][1]), (None, "nobody else here at all"), (rows[5][0], rows[5][1]), (9010, "long " * 30_000 + "tail")]
    got = neardup.near_duplicates(docs(spark, rows), width).collect()
    want, sizes = brute_components(rows, width, 80)
    show = lambda ids, n, comp: sorted(map(str, zip(ids, n, comp, strict=True)))
    assert show([x.doc_id for x in got], [x.n_shingles for x in got], [x.component_id for x in got]) == show([r[0] for r in rows], sizes, want)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got if x.doc_id is not None)
    left = neardup.drop_near_duplicates(docs(spark, rows), width)
    assert left.columns == docs(spark, []).columns and left.count() == sum(x.kept for x in got)
    assert neardup.near_duplicates(docs(spark, []), width).count() == 0


def test_rare_pairs_miss_no_similar_pair(spark):
    """Templates with own parts, edited copies and their neighbours: what the filter leaves holds all similar pairs."""
    rng = random.Random(8)
    template = [f"common{k}" for k in range(60)]
    rows = []
    for k in range(150):
        own = rng.choice([2, 6, 8, 10, 20])
        rows.append(" ".join([f"own{k % 90}x{j}" for j in range(own)] + template[: rng.choice([30, 58, 60])]))
    made = spark.createDataFrame([(f"c{k}", f"g{k % 7 if k < 50 else k}", t) for k, t in enumerate(rows)], "class string, component string, text string")
    got = {(r.a, r.b) for r in neardup._rare_pairs(made, 2, 80).collect()}
    sets = [{tuple(w[j : j + 2]) for j in range(len(w) - 1)} for w in (t.split() for t in rows)]
    group = [k % 7 if k < 50 else k for k in range(len(rows))]
    want = {tuple(sorted((f"c{a}", f"c{b}"))) for a in range(len(rows)) for b in range(a) if group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert got >= want and len(want) > 50 and len(got) < 0.5 * len(rows) ** 2 / 2


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    same = (neardup.circulant_signature(np.sort(a), 512) == neardup.circulant_signature(np.sort(b), 512)).mean()
    assert abs(same - 800 / 1200) < 0.08


def test_word_hashes_do_not_depend_on_place_or_block():
    words = ["ab", "ß", "x" * 900, "1"] * 2000
    text = " ".join(words).encode()
    h = word_hashes(text_bytes(text))
    assert len(h) == len(words) and len(set(h.tolist())) == 4
    assert (h[:4] == word_hashes(text_bytes("AB\nß\t" + "X" * 900 + "  1"))).all()
    assert len(word_hashes(text_bytes("y" * 2_000_000 + " z"))) == 2
    assert len(shingle_set(h[:0], 2)) == 0 and len(shingle_set(h[:1], 2)) == 1


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_myers_equals_the_table():
    rng = random.Random(3)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        assert decontam.myers_distance(p, t) == edit_distance_inside(p, t)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioustr") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randint(8, 40)))) for k in range(12)] + [(50, ""), (51, None), (None, "the item without any name at all")]
    rows = []
    for k in range(60):
        text = " ".join(word() for _ in range(50))
        if k % 2:
            item = list(items[k % 12][1])
            for _ in range(rng.randint(0, 1 + len(item) // 15)):
                item[rng.randrange(len(item))] = rng.choice("xyz ")
            at = rng.randrange(len(text))
            text = text[:at] + " " + "".join(item).upper() + "\n" + text[at:]
        rows.append((k, text))
    rows += [(100, None), (101, ""), (102, "x The ITEM without\tany name at all y"), (1, rows[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontam.find_contamination(docs(spark, rows), bench).collect()}
    want = {}
    for i, t in rows:
        for j, s in items:
            n, m = decontam.normalise(t), decontam.normalise(s)
            if n and m:
                k = edit_distance_inside(m, n)
                if k <= decontam.error_budget(m):
                    want[(i, j)] = k
    assert got == want and len(want) > 10
    clean = decontam.decontaminate(docs(spark, rows), bench)
    assert {x.doc_id for x in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert clean.columns == docs(spark, []).columns
    assert decontam.find_contamination(docs(spark, []), bench).count() == 0
    assert decontam.decontaminate(docs(spark, rows), bench.filter("false")).count() == len(rows)


def labelled(spark, n=600):
    rng = random.Random(5)
    good = ["river", "stone", "under", "light", "house", "green", "walked", "slowly"]
    rows, marks = [], []
    for k in range(n):
        t = [rng.choice(good) for _ in range(40)]
        bad, toxic = k % 5 == 0, k % 7 == 0
        if toxic:
            t[3:3] = [rng.choice(["idiot", "zargling", "zargloon", "moron", "scum"])] * rng.randint(1, 3)
        text = " | ".join(t) if bad else " ".join(t).capitalize() + "."
        rows.append((k, text))
        marks.append((k, int(not bad), int(toxic)))
    rows += [(9000, ""), (9001, None), (None, "river stone"), (3, rows[3][1]), (9002, "river " * 50_000)]
    marks += [(9000, None, None), (None, 1, 1), (3, 1, 0)]
    return docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column, cut, modulus, held):
    met = scored.join(labels.filter(F.col(column).isNotNull()).distinct(), "doc_id").filter(crc_remainder(F.col("doc_id"), modulus) == held)
    return met.agg(F.avg(((F.col("score") >= cut).cast("int") == F.col(column)).cast("double"))).first()[0]


def test_quality_on_held_out_rows(spark):
    d, labels = labelled(spark)
    model = quality.fit_quality(d, labels)
    scored = quality.score_quality(d, model).cache()
    assert scored.columns == [*d.columns, "score"] and scored.count() == d.count()
    assert accuracy(scored, labels, "quality", quality.ACCEPT, *quality.HELD_OUT) > 0.97
    blank = {x.score for x in scored.filter("doc_id in (9000, 9001)").collect()}
    assert len(blank) == 1 and scored.filter("score < 0 or score > 1").count() == 0
    assert len({x.score for x in scored.filter("doc_id = 3").collect()}) == 1
    assert quality.score_quality(d.filter("false"), model).count() == 0
    again = quality.fit_quality(d.repartition(5), labels)
    assert np.array_equal(again.weights, model.weights)


def test_toxicity_on_held_out_rows(spark):
    d, labels = labelled(spark)
    model = toxicity.fit_toxicity(d, labels)
    scored = toxicity.score_toxicity(d, model).cache()
    assert accuracy(scored, labels, "toxic", toxicity.ACCEPT, *toxicity.HELD_OUT) > 0.95
    assert scored.count() == d.count() and len({x.score for x in scored.filter("doc_id in (9000, 9001)").collect()}) == 1
    assert model.label_model.posterior[0, toxicity.UNKNOWN] < 0.5
    assert toxicity.score_toxicity(d.filter("false"), model).count() == 0


def test_classifiers_without_labels(spark):
    d, labels = labelled(spark, 40)
    none = labels.filter("false")
    assert {x.score for x in quality.score_quality(d, quality.fit_quality(d, none)).collect()} == {0.5}
    assert toxicity.score_toxicity(d, toxicity.fit_toxicity(d, none)).count() == d.count()


def test_label_model_finds_rates_and_dependence():
    """Rows drawn from a known model: rates, label accuracy and a copied voter are found without the truth."""
    rng, m, n = np.random.default_rng(4), len(toxicity.VOTERS), 60_000
    toxic = rng.random(n) < 0.15
    hit, false = np.linspace(0.35, 0.8, m), np.linspace(0.002, 0.02, m)
    x = rng.random((n, m)) < np.where(toxic[:, None], hit, false)
    x[:, 1] = x[:, 0]  # one voter is another's copy
    label = np.where(rng.random(n) < 0.3, np.where(toxic ^ (rng.random(n) < 0.06), toxicity.TOXIC, toxicity.OTHER), toxicity.UNKNOWN)
    rows, counts = np.unique(np.stack([(x * (1 << np.arange(m))).sum(axis=1), label], axis=1), axis=0, return_counts=True)
    model = toxicity.fit_label_model(rows[:, 0], rows[:, 1], counts, 0.3)
    rates = np.where(np.arange(m) == 1, hit[0], hit)
    assert np.abs(model.rate_toxic - rates).max() < 0.03 and np.abs(model.rate_other[2:] - false[2:]).max() < 0.01
    assert abs(model.label_right[0] - 0.94) < 0.02 and abs(model.label_right[1] - 0.94) < 0.02
    assert model.parent[1] == 0 or model.parent[0] == 1
    # the posterior of each pattern is that of the true model, in which a copy says nothing new
    free = np.delete(np.arange(m), 1)
    logit = np.log(0.15 / 0.85) + (x[:, free] * np.log(hit[free] / false[free]) + ~x[:, free] * np.log((1 - hit[free]) / (1 - false[free]))).sum(axis=1)
    told = np.select([label == toxicity.TOXIC, label == toxicity.OTHER], [np.log(0.94 / 0.06), np.log(0.06 / 0.94)], 0.0)
    got = model.posterior[(x * (1 << np.arange(m))).sum(axis=1), label]
    assert np.abs(got - 1 / (1 + np.exp(-(logit + told)))).mean() < 0.01


def test_sample_is_bounded(spark):
    d, labels = labelled(spark)
    assert linear.labelled_sample(d, labels, "quality", F.lit(True), 50, 1).select("order_key").distinct().count() == 50
