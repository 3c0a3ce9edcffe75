"""Jobs that grow with their input only: same results by other ways, brute force on small cases."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoweave.operators import learn, match, tune


def shared(rows):
    """n of each pair of cells (smaller first) that share places."""
    at, n = collections.defaultdict(list), collections.Counter()
    for cell, px in rows:
        if px is not None and cell is not None:
            at[px].append(cell)
    for cells in at.values():
        n.update((min(a, b), max(a, b)) for a, b in itertools.combinations(cells, 2) if a != b)
    return n


def sets(spark, seed=3, objects=40, places=25):
    rng = np.random.default_rng(seed)
    # place 0 is in nearly every object, and one object in nearly every place
    return sorted({(int(c), int(p)) for c in range(objects) for p in range(places) if p == 0 or c == 7 or rng.random() < 0.2})


@pytest.mark.parametrize("block, meetings", [(1024, 4_000_000), (3, 50)])
def test_pairs_of_a_table_with_itself(spark, monkeypatch, block, meetings):
    monkeypatch.setattr(match, "BLOCK", block)
    monkeypatch.setattr(match, "MEETINGS", meetings)
    rows = sets(spark) + [(3, 3), (5, 3), (5, 3), (None, 3), (9, None)]
    df = spark.createDataFrame(rows, "cell int, px int")
    got = {(x.ta, x.tb): (x.n, x.area_a, x.area_b) for x in match.intersections(df, df, ["px"], (), ordered=True).collect()}
    area = collections.Counter(c for c, _ in rows)
    assert got == {(a, b): (n, area[a], area[b]) for (a, b), n in shared(rows).items()}
    assert not match.intersections(df.limit(0), df.limit(0), ["px"], (), ordered=True).collect()


def test_overlaps_by_size_need_no_pairs(spark):
    rows = sets(spark)
    area = collections.Counter(c for c, _ in rows)
    want = collections.Counter()
    for (a, b), n in shared(rows).items():
        want[min(area[a], area[b]), max(area[a], area[b])] += n / min(area[a], area[b])
    by_size = tune.size_overlaps(spark.createDataFrame(rows, "cell int, px int"), ["px"])
    got = {(x.area_lo, x.area_hi): x.frac for x in by_size.groupBy("area_lo", "area_hi").agg(F.sum("frac").alias("frac")).collect() if x.frac}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    t = [3.0, 5.0, 6.0, 9.0]
    cost = {x: round(sum(f for (lo, hi), f in want.items() if hi < x + 1 or lo >= x - 1), 6) for x in t}
    tried = tune.overlap_threshold(by_size, spark.createDataFrame([(x,) for x in t], "t double"), 1)
    assert {x.t: x.cost for x in tried.collect()} == pytest.approx(cost, abs=2e-6)


def counted(spark, df):
    """``df`` and a counter of how often one of its rows is made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    return df.mapInPandas(run, df.schema), made


def test_links_need_one_join(spark):
    rows = [(1, t, c, float(c), 0.0, (t + c) % 2) for t in range(3) for c in range(2)] + [(1, 3, None, 0.0, 0.0, 1)]
    found = learn.link_rows(spark.createDataFrame(rows, "series long, tp int, cell int, x double, y double, label int"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted((x.tp, x.cell, x.prev_tp, x.prev_cell, x.same) for x in found.collect()) == [(t, c, t - 1, p, float((t + c) % 2 == (t - 1 + p) % 2)) for t in (1, 2) for c in (0, 1) for p in (0, 1)]


def test_search_makes_its_table_once(spark):
    rows = [(e, c, float(3 + 2 * c), 0.1 * c, 0.0, c, 0.4 + 0.1 * c) for e in range(5) for c in range(4)]
    stats, made = counted(spark, spark.createDataFrame(rows, "example int, cell int, area double, p_edge double, containment double, assignment int, iou double"))
    best, top = tune.coordinate_search(stats, 10, {"lower": [1, 6], "p_edge_min": [0.0, 0.2]}, {"lower": 1.0, "upper": 50.0, "p_edge_min": 0.0, "max_containment": 1.0})
    assert made.value == len(rows)
    assert (best["lower"], best["p_edge_min"]) == (1.0, 0.0) and abs(top - 1.0) < 1e-12  # 15 hits of 20 objects, 10 owed
