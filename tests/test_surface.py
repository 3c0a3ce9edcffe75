"""Table functions, SQL surface and section choices by hand."""

import numpy as np
import pytest

from cytoweave.functions import generators
from cytoweave.operators import augment, track


def test_table_functions_from_sql(spark):
    generators.register(spark)
    spark.createDataFrame([(1, 100, 100), (2, 300, 100), (3, None, 5)], "id int, h int, w int").createOrReplaceTempView("sizes")
    tiles = spark.sql("SELECT id, t.* FROM sizes s, LATERAL tiles_of(s.h, s.w) t ORDER BY id, tile").collect()
    assert [tuple(x) for x in tiles if x.id == 1] == [(1, 0, 0, 0, 100, 100)]
    two = [x for x in tiles if x.id == 2]
    assert two[0].r0 == 0 and max(x.r0 + x.height for x in two) >= 300 and max(x.c0 + x.width for x in two) >= 100 and not [x for x in tiles if x.id == 3]
    crops = spark.sql("SELECT id, e.draw, e.r0, e.c0 FROM sizes s, LATERAL examples_of(s.h, s.w, 90, 40) e WHERE id = 2 ORDER BY draw").collect()
    assert [tuple(x)[1:] for x in crops] == [(1, 0, 0), (2, 0, 40), (3, 90, 0), (4, 90, 40), (5, 180, 0), (6, 180, 40)]
    cells = spark.sql("SELECT m.* FROM (SELECT array(1.0D, 0.0D, 0.0D, 1.0D, 0.0D, 0.0D, 0.0D, 0.0D, 1.0D) AS v) s, LATERAL masks_of(s.v, 3, 0.5D) m ORDER BY cell, r, c").collect()
    assert [tuple(x) for x in cells] == [(1, 0, 0), (1, 1, 0), (2, 2, 2)]
    assert tuple(spark.sql("SELECT iou(4, 9, 9), containment(4, 9, 5)").first()) == (4 / 14, 0.8)


def test_section_choices():
    assert augment.section_choices(3, 2) == [[0, 1], [0, 2], [1, 2]]
    assert [0, 3] not in augment.section_choices(4, 2) and len(augment.section_choices(5, 5)) == 1
    assert augment.section_choices(2, 3) == []


def test_sections_are_chosen_for_each_frame(spark):
    px = spark.createDataFrame([(f, z, 0, 0, float(z)) for f in range(60) for z in range(4)], "frame_id long, z int, r int, c int, v double")
    got = {}
    for x in augment.choose_sections(px, 4, 2, 1).orderBy("frame_id", "z").collect():
        got.setdefault(x.frame_id, []).append(int(x.v))
    assert len(got) == 60 and {tuple(v) for v in got.values()} == {tuple(v) for v in augment.section_choices(4, 2)}
    mean = {x.frame_id: x.v for x in augment.choose_sections(px, 4, 2, 1, mean=True).collect()}
    assert all(mean[f] == sum(v) / 2 for f, v in got.items())
    with pytest.raises(ValueError, match="fewer"):
        augment.choose_sections(px, 4, 5, 1)


def test_reducers_by_name(spark):
    rows = spark.createDataFrame([(1, tp, 1, float(tp), 0.0) for tp in range(4)], "series long, tp int, cell int, x double, y double")
    by = lambda reduce: [x.label for x in track.track(rows, scale=(1.0, 1.0), reduce=reduce).orderBy("tp").collect()]
    assert by("max") == by(np.maximum) and by("sum") == by(np.add) and by("min") == by(np.minimum)
