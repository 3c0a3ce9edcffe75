"""Connected components of chains, stars and random links."""

import random

import pytest

from cytoweave.llm import neardup
from cytoweave.llm.components import connected_components


def brute(links):
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in links:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((k, root(k)) for k in parent)


def chain(n, seed):
    names = [f"{k:05d}" for k in range(n)]
    random.Random(seed).shuffle(names)
    return list(zip(names, names[1:], strict=False))


def shapes():
    rng = random.Random(3)
    yield chain(3000, 1)
    yield [(f"{k:05d}", f"{k + 1:05d}") for k in range(2000)]
    star = [("m", f"{'a' if k % 2 else 'z'}{k}") for k in range(200)]
    sparse = [(f"r{rng.randrange(500)}", f"r{rng.randrange(500)}") for _ in range(260)]
    yield [*star, *sparse, ("self", "self"), ("q", None), (None, None), ("p", "o"), ("o", "p"), ("p", "o")]


@pytest.mark.parametrize("links", list(shapes()), ids=["chain", "ordered", "mixed"])
def test_components_of_any_shape(spark, links):
    got = connected_components(spark.createDataFrame(links, "a string, b string"))
    assert sorted((x.node, x.component) for x in got.collect()) == brute(links)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_versions_edited_one_from_the_other(spark):
    words = [f"w{k}" for k in range(2050)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 40])) for k in range(1000)]  # near only to the next ones
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == 1000 and {x.component_id for x in got} == {0}
