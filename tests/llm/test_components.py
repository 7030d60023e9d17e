"""Connected components: every vertex leaves the graph once, and what is settled is not gone over again."""

import random

import pytest
from pyspark.sql import functions as F

from loglathe.llm import components as module
from loglathe.llm.tables import Tables


def reached(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in list(root)}


RNG = random.Random(3)
SHAPES = {
    "none": [],
    "self": [(4, 4), (None, 3), (3, None)],
    "path": [(i, i + 1) for i in range(200)],
    "zigzag": [(i, 200 - i) for i in range(100)] + [(i, 201 - i) for i in range(1, 101)],
    "star below": [(0, i) for i in range(1, 300)],
    "star above": [(500, i) for i in range(300)],
    "ring": [(i, (i + 7) % 90) for i in range(90)],
    "clique": [(i, j) for i in range(20) for j in range(i)],
    "sparse": [(RNG.randrange(400), RNG.randrange(400)) for _ in range(180)],
    "negative": [(-5, 3), (3, -9), (7, 8), (8, 7), (8, 7)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_roots_are_the_smallest_vertices_reached(spark, shape):
    links = SHAPES[shape]
    got = module.components(Tables(spark, "test"), spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted(reached(links).items())


def test_settled_links_are_not_joined_again(spark, monkeypatch):
    heads, members = 24, 2000
    rng = random.Random(1)
    links = [(rng.randrange(t, 2 * heads), 100 + i) for t in range(heads) for i in range(members)]
    joined = []
    plain = module._spread

    def counted(edges):
        joined.append(edges.count())
        return plain(edges)

    monkeypatch.setattr(module, "_spread", counted)
    got = module.components(Tables(spark, "test"), spark.createDataFrame(links, "a long, b long"))
    assert {(r["node"], r["root"]) for r in got.collect()} == set(reached(links).items())
    assert sum(joined) < members
    assert got.select("node").distinct().count() == got.count() == got.agg(F.count("root")).first()[0]
