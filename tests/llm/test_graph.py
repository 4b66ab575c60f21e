"""Components against a plain union-find, and tables in the shared folder."""

import random

from quillon.llm import graph, store


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stored_tables(spark):
    df = store.stored(spark.range(5), "five")
    assert df.count() == 5 and df.dtypes == spark.range(5).dtypes
    store.discard(df)
    store.discard(spark.range(3))
