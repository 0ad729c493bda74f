"""Connected components against union-find, in one task and by contractions."""

import random

import pytest

from assize.operators.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("one_task", [0, 100_000])
@pytest.mark.parametrize("name", [int, "n{:04d}é".format])
def test_components(spark, one_task, name):
    rng = random.Random(4)
    path = [(k, k + 1) for k in range(0, 60)]
    hub = [(100, k) for k in range(101, 180)]
    some = [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    edges = [(name(a), name(b)) for a, b in path + hub + some + [(500, 500), (7, 3), (7, 3)]]
    rng.shuffle(edges)
    kind = "long" if name is int else "string"
    table = spark.createDataFrame(edges + [(None, edges[0][0])], f"a {kind}, b {kind}").repartition(5)
    got = [tuple(r) for r in connected_components(table, "a", "b", hot_rows=20, one_task=one_task).collect()]
    assert len(got) == len(set(got)) and dict(got) == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
