"""Components against union-find on random and extreme graphs."""

import random

import pytest

from sievework.operators.components import connected_components


def plain(edges):
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {v: find(v) for v in parent}


random.seed(1)
GRAPHS = {
    "empty": [], "loops and nulls": [(1, 1), (None, 2), (3, None)], "path": [(i, i + 1) for i in range(200)], "zigzag": [(i % 2 * 1000 + i, (i + 1) % 2 * 1000 + i + 1) for i in range(100)],
    "star": [(500, i) for i in range(300)], "clique": [(i, j) for i in range(30) for j in range(30)], "random": [(random.randrange(400), random.randrange(400)) for _ in range(350)], "negative": [(-5, 3), (3, -9), (-9, -9), (7, 8)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    got = connected_components(spark.createDataFrame(GRAPHS[name], "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == plain(GRAPHS[name]) and len(got) == len(plain(GRAPHS[name]))
