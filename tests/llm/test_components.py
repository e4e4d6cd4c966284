"""Connected components against a brute-force union of sets."""

import random

import pytest

from lexmill.llm.components import connected
from lexmill.llm.store import Scratch


def by_union(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            up[high] = low
    return sorted((x, root(x)) for x in up)


def shuffled_path(n):
    nodes = list(range(n))
    random.Random(5).shuffle(nodes)
    return list(zip(nodes, nodes[1:]))


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(5, 2), (2, 5), (2, 9)], [(i, 500) for i in range(40)], shuffled_path(60)])
def test_components(spark, edges):
    found = connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "x").collect()
    assert sorted(map(tuple, found)) == by_union(edges)
