"""Components of random links, by either way."""

import random

import numpy as np
import pytest

from glossweave.llm.components import components, forest


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        if u != v:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for e in edges if e[0] != e[1] for x in e}


def graphs():
    r = random.Random(6)
    yield [(r.randint(-50, 300), r.randint(-50, 300)) for _ in range(180)]
    yield [(i, i + 1) for i in range(200)] + [(500, 400), (7, 7)]


def test_forest():
    for edges in graphs():
        nodes, roots = forest(np.array([u for u, _ in edges]), np.array([v for _, v in edges]))
        want = brute(edges)
        assert {n: r for n, r in zip(nodes.tolist(), roots.tolist()) if n in want} == want


@pytest.mark.parametrize("last", [1 << 20, 10])
def test_components(spark, last):
    for edges in graphs():
        got = components(spark.createDataFrame(edges, "u long, v long"), last).collect()
        assert {x.node: x.root for x in got} == brute(edges) and len(got) == len(brute(edges))
    assert components(spark.createDataFrame([], "u long, v long"), last).count() == 0
