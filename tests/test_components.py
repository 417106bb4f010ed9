import random

import pytest

from libris.operators.components import components


@pytest.mark.parametrize("local", [-1, 1 << 18])
def test_components(spark, local):
    r = random.Random(0)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(140)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5040)] + [(-(2**62), 2**62), (7, None)]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), local=local).collect()}
    assert got == {n: root(n) for a, b in edges[:-1] if a != b for n in (a, b)} | {n: root(n) for n in got}
    assert components(spark.createDataFrame([], "a long, b long"), local=local).count() == 0
