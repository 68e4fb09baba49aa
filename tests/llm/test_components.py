import random

import pytest

from logweave.llm.components import components
from logweave.shipping import ship


def expected(edges):
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            above[b] = a
    groups = {}
    for x in above:
        groups.setdefault(root(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("small", [0, 15_000])
def test_components(spark, small):
    ship(spark)
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    edges += [(5, 5), (None, 3), (7, None), (1, 0), (0, 1)]
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint"), small).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == expected(edges)
    assert len(rows) == len({r["node"] for r in rows})


def test_no_edges(spark):
    ship(spark)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
