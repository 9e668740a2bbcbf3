"""Components against a plain union-find: chains, stars, cycles, random graphs."""

import random

from stacksmith.llm.components import components


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(200)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7)]
    edges += [(9000 - i, 8000 + i) for i in range(400)] + [(rng.randrange(10_000, 10_900), rng.randrange(10_000, 10_900)) for _ in range(700)]
    edges += [(-5, 3000), (3000, -9)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert len(got) == len(root) and {r.node: r.component for r in got} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
