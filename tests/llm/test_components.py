"""Components of random links against union-find."""

import random

import pytest

from callsheet.llm.components import components


@pytest.mark.parametrize("links", [0, 30, 90, 400])
def test_random_links(spark, links):
    rnd = random.Random(links)
    rows = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(links)]
    rows += [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 340)]
    rows = rows if links else []
    parent = {n: n for row in rows for n in row if row[0] != row[1]}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in rows:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = components(spark.createDataFrame(rows, "a BIGINT, b BIGINT")).collect()
    assert sorted(map(tuple, found)) == sorted((n, root(n)) for n in parent)
