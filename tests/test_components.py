"""Components against the links they come from."""

import random

from loomstone.operators import components


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(190)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7)]
    df = spark.createDataFrame(links, "hub bigint, node bigint").repartition(7)
    old, components.AT_ONCE = components.AT_ONCE, 3
    try:
        got = {r.node: r.root for r in components.components(df).collect()}
    finally:
        components.AT_ONCE = old
    assert all(got[a] == got[b] for a, b in links if a != b) and all(got[got[x]] == got[x] <= x for x in got)
    assert len({got[x] for x in range(400, 461)}) == 1 and got[460] == 400
    assert components.components(df.limit(0)).count() == 0
