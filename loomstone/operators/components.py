"""Connected components by contraction and alternating stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators.dedup import dropped, saved

#: Links that are contracted at a time, wherever they lie: memory, not a limit.
AT_ONCE = 1 << 20


def _forest(u: list[int], v: list[int]) -> tuple[list[int], list[int]]:
    """Each node that links hold below its smallest one."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    for x, y in zip(u, v, strict=True):
        a, b = find(x), find(y)
        up[max(a, b)] = min(a, b)
    nodes = [x for x in up if find(x) != x]
    return nodes, [find(x) for x in nodes]


def _contract(most: int):
    """Links of one partition, about `most` at a time, as a forest of stars: as many links or fewer, the same components."""

    def run(batches):
        u: list[int] = []
        v: list[int] = []
        for batch in batches:
            u += batch["u"].to_pylist()
            v += batch["v"].to_pylist()
            if len(u) >= most:
                yield _stars_of(u, v)
                u, v = [], []
        yield _stars_of(u, v)

    return run


def _stars_of(u: list[int], v: list[int]) -> pa.RecordBatch:
    nodes, roots = _forest(u, v)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["u", "v"])


def components(links: DataFrame, a: str = "hub", b: str = "node") -> DataFrame:
    """node, root: the smallest node that links reach, for every linked node.

    Large and small stars alternate until only stars are left; in each round every partition contracts its own links. The same
    steps run at every size; only the number of rounds follows the links. Each round is written and the one before deleted.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = saved(edges.mapInArrow(_contract(AT_ONCE), "u bigint, v bigint"))
    while not _stars_only(edges):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("c"), "m")
        large = both.where("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(low, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = saved(small.where("u > v").distinct().mapInArrow(_contract(AT_ONCE), "u bigint, v bigint"))
        dropped(edges)
        edges = new
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._loomstone_path = edges._loomstone_path
    return out


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node has one link down, or links up only."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.count("*").alias("n")).where("down > 0 AND n > 1").isEmpty()
