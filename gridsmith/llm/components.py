"""Connected components of links, by alternating large and small stars.

All state is in written edge tables; no node or edge reaches the driver, only a
count and a checksum per round.  Hubs are met by partial aggregation (the least
neighbour) and by joins that adaptive execution can split.  Up to SMALL_LINKS
links (counted) are joined by one task in one go instead, which spares the rounds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.arrowmap import map_batches
from gridsmith.llm.scratch import Scratch


SMALL_LINKS = 200_000


def _united(batches):
    """(node, root) of all links of a task, by union and find."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([find(n) for n in part], pa.string())], names=["node", "root"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a and b); the root is the least node of its component."""
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= SMALL_LINKS:
        return map_batches(edges.coalesce(1), _united, "node string, root string")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(edges, large)
        edges = after
        # The checksum of the edge set; it no longer changes once every component is a star.
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
