"""Connected components of a graph held in a table: alternating large-star and small-star rounds.

Every round is written to the shared folder, so lost executors cost one round at most and lineage stays short.
Smallest neighbours are found by aggregation with map-side combine; the join back puts a node with very many links on
one side only, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm.common import staged

#: A star round at least halves the longest chain; more rounds mean that something is wrong.
MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return int(r.n), int(r.h or 0)


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs -> node, component (the smallest node reachable), for every node that has a link to another.

    Loops, null ends and repeated edges don't matter; no edges give no rows.
    """
    oriented = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = staged(oriented.distinct(), "edges")
    mark = _mark(e)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # v >= u keep their own smallest neighbour: links of a node to smaller ones stay in the star of that node.
        large = large.union(low.filter(F.col("m") < F.col("k")).select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(least, F.col("u") == F.col("k")).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        e = staged(small, "edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
