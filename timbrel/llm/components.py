"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step replaces the edges by as many or fewer, all pointing at a smaller neighbour; a neighbourhood is never gathered,
only its minimum is, so a node with very many edges costs a partial aggregate and a join that may be split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.llm.common import local, materialize, release


def _done(edges: DataFrame) -> bool:
    """Is every node either a centre or points at one centre only?"""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("out")), F.struct(F.col("v").alias("n"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    nodes = ends.groupBy("n").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return nodes.filter("out > 1 OR (out = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of ``edges``; component is the smallest node reachable. Nodes are of one
    orderable type. Null ends, loops and repeated edges don't count; no edges give no rows."""
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    star = materialize(ends.distinct(), "edges")
    while not _done(star):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).withColumn("m", F.least("n", "m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        moved = large.join(least, F.col("u") == F.col("n")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = materialize(moved.filter("u != v").distinct(), "edges")
        release(star)
        star = after
    roots = star.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def components_of_few(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """As ``components``, of so few edges between whole numbers that the driver may hold them; without any pass over the
    executors' disks. To be broadcast."""
    found = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).cast("long"), F.col(b).cast("long")).toArrow()
    nodes, place = np.unique(np.concatenate([x.to_numpy() for x in found.columns]), return_inverse=True)
    one, two = place[: found.num_rows], place[found.num_rows :]
    root = np.arange(len(nodes))
    while (apart := root[one] != root[two]).any():
        x, y = root[one[apart]], root[two[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return local(edges.sparkSession, pa.table({"node": nodes, "component": nodes[root]}))
