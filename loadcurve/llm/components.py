"""Connected components over an edge table, without collecting it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

EDGES_PER_TASK = 1_000_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b",
                         per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of ``edges``.

    The edges are dealt to tasks of about ``per_task`` edges, and each task
    joins its own into stars, which keeps what they connect.  If that took more
    than one task, alternating large-star and small-star steps follow: each is
    a grouped minimum (partial sums before the shuffle) and one join on the
    node, which adaptive execution splits where a hub is hot; no neighbour list
    is built.  Every step is checkpointed, so lineage and recovery stay short.
    Nodes must not be null; loops and repeated edges do no harm; no edges give
    no rows.
    """
    pairs = materialize(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
                        .filter("u <> v"))
    parts = max(1, -(-pairs.count() // per_task))
    pairs = materialize(pairs.repartition(parts).mapInArrow(_stars, "u long, v long"))
    seen = None
    while parts > 1:
        pairs = materialize(_small_star(_large_star(pairs)))
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        seen = state
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(batches):
    """Each node of a task's edges with the smallest node it reaches through them."""
    table = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    ends = [np.asarray(table.column(c)) for c in range(2)]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    if not len(nodes):
        return
    u, v = at[: len(ends[0])], at[len(ends[0]):]
    root = np.arange(len(nodes))
    while True:  # hook the larger root to the smaller one, then shorten the paths
        x, y = root[u], root[v]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            short = root[root]
            if (short == root).all():
                break
            root = short
    own = np.flatnonzero(root != np.arange(len(nodes)))
    for i in range(0, len(own), 100_000):
        part = own[i: i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[root[part]])], ["u", "v"])


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
