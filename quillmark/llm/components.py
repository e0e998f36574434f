"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import store


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a batch, replaced by one from each node to its group's least node."""
    for batch in batches:
        ends = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        a, b = at[: len(ends[0])], at[len(ends[0]) :]
        root = np.arange(len(nodes))
        while True:  # nodes are in order, so the least number is the least node
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            np.minimum.at(low, root, low)
            low = low[low]
            if np.array_equal(low, root):
                break
            root = low
        own = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); component is the least node.

    Nodes of null or self-edges alone are left out. Each round is a table in the
    shared folder, so no lineage grows; all steps are joins and minima by node, and
    no task holds a component. Empty edges give an empty table.
    """
    edges = edges.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long")
    now, mark = None, None
    while True:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Every edge now goes from a node to a smaller one: hang each on the least of its node.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a")
        small = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = store.saved(small, "stars")
        told = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before is not None:
            store.dropped(before)
        if mark == tuple(told):
            break
        mark, edges = tuple(told), now
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
