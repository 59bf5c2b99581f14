"""Connected components as joins over shrinking edge tables, finished in one task once few edges are left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Edges that one task may hold (some 200 MB); larger tables are contracted by joins first.
TASK_EDGES = 1 << 20


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task: every node with the least node of its component."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([root(x) for x in parent], kind)], ["a", "b"])


def components(edges: DataFrame, starred: bool = False) -> DataFrame:
    """``node`` and ``label`` (one node of its component) for every node of ``edges(a, b)``.

    Each task first replaces its own edges by stars (unless they are, ``starred``). While more than ``TASK_EDGES`` edges are left, a round points every
    node at its least neighbour and keeps the edges between the nodes pointed at; the rest fits one task, and the
    pointers are followed back. Identifiers should be hashes: then a round leaves a fraction of the nodes, whatever
    the shape. Edges stay in tables, never at the driver.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    kind = edges.schema["a"].dataType.simpleString()
    pairs = edges.select("a", "b").filter("a <> b")
    if not starred:  # a second Python worker beside that of `edges`
        pairs = pairs.mapInArrow(stars, f"a {kind}, b {kind}").filter("a <> b")
    pairs = pairs.checkpoint()
    levels = []
    while pairs.count() > TASK_EDGES:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        least = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")).checkpoint()
        levels.append(least)
        here, there = (least.select(F.col("a").alias(k), F.col("to").alias(f"to_{k}")) for k in ("a", "b"))
        pairs = (pairs.join(here, "a").join(there, "b").filter("to_a <> to_b")
                 .select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
                 .mapInArrow(stars, f"a {kind}, b {kind}").filter("a <> b").checkpoint())
    labels = pairs.coalesce(1).mapInArrow(stars, f"a {kind}, b {kind}").select(
        F.col("a").alias("node"), F.col("b").alias("label"))
    while levels:
        end = labels.select(F.col("node").alias("to"), "label")
        labels = levels.pop().join(end, "to", "left").select(F.col("a").alias("node"), F.coalesce("label", "to").alias("label"))
    return labels.checkpoint()
