"""Connected components by contraction, as DataFrame rounds over the edges that are left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_facts, staged

#: So few edges are finished in one task.
FEW = 10_000


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """node and root (the same for all nodes of a component) for all nodes of ``edges`` (a, b: long).

    Each round points every node to the least of its neighbours and itself, and replaces edges by what their ends point to:
    the nodes that are left shrink by half at least. ``few`` edges are finished by union-find in one task. Every round is
    written to the shared folder, so lineage stays short; a node of many edges and a root of many nodes are dealt over tasks.
    Self-loops and repeated edges do no harm; no edges give no rows.
    """
    edges = staged(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mapping = None
    while True:
        n = edges.count()
        if n <= few:
            step = staged(edges.repartition(1).mapInArrow(_joined, "node long, root long"), "step")
        else:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            step = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "step")
        if mapping is None:
            mapping = step
        elif n:
            roots = mapping.groupBy("root").agg(F.count("*").alias("n"))
            onward = roots.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
            mapping = staged(join_facts(mapping, staged(onward, "onward"), ["root"], "n", mapping.count()).select("node", F.coalesce("next", "root").alias("root")), "mapping")
        if n <= few:
            return mapping
        for c in "ab":
            degrees = edges.groupBy(c).agg(F.count("*").alias("n")).join(step.select(F.col("node").alias(c), F.col("root").alias(f"{c}2")), c)
            edges = join_facts(edges, staged(degrees, "degrees"), [c], "n", n)
        edges = staged(edges.filter("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    over: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while over.get(top, top) != top:
            top = over[top]
        while over.get(x, x) != top:
            over[x], x = top, over[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            over.setdefault(a, a)
            over.setdefault(b, b)
            over[max(x, y)] = min(x, y)
            over.setdefault(min(x, y), min(x, y))
    nodes = list(over)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(root, nodes)), pa.int64())], ["node", "root"])
