"""Exact top-k search by inner product over KD-trees (operator 4).

Vectors are dealt to cells by median splits fitted on a bounded sample (it only shapes the cells: every row is dealt and
every answer is exact), and a cell of many rows to several shards of bounded size. Each shard builds a KD-tree by median
splits on its widest side and keeps a tight bounding box for every node. A block of queries goes best first through its
home shard's tree by the boxes' upper bounds and stops at the first box below its kth score. The kth scores found there go
on to the other shards: a block whose own box and lowest kth score cannot reach a shard's root box skips the shard, and in a tree that is visited each
query stops by its own kth score. How much is skipped depends on the vectors: clusters are, while no box of vectors that fill
many dimensions evenly is ever out of reach.

Components are integers; a vector with one of 2^53 or more takes no part. Sums are exact at any size; a score beyond a long counts as the nearest long.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Rows of a shard, at most, and of a leaf; queries of a block; root boxes of a pack and blocks that meet it in one task.
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES, PACK_BOXES, PACK_BLOCKS = 8192, 256, 512, 256, 64
#: A table has so many shards at least, if its rows fill so many leaves.
SHARDS = 8
#: Rows of the sample that the cells are fitted on, at most, and of a cell in it, at least.
SAMPLE_ROWS, CELL_SAMPLE = 16_384, 16
SCALE = 1024
#: Components are smaller than this, where a double still holds every integer; a score is at most this.
TOO_LARGE, MOST = 2**53, 2**63 - 1


def shard_rows(total: int) -> int:
    """Rows of a shard in a table of so many."""
    return max(1, min(SHARD_ROWS, max(LEAF_ROWS, -(-total // SHARDS))))


def integer_vectors(vectors: DataFrame, vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (array of floor(1024 * x), x as double). Rows with a null id, a null or empty vector, or null,
    non-finite or too large components take no part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * SCALE >= float(TOO_LARGE)))
    usable = F.col(vector_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))
    return vectors.filter(usable).select(F.col(vector_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def split_cells(x: np.ndarray, rows: int, most: int | None = None) -> np.ndarray:
    """Median splits of a sample ``x`` of so many rows: axis, cut, and what follows below the cut and from it on (a node, or
    -1 - cell). A cell stands for at most ``most`` rows (``SHARD_ROWS``), unless too little of the sample or only equal vectors are left."""
    most = most or SHARD_ROWS
    nodes: list[list[int]] = []
    stack, cells = [(np.arange(len(x)), -1, 0)], 0
    while stack:
        index, parent, place = stack.pop()
        part = x[index]
        spread = part.max(axis=0) - part.min(axis=0)
        side = int(np.argmax(spread))
        leaf = spread[side] == 0 or len(index) < 2 * CELL_SAMPLE or len(index) * rows <= most * len(x)
        if parent >= 0:
            nodes[parent][place] = -1 - cells if leaf else len(nodes)
        if leaf:
            cells += 1
            continue
        values = np.sort(part[:, side])
        cut = values[len(values) // 2]
        if cut == values[0]:
            cut = values[np.searchsorted(values, cut, "right")]
        below = part[:, side] < cut
        stack += [(index[below], len(nodes), 2), (index[~below], len(nodes), 3)]
        nodes.append([side, int(cut), 0, 0])
    return np.array(nodes, np.int64).reshape(-1, 4)


def cell_of(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = np.full(len(x), 0 if len(nodes) else -1, np.int64)
    while (inner := np.flatnonzero(at >= 0)).size:
        axis, cut, below, above = nodes[at[inner]].T
        at[inner] = np.where(x[inner, axis] < cut, below, above)
    return -1 - at


def _in_cells(rows: DataFrame, splits: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` (vec_id, dim, asked, v) with ``cell``; vectors of a length that the sample lacks are in one cell."""
    if not splits:
        return rows.withColumn("cell", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(dims, dtype=np.int64) - dims
            cells = np.zeros(len(dims), np.int32)
            for dim in splits.keys() & set(dims.tolist()):
                mine = np.flatnonzero(dims == dim)
                cells[mine] = cell_of(flat[starts[mine][:, None] + np.arange(dim)], splits[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, "vec_id long, dim int, asked boolean, v array<long>, cell int")


def _fit_cells(rows: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """(splits for each length of vectors, from a sample of at most ``SAMPLE_ROWS`` rows; rows of a shard). No splits where all rows are one shard's."""
    most = F.struct("n", "dim")
    total, top = rows.groupBy("dim").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max(most)).first()
    each = shard_rows(total or 0)
    if not total or top.n <= each:
        return {}, each
    some = rows.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(total)) < SAMPLE_ROWS).select("dim", "v").limit(SAMPLE_ROWS).collect()
    dims = {r.dim for r in some}
    return {d: split_cells(x, max(1, total * len(x) // len(some)), each) for d in dims if len(x := np.array([r.v for r in some if r.dim == d], np.int64))}, each


def _exact(size: int) -> type:
    """A type that sums of up to this size fit exactly; doubles are the fastest."""
    return np.float64 if size < 2**53 else np.int64 if size < 2**63 else object


def upper_bounds(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each query and box the highest inner product that a vector in the box can have."""
    side = max(abs(int(lo.min())), abs(int(hi.max())), abs(int(lo.max())), abs(int(hi.min())), 1)
    kind = _exact(max(1, abs(int(queries.min())), abs(int(queries.max()))) * side * queries.shape[1])
    q, zero = queries.astype(kind), kind(0) if kind is not object else 0
    return np.maximum(q, zero) @ hi.T.astype(kind) + np.minimum(q, zero) @ lo.T.astype(kind)


def block_bounds(qlo: np.ndarray, qhi: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each box the highest inner product of a vector in it and one between ``qlo`` and ``qhi``."""
    side = max(1, *(int(np.abs(a).max()) for a in (qlo, qhi, lo, hi)))
    kind = _exact(side * side * len(qlo))
    a, b, lo, hi = (v.astype(kind) for v in (qlo, qhi, lo, hi))
    return np.maximum(np.maximum(a * lo, a * hi), np.maximum(b * lo, b * hi)).sum(axis=1)


def _small(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    kinds = (k for k in (np.int16, np.int32) if np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
    return x.astype(next(kinds, np.int64))


class Tree:
    """KD-tree over integer vectors; nodes in heap order are not needed, children are listed."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.lexsort((ids,))
        self.lo, self.hi, self.children, self.span = [], [], [], []
        index = order.copy()
        stack = [(0, len(ids), -1)]
        while stack:
            a, b, parent = stack.pop()
            part = x[index[a:b]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            node = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.children.append([])
            self.span.append((a, b))
            if parent >= 0:
                self.children[parent].append(node)
            side = int(np.argmax(hi - lo))
            if b - a > LEAF_ROWS and hi[side] > lo[side]:  # equal vectors stay together
                half = (b - a) // 2
                index[a:b] = index[a:b][np.argpartition(part[:, side], half)]
                stack += [(a, a + half, node), (a + half, b, node)]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.ids, self.x = ids[index], _small(x[index])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: list[int | None], k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """For each query up to k (score, -vec_id) that can be among its best, given a kth score known before."""
        bounds = upper_bounds(queries, self.lo, self.hi)
        kind = _exact(max(1, abs(int(queries.min())), abs(int(queries.max()))) * max(1, abs(int(self.lo.min())), abs(int(self.hi.max()))) * queries.shape[1])
        q, x = queries.astype(kind), self.x.astype(kind)
        for i, known in enumerate(least):
            best: list[tuple[int, int]] = []
            floor = known
            heap = [(-bounds[i, 0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                if floor is not None and -bound < floor:
                    break
                if self.children[node]:
                    for child in self.children[node]:
                        if floor is None or bounds[i, child] >= floor:
                            heapq.heappush(heap, (-bounds[i, child], child))
                    continue
                a, b = self.span[node]
                score = x[a:b] @ q[i]
                if kind is object:
                    score = np.clip(score, -MOST - 1, MOST)
                good = self.ids[a:b] != query_ids[i]
                if floor is not None:
                    good &= score >= floor
                at = np.flatnonzero(good)
                if len(at) > k:
                    at = at[np.lexsort((self.ids[a:b][at], -score[at]))[:k]]
                best = heapq.nlargest(k, best + [(int(s), -int(v)) for s, v in zip(score[at], self.ids[a:b][at], strict=True)])
                if len(best) == k and (floor is None or best[-1][0] > floor):
                    floor = best[-1][0]
            yield int(query_ids[i]), best


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    v = table.column("v").combine_chunks()
    return ids, v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row where ``is_query`` holds, the k highest inner products with
    the other rows of ``vectors`` (vec_id, v), ties to the smaller vec_id; all of them where there are fewer.

    Only vectors of the query's length are its candidates; rows with the query's own vec_id are not. Rows that repeat
    a vec_id are candidates each; a query id that repeats is answered once, for the smallest of its vectors. No row is
    dropped at any size: more rows make more shards.
    """
    rows = vectors.select("vec_id", F.size("v").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asked"), "v")
    splits, each = _fit_cells(rows)
    rows = _in_cells(rows, splits)
    cell = ["dim", "cell"]
    counted = rows.groupBy(*cell).agg(F.count("*").alias("n"), F.count_if("asked").alias("q"))
    cells = staged(counted.select(*cell, F.ceil(F.col("n") / each).cast("int").alias("parts"), F.ceil(F.col("q") / BLOCK_QUERIES).cast("int").alias("blocks")), "cells")
    shards, most, blocks = cells.groupBy("dim").agg(F.sum("parts").alias("n"), F.sum("blocks").alias("b")).agg(F.sum("n"), F.max("n"), F.sum("b")).first()
    packs, salts = (max(1, -(-(n or 0) // each_of)) for n, each_of in ((shards, PACK_BOXES), (blocks, PACK_BLOCKS)))

    def tree(key: tuple, table: pa.Table) -> pa.Table:
        made = Tree(*_matrix(table))
        columns = {"dim": key[0].as_py(), "cell": key[1].as_py(), "part": key[2].as_py(), "lo": made.lo[0].tolist(), "hi": made.hi[0].tolist(), "tree": pickle.dumps(made)}
        return pa.Table.from_pylist([columns], pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64())), ("tree", pa.binary())]))

    def block(key: tuple, table: pa.Table) -> pa.Table:
        ids, x = _matrix(table)
        order = np.argsort(ids)
        columns = {"dim": key[0].as_py(), "cell": key[1].as_py(), "block": key[2].as_py(), "home": key[3].as_py(), "n": len(ids), "lo": x.min(axis=0).tolist(), "hi": x.max(axis=0).tolist(), "queries": pickle.dumps((ids[order], _small(x[order])))}
        return pa.Table.from_pylist([columns], pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("block", pa.int32()), ("home", pa.int32()), ("n", pa.int32()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64())), ("queries", pa.binary())]))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        at = [table.column(c).to_numpy() for c in ("cell", "part")]
        box = [table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(at[0]), -1) for c in ("lo", "hi")]
        columns = {"dim": key[0].as_py(), "pack": key[1].as_py(), "boxes": pickle.dumps((*at, *box))}
        return pa.Table.from_pylist([columns], pa.schema([("dim", pa.int32()), ("pack", pa.int32()), ("boxes", pa.binary())]))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                to_cell, to_part, lo, hi = pickle.loads(r["boxes"])
                ask = np.ones(len(lo), bool)
                if r["least"] is not None:  # each of the block's queries has a kth score
                    ask = np.asarray(block_bounds(np.array(r["lo"]), np.array(r["hi"]), lo, hi) >= r["least"], bool)
                b = np.flatnonzero(ask & ~((to_cell == r["cell"]) & (to_part == r["home"])))
                columns = [np.full(len(b), r[c]) for c in ("dim", "cell", "block")] + [to_cell[b], to_part[b]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], ["dim", "cell", "block", "to_cell", "to_part"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x = pickle.loads(batch.column("queries")[i].as_py())
                known = dict(batch.column("kth")[i].as_py() or ()) if "kth" in batch.schema.names else {}
                floors = [known.get(q) for q in ids.tolist()]
                found = pickle.loads(batch.column("tree")[i].as_py()).search(ids, x, floors, k)
                hits = [(a, -v, s) for a, best in found for s, v in best]
                at = [pa.array([batch.column(c)[i].as_py()] * len(hits), pa.int32()) for c in ("dim", "cell", "block")]
                columns = [pa.array(c, pa.int64()) for c in (zip(*hits, strict=True) if hits else ([], [], []))]
                yield pa.RecordBatch.from_arrays([*at, *columns], ["dim", "cell", "block", "query_id", "vec_id", "score"])

    hits_schema = "dim int, cell int, block int, query_id long, vec_id long, score long"
    # equal rows that come from several partitions are dealt apart as well
    part = F.pmod(F.xxhash64("vec_id", "v", F.spark_partition_id()), F.col("parts")).cast("int")
    trees = rows.join(cells.select(*cell, "parts"), cell).withColumn("part", part).select("vec_id", "v", *cell, "part").groupBy(*cell, "part").applyInArrow(tree, "dim int, cell int, part int, lo array<long>, hi array<long>, tree binary")
    trees = staged(trees, "trees")  # written once: built once, and read by the home blocks, for its boxes, and by the others
    queries = rows.filter("asked").groupBy("vec_id", "dim").agg(F.min(F.struct("v", "cell")).alias("m")).select("vec_id", "dim", "m.v", "m.cell")
    queries = staged(queries, "asked")
    # a block whose home shard got no row has no kth score yet, and goes to every shard
    dealt = queries.join(cells.select(*cell, "parts", "blocks"), cell).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")).cast("int")).withColumn("home", F.pmod("block", "parts"))
    made = "dim int, cell int, block int, home int, n int, lo array<long>, hi array<long>, queries binary"
    asked = staged(dealt.select("vec_id", "v", *cell, "block", "home").groupBy(*cell, "block", "home").applyInArrow(block, made), "queries")
    first = staged(asked.withColumnRenamed("home", "part").join(trees, [*cell, "part"]).select(*cell, "block", "queries", "tree").mapInArrow(visit, hits_schema), "home")
    hits = first
    if (most or 0) > 1:  # there are shards beside a block's home
        nth = first.groupBy(*cell, "block", "query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).filter(F.size("s") >= k).withColumn("s", F.element_at("s", k))
        kth = staged(nth.groupBy(*cell, "block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "s"))).alias("kth"), F.min("s").alias("least"), F.count("*").alias("known")), "kth")
        # the stated query set against all rows: each block's box is held against every pack of root boxes; a pack meets so many blocks in one task
        boxes = trees.select(*cell, "part", "lo", "hi").withColumn("pack", F.pmod(F.xxhash64("cell", "part"), F.lit(packs)).cast("int")).groupBy("dim", "pack").applyInArrow(pack, "dim int, pack int, boxes binary")
        boxes = boxes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        facing = asked.select(*cell, "block", "home", "n", "lo", "hi").join(kth.drop("kth"), [*cell, "block"], "left")
        facing = facing.withColumn("least", F.when(F.col("known") == F.col("n"), F.col("least"))).withColumn("salt", F.pmod(F.xxhash64("cell", "block"), F.lit(salts)).cast("int"))
        facing = facing.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).join(boxes, ["dim", "pack", "salt"])
        reached = staged(facing.select(*cell, "block", "home", "lo", "hi", "least", "boxes").mapInArrow(reach, "dim int, cell int, block int, to_cell int, to_part int"), "reached")
        theirs = trees.select("dim", F.col("cell").alias("to_cell"), F.col("part").alias("to_part"), "tree")
        blocks_of = asked.select(*cell, "block", "queries").join(kth.select(*cell, "block", "kth"), [*cell, "block"], "left")
        rest = reached.join(blocks_of, [*cell, "block"]).join(theirs, ["dim", "to_cell", "to_part"]).select(*cell, "block", "queries", "kth", "tree").mapInArrow(visit, hits_schema)
        hits = first.unionByName(rest)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # the same query id with vectors of two lengths: the shorter is answered
    hits = hits.join(queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("dim").alias("dim")), ["query_id", "dim"], "left_semi")
    return hits.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
