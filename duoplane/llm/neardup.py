"""Embedding near-dedup (operator 13): spherical k-means cells, blocked cosine products within them, one kept row a group.

Equal vectors of a label become one class first. For each label of more than two cells' rows, spherical k-means on a bounded
sample gives centroids; a vector's home is the cell of its most similar one. A pair whose vectors have different homes is
compared in the cell of the smaller number, which the other visits if it is no further than ``margin`` from the plane between
the two. With the margin at the chord of the threshold no pair could be missed; but then, in many dimensions, nearly every
cell is visited. ``Z`` standard deviations of the projection of such a chord on a direction that doesn't depend on it (chord /
sqrt(dimensions)) are enough for all but one in some thousand of the pairs that a plane parts; ``z=None`` takes the whole chord.

Inside a cell nothing is compared whose answer is known from the angles to the centroid: two homes within half the
threshold's angle are linked for sure (so a group of near copies, however large, is counted and not multiplied out), and
what is beyond one and a half of it can't be linked with them. All else is dealt into blocks of about ``BLOCK`` vectors; a task multiplies two blocks
in double precision and returns, for each vector with links, their number and the smallest class it hangs together with in that task:
rows by vectors, never by pairs. Components follow from these.

Vectors that are null, empty, zero or hold null or non-finite entries link with nothing, nor do rows without a label or vectors of different
lengths. Copies link with each other; rows that repeat an id are rows like others; a null id is never a representative
and kept is false for it. An empty table gives no rows; other columns are not looked at. The driver holds at most ``CELLS``
centroids and counts, whatever the number of rows; beyond ``CELLS * CELL`` vectors cells grow in rows, which are dealt into more blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_facts, staged
from .components import components
from .vectors import binary, matrices

LINK = 0.93
#: Entries of a matrix of similarities to centroids that are held at once.
ENTRIES = 1 << 21
#: Vectors of a cell, of a block, most cells, vectors in the k-means sample for each cell, its rounds.
CELL, BLOCK, CELLS, SAMPLE, ROUNDS = 1024, 1024, 16_384, 32, 8
Z = 3.0


def _keyed(rows: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, v: the vector's bytes (as floats where these hold it exactly), null where it takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[bytes | None] = [None] * batch.num_rows
            for at, matrix in matrices(batch.column(2)):
                matrix = matrix + 0.0  # -0.0 is 0.0
                with np.errstate(over="ignore"):
                    small = (matrix.astype("<f4") == matrix).all(axis=1)
                for of, kind, lead in ((small, "<f4", b"f"), (~small, "<f8", b"d")):
                    some = np.flatnonzero(of & matrix.any(axis=1))
                    for i, v in zip(at[some].tolist(), binary(matrix[some].astype(kind)), strict=True):
                        held[i] = lead + v
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.binary())], ["vec_id", "label", "v"])

    picked = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).alias("label"), vector)
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", rows.schema[label].dataType), T.StructField("v", T.BinaryType())])
    return picked.mapInArrow(run, schema)


def units(held: list[bytes]) -> np.ndarray:
    """Unit vectors (all of one length) in double precision."""
    x = np.stack([np.frombuffer(v, "<f4" if v[:1] == b"f" else "<f8", offset=1).astype(np.float64) for v in held])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _spread(x: np.ndarray, most: int) -> np.ndarray:
    """The first rows of ``x``, ``most`` at most, that no earlier one taken is a near copy of."""
    taken, n = np.empty((min(most, len(x)), x.shape[1])), 0
    for row in x:
        if n == len(taken):
            break
        if not n or (taken[:n] @ row).max() < LINK:
            taken[n] = row
            n += 1
    return taken[:n].copy()


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centroid that each row is most similar to, the first of equals."""
    step = max(1, ENTRIES // len(c))
    return np.concatenate([np.argmax(x[a : a + step] @ c.T, axis=1) for a in range(0, len(x), step)])


def spherical_means(x: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` centroids of unit vectors. Seeds are rows in order that no earlier seed is a near copy of; centroids that come
    to lie as near as that to another are left out, so that one tight group has one cell."""
    c = _spread(x, k)
    for _ in range(ROUNDS):
        home = nearest(x, c)
        order = np.argsort(home, kind="stable")
        first = np.flatnonzero(np.diff(home[order], prepend=-1))
        total = np.add.reduceat(x[order], first)
        size = np.sqrt((total * total).sum(axis=1))
        c[home[order][first][size > 1e-9]] = total[size > 1e-9] / size[size > 1e-9, None]
    return _spread(c, k)


class Cells:
    """Centroids by (label, length), with what placing a vector needs."""

    def __init__(self, link: float, z: float | None) -> None:
        self.link, self.z, self.of = link, z, {}
        angle = math.acos(link)
        #: cosines to a centroid: of the core (any two of it are linked), and of what may be linked with the core; a little apart from the bounds, for rounding
        self.core, self.shell = math.cos(angle / 2) + 1e-9, math.cos(min(math.pi, 1.5 * angle)) - 1e-9

    def margin(self, d: int) -> float:
        chord = math.sqrt(2 - 2 * self.link)
        return chord if self.z is None else chord * min(1.0, self.z / math.sqrt(d))

    def place(self, label: object, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where unit vectors go: rows, cells, at home?, cosines to the centroids; a row for each home and each visit."""
        c = self.of.get((label, x.shape[1]))
        if c is None:
            return np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool), np.full(len(x), -2.0)
        out, step = [], max(1, ENTRIES // len(c))
        for a in range(0, len(x), step):
            near = x[a : a + step] @ c.T
            at, home = np.arange(len(near)), np.argmax(near, axis=1)
            apart = np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 0))  # of the two centroids
            visit = (near[at, home][:, None] - near <= self.margin(x.shape[1]) * apart) & (np.arange(len(c)) < home[:, None])
            guest, to = np.nonzero(visit)
            out.append((a + np.concatenate([at, guest]), np.concatenate([home, to]), np.repeat([True, False], [len(at), len(guest)]), np.concatenate([near[at, home], near[guest, to]])))
        return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def _by_length(labels: list, held: list[bytes]) -> Iterator[tuple[object, int, list[int]]]:
    groups: dict[tuple, list[int]] = {}
    for i, (label, v) in enumerate(zip(labels, held, strict=True)):
        groups.setdefault((label, (len(v) - 1) // (4 if v[:1] == b"f" else 8)), []).append(i)
    for (label, d), at in groups.items():
        yield label, d, at


def _fit(classes: DataFrame, link: float, z: float | None, cell: int) -> Cells:
    """Centroids of every label and length with more than two cells of classes."""
    cells = Cells(link, z)
    sizes = classes.groupBy("label", "d").count()
    total = classes.count()
    per = max(cell, -(-total // CELLS))
    large = {(r.label, r.d): r["count"] for r in sizes.filter(F.col("count") >= 2 * per).collect()}  # CELLS / 2 of them at most
    if not large:
        return cells
    rates = {key: min(1.0, SAMPLE * (-(-n // per)) / n) for key, n in large.items()}

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("label").to_pylist(), batch.column("d").to_pylist(), batch.column("h").to_pylist(), strict=True)
            yield batch.filter(pa.array([h < rates.get((label, d), 0) for label, d, h in keys], pa.bool_()))

    def means(key: tuple, table: pa.Table) -> pa.Table:
        held = table.sort_by("h").column("v").to_pylist()
        c = spherical_means(units(held), -(-large[key[0].as_py(), key[1].as_py()] // per))
        return pa.Table.from_arrays([pa.array([k.as_py()] * len(c), k.type) for k in key] + [pa.array(range(len(c)), pa.int32()), pa.array(binary(c.astype("<f8")), pa.binary())], ["label", "d", "j", "c"])

    hashed = classes.select("label", "d", "v", (F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("h"))
    schema = T.StructType([hashed.schema["label"], T.StructField("d", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("c", T.BinaryType())])
    found: dict[tuple, list] = {}
    for r in hashed.mapInArrow(drawn, hashed.schema).groupBy("label", "d").applyInArrow(means, schema).collect():  # CELLS centroids at most
        found.setdefault((r.label, r.d), []).append((r.j, np.frombuffer(r.c, "<f8")))
    cells.of = {key: np.array([c for _, c in sorted(cs, key=lambda jc: jc[0])]) for key, cs in found.items()}
    return cells


#: What a cell counts of its rows: not in the core, guests, core, and those that may link with the core; and of the core's weight and least class.
_COUNTS = ["inner", "guests", "core", "shell", "weight", "least"]


def _counted(cells: Cells) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, held = batch.column("label").to_pylist(), batch.column("v").to_pylist()
            m, cid = batch.column("m").to_numpy(), batch.column("cid").to_numpy()
            out = []
            for label, d, at in _by_length(labels, held):
                rows, cell, home, near = cells.place(label, units([held[i] for i in at]))
                core, shell, mine = home & (near >= cells.core), near >= cells.shell, np.array(at)[rows]
                for j in np.unique(cell).tolist():
                    here = cell == j
                    own = mine[here & core]
                    out.append((label, d, j, int((here & home & ~core).sum()), int((here & ~home).sum()), len(own), int((here & shell & ~core).sum()), int(m[own].sum()), int(cid[own].min()) if len(own) else None))
            columns = list(zip(*out, strict=True)) or [[]] * 9
            kinds = [batch.schema.field("label").type, pa.int32(), pa.int32(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["label", "d", "cell", *_COUNTS])

    return run


def _dealt(cells: Cells, sizes: dict[tuple, tuple[int, int, int, int, int, int]], block: int) -> Callable:
    """Classes to the tasks in which they are compared: label, task, left (side), cid, m, v; and, with a null task, the facts
    of the core's classes: m is then the weight of their links, left null and least the class that they hang together with."""

    def tasks(key: tuple, counts: tuple[int, int, int, int], home: bool, core: bool, shell: bool, h: int) -> Iterator[tuple[str, bool]]:
        inner, guests, cores, shells = (max(1, -(-n // block)) for n in counts)
        name = "/".join(map(str, key))
        if core:
            if counts[3]:
                for s in range(shells):
                    yield f"{name}/c{h % cores}.{s}", True
            return
        if shell and counts[2]:
            for c in range(cores):
                yield f"{name}/c{c}.{h % shells}", False
        if counts[0] + counts[1] <= 2 * block:
            if counts[0]:
                yield f"{name}/all", home
        elif home:
            mine = h % inner
            yield f"{name}/s{mine}", True
            for b in range(mine):
                yield f"{name}/p{b}.{mine}", False
            for b in range(mine + 1, inner):
                yield f"{name}/p{mine}.{b}", True
            if counts[1]:
                for g in range(guests):
                    yield f"{name}/g{mine}.{g}", True
        elif counts[0]:
            for b in range(inner):
                yield f"{name}/g{b}.{h % guests}", False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, held = batch.column("label").to_pylist(), batch.column("v").to_pylist()
            m, cid, hashes = (batch.column(c).to_numpy().tolist() for c in ("m", "cid", "h"))
            at_, task_, left_, weight_, least_ = [], [], [], [], []

            def put(i: int, task: str | None, left: bool | None, weight: int, least: int | None) -> None:
                for to, x in ((at_, i), (task_, task), (left_, left), (weight_, weight), (least_, least)):
                    to.append(x)  # noqa: B023

            for label, d, at in _by_length(labels, held):
                for r, j, home, cosine in zip(*(p.tolist() for p in cells.place(label, units([held[i] for i in at]))), strict=True):
                    counts = sizes.get((label, d, j), (1, 0, 0, 0, 0, None))
                    i, core = at[r], home and cosine >= cells.core
                    if core and counts[2] > 1:
                        put(i, None, None, counts[4] - m[i], counts[5])
                    for task, left in tasks((d, j), counts[:4], home, core, cosine >= cells.shell and not core, hashes[i]):
                        put(i, task, left, m[i], None)
            picked = pa.array(at_, pa.int64())
            v = pa.array([held[i] if t is not None else None for i, t in zip(at_, task_, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("label").take(picked), pa.array(task_, pa.string()), pa.array(left_, pa.bool_()), batch.column("cid").take(picked), pa.array(weight_, pa.int64()), v, pa.array(least_, pa.int64())], ["label", "task", "left_", "cid", "m", "v", "least"])

    return run


def _linked(link: float, tile: int) -> Callable:
    """The links of a task: left with left (tasks of one block or of a whole cell) and left with right, by tiles."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        task = key[1].as_py()
        table = table.sort_by([("left_", "descending"), ("cid", "ascending")])
        left = int(table.column("left_").to_numpy().sum())
        cid, m, x = table.column("cid").to_numpy(), table.column("m").to_numpy(), units(table.column("v").to_pylist())
        alone = "/s" in task or "/all" in task
        links, out = np.zeros(len(cid), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for a in range(0, left, tile):
            rows = slice(a, min(a + tile, left))
            for b in range(a if alone else left, len(cid), tile):
                if alone and b < left < b + tile:
                    spans = [slice(b, left), slice(left, b + tile)]
                else:
                    spans = [slice(b, min(b + tile, left) if b < left else b + tile)]
                for columns in spans:
                    hit = x[rows] @ x[columns].T >= link
                    if columns.start == rows.start:
                        hit = np.triu(hit, 1)
                    if hit.any():
                        links[rows] += hit @ m[columns]
                        links[columns] += hit.T @ m[rows]
                        out.append(_together(hit, cid[rows], cid[columns]))
        some = np.flatnonzero(links)
        nodes, least = (np.concatenate(c) for c in zip(*out, strict=True))
        count = len(some) + len(nodes)
        columns = [np.concatenate([cid[some], nodes]), pa.array(np.concatenate([links[some], np.zeros(len(nodes), np.int64)])), pa.array(np.concatenate([cid[some], least]))]
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), *columns[1:]], ["cid", "links", "least"]).slice(0, count)

    return run


def _together(hit: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row and column of ``hit`` with a link, and the least number that its links lead to within it."""
    r, c = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    hit, a, b, far = hit[np.ix_(r, c)], rows[r].copy(), columns[c].copy(), np.iinfo(np.int64).max
    while True:
        a2 = np.minimum(a, np.where(hit, b, far).min(axis=1))
        b2 = np.minimum(b, np.where(hit, a2[:, None], far).min(axis=0))
        if (a2 == a).all() and (b2 == b).all():
            return np.concatenate([rows[r], columns[c]]), np.concatenate([a, b])
        a, b = a2, b2


def near_duplicates(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", link: float = LINK, z: float | None = Z, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows``."""
    keyed = _keyed(rows, id_column, vector, label)
    there = keyed.filter("v is not null and label is not null")
    d = F.when(F.substring("v", 1, 1) == F.lit(b"f"), (F.length("v") - 1) / 4).otherwise((F.length("v") - 1) / 8).cast("int")
    grouped = there.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    classes = staged(grouped.withColumns({"d": d, "h": F.pmod(F.xxhash64("v", F.lit(1)), F.lit(1 << 40)), "key": F.unhex(F.sha2("v", 256)), "cid": F.monotonically_increasing_id()}), "classes")
    cells = _fit(classes, link, z, cell)
    like = classes.schema["label"]
    schema = T.StructType([like, T.StructField("d", T.IntegerType()), T.StructField("cell", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in _COUNTS]])
    counts = classes.select("label", "d", "v", "m", "cid").mapInArrow(_counted(cells), schema).groupBy("label", "d", "cell").agg(*[F.sum(c).alias(c) for c in _COUNTS[:5]], F.min("least").alias("least"))
    # cells of a centroid first, of which there are CELLS at most; then the largest of the labels without one
    special = (F.col("guests") > 0) | (F.col("core") > 0)
    counted = counts.filter(special | (F.col("inner") > 2 * block)).orderBy(special.desc(), F.desc("inner")).limit(2 * CELLS).collect()
    sizes = {(r.label, r.d, r.cell): tuple(r[c] for c in _COUNTS) for r in counted}
    schema = T.StructType([like, *[T.StructField(c, t) for c, t in (("task", T.StringType()), ("left_", T.BooleanType()), ("cid", T.LongType()), ("m", T.LongType()), ("v", T.BinaryType()), ("least", T.LongType()))]])
    dealt = classes.select("label", "v", "m", "cid", "h").mapInArrow(_dealt(cells, sizes, block), schema)
    compared = dealt.filter("task is not null").groupBy("label", "task").applyInArrow(_linked(link, block), "cid long, links long, least long")
    sure = dealt.filter("task is null").select("cid", F.col("m").alias("links"), "least")
    found = staged(compared.unionByName(sure), "links")
    return _results(keyed, classes, found)


def _results(keyed: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "cid")
    slim = classes.select("label", "key", "cid", "rep", "m")
    rooted = staged(slim.join(roots, "cid", "left").join(links, "cid", "left"), "rooted")
    grouped = rooted.filter("root is not null")
    least = staged(grouped.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("n")), "least")
    named = join_facts(grouped, least, ["root"], "n", grouped.count()).unionByName(rooted.filter("root is null").withColumn("least", F.col("rep")))
    facts = staged(named.select("label", "key", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("least").alias("component_id"), "m"), "facts")
    mine = keyed.select("vec_id", "label", F.unhex(F.sha2("v", 256)).alias("key"))
    linked = join_facts(mine.filter("key is not null and label is not null"), facts, ["label", "key"], "m", keyed.count())
    alone = mine.filter("key is null or label is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: All rows of a label against each other; components by repeated least labels.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.node = l.a WHERE r.root < l.b)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON c.node = e.vec_id
"""
