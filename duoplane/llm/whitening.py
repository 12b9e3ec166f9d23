"""Embedding whitening (operator 11): blockwise TSQR and a one-sided Jacobi SVD of its triangle.

Entries become integers (``floor(256 * c)``), so that counts and sums are exact. The fit list holds each distinct vector once;
it is written to the shared folder. Every task centres its vectors and folds them, block by block, into one triangle R by QR;
triangles are folded in a tree whose groups are bounded by bytes, until one is left for each length of vector. Plane rotations
then make R's columns orthogonal: their norms are the standard deviations (times the root of n), the accumulated rotations the
components. No product of the data with itself is formed, so small deviations keep their digits.

Rows whose vector is null or holds null or non-finite entries are dropped, as are entries beyond a long once multiplied.
Vectors of each length are fitted apart. Repeated rows give repeated results, a null id stays null, an empty table (or one of
empty vectors) gives no rows. Components without deviation (constant data, fewer vectors than entries) can't be whitened and
give no rows. ``deviation`` is null where the exact value doesn't fit a long. Other columns of the input are not looked at.
The driver holds sums and up to ``k`` components for each length: it grows with lengths, never with rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged
from .vectors import binary, matrices

SCALE, K = 256, 4
#: Triangles that are folded in one group take so many bytes (two at least); the driver's sums so many entries.
FOLD_BYTES, WIDEST = 64 << 20, 1 << 22
_WIDTHS = ("<i2", "<i4", "<i8")


@dataclass
class Fit:
    """What is known of one length: count, exact sums, components (k x length), variances, shares of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    shares: np.ndarray
    identity_error: float = 0.0


def _integers(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which rows fit a long, their integers)."""
    scaled = np.floor(matrix * SCALE)
    fits = (np.abs(scaled) < 2.0**62).all(axis=1)
    return fits, scaled[fits].astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Integer vectors in the least width that holds them, so that equal vectors have equal bytes."""
    for batch in batches:
        for _, matrix in matrices(batch.column(0)):
            _, x = _integers(matrix)
            most = np.abs(x).max(axis=1, initial=0)
            kind = np.searchsorted([2**15, 2**31], most, side="right")
            for w in np.unique(kind).tolist():
                held = binary(x[kind == w].astype(_WIDTHS[w]))
                yield pa.RecordBatch.from_arrays([pa.array([matrix.shape[1]] * len(held), pa.int32()), pa.array(held, pa.binary())], ["dim", "x"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The integer vectors of packed batches, by length and width."""
    for batch in batches:
        dims, sizes = batch.column("dim").to_numpy(), np.array([len(v) for v in batch.column("x").to_pylist()])
        held = batch.column("x").to_pylist()
        for d, size in sorted(set(zip(dims.tolist(), sizes.tolist(), strict=True))):
            rows = np.flatnonzero((dims == d) & (sizes == size))
            width = {2: 0, 4: 1, 8: 2}[size // d]
            yield d, np.frombuffer(b"".join(held[i] for i in rows), _WIDTHS[width]).astype(np.int64).reshape(-1, d)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, tuple[int, list[int]]] = {}
    for d, x in _unpacked(batches):
        n, sums = totals.get(d, (0, [0] * d))
        safe = int(np.abs(x).max()) * len(x) < 2**62
        new = x.sum(axis=0) if safe else x.astype(object).sum(axis=0)
        totals[d] = n + len(x), [a + int(b) for a, b in zip(sums, new, strict=True)]
    for d, (n, sums) in totals.items():
        columns = [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(list(map(str, sums)))]
        yield pa.RecordBatch.from_arrays(columns, ["dim", "at", "n", "s"])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: longs where they hold it, Python's integers beyond."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (deviations(x, n, sums) / n).astype(np.float64)


def fold(r: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    """The triangle of what ``r`` stands for and ``block``."""
    return np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")


def _triangles(moments: dict[int, tuple[int, list[int]]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for d, x in _unpacked(batches):
            y = centred(x, *moments[d])
            for i in range(0, len(y), step := max(4 * d, 1024)):
                found[d] = fold(found.get(d), y[i : i + step])
        node = TaskContext.get().partitionId()
        for d, r in found.items():
            yield _triangle(d, node, r)

    return run


def _triangle(d: int, node: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([node], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], ["dim", "node", "r"])


def _folded(key: tuple, table: pa.Table) -> pa.Table:
    d, node = (k.as_py() for k in key)
    r = None
    for held in table.sort_by("node").column("r").to_pylist():
        r = fold(r, np.frombuffer(held, "<f8").reshape(-1, d))
    return pa.Table.from_batches([_triangle(d, node, r)])


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values falling, right vectors as rows) of ``r``, by plane rotations of pairs of columns, each pair once a
    sweep; the pairs of a step are disjoint, and are rotated at once."""
    d = r.shape[1]
    u, v, m = r.astype(np.float64).copy(), np.eye(d), d + d % 2
    top = np.abs(u).max(initial=0)
    if top:
        u /= top
    order = np.arange(m)
    for _ in range(60):
        turned = False
        for _ in range(m - 1):
            p, q = order[: m // 2], order[m // 2 :][::-1]
            real = np.maximum(p, q) < d
            p, q = np.minimum(p, q)[real], np.maximum(p, q)[real]
            a, b = u[:, p], u[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            go = np.abs(ab) > 1e-15 * np.sqrt(aa * bb)
            if go.any():
                turned = True
                p, q = p[go], q[go]
                zeta = (bb[go] - aa[go]) / (2 * ab[go])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s = c * t
                for w in (u, v):
                    w[:, p], w[:, q] = c * w[:, p] - s * w[:, q], s * w[:, p] + c * w[:, q]
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if not turned:
            break
    sigma = np.sqrt((u * u).sum(0)) * top
    falling = np.argsort(-sigma, kind="stable")
    return sigma[falling], v[:, falling].T


def _solved(k: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        d = key[0].as_py()
        sigma, vectors = jacobi(np.frombuffer(table.column("r")[0].as_py(), "<f8").reshape(-1, d))
        real = np.flatnonzero(sigma[:k] > sigma[0] * 64 * d * np.finfo(float).eps)
        total = float((sigma * sigma).sum())
        columns = [pa.array([d] * len(real), pa.int32()), pa.array(real.tolist(), pa.int32()), pa.array(sigma[real]), pa.array(sigma[real] ** 2 / (total or 1.0)), pa.array(binary(vectors[real].astype("<f8")), pa.binary())]
        return pa.Table.from_arrays(columns, ["dim", "component", "sigma", "share", "v"])

    return run


def whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    return centred(x, fit.n, fit.sums) @ fit.components.T / np.sqrt(fit.variances)


def fit_whitening(rows: DataFrame, vector: str = "embedding", k: int = K) -> dict[int, Fit]:
    """Components of the distinct integer vectors, for each length."""
    distinct = staged(rows.select(vector).mapInArrow(_packed, "dim int, x binary").distinct(), "distinct")
    sums = distinct.mapInArrow(_summed, "dim int, at int, n long, s string").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    moments: dict[int, tuple[int, list[int]]] = {}
    for r in sums.limit(WIDEST + 1).collect():  # entries of the lengths, not rows of the table
        n, held = moments.setdefault(r.dim, (r.n, [0] * r.dim))
        held[r["at"]] = int(r.s)
    if sum(map(len, (held for _, held in moments.values()))) > WIDEST:
        raise ValueError(f"vectors of so many lengths that their entries are more than {WIDEST}")
    if not moments:
        return {}
    schema = "dim int, node long, r binary"
    triangles = staged(distinct.mapInArrow(_triangles(moments), schema), "triangles")
    fan = max(2, FOLD_BYTES // (8 * max(moments) ** 2))
    nodes = triangles.agg(F.max("node")).first()[0] + 1
    while True:
        triangles = triangles.withColumn("to", F.floor(F.col("node") / fan)).groupBy("dim", "to").applyInArrow(_folded, schema)
        nodes = -(-nodes // fan)
        if nodes == 1:
            break
    found = triangles.groupBy("dim").applyInArrow(_solved(k), "dim int, component int, sigma double, share double, v binary").collect()
    fits = {}
    for d, (n, held) in moments.items():
        mine = sorted((r for r in found if r.dim == d), key=lambda r: r.component)
        if mine:
            sigma = np.array([r.sigma for r in mine])
            fits[d] = Fit(n, held, np.array([np.frombuffer(r.v, "<f8") for r in mine]), sigma**2 / n, np.array([r.share for r in mine]))
    _judge(distinct, fits, k)
    return fits


def _judge(distinct: DataFrame, fits: dict[int, Fit], k: int) -> None:
    """How far the covariance of the whitened fit list is from the identity."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, x in _unpacked(batches):
            if d in fits:
                w = whitened(x, fits[d])
                columns = [pa.array(w[:, j] if j < w.shape[1] else [None] * len(w), pa.float64()) for j in range(k)]
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(w), pa.int32()), *columns], ["dim", *[f"w{j}" for j in range(k)]])

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    projected = distinct.mapInArrow(project, T.StructType([T.StructField("dim", T.IntegerType()), *[T.StructField(f"w{j}", T.DoubleType()) for j in range(k)]]))
    for r in projected.groupBy("dim").agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).collect():
        fits[r.dim].identity_error = max(abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < len(fits[r.dim].variances))


def whiten(rows: DataFrame, fits: dict[int, Fit], id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: id, component, n, deviation, whitened, explained, identity_error; one pass over
    the rows without a shuffle."""
    names = {"component": T.IntegerType(), "n": T.LongType(), "deviation": T.LongType(), "whitened": T.DoubleType(), "explained": T.DoubleType(), "identity_error": T.DoubleType()}
    schema = T.StructType([T.StructField("vec_id", rows.schema[id_column].dataType), *[T.StructField(c, t) for c, t in names.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in matrices(batch.column(1)):
                if (fit := fits.get(matrix.shape[1])) is None:
                    continue
                fits_long, x = _integers(matrix)
                k, ids = len(fit.variances), batch.column(0).take(pa.array(at[fits_long]))
                off = deviations(x, fit.n, fit.sums)
                if int(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 2**63:
                    total = (off * off).sum(axis=1).tolist()
                else:
                    total = [v if (v := sum(int(e) ** 2 for e in row)) < 2**63 else None for row in off]
                each = np.repeat(np.arange(len(x)), k)
                w = (off / fit.n).astype(np.float64) @ fit.components.T / np.sqrt(fit.variances)
                columns = [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array([fit.n] * len(each), pa.int64())]
                columns += [pa.array(total, pa.int64()).take(pa.array(each)), pa.array(w.ravel()), pa.array(np.tile(fit.shares, len(x))), pa.array([fit.identity_error] * len(each))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", *names])

    return rows.select(id_column, vector).mapInArrow(run, schema)
