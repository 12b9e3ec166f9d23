"""Toxicity (operator 6): a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence of hashed byte n-grams (lower-cased ASCII, white space as blanks). The model is fitted to a
bounded, documented sample of labelled documents, in one task; every whole text is scored where it is read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .langid import held_out

ORDERS, BITS = (3, 4, 5), 20
#: Labelled documents in the sample, and its bytes: the document that goes beyond them is the last, however long each is.
SAMPLE_DOCS, SAMPLE_BYTES = 6000, 64 << 20
#: n-grams in the model, and the sampled documents that have to hold one.
FEATURES, LEAST_DOCS = 4000, 4
#: Least G statistic (log-likelihood ratio of presence by class) of an n-gram in the model.
LEAST_G = 12.0
#: Bytes of text whose features are made at once while fitting (or one longer document).
PART_BYTES = 256 << 10
ROUNDS, RATE, RIDGE = 150, 0.05, 1e-4


@dataclass
class Model:
    features: np.ndarray  # hashes
    weights: np.ndarray
    bias: float


_FOLD = np.array([32 if i <= 32 else i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def features(texts: list[bytes], chosen: np.ndarray | None = None) -> np.ndarray:
    """Sorted, distinct (text << BITS | n-gram hash) of all texts; only hashes with a true entry in ``chosen``. Longer texts
    are looked at in pieces that overlap, so memory is bounded by ``PART_BYTES`` and what is found."""
    pieces, owner, reach = [], [], max(ORDERS) - 1
    for i, text in enumerate(texts):
        padded = b"\x20" + text + b"\x20"
        for a in range(0, max(1, len(padded) - reach), PART_BYTES - reach):
            pieces.append(padded[a : a + PART_BYTES])
            owner.append(i)
    part = np.cumsum(list(map(len, pieces)), dtype=np.int64) // PART_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(pieces)]
    found = [_features(pieces[a:b], np.array(owner[a:b], np.int64), chosen) for a, b in itertools.pairwise(bounds) if b > a]
    return found[0] if len(found) == 1 else np.unique(np.concatenate([np.zeros(0, np.int64), *found]))


def _features(pieces: list[bytes], owner: np.ndarray, chosen: np.ndarray | None) -> np.ndarray:
    joined = np.frombuffer(b"".join([t + b"\x00" for t in pieces]), np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths)
    flat = _FOLD[joined].astype(np.uint64)
    flat[ends - 1] = 0  # between pieces
    gap = np.zeros(len(flat) + max(ORDERS), bool)
    gap[ends - 1] = True
    out, window, across = [], np.zeros(len(flat), np.uint64), np.zeros(len(flat), bool)
    for k in range(max(ORDERS)):
        window[: max(0, len(flat) - k)] |= flat[k:] << np.uint64(8 * k)
        across |= gap[k : k + len(flat)]
        across[max(0, len(flat) - k) :] = True
        if k + 1 in ORDERS:
            code = (((window + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
            at = np.flatnonzero(~across & chosen[code]) if chosen is not None else np.flatnonzero(~across)
            out.append((owner[np.searchsorted(ends, at, side="right")] << BITS) | code[at])
    return np.unique(np.concatenate(out))


def fit(texts: list[str], labels: list[int]) -> Model:
    """Logistic regression, with NB-scaled features, to texts with labels 0 or 1; without both labels a constant."""
    y = np.array(labels, np.float64)
    n = len(y)
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1) if n else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    toxic, clean = np.ones(1 << BITS), np.ones(1 << BITS)
    raw = [t.encode() for t in texts]
    part = np.cumsum(list(map(len, raw))) // PART_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in itertools.pairwise(bounds):
        found = features(raw[a:b])
        code, doc = found & ((1 << BITS) - 1), (found >> BITS) + a
        toxic += np.bincount(code, y[doc], 1 << BITS)
        clean += np.bincount(code, 1 - y[doc], 1 << BITS)
    ratio = np.log(toxic / toxic.sum()) - np.log(clean / clean.sum())
    value = np.where(toxic + clean - 2 >= LEAST_DOCS, _g(toxic - 1, clean - 1, y.sum(), n - y.sum()), 0)
    best = np.argsort(-value, kind="stable")[:FEATURES]
    best = np.sort(best[value[best] >= LEAST_G])
    chosen = np.zeros(1 << BITS, bool)
    chosen[best] = True
    slot = np.cumsum(chosen) - 1
    key = np.concatenate([features(raw[a:b], chosen) + (a << BITS) for a, b in itertools.pairwise(bounds)])
    row, column = key >> BITS, slot[key & ((1 << BITS) - 1)]
    x = ratio[best][column]
    w, b = np.zeros(len(best)), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, ROUNDS + 1):  # Adam on the whole sample
        z = np.bincount(row, x * w[column], n) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(column, x * error[row], len(w)) / n + RIDGE * w
        gb = float(error.mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        up, down = 1 - 0.9**step, 1 - 0.999**step
        w -= RATE * (m / up) / (np.sqrt(v / down) + 1e-8)
        b -= RATE * (mb / up) / (vb / down) ** 0.5 if vb else 0.0
    return Model(best, w * ratio[best], b)


def _g(a: np.ndarray, b: np.ndarray, n_a: float, n_b: float) -> np.ndarray:
    """G statistic of presence in ``a`` of n_a and ``b`` of n_b documents."""
    total = np.zeros(len(a))
    for seen, of in ((a, n_a), (b, n_b)):
        for x, share in ((seen, (a + b) / (n_a + n_b)), (of - seen, 1 - (a + b) / (n_a + n_b))):
            with np.errstate(divide="ignore", invalid="ignore"):
                total += np.where(x > 0, x * np.log(x / (of * share)), 0)
    return 2 * total


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit to the ``sample_docs`` labelled documents whose ids hash lowest, none of them held out, up to ``sample_bytes`` of
    whole texts. Of repeated labels the largest counts, of repeated documents the text that sorts first; null labels, ids
    and texts are left out."""
    usable = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    draw = F.xxhash64("doc_id", F.lit("toxicity"))
    picked = usable.orderBy(draw, "doc_id").limit(2 * sample_docs)
    joined = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sample = joined.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    # one task fits the bounded sample; the sort spills, and what comes after the sample is full is passed over
    sample = sample.withColumn("draw", draw).repartition(1).sortWithinPartitions("draw", "doc_id").select("text", "toxic")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        marks: list[int] = []
        size = 0
        for batch in slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if len(texts) < sample_docs and size < sample_bytes:
                    texts.append(text)
                    marks.append(min(1, max(0, toxic)))
                    size += len(text.encode())
        model = fit(texts, marks)
        yield pa.RecordBatch.from_pydict({"features": pa.array([model.features.tolist()], pa.list_(pa.int64())), "weights": pa.array([model.weights.tolist()], pa.list_(pa.float64())), "bias": pa.array([model.bias])})

    found = sample.mapInArrow(train, "features array<long>, weights array<double>, bias double").collect()
    return Model(np.array(found[0].features, np.int64), np.array(found[0].weights, np.float64), found[0].bias) if found else fit([], [])


def score(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on), one row for every row of ``docs``; ``keep`` gives
    score and predicted beside the columns of ``docs`` instead (a column of these names is replaced).

    A null text is scored as the empty text. Whole texts of any length, no shuffle.
    """
    weights, hashes, bias = model.weights.astype(np.float32), model.features.astype(np.int32), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, chosen = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
        table[hashes], chosen[hashes] = weights, True
        for batch in slices(batches, "text", 2 << 20):
            found = features([(t or "").encode() for t in batch.column("text").to_pylist()], chosen)
            z = np.bincount(found >> BITS, table[found & ((1 << BITS) - 1)], batch.num_rows) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names if keep or c != "text"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*[c for c in names if keep or c != "text"], "score", "predicted"])

    if keep:
        rows = docs.drop("score", "predicted")
    else:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if keep or f.name != "text")
    return rows.mapInArrow(run, schema + ", score double, predicted int")
