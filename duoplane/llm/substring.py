"""Substring dedup by content-defined chunking (operator 5).

A gear rolling hash over the bytes before each word start decides where chunks end: where it is least among its
``REACH`` neighbours on either side, so an insertion only moves the boundaries near it, and chunks are of 2 * REACH + 1
words on average with few long ones. In a stretch of over ``SPARSE`` bytes without a word start (scripts without spaces,
base64, minified code) it chooses among all starts of characters, least among ``CHARACTERS`` on either side. Chunks are
compared by a 128-bit digest; of the copies of a chunk the first (by document, then place) stays. A copy is taken out where
it stands in a run of copied chunks of ``LEAST_WORDS`` words or ``LEAST_BYTES`` bytes at least: a short line that many
documents share stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_facts, slices, staged, unused

#: The gear hash sees this many bytes; a word start ends a chunk where it is least among so many before and after it.
GEAR, REACH = 16, 4
#: Bytes without a word start beyond which every character may end a chunk, where it is least among so many on either side.
SPARSE, CHARACTERS = 64, 16
#: Longest chunk in bytes; in a longer one the gear hash's least word start (or character) so near ends it, of equal ones the last.
LONGEST = 512
#: Words that a run of copied chunks needs. A repeated passage loses up to about REACH + one chunk at either end.
LEAST_WORDS = 20
#: Bytes that suffice instead, for text with few spaces; about twice those of twenty words, so that words decide elsewhere.
LEAST_BYTES = 256

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """32-bit gear hash of the ``GEAR`` bytes that end at each byte."""
    h = _TABLE[data]
    k = 1
    while k < GEAR:
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(k)
        h = h + shifted
        k *= 2
    return h


def _least(h: np.ndarray, reach: int) -> np.ndarray:
    """Whether each value is least among ``reach`` on either side; of equal ones the first."""
    around = np.full(len(h) + 2 * reach, 1 << 33)
    around[reach : reach + len(h)] = h
    least = np.ones(len(h), bool)
    for k in range(1, reach + 1):
        least &= (h < around[reach - k : reach - k + len(h)]) & (h <= around[reach + k : reach + k + len(h)])
    return least


def chunk_ends(text: bytes) -> list[int]:
    """Byte offsets at which the chunks of a text end; the last is its length."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if not n:
        return []
    space = (data == 32) | ((data >= 9) & (data <= 13))
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    h = gear_hash(data).astype(np.int64)
    cut = start[_least(h[start - 1], REACH)]
    lead = (data & 0xC0) != 0x80  # first byte of a character
    bounds = np.concatenate(([0], start, [n]))
    sparse = np.flatnonzero(np.diff(bounds) > SPARSE)
    if len(sparse):
        inner = [np.flatnonzero(lead[a + 1 : b]) + a + 1 for a, b in zip(bounds[sparse].tolist(), bounds[sparse + 1].tolist(), strict=True)]
        cut = np.sort(np.concatenate((cut, *(at[_least(h[at - 1], CHARACTERS)] for at in inner))))
    edges = np.concatenate(([0], cut, [n]))
    if (np.diff(edges) <= LONGEST).all():
        return edges[1:].tolist()
    out: list[int] = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        while b - a > LONGEST:
            x, y = np.searchsorted(start, [a + 1, a + LONGEST + 1])
            at = start[x:y] if y > x else np.flatnonzero(lead[a + 1 : a + LONGEST + 1]) + a + 1
            a = int(at[len(at) - 1 - np.argmin(h[at - 1][::-1])])
            out.append(a)
        if b > a:
            out.append(b)
    return out


#: Columns of a row's identity. An id, or a hash of the text where there is none, tells documents apart; a second hash of
#: the text tells apart those that repeat an id.
_IDENTITY = ["id", "none", "own"]


def _identity() -> list[Column]:
    """A row without text has no chunk, so nothing needs to find it again: its third part is NULL, its first one arbitrary."""
    some = F.length("text") > 0
    known = F.when(some, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("id"), "text"))).otherwise(F.monotonically_increasing_id())
    return [known, F.col("doc_id").isNull(), F.when(some, F.xxhash64("text"))]


def dedup(docs: DataFrame, least_words: int = LEAST_WORDS, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """All columns of ``docs``, text without its repeated passages, and n_chunks, n_removed (chunks), removed_bytes and
    spans (array of the removed (start, end), in bytes of the old text).

    Every whole text is cut into chunks. A null text stays null, an empty one empty; neither has chunks. Documents are
    ordered by doc_id; those without one come last, by a hash of their texts. Rows that repeat a doc_id, and rows without
    one that repeat a text, count as one place, so that what only they share stays in each of them. Extra columns pass
    through whatever they are called; columns named like an output are replaced.
    """
    made = ["n_chunks", "n_removed", "removed_bytes", "spans"]
    docs = docs.drop(*made)
    columns = ["id", "none", "own", "number", "digest", "check", "words", "again"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest_of, low = xxhash.xxh3_128_intdigest, (1 << 64) - 1
        for batch in slices(batches, "text", 2 << 20):
            counts, number, digest, check, words, again = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                a, ends, had = 0, chunk_ends(raw), set()
                for b in ends:
                    found = digest_of(raw[a:b])
                    digest.append((found >> 64) - (1 << 63))
                    check.append((found & low) - (1 << 63))
                    again.append(found in had)
                    had.add(found)
                    words.append(len(raw[a:b].split()))
                    a = b
                number.extend(range(len(ends)))
                counts.append(len(ends))
            whose = np.repeat(np.arange(batch.num_rows), counts)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int16(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(whose)) for c in _IDENTITY] + [pa.array(x, t) for x, t in zip((number, digest, check, words, again), kinds, strict=True)], columns)

    named = docs.filter(F.length("text") > 0).select(*[x.alias(c) for x, c in zip(_identity(), _IDENTITY, strict=True)], "text")
    chunks = staged(named.mapInArrow(cut, "id long, none boolean, own long, number int, digest long, check long, words short, again boolean"), "chunks")
    # documents in order: ids, then, in the upper quarter of the longs, those without
    place = F.when(F.col("none"), F.lit(1 << 62) + F.shiftrightunsigned("own", 2)).otherwise(F.col("id"))
    once = chunks.filter("not again")
    first = once.groupBy("digest", "check").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).filter("first < last").drop("last")
    # copies of a chunk within its document are known there; the others are those after the first document's
    copies = join_facts(once, staged(first, "firsts"), ["digest", "check"], "n", chunks.count()).filter(place > F.col("first"))
    copies = copies.select(*_IDENTITY, "number", "words").unionByName(chunks.filter("again").select(*_IDENTITY, "number", "words"))
    # what a document loses, as the numbers of its copied chunks and their words
    names = docs.columns
    *keys, copied = unused(names, *_IDENTITY, "copied")
    lost = copies.groupBy(*_IDENTITY).agg(F.sort_array(F.collect_set(F.struct("number", "words"))).alias(copied))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in made[:3]), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts, facts = [], []
            for text, numbers in zip(batch.column("text").to_pylist(), batch.column(copied).to_pylist(), strict=True):
                raw = (text or "").encode()
                ends = chunk_ends(raw)
                spans = _runs(numbers or [], ends, least_words, least_bytes)
                kept, at = [], 0
                for a, b, _ in spans:
                    kept.append(raw[at:a])
                    at = b
                texts.append(None if text is None else b"".join([*kept, raw[at:]]).decode() if spans else text)
                facts.append((len(ends), sum(s[2] for s in spans), sum(b - a for a, b, _ in spans), [{"start": a, "end": b} for a, b, _ in spans]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            arrays = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(c, t) for c, t in zip(zip(*facts, strict=True), kinds, strict=True)], names + made)

    keyed = docs.withColumns(dict(zip(keys, _identity(), strict=True)))
    lost = lost.select(*[F.col(a).alias(b) for a, b in zip(_IDENTITY, keys, strict=True)], copied)
    return keyed.join(lost, keys, "left").select(*[F.col(f"`{c}`") for c in names], copied).mapInArrow(apply, schema)


def _runs(copied: list[dict], ends: list[int], least_words: int, least_bytes: int) -> list[tuple[int, int, int]]:
    """(start, end, chunks) of the runs of neighbouring copied chunks that have enough words or bytes."""
    out, i = [], 0
    while i < len(copied):
        j, words = i, copied[i]["words"]
        while j + 1 < len(copied) and copied[j + 1]["number"] == copied[j]["number"] + 1:
            j += 1
            words += copied[j]["words"]
        first = copied[i]["number"]
        start, end = ends[first - 1] if first else 0, ends[copied[j]["number"]]
        if words >= least_words or end - start >= least_bytes:
            out.append((start, end, j - i + 1))
        i = j + 1
    return out
