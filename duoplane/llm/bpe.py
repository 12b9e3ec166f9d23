"""Byte-level BPE encoding and decoding (operator 7).

Distinct pre-tokens of a batch become rows of length-bucketed, padded numpy matrices. In every round each row
merges its leftmost pair of least rank; ranks come from an open-addressing hash table over id pairs, rows that have
no pair left are compacted away. A longer pre-token becomes several rows, windows that overlap, and is put together
again where two windows agree on two neighbouring tokens. Ids are spread back over the documents by indexing, and
decoding gathers the ids' bytes from one flat vocabulary buffer.

Why windows give the same ids: a stretch that no merge leaves is merged as it would be alone. If, as ``BytePairCoder``
checks, every token is merged from its bytes in order of rank, a sequence of tokens is the encoding of its bytes as soon
as every two neighbours are the encoding of theirs; in the sequence put together, all neighbours stand so in a window.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .common import repeat_ranges, slices

NO_RANK = np.int32(2**31 - 1)
#: Bytes of the widest row of a matrix, whose rounds are quadratic in it, and by how many two windows of a piece overlap.
LONGEST_ROW, OVERLAP = 256, 64
#: Pre-tokens, and ids of theirs, that a worker keeps between batches.
CACHE, CACHED_IDS = 200_000, 4 << 20


class PairTable:
    """Hash table from a pair of ids to the merged id (which is also its rank), with vectorised lookup."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ids = np.full(1 << bits, NO_RANK, np.int32)
        left = np.array([(a << 32) | b for a, b in pairs], np.int64)
        ids = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(left)
        while len(left):  # every slot takes the first of its newcomers, the others move on
            free = self._keys[slot] == -1
            at, first = np.unique(np.where(free, slot, -1), return_index=True)
            take = first[at >= 0]
            self._keys[slot[take]], self._ids[slot[take]] = left[take], ids[take]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, ids, slot = left[rest], ids[rest], (slot[rest] + 1) & self._mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids, ``NO_RANK`` where the pair has none; a negative id is padding."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        out = np.full(key.shape, NO_RANK, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key = key.ravel()
        slot = self._slot(key[todo])
        flat = out.ravel()
        while len(todo):
            there = self._keys[slot]
            hit = there == key[todo]
            flat[todo[hit]] = self._ids[slot[hit]]
            go = ~hit & (there != -1)
            todo, slot = todo[go], (slot[go] + 1) & self._mask
        return out


class BytePairCoder:
    """Encoder and decoder for a rank file: one base64 token and its rank a line."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ranks = self.ranks
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs = PairTable(pairs)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self._decimal = list(map(str, range(len(tokens))))
        self._lengths = np.array([len(t) for t in tokens], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._fell = False
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.decimals: list[str] = []
        self._flat, self._used = np.empty(1 << 16, np.int32), 0
        self._at, self._n = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int32)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, by length-bucketed matrices."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if len(long := np.flatnonzero(lengths > LONGEST_ROW).tolist()):
            for i, ids in zip(long, self._merge_windows([pieces[i] for i in long]), strict=True):
                out[i] = ids
        width = 1
        low = -1
        while low < LONGEST_ROW:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            for a in range(0, len(rows), 1 << 14):
                self._merge_matrix(pieces, rows[a : a + (1 << 14)], lengths, width, out)
            low, width = width, min(LONGEST_ROW, width + max(1, width // 2))
        return out

    @functools.cached_property
    def in_order(self) -> bool:
        """Is every token merged from its bytes, by rising ranks? Then windows may be put together."""
        self._fell = False
        tokens = [t for t in self.ranks if len(t) <= LONGEST_ROW]
        made = self.merge(tokens)
        return len(tokens) == len(self.ranks) and not self._fell and all(len(m) == 1 for m in made)

    def _merge_windows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of long pieces. Windows that don't agree with the next are united and merged as one row, until all agree."""
        if not self.in_order:
            return list(map(self._merge_row, pieces))
        step = LONGEST_ROW - OVERLAP
        spans = [[(a, min(len(p), a + LONGEST_ROW)) for a in range(0, max(1, len(p) - OVERLAP), step)] for p in pieces]
        found = iter(self.merge([p[a:b] for p, own in zip(pieces, spans, strict=True) for a, b in own]))
        out = []
        for p, own in zip(pieces, spans, strict=True):
            windows = [(a, b, next(found)) for a, b in own]
            ends = [a + np.cumsum(self._lengths[ids]) for a, _, ids in windows]
            while True:
                cuts = [_agreed(windows[i], ends[i], windows[i + 1], ends[i + 1]) for i in range(len(windows) - 1)]
                if None not in cuts:
                    break
                united: list[tuple] = []
                new_ends = []
                for i, (window, end) in enumerate(zip(windows, ends, strict=True)):
                    if i and cuts[i - 1] is None:
                        united[-1], new_ends[-1] = (united[-1][0], window[1], None), None
                    else:
                        united.append(window)
                        new_ends.append(end)
                windows = [w if w[2] is not None else (w[0], w[1], self._merge_row(p[w[0] : w[1]])) for w in united]
                ends = [e if e is not None else w[0] + np.cumsum(self._lengths[w[2]]) for w, e in zip(windows, new_ends, strict=True)]
            bounds = [0, *cuts, len(p)]
            out.append(np.concatenate([w[2][np.searchsorted(e, x, side="right") : np.searchsorted(e, y, side="right")] for w, e, x, y in zip(windows, ends, bounds[:-1], bounds[1:], strict=True)]))
        return out

    def _merge_row(self, piece: bytes) -> np.ndarray:
        """One row of any width: in each round its least rank is merged wherever it stands, from the left (only leftmost
        where ranks may fall)."""
        every = self.in_order
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NO_RANK:
            at = np.flatnonzero(ranks == least) if every else np.array([ranks.argmin()])
            begun = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begun) % 2 == 0]  # of overlapping pairs every other one
            ids[at] = least
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            new = at - np.arange(len(at))
            for pair in (new[new > 0] - 1, new[new < len(ranks)]):
                ranks[pair] = self.pairs.find(ids[pair], ids[pair + 1])
        return ids

    def _merge_matrix(self, pieces: list[bytes], rows: np.ndarray, lengths: np.ndarray, width: int, out: list) -> None:
        n = lengths[rows]
        flat = np.frombuffer(b"".join([pieces[i] for i in rows.tolist()]), np.uint8)
        ids = np.full((len(rows), width + 1), -1, np.int32)
        ids[np.repeat(np.arange(len(rows)), n), repeat_ranges(np.zeros(len(n), np.int64), n)] = self.byte_ids[flat]
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        columns, last = np.arange(width + 1), np.full(len(rows), -1, np.int32)
        while True:
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            least = ranks[each, at]
            over = least == NO_RANK
            if over.any():
                for i, row in zip(rows[over].tolist(), ids[over], strict=True):
                    out[i] = row[row >= 0]
                rows, ids, ranks, at, least, last = (x[~over] for x in (rows, ids, ranks, at, least, last))
                each = each[: len(rows)]
            self._fell |= bool((least < last).any())
            last = least
            if not len(rows):
                return
            ids[each, at] = least
            after = columns[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_RANK
            ranks[each, at] = self.pairs.find(least, ids[each, at + 1])
            inner = at > 0
            ranks[each[inner], at[inner] - 1] = self.pairs.find(ids[each[inner], at[inner] - 1], least[inner])

    def _learn(self, new: list[str]) -> None:
        raw = [t.encode() for t in new]
        whole = [self.ranks.get(t) for t in raw]
        rest = iter(self.merge([t for t, r in zip(raw, whole, strict=True) if r is None]))
        ids = [np.array([r], np.int32) if r is not None else next(rest) for r in whole]
        first = len(self.decimals)
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        self._flat = _room(self._flat, self._used, len(flat))
        self._flat[self._used : self._used + len(flat)] = flat
        self._at, self._n = _room(self._at, first, len(ids)), _room(self._n, first, len(ids))
        self._n[first : first + len(ids)] = n
        self._at[first : first + len(ids)] = self._used + np.cumsum(n) - n
        self._used += len(flat)
        decimal = self._decimal.__getitem__
        self.decimals.extend([" ".join(map(decimal, x.tolist())) for x in ids])
        self.codes.update(zip(new, range(first, first + len(ids)), strict=True))

    def encode(self, documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """For lists of pre-tokens: all ids in a row, each document's number of ids, and its ids as decimals."""
        new = set().union(*documents).difference(self.codes) if documents else set()
        if len(self.codes) + len(new) > CACHE or self._used > CACHED_IDS:
            self._forget()
            new = set().union(*documents)
        self._learn(list(new))
        text = self.decimals.__getitem__
        codes = list(map(self.codes.__getitem__, itertools.chain.from_iterable(documents)))
        flat = np.array(codes, np.int64)
        ends = [0, *itertools.accumulate(map(len, documents))]
        n = self._n[flat].astype(np.int64)
        ids = self._flat[repeat_ranges(self._at[flat], n)]
        cuts = np.concatenate(([0], np.cumsum(n)))[ends]
        return ids, np.diff(cuts), [" ".join(map(text, codes[a:b])) for a, b in itertools.pairwise(ends)]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each document, from all ids in a row and each document's number of ids."""
        n = self._lengths[ids]
        data = self._bytes[repeat_ranges(self._starts[ids], n)].tobytes()
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _agreed(a: tuple, a_ends: np.ndarray, b: tuple, b_ends: np.ndarray) -> int | None:
    """A place between two neighbouring tokens that two overlapping windows share, or None."""
    start, end = b[0], a[1]
    mine = np.concatenate(([a[0]], a_ends)) if a[0] >= start else a_ends
    mine, theirs = mine[mine >= start], np.concatenate(([start], b_ends))
    theirs = theirs[theirs <= end]
    both = np.intersect1d(mine, theirs, assume_unique=True)
    if len(both) < 3:
        return None
    m, t = np.searchsorted(mine, both), np.searchsorted(theirs, both)
    good = (np.diff(m) == 1) & (np.diff(t) == 1)  # one token in either window
    at = np.flatnonzero(good[:-1] & good[1:])
    return int(both[at[len(at) // 2] + 1]) if len(at) else None


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    out = np.empty(2 * (used + more), array.dtype)
    out[:used] = array[:used]
    return out


@functools.lru_cache(2)
def coder(path: str) -> BytePairCoder:
    return BytePairCoder(path)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again; returns doc_id, n_tokens, ids_sha256, decoded_sha256 and
    decoded (the decoded text), with ``with_ids`` also ids (array of int), and passes other columns of ``docs`` on.

    A null or empty text has no ids and decodes to the empty text; rows with a null or repeated doc_id are
    encoded like any other. Texts of any length are taken whole: they are cut into pre-tokens, never elsewhere.
    No shuffle: each document is encoded where it is read. Columns of ``docs`` named like an output are replaced.
    """
    odd, masked = pretokens.odd_characters()
    made = ["n_tokens", "ids_sha256", "decoded_sha256", "decoded"] + ["ids"] * with_ids
    kept = [f for f in docs.schema.fields if f.name not in made]
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType())}
    schema = T.StructType([*kept, *(T.StructField(c, kinds.get(c, T.StringType())) for c in made)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, split = coder(ranks_path), pretokens.splitter(pattern, odd, masked).split
        sha = hashlib.sha256
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, counts, decimals = bpe.encode(list(map(split, texts)))
            decoded = bpe.decode(ids, counts)
            arrays = [batch.column(c) for c in names] + [
                pa.array(counts, pa.int64()),
                pa.array([sha(x.encode()).hexdigest() for x in decimals], pa.string()),
                pa.array([sha(x).hexdigest() for x in decoded], pa.string()),
                pa.array(decoded, pa.binary()).cast(pa.string()),
            ]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(arrays, names + made)

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
