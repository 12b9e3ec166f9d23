"""Token counts without ids (operator 3).

Each block of documents becomes one row per distinct pre-token, holding which documents of the block use it and how
often, packed in a few bytes. One shuffle brings the rows of a pre-token together; its pieces are counted once, the
count is joined to the frequencies, and every task adds up its documents' sums before a last, small shuffle by block.
No token id is ever materialised.

A pre-token that many documents of a block share is dealt out by the input partition of its block, ``SHARE`` of them
together, so that a word of every document has the more parts the more input there is. Its pieces are still counted once,
and that count goes to each of its parts.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import input_partitions, slices

#: Bytes of text in a block.
BLOCK_BYTES = 24 << 20
#: Input partitions whose rows of a frequent pre-token stay together, and the documents of a block from which it is frequent.
SHARE, FREQUENT = 8, 128
#: Sums that a task gathers before it passes them on.
GATHERED = 8 << 20

_ROWS = "block long, pretoken string, salt int, places binary, ids binary, sizes binary"


def pack(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes (seven bits each, low first) of unsigned values; the byte offset of each row start."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >= np.uint64(1) << np.uint64(7 * k)
        if not more.any():
            break
        size += more
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(int(ends[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        byte = (values[has] >> np.uint64(7 * k)) & np.uint64(0x7F)
        out[ends[:-1][has] + k] = byte | np.where(size[has] > k + 1, np.uint64(0x80), np.uint64(0))
    return out, ends[rows]


def unpack(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of ``pack`` and the byte at which each begins."""
    last = data < 128
    starts = np.flatnonzero(np.concatenate(([True], last[:-1]))) if len(data) else np.empty(0, np.int64)
    n = np.diff(np.append(starts, len(data)))
    out = np.zeros(len(starts), np.int64)
    for k in range(int(n.max(initial=0))):
        has = n > k
        out[has] |= (data[starts[has] + k].astype(np.int64) & 0x7F) << (7 * k)
    return out, starts


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def _special(path: str) -> list[str]:
    return sorted((t.content for t in _tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)


def count_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """Token count of every whole text: returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``tokenizer_path`` names a byte-level BPE file of the tokenizers library that splits by ``pattern``; its special
    strings inside a text count as one token, as the library has it. A null text counts as empty: 0 bytes, 0 tokens.
    One row for every row of ``docs``, also for null or repeated doc_ids; other columns are left out. An empty table
    gives an empty result.
    """
    odd, masked = pretokens.odd_characters()

    def block_rows(ordinal: int, ids: list, sizes: list, codes: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
        # the same on a retry: where the block lies in the input
        block = (TaskContext.get().partitionId() << 24) + ordinal
        n_docs, n_names = len(ids), len(names)
        doc = np.repeat(np.arange(n_docs), [len(c) for c in codes])
        key, freq = np.unique(np.concatenate(codes) * n_docs + doc, return_counts=True)
        name, doc = np.divmod(key, n_docs)
        first = np.concatenate(([True], np.diff(name) > 0)) if len(name) else np.empty(0, bool)
        gap = doc - np.where(first, 0, np.concatenate(([0], doc[:-1]))) if len(name) else doc
        often = freq > 1
        # per document: 2 * gap + (frequency over 1), then that frequency
        at = np.arange(len(gap)) + np.cumsum(often) - often
        values = np.empty(len(gap) + int(often.sum()), np.int64)
        values[at] = 2 * gap + often
        values[at[often] + 1] = freq[often]
        starts = np.append(at[first], len(values)) if len(name) else np.zeros(1, np.int64)
        data, offsets = pack(values, starts)
        spread = np.diff(np.append(np.flatnonzero(first), len(name)))
        salts = np.where(spread >= FREQUENT, 1 + TaskContext.get().partitionId() // SHARE, 0).astype(np.int32)
        order = name[first]
        none = pa.nulls
        meta = [pa.array([block]), none(1, pa.string()), pa.array([(31 * TaskContext.get().partitionId() + ordinal) % (1 << 30)], pa.int32()), none(1, pa.binary())]
        meta += [pa.array([_longs(ids)], pa.binary()), pa.array([np.array(sizes, np.int64).tobytes()], pa.binary())]
        k = len(order)
        places = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        rows = [pa.array(np.full(k, block, np.int64)), pa.array([names[i] for i in order.tolist()], pa.string()), pa.array(salts), places, none(k, pa.binary()), none(k, pa.binary())]
        columns = [c.strip().split(" ")[0] for c in _ROWS.split(",")]
        assert n_names >= k
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, columns) for x in (meta, rows)]).combine_chunks().to_batches()[0]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, special = pretokens.splitter(pattern, odd, masked).split, _special(tokenizer_path)
        parts = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None

        def pieces(text: str) -> list[str]:
            if parts is None or not any(s in text for s in special):
                return split(text)
            return list(itertools.chain.from_iterable([p] if k % 2 else split(p) for k, p in enumerate(parts(text))))

        ids, sizes, codes, table, ordinal = [], [], [], {}, 0
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids += batch.column("doc_id").to_pylist()
            sizes += [len(t.encode()) for t in texts]
            for t in texts:
                found = pieces(t)
                for f in set(found).difference(table):
                    table[f] = len(table)
                codes.append(np.array(list(map(table.__getitem__, found)), np.int64))
            if sum(sizes) >= BLOCK_BYTES:
                yield block_rows(ordinal, ids, sizes, codes, list(table))
                ids, sizes, codes, table, ordinal = [], [], [], {}, ordinal + 1
        if ids:
            yield block_rows(ordinal, ids, sizes, codes, list(table))

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("pretoken")))  # here, not in the plan: a filter would part the two exchanges
            found = tokenizer.encode_batch(batch.column("pretoken").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("pretoken"), batch.column("salts"), pa.array(list(map(len, found)), pa.int64())], ["pretoken", "salts", "n_pieces"])

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        names = ["block", "ids", "sizes", "sums"]

        def out() -> Iterator[pa.RecordBatch]:
            for block, values in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([pack(values, np.zeros(0, np.int64))[0].tobytes()], pa.binary())], names)
            sums.clear()

        for batch in batches:
            meta = pc.is_null(batch.column("pretoken"))
            if meta.true_count:
                own = batch.filter(meta)
                yield pa.RecordBatch.from_arrays([own.column("block"), own.column("ids"), own.column("sizes"), pa.nulls(own.num_rows, pa.binary())], names)
            rows = batch.filter(pc.invert(meta))
            if not rows.num_rows:
                continue
            rows = rows.take(pc.sort_indices(rows.column("block")))
            block, n = rows.column("block").to_numpy(), rows.column("n_pieces").to_numpy()
            places = rows.column("places")
            values, starts = unpack(np.frombuffer(b"".join(places.to_pylist()), np.uint8))
            row = np.searchsorted(np.cumsum(pc.binary_length(places).to_numpy()), starts, side="right")
            head = np.ones(len(values), bool)  # a frequency follows each odd value, whatever it is itself
            flagged = np.flatnonzero(values & 1).tolist()
            skip = -1
            for i in flagged:
                if i != skip and i + 1 < len(values):
                    head[i + 1] = False
                    skip = i + 1
            at = np.flatnonzero(head)
            freq = np.where(values[at] & 1, values[np.minimum(at + 1, len(values) - 1)], 1)
            row, gap = row[at], values[at] >> 1
            run = np.cumsum(gap)
            new = np.concatenate(([True], np.diff(row) > 0))
            doc = run - np.repeat((run - gap)[new], np.diff(np.append(np.flatnonzero(new), len(row))))
            for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]):
                x, y = np.searchsorted(row, [a, b])
                found = np.bincount(doc[x:y], (freq[x:y] * n[row[x:y]]).astype(np.float64)).astype(np.int64)
                had = sums.get(int(block[a]), np.zeros(0, np.int64))
                if len(had) < len(found):
                    had, found = found, had
                had[: len(found)] += found
                sums[int(block[a])] = had
            if sum(map(len, sums.values())) > GATHERED:
                yield from out()
        yield from out()

    def finish(table: pa.Table) -> pa.Table:
        ids, sizes, total = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, b, c in zip(*(table.column(x).to_pylist() for x in ("ids", "sizes", "sums")), strict=True):
            if c is None:
                ids, sizes = _from_longs(a), np.frombuffer(b, np.int64)
            else:
                more, _ = unpack(np.frombuffer(c, np.uint8))
                if len(total) < len(more):
                    total, more = more, total
                total[: len(more)] += more
        total = np.concatenate((total, np.zeros(len(sizes) - len(total), np.int64)))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": sizes, "n_tokens": total, "over_limit": total > limit})

    width = input_partitions(docs)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(blocks, _ROWS)
    # One exchange serves the counting and the join; both sides ask for the same columns of it, so it is reused.
    keyed = found.repartition(width, "pretoken", "salt")
    used = [F.sum(F.length(c)).alias(c) for c in ("places", "ids", "sizes")] + [F.max("block").alias("block")]
    distinct = keyed.groupBy("pretoken", "salt").agg(*used).filter("coalesce(places, ids, sizes, block) is not null")
    # each pre-token is counted once, wherever its parts are: this exchange holds distinct pre-tokens only
    salts = F.collect_list(F.when(F.col("pretoken").isNotNull(), F.col("salt"))).alias("salts")
    parts = distinct.groupBy("pretoken").agg(salts)
    pieces = parts.mapInArrow(pieces_of, "pretoken string, salts array<int>, n_pieces long").select("pretoken", F.explode("salts").alias("salt"), "n_pieces")
    joined = keyed.join(pieces, ["pretoken", "salt"], "left").select("block", "pretoken", "places", "ids", "sizes", "n_pieces")
    sums = joined.mapInArrow(partial_sums, "block long, ids binary, sizes binary, sums binary")
    return sums.groupBy("block").applyInArrow(finish, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _longs(values: list) -> bytes:
    """Longs that may be null, as bytes: the values, then which of them are null."""
    gone = np.array([v is None for v in values], np.uint8)
    return np.array([v or 0 for v in values], np.int64).tobytes() + gone.tobytes()


def _from_longs(data: bytes) -> list:
    n = len(data) // 9
    values, gone = np.frombuffer(data, np.int64, n).tolist(), np.frombuffer(data, np.uint8, n, 8 * n).tolist()
    return [None if g else v for v, g in zip(values, gone, strict=True)]
