"""N-gram Jaccard join (operator 8): documents whose sets of word shingles are similar, as a grouped prefix join.

1. One pass makes each document's distinct shingles. Each block of documents sends its distinct ones, with the number of
   its documents that have each, packed by range of hash, to tasks that find which of them occur in two documents or more
   and in how many; a shingle of one document links nothing. What comes back to each document is the list of its shared
   shingles, rarest first. All later steps use these lists: the overlap of two documents is that of their lists.
2. Documents of equal sets become one class, with its smallest row for all.
3. A document of n shingles can only be linked through the first n - ceil(t n) + 1 of them in the global order (its
   prefix). A sweep verifies each class against two rows of each of its min-hash buckets, that of the commonest shingles
   and any other. That joins the large groups of near copies without forming their pairs.
4. Classes of equal prefix, size and component so far collapse into one group. Groups are joined on prefix shingles and
   on the sizes that length and position leave to partners, each pair of groups once, and expanded to their members, which are
   verified: one of each group with all of the other, then the rest where that found no link. Only
   pairs of different components are formed: a shingle's largest component meets the others' groups, never itself.

Every link between different sets is either verified or lies within a component that verified links hold together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, input_partitions, join_facts, repeat_ranges, slices, staged, unused
from .components import components
from .token_counts import pack, unpack

#: Words of a shingle, and the similarity in hundredths from which two documents are linked.
WORDS, PERCENT = 5, 75
#: Bits of a shingle's hash. Two of some hundred shingles of a pair of documents meet by chance once in 10**9 pairs.
HASH_BITS = 48
#: Bytes of text, and documents, after which a block is full; bytes of text for each range of hashes.
BLOCK_BYTES, BLOCK_DOCS, RANGE_BYTES = 4 << 20, 1 << 20, 16 << 20
#: Up to so many bits of a range's name, blocks send to ranges; beyond, through routes, or rows would be as many as blocks times ranges.
DIRECT_BITS = 10
#: Min-hash buckets of a document. They only save work: what they miss, the prefix join finds.
BUCKETS = 4

#: Groups of a shingle that meet by it alone, at most; the width of a band of sizes.
FEW_GROUPS, BAND = 32, 0.02

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_ODD = np.random.default_rng(20240301).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct shingle hashes of a text, from hashes of its words."""

    def __init__(self, words: int) -> None:
        self._k, self._known = words, {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        found = text.encode().translate(_LOWER).split()
        if not found:
            return np.zeros(0, np.uint64)
        known = self._known
        if len(known) > 200_000:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in found], np.uint64)
        n = max(1, len(h) - self._k + 1)
        x = np.full(n, min(len(h), self._k), np.uint64)
        for j in range(min(len(h), self._k)):
            x += h[j : j + n] * _ODD[j]
        return np.unique(_mix(x) >> np.uint64(64 - HASH_BITS))


def _shared(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row for every row of ``docs``: row, doc_id, own, n (distinct shingles), central (in how many documents one occurs
    on average), tokens (shared shingles as numbers, rarest first), prefix (those of them in the prefix), hashes (its
    min-hashes), h1 and h2 (of the set, where all of it is shared)."""
    width = input_partitions(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(1, int(np.ceil(np.log2(max(width * 2, size / RANGE_BYTES)))))  # of the hash, which name its range
    # of many ranges, those that agree in their upper bits are one route; about as many blocks as a route has ranges share one
    below = bits // 2 if bits > DIRECT_BITS else 0
    bundles = max(1, int(size / BLOCK_BYTES) >> below)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, ordinal = Shingler(words), 0
        ids, own, sets, size = [], [], [], 0
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            ids += batch.column("doc_id").to_pylist()
            own += batch.column("own").to_pylist()
            sets += [shingles(t or "") for t in texts]
            size += sum(map(len, filter(None, texts)))
            if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                yield from block(ordinal, ids, own, sets)
                ids, own, sets, size, ordinal = [], [], [], 0, ordinal + 1
        if ids:
            yield from block(ordinal, ids, own, sets)
        del ids, own, sets, shingles
        give_back()

    kinds = {"range": pa.int64(), "block": pa.int64(), "hashes": pa.binary(), "counts": pa.binary(), "places": pa.binary(), "doc_id": pa.list_(pa.int64()), "own": pa.list_(pa.int64()), "n": pa.list_(pa.int32())}
    packed_schema = "range long, block long, hashes binary, counts binary, places binary, doc_id array<long>, own array<long>, n array<int>"
    none = np.zeros(0, np.int64)

    def packed(values: np.ndarray) -> bytes:
        return pack(values, none)[0].tobytes()

    def unpacked(data: bytes) -> np.ndarray:
        return unpack(np.frombuffer(data, np.uint8))[0]

    def row(**values: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([values.get(c)], t) for c, t in kinds.items()], list(kinds))

    def block(ordinal: int, ids: list, own: list, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 24) + ordinal  # the same on a retry
        n = [len(s) for s in sets]
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        doc, flat = np.repeat(np.arange(len(n)), n)[order], flat[order]
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else none
        counts, flat = np.diff(np.append(first, len(flat))), flat[first]
        # what only this block needs passes by the ranges
        yield row(range=-1 - number, block=number, counts=packed(counts), places=packed(doc), doc_id=ids, own=own, n=n)
        shift = np.uint64(HASH_BITS - bits + below)
        cuts = np.searchsorted(flat >> shift, np.arange((1 << (bits - below)) + 1, dtype=np.uint64))
        low = flat & ((np.uint64(1) << shift) - np.uint64(1))
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[r], cuts[r + 1]
            yield row(range=r, block=number, hashes=packed(np.diff(low[a:b], prepend=np.uint64(0))), counts=packed(counts[a:b]))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        """Of one range, block by block: in how many documents each of its shingles is (0: one), and the shared ones' numbers."""
        if key[0].as_py() < 0:
            return table.append_column("times", pa.nulls(len(table), pa.binary())).append_column("tokens", pa.nulls(len(table), pa.binary())).drop_columns(["hashes"])
        table = table.take(pc.sort_indices(table, [("block", "ascending")]))
        hashes = [np.cumsum(unpacked(h)) for h in table.column("hashes").to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
        flat, counts = np.concatenate(hashes), np.concatenate(list(map(unpacked, table.column("counts").to_pylist())))
        order = np.argsort(flat, kind="stable")
        new = np.concatenate(([True], np.diff(flat[order]) > 0))
        total = np.add.reduceat(counts[order], np.flatnonzero(new))
        which = np.empty(len(flat), np.int64)
        which[order] = np.cumsum(new) - 1
        number = (np.cumsum(total > 1) - 1) * (1 << bits) + key[0].as_py()
        times, token = np.where(total > 1, total, 0)[which], number[which]
        bounds = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        return pa.table({
            "range": table.column("range"), "block": table.column("block"), "counts": pa.nulls(len(table), pa.binary()), "places": pa.nulls(len(table), pa.binary()),
            "doc_id": pa.nulls(len(table), kinds["doc_id"]), "own": pa.nulls(len(table), kinds["own"]), "n": pa.nulls(len(table), kinds["n"]),
            "times": pa.array([packed(times[a:b]) for a, b in bounds], pa.binary()), "tokens": pa.array([token[a:b][times[a:b] > 0].tobytes() for a, b in bounds], pa.binary()),
        })

    def bundled(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of a bundle's blocks on one route: their hashes, the distinct ones of all, and in how many documents each is."""
        hashes = [np.cumsum(unpacked(h)).astype(np.int64) for h in table.column("hashes").to_pylist()]
        every, which = np.unique(np.concatenate(hashes), return_inverse=True)
        return hashes, every, np.bincount(which, np.concatenate(list(map(unpacked, table.column("counts").to_pylist()))), len(every)).astype(np.int64)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        """A bundle's hashes of one route, by range: one row for all its blocks."""
        _, every, total = bundled(table)
        shift = HASH_BITS - bits
        out = []
        for r in np.unique(every >> shift).tolist():
            a, b = np.searchsorted(every, [r << shift, (r + 1) << shift])
            low = every[a:b] - (r << shift)
            out.append({"range": (key[0].as_py() << below) + r, "block": key[1].as_py(), "hashes": packed(np.diff(low, prepend=0)), "counts": packed(total[a:b])})
        return pa.Table.from_pylist(out, pa.schema(list(kinds.items())))

    def split(key: tuple, sent: pa.Table, back: pa.Table) -> pa.Table:
        """What the ranges say of a bundle's hashes, for each of its blocks."""
        hashes, every, _ = bundled(sent)
        back = back.take(pc.sort_indices(back, [("range", "ascending")]))
        times = np.concatenate([none, *map(unpacked, back.column("times").to_pylist())])
        token = np.zeros(len(times), np.int64)
        token[times > 0] = np.frombuffer(b"".join(back.column("tokens").to_pylist()), np.int64)
        out = []
        for block_, own in zip(sent.column("block").to_pylist(), hashes, strict=True):
            at = np.searchsorted(every, own)
            out.append({"range": key[0].as_py(), "block": block_, "times": packed(times[at]), "tokens": token[at][times[at] > 0].tobytes()})
        return pa.Table.from_pylist(out, pa.schema([*kinds.items(), ("times", pa.binary()), ("tokens", pa.binary())]).remove(2))

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        """All of a block's shared shingles, document by document."""
        table = table.take(pc.sort_indices(table, [("range", "ascending")]))
        facts, rest = table.slice(0, 1), table.slice(1)  # its own facts have a negative range
        counts, places = unpacked(facts.column("counts")[0].as_py()), unpacked(facts.column("places")[0].as_py())
        times = np.concatenate([none, *map(unpacked, rest.column("times").to_pylist())])
        token = np.zeros(len(times), np.int64)
        token[times > 0] = np.frombuffer(b"".join(rest.column("tokens").to_pylist()), np.int64)
        entry = np.repeat(np.arange(len(counts)), counts)
        shared = times[entry] > 0
        doc, entry = places[shared], entry[shared]
        token, times = token[entry], times[entry]
        order = np.lexsort((token, times, doc))
        doc, token, times = doc[order], token[order], times[order]
        ids, own, n = (facts.column(c)[0].as_py() for c in ("doc_id", "own", "n"))
        ends = np.searchsorted(doc, np.arange(len(ids) + 1))
        have, size = np.diff(ends), np.array(n, np.int64)
        first = size - -(-percent * size // 100) + 1 - (size - have)  # those before it are of one document only
        first = np.where(size > 0, np.clip(first, 0, have), 0)
        hashes, whole = np.zeros((BUCKETS, len(ids)), np.int64), np.zeros((2, len(ids)), np.int64)
        some = np.flatnonzero(have)
        for k in range(BUCKETS if len(token) else 0):
            mixed = (_mix(token.astype(np.uint64) * _ODD[40 + k]) >> np.uint64(1)).astype(np.int64)
            hashes[k, some] = np.minimum.reduceat(mixed, ends[:-1][some])
        for k in range(2 if len(token) else 0):  # of the set: sums of independent hashes
            whole[k, some] = np.add.reduceat(_mix((token.astype(np.uint64) + np.uint64(1)) * _ODD[50 + k]), ends[:-1][some]).astype(np.int64)
        partly = (have < size) | (size == 0)
        lists = lambda a, b: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(b - a))).astype(np.int32)), pa.array(token[repeat_ranges(a, b - a)]))
        return pa.table({
            "row": (key[0].as_py() << 24) + np.arange(len(ids)), "doc_id": pa.array(ids, pa.int64()), "own": pa.array(own, pa.int64()), "n": size,
            "central": np.bincount(doc, times, len(ids)) / np.maximum(size, 1),
            "tokens": lists(ends[:-1], ends[1:]), "prefix": lists(ends[:-1], ends[:-1] + first), "hashes": pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BUCKETS), pa.array(hashes.T.ravel())),
            "h1": pa.array(whole[0], mask=partly), "h2": pa.array(whole[1], mask=partly),
        })

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("own"))
    counted_schema = "range long, block long, counts binary, places binary, doc_id array<long>, own array<long>, n array<int>, times binary, tokens binary"
    sent = texts.mapInArrow(cut, packed_schema)
    if below:
        sent = staged(sent.withColumn("bundle", F.pmod(F.xxhash64("block"), F.lit(bundles))), "routes")
        routed = sent.filter("range >= 0")
        merged = routed.groupBy("range", "bundle").applyInArrow(merge, packed_schema)
        back = merged.groupBy("range").applyInArrow(count, counted_schema).select("range", F.shiftright("range", below).alias("route"), F.col("block").alias("bundle"), "times", "tokens")
        counted = routed.groupBy("range", "bundle").cogroup(back.groupBy("route", "bundle")).applyInArrow(split, counted_schema)
        facts = sent.filter("range < 0").drop("bundle", "hashes").withColumns({"times": F.lit(None).cast("binary"), "tokens": F.lit(None).cast("binary")})
        counted = counted.unionByName(facts)
    else:
        counted = sent.groupBy("range").applyInArrow(count, counted_schema)
    made = counted.groupBy("block").applyInArrow(gather, "row long, doc_id long, own long, n long, central double, tokens array<long>, prefix array<long>, hashes array<long>, h1 long, h2 long")
    return staged(made, "shingles")


def _verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b of rows) whose overlap reaches ``percent`` of their union. A row of many pairs is dealt out."""
    pairs = staged(pairs, "pairs")
    total = pairs.count()
    if not total:
        return pairs
    for side in "ab":
        times = pairs.groupBy(side).agg(F.count("*").alias("k"))
        sets = rows.select(F.col("row").alias(side), F.col("n").alias(f"n_{side}"), F.col("tokens").alias(f"t_{side}")).join(times, side)
        known = join_facts(pairs if side == "a" else known, sets, [side], "k", total)
    known = known.withColumn("both", F.size(F.array_intersect("t_a", "t_b")))
    return staged(known.filter(F.col("both") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"), "links")


def _united(so_far: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) with more links (a, b)."""
    if links.isEmpty():
        return so_far
    return components(so_far.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def _pairs(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (group_a, group_b, k_a, k_b) of different components that may be linked: those that share a prefix shingle, each pair at
    the first one, with sizes and positions that leave room for the overlap.

    From a shingle at a position of a list on, so much is left; with a partner of more than a certain size that isn't enough. So each posting
    knows the sizes of its partners before it meets any. Where few groups have a shingle they meet by the shingle alone; for others, sizes are cut into
    narrow bands: a posting waits in the band of its size, and asks in the bands of its partners' sizes only. A shingle that many
    texts have late in their lists brings together none of them that couldn't be linked.
    """
    postings = groups.select("group", "n", "len", "component", "k", F.posexplode("prefix").alias("at", "token"))
    # overlap * (100 + percent) >= percent * (n_a + n_b)
    most = F.floor((F.col("len") - F.col("at")) * (100 + percent) / percent - F.col("n"))
    postings = postings.withColumn("most", F.least(most, F.floor(F.col("n") * 100 / percent)))
    postings = postings.filter(F.col("most") * 100 >= percent * F.col("n"))
    tally = postings.groupBy("token", "component").agg(F.count("*").alias("j"))
    largest = tally.groupBy("token").agg(F.max(F.struct("j", "component")).alias("top"), F.count("*").alias("parts"), F.sum("j").alias("j")).filter("parts > 1")
    largest = staged(largest.select("token", F.col("top.component").alias("top"), "j", (F.col("j") > FEW_GROUPS).alias("many")), "tokens")
    mixed = staged(join_facts(postings, largest, ["token"], "j", groups.count()), "postings")
    kept = ["group", "n", "most", "at", "component", "k"]
    side = lambda df, c: df.select("token", "band", *(["top"] if c == "b" else []), *[F.col(x).alias(f"{x}_{c}") for x in kept])
    band = lambda n: F.floor(F.ln(n) / float(np.log1p(BAND))).cast("int")
    few, many = (mixed.filter("not many").withColumn("band", F.lit(-1))), mixed.filter("many")
    a = side(few.unionByName(many.withColumn("band", band("n"))).filter("component <> top"), "a")
    asked = F.sequence(band(F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100))), band("most"))
    b = side(few.unionByName(many.withColumn("band", F.explode(asked))), "b")
    fits = (F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("top")) | (F.col("group_a") < F.col("group_b")))
    fits &= (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b"))
    return staged(a.join(b, ["token", "band"]).filter(fits).select("group_a", "group_b", "k_a", "k_b").distinct(), "group_pairs")


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """row, doc_id, own (hash of the text), n_shingles and component (a row number) for every row of ``docs``; ``edges``
    of the module's description are not expanded.

    Texts are lower-cased (A-Z) and cut at white space (blank, tab to carriage return); a text of fewer words than a
    shingle has one shingle, one without words or a null text none and is linked with nothing. Repeated and null doc_ids
    are rows of their own. An empty table gives an empty result.
    """
    rows = _shared(docs, words, percent)
    total = rows.count()
    # equal sets: nothing but shared shingles, the same ones
    alike = ["n", "h1", "h2"]
    same = rows.filter("h1 is not null").select("row", *alike)
    first = same.groupBy(*alike).agg(F.min("row").alias("first"), F.count("*").alias("k")).filter("k > 1")
    copies = staged(join_facts(same, first, alike, "k", total).filter("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b")), "copies")
    used = rows.filter(F.size("prefix") > 0).select("row", "n", "central", F.size("tokens").alias("len"), "prefix", "hashes")
    used = staged(used.join(copies.select(F.col("a").alias("row")), "row", "left_anti"), "used")

    # edited copies are nearer to what they were made from than to each other; the other hub is any of the bucket
    buckets = used.select("row", "central", F.posexplode("hashes").alias("k", "h"))
    draws = [F.min(F.struct(draw.alias("draw"), "row"))["row"] for draw in (-F.col("central"), F.xxhash64("row", "k"))]
    hubs = buckets.groupBy("k", "h").agg(F.array_distinct(F.array(*draws)).alias("hubs"), F.count("*").alias("many")).filter("many > 1")
    swept = join_facts(buckets, hubs, ["k", "h"], "many", BUCKETS * total).select(F.col("row").alias("a"), F.explode("hubs").alias("b"))
    links = _verified(swept.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), rows, percent)
    so_far = components(links)

    key = ["n", "p1", "p2", "component"]
    prefixed = used.select("row", "n", "len", "prefix", F.xxhash64("prefix").alias("p1"), F.xxhash64(F.lit("again"), "prefix").alias("p2"))
    named = prefixed.join(so_far.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("root", "row")).drop("root")
    named = staged(named, "named")
    groups = staged(named.groupBy(*key).agg(F.min("row").alias("group"), F.max("len").alias("len"), F.min("prefix").alias("prefix"), F.count("*").alias("k")), "groups")
    pairs = _pairs(groups, percent)
    if not pairs.isEmpty():
        many = groups.select("group", *key, "k")
        members = staged(join_facts(named.select("row", *key), many, key, "k", total).select("group", "row"), "members")
        m_a, m_b = (members.select(F.col("group").alias(f"group_{c}"), F.col("row").alias(c)) for c in "ab")
        # all of a group are one component already: a link of any two joins the groups, and mostly that of one of them with any of the other is there
        one = pairs.join(m_b, "group_b").select(F.col("group_a").alias("a"), "b").unionByName(pairs.join(m_a, "group_a").select("a", F.col("group_b").alias("b"))).distinct()
        so_far = _united(so_far, _verified(one, rows, percent))
        left = pairs.filter("k_a > 1 and k_b > 1")
        for c in "ab":
            left = left.join(so_far.select(F.col("node").alias(f"group_{c}"), F.col("root").alias(f"root_{c}")), f"group_{c}", "left")
        left = staged(left.filter(F.coalesce("root_a", "group_a") != F.coalesce("root_b", "group_b")).select("group_a", "group_b"), "left")
        if not left.isEmpty():
            so_far = _united(so_far, _verified(left.join(m_a, "group_a").join(m_b, "group_b").select("a", "b"), rows, percent))
    # a copy is where the first of its set is
    placed = rows.select("row", "doc_id", "own", F.col("n").alias("n_shingles")).join(copies.select(F.col("a").alias("row"), "b"), "row", "left").withColumn("node", F.coalesce("b", "row")).drop("b")
    return placed.join(so_far, "node", "left").select("row", "doc_id", "own", "n_shingles", F.coalesce("root", "node").alias("component"))


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included; null only where no
    document of the component has an id), one row for every row of ``docs``. See ``classes``."""
    found = staged(classes(docs, words, percent), "classes")
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k"))
    alone = found.join(least.filter("k > 1"), "component", "left_anti").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return join_facts(found, least.filter("k > 1"), ["component"], "k", found.count()).select("doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The columns of ``docs``, whatever they are called, with one document of each component: that of the smallest doc_id
    (nulls last; of repeated ids one text). Rows equal in doc_id and text count as one document; those without words are
    in no group and all stay, repeated rows aside. An empty table stays empty."""
    keys = unused(docs.columns, "id", "none", "own")
    identity = [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.col("doc_id").isNull()]
    found = classes(docs, words, percent).select(*[x.alias(c) for x, c in zip([*identity, F.col("own")], keys, strict=True)], "component")
    kept = found.groupBy("component").agg(F.min(F.struct(*keys)).alias("k")).select("k.*").distinct()
    mine = docs.withColumns(dict(zip(keys, [*identity, F.xxhash64("text")], strict=True)))
    return mine.join(kept, keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])
