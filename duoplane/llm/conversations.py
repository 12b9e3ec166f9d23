"""Conversation structure repair (operator 12): layers of rising cost over bitsets of grammar states.

A repaired conversation's role initials read ``(s?(ua)+)?``. Four states say how far a prefix has come: nothing yet, after s,
after u, after a. A layer holds, for every turn, the bitset of the states from which the rest can be accepted at exactly that
cost; it follows from cheaper layers (delete 2, rerole 1, insert 5, five more for a truncated turn that stays) and, as keeping is free,
from its own next turn. The first layer that accepts gives the cost; from there the bits are traced forward, the least letter
first, which gives the ASCII-least audit. Conversations are gone through in blocks of ``BLOCK`` turns, from the last to the first, a
block's ends priced by what follows: so the work is linear in the turns, and equal blocks are solved once.

Rows: nulls of role and text are one space. Turns are in rising order, nulls first, ties by role and then by the SHA-256 of the
text; rows equal in all are each other's copies, of which the first counts. A null conversation id is a conversation. Other
columns are not looked at; an empty table gives no rows.

Spark does the counting and ordering on rows without texts: copies are summed before they are shuffled, first uses are minima
by key, and order is a range partitioning, so that a long conversation lies over many tasks. A turn takes one byte in the
string that the layers go through, as it does in the audit. Texts are shuffled once, for the digest, which is a chain over a
conversation's rows in order: they are streamed, and never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import input_partitions

BLANK = r"[^\x20\x09-\x0D]"
BLOCK = 32
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: What acceptance costs after the last turn, by state: the inserts that complete a pair.
_AT_END = (0, 2 * INSERT, INSERT, 0)
_START, _S, _U, _A = range(4)
#: The state that a turn of either kind leads to, by state: user after anything but user, assistant after user.
_NEXT = (_U, _U, _A, _U)


def _before(states: int) -> int:
    """The states from which a user or assistant turn leads into ``states`` (bitsets)."""
    return (0b1011 if states >> _U & 1 else 0) | (1 << _U if states >> _A & 1 else 0)


_BEFORE = [_before(b) for b in range(16)]
_KEEP = {
    "s": [1 << _START if b >> _S & 1 else 0 for b in range(16)],
    "u": [0b1011 if b >> _U & 1 else 0 for b in range(16)],
    "a": [1 << _U if b >> _A & 1 else 0 for b in range(16)],
    "x": [0] * 16,
}


@lru_cache(maxsize=1 << 16)
def _block(turns: str, ends: tuple[int, int, int, int]) -> tuple[tuple[int, str, int], ...]:
    """For each state before ``turns``: (cost of the cheapest way to the end, its least audit, the state after it). ``ends``
    prices the states after the turns. Turns: s, u, a, x by role initial, capital if truncated, D if it has to go."""
    n = len(turns)
    layers: list[list[int]] = []
    found: dict[int, int] = {}
    nothing = [0] * (n + 1)
    at = lambda cost: layers[cost] if cost >= 0 else nothing
    while len(found) < 4:
        cost = len(layers)
        layer = [0] * (n + 1)
        layers.append(layer)
        layer[n] = sum(1 << q for q in range(4) if ends[q] == cost)
        gone, added = at(cost - DELETE), at(cost - INSERT)
        for i in range(n - 1, -1, -1):
            c = turns[i]
            states = gone[i + 1] | _BEFORE[added[i]]
            if c != "D":
                more = TRUNCATED if c.isupper() else 0
                states |= _KEEP[c.lower()][at(cost - more)[i + 1]] | _BEFORE[at(cost - more - REROLE)[i + 1]]
            layer[i] = states
        for q in range(4):
            if layer[0] >> q & 1:
                found.setdefault(q, cost)
    return tuple(_traced(turns, layers, q, found[q]) for q in range(4))


def _traced(turns: str, layers: list[list[int]], start: int, total: int) -> tuple[int, str, int]:
    """The least letters on a way of ``total`` from ``start``, by the bits of the layers."""
    has = lambda cost, i, q: cost >= 0 and layers[cost][i] >> q & 1
    audit, i, state, cost = [], 0, start, total
    while i < len(turns):
        c = turns[i]
        more = TRUNCATED if c.isupper() and c != "D" else 0
        onward, kept = _NEXT[state], _kept(c, state)
        if has(cost - DELETE, i + 1, state):
            letter, i, cost = "D", i + 1, cost - DELETE
        elif has(cost - INSERT, i, onward):
            letter, state, cost = "I", onward, cost - INSERT
        elif kept is not None and has(cost - more, i + 1, kept):
            letter, i, state, cost = "K", i + 1, kept, cost - more
        else:
            letter, i, state, cost = "R", i + 1, onward, cost - more - REROLE
        audit.append(letter)
    return total, "".join(audit), state


def _kept(turn: str, state: int) -> int | None:
    """The state after keeping a turn; None where the grammar doesn't take it."""
    c = turn.lower()
    if c == "s":
        return _S if state == _START else None
    return _NEXT[state] if c != "x" and turn != "D" and (c == "u") == (state != _U) else None


def least_repair(turns: str) -> tuple[int, str]:
    """(cost, ASCII-least audit) of the cheapest edits of a conversation."""
    ends, prices, base = _AT_END, [], 0
    starts = range(0, len(turns), BLOCK)
    for i in reversed(starts):
        prices.append(ends)
        costs = [c for c, _, _ in _block(turns[i : i + BLOCK], ends)]
        base += min(costs)
        ends = tuple(c - min(costs) for c in costs)
    audit, state = [], _START
    for i in starts:
        _, letters, state = _block(turns[i : i + BLOCK], prices.pop())[state]
        audit.append(letters)
    return base + ends[_START], "".join(audit) + "I" * (_AT_END[state] // INSERT)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: the faults that the fixed rule plants. A row that it repeats is there twice."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rule = F.crc32(key) % 20
    text = F.coalesce("text", space)
    changed = rows.select(
        "conv_id", "turn", F.when(rule == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(rule == 1, "").when(rule == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), rule.alias("_rule"),
    )
    return changed.withColumn("_n", F.explode(F.when(F.col("_rule") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("conv_id", "turn", "role", "text", (F.col("_rule") == 0).alias("dropped"))


def _digest() -> Column:
    """What tells rows of equal turn and role apart, and orders them."""
    return F.unhex(F.sha2(F.col("text"), 256))


def _slim(rows: DataFrame) -> DataFrame:
    """Rows without texts, copies summed: conv_id, turn, role, digest, mark (the turn's letter; B if blank), m."""
    last = F.regexp_extract(F.col("text"), r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    mark = F.when(~F.col("text").rlike(BLANK), "B").when(last.isin(".", "!", "?"), kind).otherwise(F.upper(kind))
    marked = rows.select("conv_id", "turn", "role", _digest().alias("digest"), mark.alias("mark"))
    return marked.groupBy("conv_id", "turn", "role", "digest").agg(F.max("mark").alias("mark"), F.count("*").alias("m"))


def _in_order() -> list[Column]:
    return [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "digest")]


_SEGMENT = {"conv_id": None, "at": "long", "turns": "string", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "distinct": "long", "first_turn": "long", "last_turn": "long", "first_role": "string", "last_role": "string"}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted slim rows to one row for each conversation of a task: its letters and counts, and its ends, by which segments
    of neighbouring tasks are put together."""
    open_: dict | None = None
    out: list[dict] = []
    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), *[pa.field(c, pa.string() if t == "string" else pa.int64()) for c, t in list(_SEGMENT.items())[1:]]])
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "mark", "m", "first", "at")]
        for conv, turn, role, mark, m, first, at in zip(*columns, strict=True):
            if open_ is None or open_["conv_id"] != conv:
                if open_ is not None:
                    out.append(open_)
                open_ = dict.fromkeys(_SEGMENT, 0) | {"conv_id": conv, "at": at, "turns": [], "first_turn": None, "last_turn": None, "first_role": None, "last_role": None}
            if not m:  # the mark of a conversation, which may have no rows
                continue
            s, letter = open_, role[:1]
            stays = mark != "B" and first
            s["turns"].append((mark if stays else "") + "D" * (m - bool(stays)))
            s["blank"] += m if mark == "B" else 0
            s["duplicate"] += m - first if mark != "B" else 0
            s["truncated"] += bool(stays and mark.isupper())
            s["illegal"] += (m - 1) + (s["last_role"] is not None and s["last_role"] + letter not in ("su", "ua", "au"))
            s["first_role"] = letter if s["first_role"] is None else s["first_role"]
            s["last_role"] = letter
            if turn is not None and turn != s["last_turn"]:
                s["distinct"] += 1
                s["first_turn"] = turn if s["first_turn"] is None else s["first_turn"]
                s["last_turn"] = turn
        if len(out) > 4096:
            yield _segment_rows(out, schema)
            out = []
    if open_ is not None:
        yield _segment_rows([*out, open_], schema)


def _segment_rows(out: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([s | {"turns": "".join(s["turns"])} for s in out], schema)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations (with their segments in order) to counts, cost and audit."""
    for batch in batches:
        out = []
        for segments in batch.column("segments").to_pylist():
            total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct"), 0)
            lowest = highest = role = None
            turns = []
            for s in segments:
                for c in total:
                    total[c] += s[c]
                turns.append(s["turns"])
                if s["first_role"] is not None:
                    total["illegal"] += role is not None and role + s["first_role"] not in ("su", "ua", "au")
                    role = s["last_role"]
                if s["first_turn"] is not None:
                    total["distinct"] -= highest == s["first_turn"]
                    lowest, highest = (s["first_turn"] if lowest is None else lowest), s["last_turn"]
            cost, audit = least_repair("".join(turns))
            gaps = 0 if lowest is None else highest - lowest + 1 - total["distinct"]
            out.append({"gaps": gaps, **{c: total[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit})
        schema = pa.schema([(c, pa.string() if c == "audit" else pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")])
        found = pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *found.columns], ["conv_id", *schema.names])


RESULT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string"}


def _typed(rows: DataFrame, columns: dict[str, str | None]) -> T.StructType:
    kinds = {"long": T.LongType(), "string": T.StringType()}
    return T.StructType([T.StructField(c, kinds[t] if t else rows.schema[c].dataType) for c, t in columns.items()])


def repairs(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text, dropped): conv_id, RESULT. ``turn`` is a long."""
    slim = _slim(rows.filter("not dropped"))
    used = slim.filter("mark <> 'B'").groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("t"))
    marks = rows.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("mark"), F.lit(0).cast("long").alias("m"), F.lit(0).alias("first"))
    each = slim.withColumn("first", F.lit(0)).unionByName(used.select("conv_id", "t.turn", "role", "digest", F.lit("").alias("mark"), F.lit(0).cast("long").alias("m"), F.lit(1).alias("first"))).unionByName(marks)
    each = each.groupBy("conv_id", "turn", "role", "digest").agg(F.max("mark").alias("mark"), F.max("m").alias("m"), F.max("first").alias("first"))
    ranged = each.repartitionByRange(input_partitions(rows), *_in_order()).sortWithinPartitions(*_in_order()).withColumn("at", F.monotonically_increasing_id())
    segments = ranged.select("conv_id", "turn", "role", "mark", "m", "first", "at").mapInArrow(_segments, _typed(rows, _SEGMENT))
    # a conversation has a segment in each of the tasks that it lies over: so many rows meet here, each a byte a turn
    gathered = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*list(_SEGMENT)[1:]))).alias("segments"))
    return gathered.mapInArrow(_solved, _typed(rows, {"conv_id": None} | RESULT))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams conversations, each led by its row with the audit, and digests what the audit leaves."""
    lead: dict | None = None
    out: list[dict] = []
    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), *[(c, pa.string() if c == "audit" else pa.int64()) for c in RESULT], ("repaired_sha256", pa.string())])
        columns = [batch.column(c) for c in ("conv_id", "role", "text", "lead")]
        for i in range(batch.num_rows):
            if (head := columns[3][i].as_py()) is not None:
                if lead is not None:
                    out.append(_finished(lead))
                lead = head | {"conv_id": columns[0][i].as_py(), "at": 0, "state": _START, "hash": hashlib.sha256(), "any": False}
            else:
                _step(lead, columns[1][i].as_py(), columns[2][i].as_py())
        if len(out) > 1024:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if lead is not None:
        yield pa.RecordBatch.from_pylist([*out, _finished(lead)], schema)


def _put(lead: dict, role: str, text: str) -> None:
    lead["hash"].update(f"{chr(10) if lead['any'] else ''}{role}:{text}".encode())
    lead["any"] = True


def _inserts(lead: dict) -> None:
    audit = lead["audit"]
    while lead["at"] < len(audit) and audit[lead["at"]] == "I":
        lead["state"] = _NEXT[lead["state"]]
        _put(lead, "user" if lead["state"] == _U else "assistant", "")
        lead["at"] += 1


def _step(lead: dict, role: str, text: str) -> None:
    _inserts(lead)
    letter = lead["audit"][lead["at"]]
    lead["at"] += 1
    if letter == "D":
        return
    if letter == "K" and role[:1] == "s":
        lead["state"] = _S
    else:
        lead["state"] = _NEXT[lead["state"]]
        role = role if letter == "K" else "user" if lead["state"] == _U else "assistant"
    _put(lead, role, text)


def _finished(lead: dict) -> dict:
    _inserts(lead)
    return {c: lead[c] for c in ("conv_id", *RESULT)} | {"repaired_sha256": lead["hash"].hexdigest()}


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation of ``rows`` (conv_id, turn, role, text, dropped)."""
    found = repairs(rows)
    leads = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.struct(*RESULT).alias("lead"))
    texts = rows.filter("not dropped").select("conv_id", "turn", "role", "text", F.lit(None).cast(leads.schema["lead"].dataType).alias("lead"))
    streamed = leads.unionByName(texts).withColumn("digest", _digest()).withColumn("follows", F.col("lead").isNull())
    order = [F.asc_nulls_first("conv_id"), F.asc("follows"), *_in_order()[1:]]
    ordered = streamed.repartition(input_partitions(rows), "conv_id").sortWithinPartitions(*order)
    return ordered.select("conv_id", "role", "text", "lead").mapInArrow(_hashed, _typed(rows, {"conv_id": None} | RESULT | {"repaired_sha256": "string"}))


#: crc32 byte by byte; rows in order; then the cheapest way to each state, row by row, least audit first.
ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
ruled AS (
  SELECT *, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(k) + 1), lambda i: list_concat([ascii(k[i])::BIGINT], list_transform(range(8), lambda z: -1::BIGINT))))),
    lambda h, b: CASE WHEN b >= 0 THEN xor(h, b) WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END)) % 20 AS r FROM keyed),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN r = 4 THEN 'user' ELSE role END AS role, CASE WHEN r = 1 THEN '' WHEN r = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM ruled, unnest(CASE WHEN r = 3 THEN [1, 2] ELSE [1] END) AS t(copy) WHERE r <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM rows_),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS use FROM placed),
judged AS (
  SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN use > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM numbered),
convs AS (SELECT DISTINCT conv_id FROM conversations),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, ''::VARCHAR AS made, [] ::VARCHAR[] AS out FROM convs
  UNION ALL
  SELECT conv_id, i, q, cost, audit, made, out FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS best FROM (
      SELECT w.conv_id, j.i, o.q2 AS q, w.cost + 5 * n.k + o.cost + CASE WHEN o.e <> 'D' AND j.fault = 'truncated' THEN 5 ELSE 0 END AS cost, w.audit || repeat('I', n.k) || o.e AS audit, '' AS made,
        list_concat(w.out, list_concat(list_transform(range(n.k::BIGINT), lambda z: CASE WHEN (w.q = 2) = (z = 0) THEN 'assistant:' ELSE 'user:' END),
          CASE o.e WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [CASE o.q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || j.text] END)) AS out
      FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
      JOIN (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)) n(q, k, q1) ON n.q = w.q
      JOIN (VALUES (0, 'D', '', 0, 2), (1, 'D', '', 1, 2), (2, 'D', '', 2, 2), (3, 'D', '', 3, 2), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0),
        (0, 'R', '', 2, 1), (1, 'R', '', 2, 1), (3, 'R', '', 2, 1), (2, 'R', '', 3, 1)) o(q1, e, c, q2, cost)
        ON o.q1 = n.q1 AND (o.c = '' OR o.c = j.c) AND (o.e = 'D' OR j.fault NOT IN ('blank', 'duplicate')))) WHERE best = 1),
lengths AS (SELECT c.conv_id, count(j.i) AS n FROM convs c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
ended AS (
  SELECT w.conv_id, w.cost + CASE w.q WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END AS cost, w.audit || CASE w.q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
    list_concat(w.out, CASE w.q WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END) AS out
  FROM ways w JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.n = w.i),
best AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT b.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
  coalesce(c.illegal, 0)::BIGINT AS illegal, b.cost::BIGINT AS cost, b.audit, sha256(array_to_string(b.out, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""
