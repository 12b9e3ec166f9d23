"""Operators 11 to 13 against brute force: nulls, ties, repeats, clashing columns, odd vectors, long conversations."""

import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from duoplane.llm import conversations, neardup, whitening

VECTORS = "vec_id long, embedding array<float>, label int, n long, component int, task string"


def rows_of(rnd, n, d=8):
    out = [(i, [rnd.gauss(0, 0.4) for _ in range(d)], i % 3, 1, 2, "x") for i in range(n)]
    out += [(n + i, out[i][1], out[i][2], 1, 2, "x") for i in range(5)]  # copies
    out += [(n + 10, None, 1, 1, 2, "x"), (n + 11, [1.0] * (d - 1) + [None], 1, 1, 2, "x"), (n + 12, [math.nan] + [1.0] * (d - 1), 1, 1, 2, "x"), (n + 13, [], 1, 1, 2, "x")]
    return out + [(None, [0.25] * d, 0, 1, 2, "x"), (n + 14, [0.0] * d, 0, 1, 2, "x"), (n + 15, [-0.0] * d, 0, 1, 2, "x"), (n + 16, out[0][1], None, 1, 2, "x"), (0, out[0][1], out[0][2], 1, 2, "x")]


# -------------------------------------------------------------------------------------------------------- whitening


def plain_whitening(vectors, k=4):
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    y = (fit * n - sums).astype(float) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    return n, [sum(int(c) ** 2 for c in r * n - sums) for r in x], ((x * n - sums).astype(float) / n) @ q[:, :k] / np.sqrt(e[:k]), (e / e.sum())[:k]


def test_whitening_equals_plain_eigenvectors(spark):
    rows = rows_of(random.Random(3), 60)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    found = whitening.whiten(df, whitening.fit_whitening(df)).collect()
    valid = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    n, deviation, white, share = plain_whitening([r[1] for r in valid])
    assert len(found) == 4 * len(valid) and {r.n for r in found} == {n} and {round(r.explained, 12) for r in found} == {round(s, 12) for s in share}
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-10
    by, want = defaultdict(list), defaultdict(list)
    for r in found:
        by[r.vec_id, r.component].append((r.deviation, r.whitened))
    for r, dev, w in zip(valid, deviation, white, strict=True):
        for j in range(4):
            want[r[0], j + 1].append((dev, w[j]))
    signs = [next(np.sign(a[0][1] * want[k][0][1]) for k, a in by.items() if k[1] == j + 1 and k[0] == 3) for j in range(4)]
    for key, got in by.items():
        assert sorted(d for d, _ in got) == sorted(d for d, _ in want[key])
        assert np.allclose(sorted(w * signs[key[1] - 1] for _, w in got), sorted(w for _, w in want[key]), atol=1e-9)


def test_whitening_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(empty, whitening.fit_whitening(empty)).count() == 0
    same = spark.createDataFrame([(1, [0.5, 0.5], 1, 1, 1, "")] * 3, VECTORS)  # no deviation, no components
    assert whitening.whiten(same, whitening.fit_whitening(same)).count() == 0
    big = spark.createDataFrame([(1, [1e300, 1.0]), (2, [1.0, 2.0]), (3, [3.0, 1.0]), (4, [1e16, 0.0]), (5, [1.0, 2.0, 3.0]), (6, [3.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    found = whitening.whiten(big, whitening.fit_whitening(big)).collect()
    assert {r.vec_id for r in found} == {2, 3, 4, 5, 6}  # 1e300 * 256 fits no long; each length is fitted apart
    assert {r.n for r in found if r.vec_id > 4} == {2} and {r.deviation for r in found if r.vec_id == 4} == {None}
    sums = 256 * np.array([3, 3], object)
    assert len({r.component for r in found if r.vec_id == 5}) == 1 and sums.sum() == 1536  # two vectors span one direction


def test_triangles_and_rotations():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(500, 12)) @ np.diag(10.0 ** -np.arange(12))
    r = None
    for i in range(0, 500, 37):
        r = whitening.fold(r, x[i : i + 37])
    sigma, vectors = whitening.jacobi(r)
    assert np.allclose(sigma / np.linalg.svd(x, compute_uv=False), 1, rtol=1e-9)  # the least as exact as the largest
    assert np.allclose(vectors @ vectors.T, np.eye(12), atol=1e-12)
    assert np.allclose(np.linalg.norm(x @ vectors.T, axis=0), sigma, rtol=1e-6)
    for shape in ((1, 3), (5, 5), (3, 1)):
        y = rnd.normal(size=shape)
        assert np.allclose(whitening.jacobi(y)[0][: min(shape)], np.linalg.svd(y, compute_uv=False))
    assert whitening.jacobi(np.zeros((2, 2)))[0].tolist() == [0, 0]


def test_many_triangles_fold_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FOLD_BYTES", 0)  # two triangles a group
    df = spark.createDataFrame(rows_of(random.Random(7), 90), VECTORS).repartition(11)
    assert whitening.fit_whitening(df)[8].identity_error < 1e-10


# ---------------------------------------------------------------------------------------------------- conversations


def plain_least(turns):
    """(cost, audit) by dynamic programming over whole strings."""
    nxt = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {0: (0, "")}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for q, (c, a) in list(out.items()):
                new = (c + 5, a + "I")
                if nxt[q] not in out or new < out[nxt[q]]:
                    out[nxt[q]] = new
        return out

    for t in turns:
        new = {}
        for q, (c, a) in inserted(best).items():
            ways = [(q, c + 2, "D")]
            if t != "D":
                more = 5 if t.isupper() else 0
                if t.lower() == "s" and q == 0:
                    ways.append((1, c + more, "K"))
                if t.lower() == "u" and q != 2 or t.lower() == "a" and q == 2:
                    ways.append((nxt[q], c + more, "K"))
                ways.append((nxt[q], c + more + 1, "R"))
            for q2, c2, e in ways:
                if q2 not in new or (c2, a + e) < new[q2]:
                    new[q2] = (c2, a + e)
        best = new
    ends = inserted(best)
    return min(ends[q] for q in (0, 3) if q in ends)


def test_layers_find_the_least_repair(monkeypatch):
    for n in range(5):
        for turns in itertools.product("suaxDUS", repeat=n):
            assert conversations.least_repair("".join(turns)) == plain_least(turns), turns
    rnd = random.Random(11)
    for block in (1, 3, 32):
        monkeypatch.setattr(conversations, "BLOCK", block)
        for _ in range(60):
            turns = "".join(rnd.choice("ssuuuaaaxDSUAX") for _ in range(rnd.randint(5, 120)))
            assert conversations.least_repair(turns) == plain_least(turns)
    assert conversations.least_repair("ua" * 20_000)[0] == 0


def conversation_rows():
    rnd = random.Random(2)
    out = [(None, None, None, None), (None, 1, "user", "Hello."), (1, None, "user", None), (1, 2, "", "x"), (2, 5, "user", " \n"), (2, 5, "user", " \n"), (3, 1, "robot", "Eh? "), (3, 9, "system", "...")]
    for c in range(4, 60):
        for t in range(rnd.randint(0, 9)):
            out.append((c, t * rnd.choice((1, 1, 1, 2)), rnd.choice(["user", "assistant", "assistant", "system", "umpire", "User"]), rnd.choice(["Yes.", "Yes.", "No", "Why?", "", f"turn {t}!", f"cut {c} {t}"])))
    return out + [(60, i // 2, ("user", "assistant")[i % 2], f"{i % 50}.") for i in range(700)]


def plain_conversations(rows):
    out, by = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = ("user" if rule == 4 else " " if role is None else role), (" " if text is None else text)
        text = "" if rule == 1 else text.translate({ord(c): None for c in ".!?"}) if rule == 2 else text
        by[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(rule, 1)
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        marks, seen, faults = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            left = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            mark = role[0] if role[:1] in ("s", "u", "a") else "x"
            marks += "D" if fault in ("blank", "duplicate") else mark.upper() if fault else mark
        cost, audit = plain_least(marks)
        made, state, i = [], 0, 0
        for e in audit:
            role, text = ("", "") if e == "I" else mine[i][1:]
            i += e != "I"
            if e == "D":
                continue
            state = 1 if e == "K" and role[0] == "s" else {0: 2, 1: 2, 2: 3, 3: 2}[state]
            made.append(f"{role if e == 'K' else {2: 'user', 3: 'assistant'}[state]}:{text}")
        turns = {t for t, *_ in mine if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def test_conversations_equal_brute_force_and_sql(spark):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, m int").repartition(3)
    found = {r[0]: tuple(r)[1:] for r in conversations.repair(conversations.damaged(df)).collect()}
    assert found == plain_conversations(rows)
    con = duckdb.connect()
    con.register("rows_", pa.table({c: pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.string()) for i, c in enumerate(("conv_id", "turn", "role", "text"))}))
    con.execute("CREATE TABLE conversations AS SELECT * FROM rows_")
    assert {r[0]: tuple(r)[1:] for r in con.execute(conversations.ORACLE).fetchall()} == found
    assert conversations.repair(conversations.damaged(df.limit(0))).count() == 0


def test_a_conversation_over_many_tasks(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t} says so.") for t in range(3000)] + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    lies = conversations.repairs(conversations.damaged(df))
    assert "rangepartitioning" in lies._jdf.queryExecution().toString()
    found = {r[0]: tuple(r)[1:] for r in conversations.repair(conversations.damaged(df)).collect()}
    assert found == plain_conversations(rows)


# ------------------------------------------------------------------------------------------------------ near copies


def plain_links(rows):
    units = {}
    for i, (_, v, label, *_) in enumerate(rows):
        if v and label is not None and all(c is not None and math.isfinite(c) for c in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            units[i] = x / np.sqrt(x @ x)
    over = list(range(len(rows)))

    def root(i):
        while over[i] != i:
            i = over[i]
        return i

    n = [0] * len(rows)
    for i, j in itertools.combinations(units, 2):
        if rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93:
            n[i] += 1
            n[j] += 1
            over[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], n[i], least.get(root(i)), r[0] is not None and r[0] == least.get(root(i))) for i, r in enumerate(rows)), key=repr)


def near_rows():
    rnd, out = random.Random(9), rows_of(random.Random(1), 150)
    for g, (size, spread) in enumerate(((60, 0.02), (40, 0.06), (3, 0.05), (25, 0.09))):
        center = [rnd.gauss(0, 1) for _ in range(8)]
        out += [(1000 + 100 * g + i, [c + rnd.gauss(0, spread * 2) for c in center], g % 2, 1, 1, "") for i in range(size)]
    return out + [(2000 + i, out[160][1], out[160][2], 1, 1, "") for i in range(30)]


@pytest.mark.parametrize(("cell", "block"), [(1024, 1024), (16, 8), (40, 7)])
def test_near_copies_equal_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(neardup, "ENTRIES", 100)
    rows = near_rows()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = sorted((tuple(r) for r in neardup.near_duplicates(df, z=None, cell=cell, block=block).collect()), key=repr)
    assert found == plain_links(rows)
    usual = neardup.near_duplicates(df, cell=cell, block=block).groupBy().sum("n_links").first()[0]
    assert usual >= 0.99 * sum(r[1] for r in found)  # recall, at the margin that is used


def test_near_copies_of_odd_tables(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    odd = spark.createDataFrame([(1, [1e300, 1e300], "a"), (2, [2e-300, 2e-300], "a"), (3, [1.0, 0.0], "a"), (4, [1.0, 0.0], "b"), (5, [1.0], "a"), (5, [1.0], "a")], "vec_id long, embedding array<double>, label string")
    found = sorted(tuple(r) for r in neardup.near_duplicates(odd).collect())
    assert found == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (5, 1, 5, True)]


def test_a_tight_group_is_not_multiplied_out():
    """The core's links are counted from the angles to the centroid; only its edge is compared."""
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=64) + rnd.normal(size=(2000, 64)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = neardup.Cells(0.93, 3.0)
    cells.of = {(1, 64): neardup.spherical_means(x[:64], 4)}
    rows, cell, home, near = cells.place(1, x)
    assert len(cells.of[1, 64]) == 1 and home.all() and rows.tolist() == list(range(2000)) and not cell.any() and (near >= cells.core).all()
    assert (x[:500] @ x[:500].T).min() >= 0.93
