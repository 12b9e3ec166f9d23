"""Every corpus operator against brute force or a library, on rows with nulls, empty and odd texts, ties and repeats."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from duoplane.llm import bpe, common, components, jaccard, jpeg, langid, licenses, media, mixing, substring, token_counts, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " \n\t ", "a", "Ünïcode ²³ Ⅷ 漢字 \x1c\x1d", "x <|endoftext|> y", "it's we'll" * 40, "a" * 3000, "ab " * 4000, "\u0000 nul", "🙂🙃" * 30]


def sentence(rnd, n, letters="abcdefgh"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = [(i, t, "en", "s1", len(t)) for i, t in enumerate(ODD)]
    base = sentence(rnd, 120)
    words = base.split()
    for i in range(12):  # near copies
        w = list(words)
        w[rnd.randrange(120)] = f"edit{i}"
        out.append((100 + i, " ".join(w), "en", "s1" if i % 2 else "s2", 1))
    out += [(200 + i, base.upper(), "en", "s2", 1) for i in range(5)]  # copies but for case
    out += [(300 + i, sentence(rnd, rnd.randint(1, 60), "ijklmnop"), "de", None, None) for i in range(30)]
    out += [(None, None, None, None, None), (None, base, None, None, None), (7, "a", "en", "s1", 1), (7, "a", "en", "s1", 1), (400, None, "en", "s1", None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return repr(x)


def test_media_keeps_payload(docs, none, rows):
    found = media.text_media(docs, with_media=True).collect()
    assert len(found) == len(rows) and media.text_media(none).count() == 0
    want = Counter()
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        padded = media.pad(raw)
        want[doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == want
    same = defaultdict(set)
    for r in found:
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        same[r.payload_sha256].add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in same.values())


def test_progressive_scans_round_trip():
    rng = np.random.default_rng(1)
    blocks = np.where(rng.random((72, 64)) < 0.1, rng.integers(-900, 900, (72, 64)), 0)
    blocks[:, 1:] = np.where(rng.random((72, 63)) < 0.1, rng.integers(-3, 4, (72, 63)), blocks[:, 1:])
    images, found, first = jpeg.decode(jpeg.encode(blocks, np.array([0, 36, 72]), [(2, 3), (3, 2)], [b"a", b"b"]))
    assert (found == blocks).all() and first.tolist() == [0, 36, 72] and [i.comment for i in images] == [b"a", b"b"]


def test_inverse_transform_and_chroma():
    flat = np.zeros((6, 64), np.int64)
    flat[:4, 0], flat[4, 0], flat[5, 0] = 8 * 50, 8 * 20, -8 * 30
    images, coefs, _ = jpeg.decode(jpeg.encode(flat, np.array([0, 6]), [(1, 1)], [b""]))
    rgb = jpeg.to_rgb(images[0], jpeg.samples(images, coefs))
    y, cb, cr = 178, 20, -30
    want = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    assert rgb.shape == (16, 16, 3) and np.abs(rgb.reshape(-1, 3) - np.clip(want, 0, 255)).max() <= 1
    spike = np.zeros((6, 64), np.int64)
    spike[0] = np.random.default_rng(2).integers(-40, 40, 64)
    got = jpeg.samples(images, spike)[0].reshape(8, 8)
    k = np.arange(8)
    c = np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * k + 1) * k[:, None] * np.pi / 16)
    plain = np.zeros(64)
    plain[jpeg.zigzag()] = spike[0]
    assert np.abs(got - np.clip(c.T @ plain.reshape(8, 8) @ c + 128, 0, 255)).max() <= 1


def test_broken_images_say_why(spark):
    good = media.store([media.pad(b"hello")])[0]
    found = {r.k: r for r in media.decode_images(spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None), (4, bytearray(good[:60]))], "k int, media binary")).collect()}
    assert found[1].width == 16 and len(found[1].rgb) == 16 * 16 * 3 and found[1].error is None
    assert found[2].error and found[4].error and found[3].error is None and found[3].rgb is None


CODES = list(range(12)), [0x00, 0x01, 0x02, 0x03, 0x11, 0x12, 0x21, 0xF0, *(16 * r for r in range(1, 15))]


class Bits:
    """Bits of a hand-made scan: DC symbols have codes of 4 bits, AC symbols of 8, in the order of ``CODES``."""

    def __init__(self):
        self.bits = ""

    def dc(self, diff):
        size = abs(diff).bit_length()
        self.bits += f"{CODES[0].index(size):04b}" + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "")
        return self

    def ac(self, symbol, extra=""):
        self.bits += f"{CODES[1].index(symbol):08b}" + extra
        return self

    def scan(self, components, start, end, high=0, low=0):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        return jpeg._marker(0xDA, bytes([len(components), *(x for c in components for x in (c, 0)), start, end, high << 4 | low])) + data


def by_hand(width, height, factors, *scans):
    frame = bytes([8, *height.to_bytes(2, "big"), *width.to_bytes(2, "big"), len(factors), *(x for i, f in enumerate(factors) for x in (i + 1, f, 0))])
    tables = b"".join(jpeg._marker(0xC4, bytes([k << 4, *(len(c) if n == (4, 8)[k] else 0 for n in range(1, 17)), *c])) for k, c in enumerate(CODES))
    return b"\xff\xd8" + jpeg._marker(0xDB, b"\x00" + b"\x01" * 64) + jpeg._marker(0xC2, frame) + tables + b"".join(scans) + b"\xff\xd9"


def test_files_without_restarts():
    # grey, three blocks, one end-of-band run over all of them, then a refinement with another
    first = Bits().ac(0x02, "11").ac(0x10, "1").scan([1], 1, 63, 0, 1)
    refined = Bits().ac(0x10, "1" + "1").scan([1], 1, 63, 1, 0)
    grey = by_hand(24, 8, [0x11], Bits().dc(100).dc(-7).dc(0).scan([1], 0, 0), first, refined)
    images, coefs, _ = jpeg.decode([grey])
    assert coefs[:, 0].tolist() == [100, 93, 93] and coefs[0, 1] == 7 and not coefs[1:, 1:].any() and not coefs[0, 2:].any()
    rgb = jpeg.to_rgb(images[0], jpeg.samples(images, coefs))
    assert rgb.shape == (8, 24, 3) and (rgb[:, 8:] == round(128 + 93 / 8)).all()
    # interleaved DC, no subsampling: Y, Cb, Cr of one square after the other
    full = by_hand(16, 8, [0x11, 0x11, 0x11], Bits().dc(8).dc(16).dc(-24).dc(8).dc(0).dc(8).scan([1, 2, 3], 0, 0))
    assert jpeg.decode([full])[1][:, 0].tolist() == [8, 16, 16, 16, -24, -16]
    # interleaved DC, chroma halved both ways: four luma blocks of a square, row by row, then one of either chroma
    bits = Bits()
    for diff in (1, 1, 1, 1, 5, 6, 1, 1, 1, 1, 5, 6):
        bits.dc(diff)
    half = by_hand(32, 16, [0x22, 0x11, 0x11], bits.scan([1, 2, 3], 0, 0))
    found = jpeg.decode([half, grey])[1][:, 0].tolist()
    assert found == [1, 2, 5, 6, 3, 4, 7, 8, 5, 10, 6, 12, 100, 93, 93]


def test_no_header_byte_breaks_the_task():
    good = media.store([media.pad(b"hello")])[0]
    end = good.index(b"\xff\xda") + 12
    for i in range(end):
        for value in {0, 1, 0x44, 0xFF, good[i] ^ 0x80} - {good[i]}:
            height, _, rgb, error = media._rgb(good[:i] + bytes([value]) + good[i + 1 :])
            assert (rgb is None) == (error is not None) and (height is None or height <= 65535)
    huge = good.replace((16).to_bytes(2, "big") * 2, b"\xff\xff\xff\xff", 1)
    assert "can hold" in media._rgb(huge)[3] and media._rgb(b"")[3]


def test_feature_describes_the_stored_image(spark):
    texts = ["", "plain text " * 40, "é漢🙂" * 100]
    found = media.text_media(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), with_media=True).collect()
    for r in found:
        w, h, *means = map(int, r.feature.replace("x", ":").split(":")[:5])
        rgb = np.frombuffer(r.rgb, np.uint8).reshape(h, w, 3)
        images, coefs, _ = jpeg.decode([bytes(r.media)])
        k = np.arange(8)
        c = np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * k + 1) * k[:, None] * np.pi / 16)
        planes = []
        for comp in images[0].components:  # the plain inverse transform, block by block
            plane = np.zeros((8 * comp.blocks_high, 8 * comp.blocks_wide))
            for b in range(comp.blocks_high * comp.blocks_wide):
                block = np.zeros(64)
                block[jpeg.zigzag()] = coefs[comp.first + b]
                y, x = divmod(b, comp.blocks_wide)
                plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = np.clip(np.floor(c.T @ block.reshape(8, 8) @ c + 128.5), 0, 255)
            planes.append(np.repeat(np.repeat(plane, h // len(plane), axis=0), w // plane.shape[1], axis=1))
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
        assert np.abs(np.clip(want, 0, 255) - rgb).max() <= 3 and np.abs(1000 * rgb.reshape(-1, 3).mean(axis=0) - means).max() <= 1
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256


def test_language_by_compression(spark, none):
    rnd = random.Random(1)
    vocabulary = [sentence(rnd, 60, "abcde").split(), sentence(rnd, 60, "vwxyz").split()]
    data = [(i, " ".join(rnd.choices(vocabulary[i % 2], k=80)), "zz" if i % 2 else "aa", "s", 1) for i in range(200)]
    frame = spark.createDataFrame([*data, (900, None, "aa", "s", 0), (901, "12 34 !", "aa", "s", 0), (None, "abc", None, None, None)], SCHEMA)
    learnt = langid.learn(frame)
    assert set(learnt) == {"aa", "zz"} and langid.learn(none) == {}
    found = {r.doc_id: r for r in langid.predict(frame, learnt).collect()}
    assert np.mean([found[i].lang_pred == lang and 0.5 < found[i].score <= 1 for i, _, lang, *_ in data]) >= 0.95
    assert found[900].lang_pred == found[901].lang_pred == "und" and found[900].held_out == (zlib.crc32(b"900") % 5 == 0)
    assert {r.lang_pred for r in langid.predict(frame, {}).collect()} == {"und"} and langid.predict(none, learnt).count() == 0


def test_language_of_held_out_documents(spark):
    rnd = random.Random(1)
    vocabulary = [sentence(rnd, 60, "abcde").split(), sentence(rnd, 60, "vwxyz").split()]
    data = [(i, " ".join(rnd.choices(vocabulary[i % 2], k=80)), "zz" if i % 2 else "aa", "s", 1) for i in range(200)]
    frame = spark.createDataFrame(data, SCHEMA)
    found = [r for r in langid.predict(frame, langid.learn(frame)).collect() if r.held_out]
    assert len(found) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)) > 20
    assert np.mean([r.lang_pred == data[r.doc_id][2] for r in found]) >= 0.95


def test_sizes_are_those_of_a_plain_compression(spark):
    """Windows of a text, each compressed with each language's dictionary; other columns of any name don't matter."""
    import zstandard

    rnd = random.Random(3)
    data = [(i, sentence(rnd, 120, "abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz", "s", i, 0.5, "x") for i in range(60)]
    data += [(70, sentence(rnd, 9000, "abcvwx"), None, "s", 1, 0.5, "x"), (71, "É" * 9, "aa", "s", 1, 0.5, "x"), (72, "", "aa", "s", 1, 0.5, "x")]
    frame = spark.createDataFrame(data, SCHEMA.replace("n_chars long", "size long, score double, draw string")).repartition(3)
    learnt = langid.learn(frame)
    drawn = {lang: [t.lower() for i, t, l, *_ in data if l == lang and zlib.crc32(str(i).encode()) % 5] for lang in ("aa", "zz")}
    assert all(set(learnt[lang].decode().split("\n")) == set(texts) for lang, texts in drawn.items())  # whole texts, all of them: the sample isn't full
    found = {r.doc_id: r for r in langid.predict(frame, learnt).collect()}
    for i, text, *_ in data:
        if not any(c.isalpha() for c in text):
            assert found[i].lang_pred == "und" and found[i].sizes == []
            continue
        raw, want = text.lower().encode(), {}
        for lang, content in learnt.items():
            make = lambda: zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)  # noqa: B023, E731
            want[lang] = [len(make().compress(raw[a : a + langid.WINDOW])) for a in range(0, len(raw), langid.WINDOW)]
        assert all(abs(size - sum(want[lang])) <= 4 * len(want[lang]) for lang, size in zip(sorted(learnt), found[i].sizes, strict=True)), i
        assert found[i].lang_pred == sorted(learnt)[found[i].sizes.index(min(found[i].sizes))]
    assert langid._content([b"a" * 100_000, b"b" * 100_000, b"c" * 1000]) == b"a" * 100_000 + b"\n" + b"c" * 1000  # whole texts that fit


def test_the_fit_is_that_of_a_plain_gradient():
    """Ratios, choice and weights by dictionaries and loops."""
    rnd = random.Random(12)
    texts = [sentence(rnd, 6, "abc" if i % 3 == 0 else "bcd") for i in range(40)] + ["", "zzz"]
    labels = [int(i % 3 == 0) for i in range(40)] + [0, 1]
    sets = [toxicity.features([t.encode()]).tolist() for t in texts]
    n, pos = len(texts), sum(labels)
    seen = {f: (sum(f in s and y for s, y in zip(sets, labels, strict=True)), sum(f in s and not y for s, y in zip(sets, labels, strict=True))) for f in {f for s in sets for f in s}}
    rows = 1 << toxicity.BITS
    toxic, clean = rows + sum(a for a, _ in seen.values()), rows + sum(b for _, b in seen.values())
    ratio = {f: math.log((a + 1) / toxic) - math.log((b + 1) / clean) for f, (a, b) in seen.items()}

    def g(a, b):
        share, out = (a + b) / n, 0.0
        for have, of in ((a, pos), (b, n - pos)):
            out += have * math.log(have / (of * share)) if have else 0
            out += (of - have) * math.log((of - have) / (of * (1 - share))) if of - have else 0
        return 2 * out

    chosen = sorted(f for f, (a, b) in seen.items() if a + b >= toxicity.LEAST_DOCS and g(a, b) >= toxicity.LEAST_G)
    assert 0 < len(chosen) <= toxicity.FEATURES
    w, bias = dict.fromkeys(chosen, 0.0), math.log(pos / (n - pos))
    m, v, mb, vb = dict.fromkeys(chosen, 0.0), dict.fromkeys(chosen, 0.0), 0.0, 0.0
    for step in range(1, toxicity.ROUNDS + 1):
        errors = [1 / (1 + math.exp(-(bias + sum(w[f] * ratio[f] for f in s if f in w)))) - y for s, y in zip(sets, labels, strict=True)]
        gradient = {f: toxicity.RIDGE * w[f] for f in chosen}
        for s, e in zip(sets, errors, strict=True):
            for f in s:
                if f in w:
                    gradient[f] += ratio[f] * e / n
        up, down = 1 - 0.9**step, 1 - 0.999**step
        for f in chosen:
            m[f], v[f] = 0.9 * m[f] + 0.1 * gradient[f], 0.999 * v[f] + 0.001 * gradient[f] ** 2
            w[f] -= toxicity.RATE * (m[f] / up) / (math.sqrt(v[f] / down) + 1e-8)
        gb = sum(errors) / n
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        bias -= toxicity.RATE * (mb / up) / math.sqrt(vb / down) if vb else 0
    model = toxicity.fit(texts, labels)
    assert model.features.tolist() == chosen and abs(model.bias - bias) < 1e-6
    assert np.allclose(model.weights, [w[f] * ratio[f] for f in chosen], atol=1e-6)


def test_token_counts_as_the_library(docs, none, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    for doc_id, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False))
        want[doc_id, len((text or "").encode()), n, n > 1024] += 1
    assert Counter(map(tuple, token_counts.count_tokens(docs, path, public_tokenizers.PATTERN).collect())) == want
    assert token_counts.count_tokens(none, path, public_tokenizers.PATTERN).count() == 0


def test_token_counts_of_many_small_blocks(docs, rows, monkeypatch):
    from tokenizers import Tokenizer

    for name, value in (("BLOCK_BYTES", 500), ("SHARE", 1), ("FREQUENT", 2), ("GATHERED", 10)):
        monkeypatch.setattr(token_counts, name, value)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = Counter((d, len(library.encode(t or "", add_special_tokens=False))) for d, t, *_ in rows)
    odd = docs.withColumnsRenamed({"lang": "pretoken", "source": "salt"})
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd, path, public_tokenizers.PATTERN).collect()) == want


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 300, 2**21, 2**48], np.int64)
    data, offsets = token_counts.pack(values, np.array([0, 3, 7]))
    assert token_counts.unpack(data)[0].tolist() == values.tolist() and offsets.tolist() == [0, 3, len(data)]


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "LEAF_ROWS", 4)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(topk, "PACK_BOXES", 3)
    monkeypatch.setattr(topk, "SAMPLE_ROWS", 200)
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(size=5).tolist()) for i in range(300)] + [(1000 + i, [0.5] * 5) for i in range(60)]
    bad = [(2000, None), (2100, [1.0, None, 1.0, 1.0, 1.0]), (2200, [float("nan")] * 5), (2300, [float("inf")] * 5), (None, [1.0] * 5), (2400, []), (2500, [1.0, 2.0])]
    frame = spark.createDataFrame([*data, *bad], "vec_id long, embedding array<double>")
    found = topk.search(topk.integer_vectors(frame), F.col("vec_id") % 100 == 0, 3).collect()
    x = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in data}
    want = []
    for q in x:
        if q % 100 == 0:
            best = sorted(((-int(x[q] @ v), i) for i, v in x.items() if i != q))[:3]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, found)) == sorted(want)
    assert topk.search(topk.integer_vectors(frame.limit(0)), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_of_large_components_and_shards_by_the_input(spark):
    assert [topk.shard_rows(n) for n in (0, 100, 2000, 10_000, 10**6)] == [256, 256, 256, 1250, 8192]
    data = [(0, [1e12, -1e12]), (100, [1e12, 1.0]), (1, [8e12, 8e12]), (2, [-8e12, 1.0]), (3, [9e12, 0.0]), (4, [1e300, 0.0]), (5, [1.0, 2.0])]
    found = topk.search(topk.integer_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")), F.col("vec_id") % 100 == 0, 10).collect()
    x = {i: [int(c * 1024) for c in v] for i, v in data if i not in (3, 4)}  # 9e12 * 1024 is beyond 2^53
    want = []
    for q in (0, 100):
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x[q], x[i], strict=True)))), i) for i in x if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, found)) == sorted(want) and any(abs(s) >= 2**63 - 1 for *_, s in want)


def test_block_bounds_hold():
    rng = np.random.default_rng(8)
    for big in (1, 2**24, 2**50):
        q, x = rng.integers(-9, 9, (20, 4)) * big, rng.integers(-9, 9, (30, 4)) * big
        bound = topk.block_bounds(q.min(axis=0), q.max(axis=0), x.min(axis=0)[None], x.max(axis=0)[None])
        assert int(bound[0]) >= max(int(s) for s in (q.astype(object) @ x.astype(object).T).ravel())


def test_cells_split_a_sample_and_bounds_hold(monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    rng = np.random.default_rng(1)
    x = np.vstack([rng.integers(-9, 9, (400, 4)), np.full((200, 4), 3)])
    nodes = topk.split_cells(x, 600)
    cells = topk.cell_of(x, nodes)
    assert sorted(set(cells.tolist())) == list(range(len(nodes) + 1)) and len(set(cells[400:].tolist())) == 1
    assert topk.split_cells(np.full((99, 2), 7), 10**6).shape == (0, 4) and topk.cell_of(x, np.zeros((0, 4), np.int64)).max() == 0
    for big in (1, 2**24, 2**40):  # doubles, longs, Python integers
        q = rng.integers(-9, 9, (20, 4)) * big
        for c in range(len(nodes) + 1):
            own = x[cells == c] * big
            bounds = topk.upper_bounds(q, own.min(axis=0)[None], own.max(axis=0)[None])
            assert all(int(b) >= max(int(s) for s in row) for b, row in zip(bounds[:, 0], q.astype(object) @ own.astype(object).T, strict=True))


def test_far_shards_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    rng, seen = np.random.default_rng(2), []
    data = [(i, (rng.normal(size=4) * 0.05 + 4 * np.eye(4)[i % 4]).tolist()) for i in range(800)]
    write = topk.staged
    monkeypatch.setattr(topk, "staged", lambda df, name: seen.append((name, write(df, name))) or seen[-1][1])
    found = topk.search(topk.integer_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")), F.col("vec_id") % 100 == 0, 3).collect()
    x = np.floor(1024 * np.array([v for _, v in data])).astype(int)
    want = [(q, k + 1, i, -s) for q in range(0, 800, 100) for k, (s, i) in enumerate(sorted((-int(x[q] @ x[i]), i) for i in range(800) if i != q)[:3])]
    assert sorted(map(tuple, found)) == sorted(want)
    staged = dict(seen)
    assert staged["reached"].count() < staged["queries"].count() * (staged["trees"].count() - 1) / 2


def test_repeated_passages_go_and_the_rest_stays(spark, docs, none, rows):
    rnd = random.Random(9)
    passage, line = sentence(rnd, 60), "All rights reserved by nobody."
    data = [(i, f"{sentence(rnd, 80)} {passage}\n{line}\n{sentence(rnd, 70)}", "en", "s", 1) for i in range(30)]
    clean = [(100 + i, f"{sentence(rnd, 150)}\n{line}", "en", "s", 1) for i in range(30)]
    found = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(data + clean, SCHEMA)).collect()}
    hit = [i for i, *_ in data if found[i].n_removed]
    assert len(hit) >= 28 and 0 not in hit and not any(found[i].n_removed for i, *_ in clean)
    for i, text, *_ in data + clean:
        raw, r = text.encode(), found[i]
        assert r.removed_bytes == sum(s.end - s.start for s in r.spans)
        assert all(raw[s.start : s.end].decode().strip() in passage + "\n" + line for s in r.spans)
        kept = b"".join(raw[a:b] for a, b in zip([0, *(s.end for s in r.spans)], [*(s.start for s in r.spans), len(raw)], strict=True))
        assert kept.decode() == r.text
    assert substring.dedup(docs).count() == len(rows) and substring.dedup(none).count() == 0


def plain_chunks(raw):
    """Ends of a text's chunks by the rules as stated, one byte at a time."""
    n, blank = len(raw), b" \t\n\x0b\x0c\r"
    table = substring._TABLE.tolist()
    h = [sum(table[raw[i - k]] << k for k in range(min(substring.GEAR, i + 1))) % (1 << 32) for i in range(n)]
    leads = [i for i in range(n) if raw[i] & 0xC0 != 0x80]

    def chosen(at, reach):
        return [p for k, p in enumerate(at) if all(h[p - 1] < h[q - 1] for q in at[max(0, k - reach) : k]) and all(h[p - 1] <= h[q - 1] for q in at[k + 1 : k + 1 + reach])]

    words = [i for i in range(1, n) if raw[i - 1] in blank and raw[i] not in blank]
    cuts = set(chosen(words, substring.REACH))
    for a, b in zip([0, *words], [*words, n], strict=True):
        if b - a > substring.SPARSE:
            cuts |= set(chosen([i for i in leads if a < i < b], substring.CHARACTERS))
    ends, a = [], 0
    for b in [*sorted(cuts), n] if n else []:
        while b - a > substring.LONGEST:
            near = [w for w in words if a < w <= a + substring.LONGEST] or [i for i in leads if a < i <= a + substring.LONGEST]
            a = min(near, key=lambda p: (h[p - 1], -p))
            ends.append(a)
        if b > a:
            ends.append(b)
            a = b
    return ends


def plain_dedup(rows):
    """(doc_id, text) rows with distinct ids, without their repeated passages."""
    first, cut = {}, {}
    for doc_id, text in sorted(rows):
        raw, a, cut[doc_id] = (text or "").encode(), 0, []
        for number, b in enumerate(plain_chunks(raw)):
            cut[doc_id].append((raw[a:b], first.setdefault(raw[a:b], (doc_id, number)) != (doc_id, number)))
            a = b
    out = {}
    for doc_id, text in rows:
        kept, run = b"", []
        for chunk, copied in [*cut[doc_id], (b"", False)]:
            if copied:
                run.append(chunk)
                continue
            if sum(len(c.split()) for c in run) < substring.LEAST_WORDS and sum(map(len, run)) < substring.LEAST_BYTES:
                kept += b"".join(run)
            kept, run = kept + chunk, []
        out[doc_id] = None if text is None else kept.decode()
    return out


def test_dedup_as_plainly(spark):
    rnd = random.Random(12)
    shared = [sentence(rnd, 50, "aeioulnrst"), "漢字" * 300, "".join(rnd.choice("ABCabc123+/") for _ in range(700)), "z" * 1500, "ein kurzer Satz."]
    data = [(i, " ".join(rnd.choice([sentence(rnd, rnd.randint(1, 60)), rnd.choice(shared)]) for _ in range(rnd.randint(0, 6)))) for i in range(120)] + [(900, None), (901, ""), (902, shared[0]), (903, shared[0])]
    for _, text in data:
        assert substring.chunk_ends((text or "").encode()) == plain_chunks((text or "").encode())
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumns({"_own": F.lit(1), "copied": F.lit("x"), "Id": F.col("doc_id"), "n_removed": F.lit(9), "a b": F.lit(2)})
    found = substring.dedup(frame.repartition(4)).collect()
    assert {r.doc_id: r.text for r in found} == plain_dedup(data) and len(found) == len(data) and {(r._own, r.copied, r["a b"]) for r in found} == {(1, "x", 2)} and all(r.Id == r.doc_id for r in found)


def test_passages_of_documents_without_ids_go(spark):
    rnd = random.Random(5)
    passage = sentence(rnd, 120)
    frame = spark.createDataFrame([(None, f"{sentence(rnd, 30)} {passage} {sentence(rnd, 30)}") for _ in range(8)], "doc_id long, text string")
    assert sorted(r.n_removed > 0 for r in substring.dedup(frame).collect()) == [False, *[True] * 7]


def test_facts_of_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 40}") for i in range(3000)] + [(5000, None)], "i long, k string")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    found = common.join_facts(rows, facts, ["k"], "n", 3001)
    want = {}
    for i in range(3000):
        k = "hot" if i % 3 else f"k{i % 40}"
        want[k] = min(want.get(k, i), i)
    assert found.columns == ["k", "i", "least"] and sorted((r.i, r.least) for r in found.collect()) == [(i, want["hot" if i % 3 else f"k{i % 40}"]) for i in range(3000)]


def test_chunks_cover_the_text_and_survive_insertion():
    rnd = random.Random(2)
    for text in [*ODD, sentence(rnd, 400)]:
        raw = text.encode()
        ends = substring.chunk_ends(raw)
        assert (ends[-1] == len(raw) and ends == sorted(set(ends)) if raw else ends == []) and all(raw[:e].decode() is not None for e in ends)
    text = sentence(rnd, 400)

    def cut(t):
        raw, ends = t.encode(), substring.chunk_ends(t.encode())
        return {raw[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    assert len(cut(text) & cut("inserted words " + text)) >= len(cut(text)) - 2


@pytest.mark.parametrize("letters", ["".join(map(chr, range(0x4E00, 0x5200))), "".join(map(chr, range(0xE01, 0xE2F))), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_repeated_passages_without_spaces_go(spark, letters):
    rnd = random.Random(3)

    def text(n):
        return "".join(rnd.choice(letters) for _ in range(n))

    passage, short = text(1000), text(60)
    data = [(i, text(300 + 37 * i) + passage + text(500) + (short if len(letters) < 200 else "") + text(200), "zh", "s", 1) for i in range(6)]
    found = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(data, SCHEMA)).collect()}
    assert found[0].n_removed == 0 and found[0].text == data[0][1]
    for i, old, *_ in data[1:]:
        raw, r = old.encode(), found[i]
        taken = [raw[s.start : s.end].decode() for s in r.spans]
        assert len(taken) == 1 and taken[0] in passage and len(taken[0]) >= 850 and r.text == old.replace(taken[0], "")


def test_toxic_words_are_learnt(spark, none):
    rnd = random.Random(4)
    data, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        data.append((i, sentence(rnd, 40) + (" zzqqz" if toxic else "") + " " + sentence(rnd, 20), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    frame, marks = spark.createDataFrame([*data, (5000, None, None, None, None), (5001, "", None, None, None)], SCHEMA), spark.createDataFrame([*labels, (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(frame, marks)
    found = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert np.mean([found[i].predicted == t for i, _, t in labels if found[i].held_out]) > 0.98
    assert found[5000].score == found[5001].score and found[5000].predicted == 0
    empty = toxicity.learn(none, marks.limit(0))
    assert len(empty.features) == 0 and toxicity.score(none, model).count() == 0 and toxicity.score(frame, empty).count() == 902


def test_features_are_all_ngrams(monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abc Dé\n") for _ in range(n)).encode() for n in (0, 1, 2, 50, 998, 1001, 3000)]
    want = set()
    for i, text in enumerate(texts):
        folded = bytes(toxicity._FOLD[b] for b in b" " + text + b" ")
        for k in toxicity.ORDERS:
            for j in range(len(folded) - k + 1):
                code = int.from_bytes(folded[j : j + k], "little") + k - 1
                want.add(i << toxicity.BITS | (code * 0x9E3779B97F4A7C15) % 2**64 >> (64 - toxicity.BITS))
    for size in (7, 1000, 1 << 20):
        monkeypatch.setattr(toxicity, "PART_BYTES", size)
        assert toxicity.features(texts).tolist() == sorted(want)


def test_long_documents_are_learnt_from(spark):
    rnd = random.Random(6)
    data = [(i, sentence(rnd, 4000) + (" qqzzq" if i % 4 == 0 else "") + sentence(rnd, 10)) for i in range(80)]
    frame, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.learn(frame, marks)
    assert len(model.features) and [r.predicted for r in toxicity.score(frame, model).orderBy("doc_id").collect()] == [int(i % 4 == 0) for i in range(80)]
    few = toxicity.learn(frame, marks, sample_bytes=1)
    assert len(few.features) == 0  # one document alone
    plain = {}
    for i, text in data[:5]:
        have = {int(x) for x in toxicity.features([text.encode()])}
        plain[i] = 1 / (1 + np.exp(-sum(w for f, w in zip(model.features.tolist(), model.weights.tolist(), strict=True) if f in have) - model.bias))
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert all(abs(got[i] - p) < 1e-4 for i, p in plain.items())


def test_long_pieces_as_the_library():
    import tiktoken

    rnd = random.Random(8)
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        coder = bpe.BytePairCoder(public_tokenizers.path(name))
        assert coder.in_order
        library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=coder.ranks, special_tokens={})
        pieces = ["".join(rnd.choice(letters) for _ in range(n)) for letters in ("a", "ab", "ABCDEFabcdef0123456789+/", "漢字仮名", "etaoin") for n in (256, 257, 448, 449, 3000, 10_000)]
        pieces += ["abc" * 4000, " " * 5000, "-" * 700 + "=" * 700, "theingation" * 900]
        want = list(map(library.encode_ordinary, pieces))
        assert [x.tolist() for x in coder.merge([p.encode() for p in pieces])] == want
        assert [coder._merge_row(p.encode()).tolist() for p in pieces[:12]] == want[:12]
        coder.in_order = False  # as for a vocabulary whose windows may not be put together
        assert [x.tolist() for x in coder.merge([p.encode() for p in pieces[:10]])] == want[:10]


def test_bpe_as_the_library(docs, none, rows):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.coder(path).ranks, special_tokens={})
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    done = bpe.encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in done.collect()) == want
    assert all(len(r.ids) == r.n_tokens and r.decoded == (r.text or "") for r in done.collect())
    assert bpe.encode_decode(none, path, public_tokenizers.PATTERN).count() == 0


def brute_components(rows):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().translate(jaccard._LOWER).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return sets, root


def test_jaccard_components(docs, none, rows):
    sets, root = brute_components(rows)
    least = {}
    for (doc_id, *_), r in zip(rows, root, strict=True):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    want = Counter((d[0], len(s), least.get(r)) for d, s, r in zip(rows, sets, root, strict=True))
    assert Counter(map(tuple, jaccard.join_components(docs).collect())) == want
    kept = jaccard.keep_first(docs).collect()
    assert len(kept) == len({(root[i], None if sets[i] else rows[i][:2]) for i in range(len(rows))}) and jaccard.join_components(none).count() == 0


def plain_components(data):
    """Smallest doc_id of each text's component, by all pairs."""
    sets, over = {}, {i: i for i, *_ in data}
    for i, t, *_ in data:
        w = t.split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    def root(i):
        while over[i] != i:
            i = over[i]
        return i

    for (i, x), (j, y) in combinations(sets.items(), 2):
        if 3 * (len(x) + len(y)) <= 7 * min(len(x), len(y)) and 100 * (both := len(x & y)) >= 75 * (len(x) + len(y) - both) and x:
            over[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in over}


def test_common_passages_form_no_candidates(spark, monkeypatch):
    """Texts of 100 shingles of which the same 76 are boilerplate aren't linked; what might be is counted."""
    rnd, seen = random.Random(21), {}
    common = sentence(rnd, 80)
    data = [(i, f"{common} {sentence(rnd, 24)}", "en", "s", 1) for i in range(300)]  # all alike but for their ends
    data += [(1000 + i, f"{sentence(rnd, 3)} {common} {sentence(rnd, 3 + i % 20)}", "en", "s", 1) for i in range(60)]  # of many sizes, some linked
    write = jaccard.staged
    monkeypatch.setattr(jaccard, "staged", lambda df, name: seen.setdefault(name, []).append(write(df, name)) or seen[name][-1])
    for few in (32, 0):  # by the shingle alone, or by bands
        seen.clear()
        monkeypatch.setattr(jaccard, "FEW_GROUPS", few)
        found = {r.doc_id: r.component_id for r in jaccard.join_components(spark.createDataFrame(data, SCHEMA)).collect()}
        assert found == plain_components(data)
        assert sum(df.count() for df in seen["group_pairs"]) <= 2 * len(data) < 300 * 299 / 2 / 20


def test_groups_join_by_any_of_their_members(spark, monkeypatch):
    """Pairs of groups of several members each, where one's first members aren't linked with the other's."""
    monkeypatch.setattr(jaccard, "BUCKETS", 1)
    rnd = random.Random(4)
    data = []
    for g in range(8):
        base = sentence(rnd, 60).split()
        for i in range(12):  # chains: each a few words from the one before
            w = list(base)
            for k in range(i):
                w[58 - 4 * k] = f"x{g}{k}"
            data.append((g * 100 + i, " ".join(w), "en", "s", 1))
    rnd.shuffle(data)
    found = {r.doc_id: r.component_id for r in jaccard.join_components(spark.createDataFrame(data, SCHEMA)).collect()}
    assert found == plain_components(data)


def test_jaccard_in_small_blocks(spark, rows, monkeypatch):
    for name, value in (("BLOCK_BYTES", 700), ("BLOCK_DOCS", 3), ("RANGE_BYTES", 100)):
        monkeypatch.setattr(jaccard, name, value)
    rnd = random.Random(3)
    more = [(1000 + i, " ".join(w if rnd.random() > 0.004 else f"e{i}" for w in rows[10][1].split() * 2), None, None, None) for i in range(40)] + [(2000 + i, "same few words here", None, None, None) for i in range(30)]
    sets, root = brute_components(rows + more)
    frame = spark.createDataFrame(rows + more, SCHEMA).withColumns({"id": F.lit(1), "_own": F.lit(2), "component": F.lit(3)})
    least = {}
    for (doc_id, *_), r in zip(rows + more, root, strict=True):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    want = Counter((d[0], len(s), least.get(r)) for d, s, r in zip(rows + more, sets, root, strict=True))
    for direct in (10, 0):  # to ranges, or through routes
        monkeypatch.setattr(jaccard, "DIRECT_BITS", direct)
        assert Counter(map(tuple, jaccard.join_components(frame.repartition(5)).collect())) == want
    kept = jaccard.keep_first(frame)
    assert kept.columns == frame.columns and kept.count() == len({(root[i], None if s else (rows + more)[i][:2]) for i, s in enumerate(sets)})


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[i] for i in range(61)}) == 1 and found[100] == found[101] != found[0]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    apart = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), few=3).collect()}
    assert {(found[a] == found[b]) == (apart[a] == apart[b]) for a in found for b in found} == {True} and set(apart) == set(found)


@pytest.mark.parametrize("operator, sql, columns", [(mixing.mix, mixing.ORACLE, ["doc_id", "size", "source_size", "target", "taken"]), (licenses.scan, licenses.ORACLE, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])])
def test_native_operators_equal_sql(spark, docs, none, rows, operator, sql, columns):
    more = [(500, "Released UNDER the MIT  license; apache license, version 2.0\ncc-by-nc", "en", "é", 1), (501, "All rights reserved.\nThis work is licensed under the GNU General Public License", "en", "Z", 1)]
    frame = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    assert sorted(map(tuple, operator(frame).select(*columns).collect()), key=key) == sorted(con.sql(f"select {', '.join(columns)} from ({sql})").fetchall(), key=key)
    assert operator(none).count() == 0


def test_wrapped_license_sentences_are_found(spark):
    texts = {
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
        "mpl-2": "word " * 33 + "\n# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy",
        "gpl-3": "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
        "": "Redistribution in source\n" + "other words between them " * 20 + "and binary forms with or without modification are permitted",
    }
    for pad in (0, 20, 31, 60, 67):  # wherever the windows fall
        found = licenses.scan(spark.createDataFrame([(i, "pad " * pad + t, "en", "s", 1) for i, t in enumerate(texts.values())], SCHEMA)).collect()
        assert {r.doc_id: r.labels for r in found} == dict(enumerate(texts))
        assert min(b.word for r in found for b in r.blocks if r.doc_id == 0) == pad


def test_other_licenses_and_prose_get_no_label(spark):
    other = ["Released under the GPL license", "Released under the Apache License", "The book was released under the old license", "Licensed under CC BY 4.0", "CC BY-SA 4.0", "Licensed under CC BY-SA 4.0"]
    other += ["All of the members met. Their seats are reserved, and so are the rights.", "Licensed under the Apache License, Version 1.0.", "This work is licensed under the GNU General Public License, version 2."]
    other += ["This work is licensed under the GNU Lesser General Public License, version 3.", "licensed under a Creative Commons Attribution-NonCommercial 3.0 International License"]
    other += ["of the GNU General Public License; either version 2 of the License, or (at your option) any later version"]
    own = [(s, label) for label, s in licenses.TEMPLATES] + [("Released under MIT license, the text follows", "mit"), ("Licensed under the Apache License 2.0", "apache-2")]
    data = [*((s, "") for s in other), *own]
    found = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame([(i, s, "en", "s", 1) for i, (s, _) in enumerate(data)], SCHEMA)).collect()}
    assert {s: found[i] for i, (s, _) in enumerate(data)} == dict(data)
    # the threshold alone decides, whichever words are missing
    bent = [("Redistribution and use in source and binary form, with or without modification, are permitted", "bsd"), ("Permission is hereby granted, free of charge, to any persons obtaining copies of this software", "mit"), ("Permission is granted, free of charge, to any persons obtaining copies of this software", "")]
    found = [r.labels for r in licenses.scan(spark.createDataFrame([(i, s, "en", "s", 1) for i, (s, _) in enumerate(bent)], SCHEMA)).orderBy("doc_id").collect()]
    assert found == [label for _, label in bent]
    plain = licenses.scan(spark.createDataFrame([(0, "a short one here", "", "", 1), (1, "short and a", "", "", 1)], SCHEMA), [("own", "A short one.")]).collect()
    assert {r.doc_id: r.labels for r in plain} == {0: "own", 1: ""}


def test_mix_meets_budgets(docs, rows):
    found = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) < 1 for s, t in target.items()) and len(found) == len(rows)
    assert sorted(map(key, found)) == sorted(map(key, mixing.mix(docs.repartition(5)).collect()))


def test_mix_of_null_and_repeated_ids(spark, monkeypatch):
    rnd = random.Random(2)
    data = [(None if i % 2 else 7, sentence(rnd, rnd.randint(0, 9)), ["a", "b", None][i % 3], f"x{i}") for i in range(600)]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string, key string").withColumns({"part": F.lit(1), "_start": F.lit("s"), "before": F.lit(2)})
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1 / 64)
    found = mixing.mix(frame).collect()
    assert sorted(r.key for r in found) == sorted(x[3] for x in data) and {(r.part, r._start, r.before) for r in found} == {(1, "s", 2)}
    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted((key(tuple(r[c] for c in columns)) for r in found)) == sorted(map(key, con.sql(f"select {', '.join(columns)} from ({mixing.ORACLE})").fetchall()))


def test_pipeline_as_plainly(spark, tmp_path):
    """All five stages in plain Python, SQL or a library's words, over a few hundred rows."""
    import corpus_pipeline
    import tiktoken

    rnd = random.Random(21)
    base, passage = [sentence(rnd, 90) for _ in range(12)], sentence(rnd, 60)
    data = []
    for i in range(260):
        words = (rnd.choice(base) if i % 3 == 0 else sentence(rnd, rnd.randint(0, 90))).split()
        words[:1] = ["edit" + str(i)] * (i % 2)
        text = " ".join(words) + (f"\n{passage}\n{sentence(rnd, 20)}" if i % 5 == 1 else "") + (" zzqqz" if i % 6 == 0 else "")
        data.append((i, text, "en", ["s1", "s2", None][i % 3], len(text)))
    data += [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(260)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.learn(spark.createDataFrame(data, SCHEMA), labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    clean = [d for d in data if sum(weight.get(f, 0) for f in toxicity.features([(d[1] or "").encode()]).tolist()) + model.bias < 0]
    assert 150 < len(clean) < 240
    _, root = brute_components(clean)
    kept = [d for i, d in enumerate(clean) if root[i] == i]
    deduped = plain_dedup([d[:2] for d in kept])
    texts = {d[0]: (deduped[d[0]], d[3]) for d in kept}
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame([(i, t, s) for i, (t, s) in texts.items()], "doc_id long, text string, source string").toArrow())
    ranks = bpe.coder(public_tokenizers.path("byte_bpe_50k.tiktoken")).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for doc_id, size, taken in con.sql(f"select doc_id, size, taken from ({mixing.ORACLE})").fetchall():
        while taken > 0:
            text = texts[doc_id][0] if taken >= size else " ".join(texts[doc_id][0].encode().split()[i].decode() for i in range(taken))
            ids = library.encode_ordinary(text)
            want[doc_id, texts[doc_id][1], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
            taken -= size
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want


def test_pipeline_of_nothing(spark, none, tmp_path):
    import corpus_pipeline

    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    import corpus_pipeline

    docs.filter("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i == 101)) for i in range(100, 112)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, kept, str(tmp_path))
        assert done.columns == kept.columns, name
        kept = done
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
