"""Progressive JPEG in numpy: entropy coding over many restart segments at once, inverse transform, colour.

The decoder takes any 8-bit, Huffman-coded progressive JPEG of one or three components with whole sampling factors:
spectral selection, successive approximation, end-of-band runs, interleaved or single-component DC scans, with or
without restart markers. Segments of the same kind of scan are decoded side by side, one numpy step for all of them;
it is fast where there are many (restart markers, or many images a batch) and slow for a single long segment.

The encoder writes coefficient blocks as they are, with a restart marker after every block, so that its files decode
at full width.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import numpy as np


@functools.lru_cache(1)
def zigzag() -> np.ndarray:
    """Row-major index of each zigzag position of an 8x8 block."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@functools.lru_cache(1)
def code_tables() -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """The encoder's one Huffman table: code and length by symbol, and the BITS and HUFFVAL of its DHT segment.
    Four bits for end-of-band and for sizes 1 to 8 without a run, five with a run of one, twelve for the rest."""
    length = np.full(256, 12)
    length[[0, *range(1, 9)]] = 4
    length[[0x10 + s for s in range(1, 9)]] = 5
    order = sorted(range(256), key=lambda s: (length[s], s))
    codes, code, last = np.zeros(256, np.int64), 0, 4
    for s in order:
        code <<= int(length[s]) - last
        last = int(length[s])
        codes[s] = code
        code += 1
    return codes, length, [int((length == k).sum()) for k in range(1, 17)], order


@functools.lru_cache(1)
def basis() -> np.ndarray:
    """The 64x64 inverse transform, scaled to integers: products and sums stay exact in doubles, in any order."""
    k = np.arange(8)
    c = np.rint(8192 * np.where(k[:, None] == 0, np.sqrt(0.125), 0.5) * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16))
    return np.kron(c, c)


class BitRows:
    """Rows of bits that grow at the right, all at once."""

    def __init__(self, rows: int, most_bits: int) -> None:
        self.width = most_bits // 32 + 2
        self.words = np.zeros((rows, self.width), np.uint32)
        self._acc, self._n, self._at = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64), np.arange(rows) * self.width
        self._flat = self.words.ravel()

    def put(self, value: np.ndarray, bits: np.ndarray) -> None:
        """Append the low ``bits`` (0 to 32) of each row's value."""
        n = bits.astype(np.uint64)
        self._acc <<= n
        self._acc |= value.astype(np.uint64)
        self._n += n
        full = np.flatnonzero(self._n >= 32)
        if len(full):
            self._n[full] -= np.uint64(32)
            self._flat[self._at[full]] = self._acc[full] >> self._n[full]
            self._at[full] += 1

    def finish(self) -> np.ndarray:
        """Pad with ones to whole bytes; the length of each row in bytes."""
        rest = (np.uint64(8) - self._n % np.uint64(8)) % np.uint64(8)
        self.put((np.uint64(1) << rest) - np.uint64(1), rest)
        self._flat[self._at] = self._acc << (np.uint64(32) - self._n)
        return (self._at - np.arange(len(self._at)) * self.width) * 4 + (self._n >> np.uint64(3)).astype(np.int64)


def _segments(bits: BitRows) -> tuple[np.ndarray, np.ndarray]:
    """All rows' bytes in a row, with a zero stuffed after each 255, and the length of each."""
    lengths = bits.finish()
    data = bits.words.byteswap().view(np.uint8)
    flat = data[np.arange(data.shape[1]) < lengths[:, None]]
    high = np.flatnonzero(flat == 0xFF)
    row = np.searchsorted(np.cumsum(lengths), high, side="right")
    return np.insert(flat, high + 1, 0), lengths + np.bincount(row, minlength=len(lengths))


def _size(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _low_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (np.int64(1) << size) - 1, v)


def encode_dc(dc: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """First DC scan at point transform ``low``, a segment for each block."""
    codes, length, _, _ = code_tables()
    v = dc >> low
    s, bits = _size(v), BitRows(len(dc), 64)
    bits.put(codes[s], length[s])
    bits.put(_low_bits(v, s), s)
    return _segments(bits)


def refine_dc(dc: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    bits = BitRows(len(dc), 8)
    bits.put((dc >> low) & 1, np.ones(len(dc), np.int64))
    return _segments(bits)


def encode_ac(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """First AC scan of a band (blocks x coefficients, zigzag order), a segment for each block."""
    codes, length, _, _ = code_tables()
    band = np.ascontiguousarray(band.T)
    band = np.sign(band) * (np.abs(band) >> low)
    bits, some, sizes = BitRows(band.shape[1], len(band) * 28 + 64), band != 0, _size(band)
    runs, none = some.all(axis=0), ~some.any(axis=0)
    low_bits = _low_bits(band, sizes)
    plain = (codes[sizes] << sizes) | low_bits
    widths = length[sizes] + sizes
    if not runs.all():
        plain[:, ~runs] = 0
        widths[:, ~runs] = 0
        plain[0, none], widths[0, none] = codes[0], length[0]
    for value, width in zip(plain, widths, strict=True):
        bits.put(value, width)
    if (odd := ~runs & ~none).any():  # zeros between others
        run = np.zeros(len(odd), np.int64)
        for k in range(len(band)):
            has = some[k] & odd
            while (far := has & (run > 15)).any():
                bits.put(np.where(far, codes[0xF0], 0), np.where(far, length[0xF0], 0))
                run -= 16 * far
            symbol = np.where(has, (run << 4) | sizes[k], 0)
            bits.put(np.where(has, (codes[symbol] << sizes[k]) | low_bits[k], 0), np.where(has, length[symbol] + sizes[k], 0))
            run = np.where(has, 0, run + 1)
        last = odd & (run > 0)
        bits.put(np.where(last, codes[0], 0), np.where(last, length[0], 0))
    return _segments(bits)


def refine_ac(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Refinement AC scan of a band to point transform ``low``, a segment for each block."""
    codes, length, _, _ = code_tables()
    size = np.abs(band) >> low
    old, fresh = size > 1, (size == 1).any(axis=1)
    bits = BitRows(len(band), band.shape[1] * 20 + 64)
    end = np.where(fresh, 0, length[0])
    bits.put(np.where(fresh, 0, codes[0]), end)  # where nothing becomes nonzero: end of band, then the correction bits
    full = old.all(axis=1)
    for a in range(0, band.shape[1], 21):
        part = size[:, a : a + 21] & 1
        n = part.shape[1]
        bits.put(np.where(full, part @ (np.int64(1) << np.arange(n)[::-1]), 0), np.where(full, n, 0))
    some = ~full & ~fresh & old.any(axis=1)
    for k in range(band.shape[1] if some.any() else 0):
        on = some & old[:, k]
        bits.put(np.where(on, size[:, k] & 1, 0), on)
    for i in np.flatnonzero(fresh).tolist():
        for value, n in _refine_row(band[i].tolist(), size[i].tolist(), codes, length):
            row = np.zeros(len(band), np.int64)
            row[i] = n
            bits.put(np.where(row > 0, value, 0), row)
    return _segments(bits)


def _refine_row(band: list[int], size: list[int], codes: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Codes and correction bits of one block: a symbol stands before the corrections that it passes over."""
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    run, last = 0, max(k for k, s in enumerate(size) if s == 1)
    for k, s in enumerate(size):
        if s == 0:
            run += 1
            continue
        while run > 15 and k <= last:
            out += [(int(codes[0xF0]), int(length[0xF0])), *held]
            run, held = run - 16, []
        if s > 1:
            held.append((s & 1, 1))
        else:
            out += [(int(codes[run << 4 | 1]), int(length[run << 4 | 1])), (int(band[k] > 0), 1), *held]
            run, held = 0, []
    return out + [(int(codes[0]), int(length[0])), *held] if run or held else out


@dataclass
class Scan:
    components: list[int]
    start: int
    end: int
    high: int
    low: int


#: Scan script of the encoder, for each component: DC and two spectral bands less one bit, then that bit.
SCRIPT = [(0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0)]


def _marker(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body


def header(width: int, height: int, comment: bytes) -> bytes:
    """Everything before the first scan: YCbCr with chroma halved both ways, unit quantisers, restart interval 1."""
    _, _, counts, order = code_tables()
    table = bytes(counts) + bytes(order)
    frame = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03" + b"\x01\x22\x00" + b"\x02\x11\x00" + b"\x03\x11\x00"
    return (
        b"\xff\xd8" + _marker(0xFE, comment) + _marker(0xDB, b"\x00" + b"\x01" * 64) + _marker(0xC2, frame)
        + _marker(0xC4, b"\x00" + _dc_table()) + _marker(0xC4, b"\x10" + table) + _marker(0xDD, b"\x00\x01")
    )


def _dc_table() -> bytes:
    """The first twelve symbols with the codes that they have in the one table need that whole table."""
    _, _, counts, order = code_tables()
    return bytes(counts) + bytes(order)


def encode(blocks: np.ndarray, images: np.ndarray, shapes: list[tuple[int, int]], comments: list[bytes]) -> list[bytes]:
    """JPEG files of many images. ``blocks``: zigzag coefficients (n x 64) of all images, each image's 4mn luma blocks
    in raster order, then its mn blocks of either chroma; ``images``: first block of each image, and n; ``shapes``: (m, n),
    the rows and columns of 16x16 squares."""
    scans = []
    for start, end, high, low in SCRIPT:
        if start == 0:
            data, lengths = (refine_dc if high else encode_dc)(blocks[:, 0], low)
        else:
            data, lengths = (refine_ac if high else encode_ac)(blocks[:, start : end + 1], low)
        ends = np.cumsum(lengths + 2)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = inside[ends - 2] = False
        out[inside] = data
        out[ends - 2] = 0xFF
        scans.append((out, np.concatenate(([0], ends)), (start, end, high, low)))
    files = []
    for i, (rows, columns) in enumerate(shapes):
        n, first = rows * columns, int(images[i])
        parts = [header(16 * columns, 16 * rows, comments[i])]
        for component, (a, b) in enumerate(((first, first + 4 * n), (first + 4 * n, first + 5 * n), (first + 5 * n, first + 6 * n))):
            numbers = (0xD0 + (np.arange(b - a) & 7)).astype(np.uint8)
            for out, ends, (start, end, high, low) in scans:
                x, y = int(ends[a]), int(ends[b])
                out[ends[a + 1 : b + 1] - 1] = numbers
                parts.append(_marker(0xDA, bytes([1, component + 1, 0x00, start, end, high << 4 | low])))
                parts.append(out[x : y - 2].tobytes())  # no restart marker after the last segment
        parts.append(b"\xff\xd9")
        files.append(b"".join(parts))
    return files


# ---------------------------------------------------------------------------------------------------- decoding


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quantiser: int
    blocks_wide: int = 0  # as stored: whole squares
    blocks_high: int = 0
    used_wide: int = 0  # as a scan of this component alone goes over it
    used_high: int = 0
    first: int = 0


@dataclass
class Image:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    blocks: int = 0
    steps: list[tuple[Scan, list[np.ndarray], int, bytes]] = field(default_factory=list)  # scan, lookups, interval, data


def _lookup(bits: bytes, symbols: bytes) -> np.ndarray:
    """16 bits to (length << 8 | symbol); length 0 where no code begins so."""
    table, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for n in range(1, 17):
        for _ in range(bits[n - 1]):
            table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


#: A marker that isn't a stuffed byte or a restart.
_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]")


@functools.lru_cache(64)
def _lookup_of(body: bytes) -> np.ndarray:
    return _lookup(body[:16], body[16:])


def parse(data: bytes) -> Image:
    """Markers of a file; raises ValueError for what isn't an 8-bit progressive Huffman JPEG of 1 or 3 components, and for one
    that claims more than its bytes can hold, before anything is allocated for it."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, at, dc, ac, interval = Image(), 2, {}, {}, 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        code = data[at + 1]
        if code == 0xFF:
            at += 1
            continue
        if code == 0xD9:
            break
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if code == 0xFE:
            image.comment = body
        elif code == 0xDB:
            while body:
                wide = body[0] >> 4
                raw = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else "u1").astype(np.int64)
                image.quantisers[body[0] & 15], body = raw, body[1 + 64 * (1 + wide) :]
        elif code == 0xC4:
            while body:
                k = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15], body = _lookup_of(body[1 : 17 + k]), body[17 + k :]
        elif code == 0xDD:
            interval = int.from_bytes(body, "big")
        elif code == 0xC2:
            if body[0] != 8 or body[5] not in (1, 3):
                raise ValueError("8-bit samples of 1 or 3 components only")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            factors = [f for c in image.components for f in (c.h, c.v)]
            if not image.width or not image.height or not all(1 <= f <= 4 for f in factors):
                raise ValueError("an empty image, or sampling factors that aren't 1 to 4")
            hs, vs = max(c.h for c in image.components), max(c.v for c in image.components)
            if any(hs % c.h or vs % c.v for c in image.components):
                raise ValueError("sampling factors that aren't whole ratios")
            if image.blocks:
                raise ValueError("more than one frame")
            wide, tall = -(-image.width // (8 * hs)), -(-image.height // (8 * vs))
            for c in image.components:
                c.blocks_wide, c.blocks_high, c.first = wide * c.h, tall * c.v, image.blocks
                c.used_wide, c.used_high = -(-image.width * c.h // (8 * hs)), -(-image.height * c.v // (8 * vs))
                image.blocks += c.blocks_wide * c.blocks_high
            if image.blocks > 8 * len(data):  # a block takes a bit at least
                raise ValueError(f"{image.width} x {image.height} pixels are more than {len(data)} bytes can hold")
        elif code in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only progressive Huffman-coded JPEG")
        elif code == 0xDA:
            k = body[0]
            idents = [c.ident for c in image.components]
            parts = [idents.index(body[1 + 2 * i]) for i in range(k)]
            start, end, high, low = body[1 + 2 * k], body[2 + 2 * k], body[3 + 2 * k] >> 4, body[3 + 2 * k] & 15
            if not 0 <= start <= end <= 63 or low > 13 or (start == 0) != (end == 0) or k != len(parts) or len(set(parts)) != k or (start and k != 1):
                raise ValueError("a scan of impossible bounds")
            found = _SCAN_END.search(data, at)
            stop = found.start() if found else len(data)
            tables = [(dc.get(body[2 + 2 * i] >> 4) if start == 0 else ac.get(body[2 + 2 * i] & 15)) for i in range(k)]
            image.steps.append((Scan(parts, start, end, high, low), tables, interval, data[at:stop]))
            at = stop
    if not image.components:
        raise ValueError("no progressive frame")
    return image


class Lanes:
    """Bit readers side by side over one buffer of unstuffed segments."""

    def __init__(self, buffer: np.ndarray, starts: np.ndarray) -> None:
        padded = np.concatenate((buffer, np.zeros(16, np.uint8)))
        self._window = np.ndarray(len(buffer) + 8, ">u8", padded, strides=(1,)).astype(np.uint64)
        self._most = len(buffer) * 8
        self.at = starts * 8

    def window(self, lanes: np.ndarray) -> np.ndarray:
        """The next 57 bits at least, left aligned."""
        at = np.minimum(self.at[lanes], self._most)
        return self._window[at >> 3] << (at & 7).astype(np.uint64)


def _take(window: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` bits (possibly none) of each window after ``skip``."""
    return ((window << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _decode_scan(coefs: np.ndarray, scan: Scan, table_of: list[np.ndarray], buffer: np.ndarray, starts: np.ndarray, block_at: np.ndarray, block_end: np.ndarray, order: np.ndarray, part: np.ndarray) -> None:
    """One kind of scan over all its segments. Segment i has the blocks order[block_at[i]:block_end[i]]; ``part`` tells
    which of the scan's components a block of ``order`` belongs to."""
    lanes_all, flat = Lanes(buffer, starts), coefs.ravel()
    n, zz = len(starts), 64
    eob = np.zeros(n, np.int64)
    before = np.zeros((len(scan.components), n), np.int64)
    for step in range(int((block_end - block_at).max(initial=0))):
        lanes = np.flatnonzero(block_at + step < block_end)
        where = block_at[lanes] + step
        base = order[where] * zz
        if scan.start == 0:
            window = lanes_all.window(lanes)
            if scan.high:
                flat[base] |= (window >> np.uint64(63)).astype(np.int64) << scan.low
                lanes_all.at[lanes] += 1
                continue
            own = part[where]
            found = np.zeros(len(lanes), np.int64)
            for p, table in enumerate(table_of):
                mine = own == p
                found[mine] = table[(window[mine] >> np.uint64(48)).astype(np.int64)]
            length, size = found >> 8, found & 15
            bits = _take(window, length, size)
            diff = np.where(bits < (np.int64(1) << size >> 1), bits - (np.int64(1) << size) + 1, bits)
            before[own, lanes] += diff
            flat[base] = before[own, lanes] << scan.low
            lanes_all.at[lanes] += length + size
        elif scan.high:
            _refine_block(flat, lanes_all, lanes, base, eob, scan, table_of[0])
        else:
            _first_block(flat, lanes_all, lanes, base, eob, scan, table_of[0])


def _first_block(flat: np.ndarray, reader: Lanes, lanes: np.ndarray, base: np.ndarray, eob: np.ndarray, scan: Scan, table: np.ndarray) -> None:
    on = eob[lanes] == 0
    eob[lanes[~on]] -= 1
    lanes, base = lanes[on], base[on]
    k = np.full(len(lanes), scan.start)
    while len(lanes):
        window = reader.window(lanes)
        found = table[(window >> np.uint64(48)).astype(np.int64)]
        length, run, size = (found >> 8).astype(np.int64), ((found >> 4) & 15).astype(np.int64), (found & 15).astype(np.int64)
        bits = _take(window, length, size)
        some = size > 0
        k += run
        value = np.where(bits < (np.int64(1) << size >> 1), bits - (np.int64(1) << size) + 1, bits) << scan.low
        inside = some & (k <= scan.end)
        if inside.all():
            flat[base + k] = value
        else:
            flat[base[inside] + k[inside]] = value[inside]
        reader.at[lanes] += length + size
        k += 1
        band_over = ~some & (run < 15)
        if band_over.any():
            who, r = lanes[band_over], run[band_over]
            more = _take(window[band_over], length[band_over], r)
            reader.at[who] += r
            eob[who] = (np.int64(1) << r) + more - 1
        live = ~band_over & (k <= scan.end)
        if not live.all():
            lanes, base, k = lanes[live], base[live], k[live]


def _refine_block(flat: np.ndarray, reader: Lanes, lanes: np.ndarray, base: np.ndarray, eob: np.ndarray, scan: Scan, table: np.ndarray) -> None:
    unit = np.int64(1) << scan.low
    ended = eob[lanes] > 0
    eob[lanes[ended]] -= 1
    run = np.full(len(lanes), -1)
    put = np.zeros(len(lanes), np.int64)

    def symbols(who: np.ndarray) -> None:
        window = reader.window(lanes[who])
        found = table[(window >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, r, size = found >> 8, (found >> 4) & 15, found & 15
        over = (size == 0) & (r < 15)
        sign = _take(window, length, np.minimum(size, 1))
        more = _take(window, length, np.where(over, r, 0))
        reader.at[lanes[who]] += length + np.where(over, r, np.minimum(size, 1))
        put[who] = np.where(size > 0, np.where(sign > 0, unit, -unit), 0)
        run[who] = np.where(over, -1, r)
        ended[who] = over
        eob[lanes[who]] = np.where(over, (np.int64(1) << r) + more - 1, eob[lanes[who]])

    first = np.flatnonzero(~ended)
    if len(first):
        symbols(first)
    tail = ended.copy()  # nothing new in the whole band: its correction bits stand in a row
    if tail.any():
        rows = np.flatnonzero(tail)
        at = base[rows][:, None] + np.arange(scan.start, scan.end + 1)
        values = flat[at]
        old = values != 0
        counts = old.sum(axis=1)
        where = (np.cumsum(old, axis=1) - 1 + reader.at[lanes[rows]][:, None])[old]
        bit = ((reader._window[np.minimum(where, reader._most) >> 3] << (where & 7).astype(np.uint64)) >> np.uint64(63)).astype(np.int64)
        had = values[old]
        values[old] = had + np.where((bit > 0) & ((np.abs(had) & unit) == 0), np.sign(had) * unit, 0)
        flat[at] = values
        reader.at[lanes[rows]] += counts
        rest = np.flatnonzero(~tail)
        if not len(rest):
            return
        lanes, base, run, put, ended = lanes[rest], base[rest], run[rest], put[rest], ended[rest]
    for k in range(scan.start, scan.end + 1):
        need = np.flatnonzero((run < 0) & ~ended)
        if len(need):
            symbols(need)
        had = flat[base + k]
        old = np.flatnonzero(had != 0)
        if len(old):
            bit = (reader.window(lanes[old]) >> np.uint64(63)).astype(np.int64)
            v = had[old]
            flat[base[old] + k] = v + np.where((bit > 0) & ((np.abs(v) & unit) == 0), np.sign(v) * unit, 0)
            reader.at[lanes[old]] += 1
        new = (had == 0) & ~ended
        place = new & (run == 0)
        flat[base[place] + k] = put[place]
        run[new] -= 1


def _block_order(image: Image, scan: Scan) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in its order, the component of each, and the blocks of one unit of its restart interval."""
    own = [image.components[i] for i in scan.components]
    if len(own) == 1:
        c = own[0]
        at, part = _raster(c.used_high, c.used_wide, c.blocks_wide)
        return at + c.first, part, 1
    rows, columns = own[0].blocks_high // own[0].v, own[0].blocks_wide // own[0].h
    y, x = (a.ravel() for a in np.mgrid[:rows, :columns])
    at, part = [], []
    for p, c in enumerate(own):
        for dy in range(c.v):
            for dx in range(c.h):
                at.append((y * c.v + dy) * c.blocks_wide + x * c.h + dx + c.first)
                part.append(np.full(len(y), p))
    return np.stack(at, axis=1).ravel(), np.stack(part, axis=1).ravel(), len(at)


@functools.lru_cache(256)
def _raster(high: int, wide: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    at = (np.arange(high)[:, None] * stride + np.arange(wide)).ravel()
    return at, np.zeros(len(at), np.int64)


def decode(files: list[bytes]) -> tuple[list[Image], np.ndarray, np.ndarray]:
    """Coefficients (blocks x 64, zigzag order) of all files, and the first block of each file.
    Scans of the same place in their files and of the same kind are decoded together."""
    images = list(map(parse, files))
    first = np.concatenate(([0], np.cumsum([i.blocks for i in images], dtype=np.int64)))
    coefs = np.zeros((int(first[-1]), 64), np.int64)
    for turn in range(max((len(i.steps) for i in images), default=0)):
        kinds: dict[tuple, list[int]] = {}
        for i, image in enumerate(images):
            if turn < len(image.steps):
                scan, tables, _, _ = image.steps[turn]
                kinds.setdefault((scan.start, scan.end, scan.high, scan.low, len(scan.components), *map(id, tables)), []).append(i)
        for members in kinds.values():
            _decode_turn(images, members, turn, first, coefs)
    return images, coefs, first


def _decode_turn(images: list[Image], members: list[int], turn: int, first: np.ndarray, coefs: np.ndarray) -> None:
    raw = np.frombuffer(b"".join(images[i].steps[turn][3] + b"\xff\xd0" for i in members), np.uint8)
    high = np.flatnonzero(raw[:-1] == 0xFF)
    high = high[np.concatenate(([True], np.diff(high) > 1))] if len(high) else high
    after = raw[high + 1]
    stuffed, marks = high[after == 0] + 1, high[(after & 0xF8) == 0xD0]
    keep = np.ones(len(raw), bool)
    keep[stuffed] = keep[marks] = keep[marks + 1] = False
    index = np.cumsum(keep)
    ends = np.where(marks > 0, index[np.maximum(marks - 1, 0)], 0)
    starts = np.concatenate(([0], ends[:-1]))
    orders, parts, at, to, had = [], [], [], [], 0
    for i in members:
        scan, _, interval, _ = images[i].steps[turn]
        order, part, unit = _block_order(images[i], scan)
        a = np.arange(0, len(order), unit * interval if interval else max(1, len(order)))
        orders.append(order + first[i])
        parts.append(part)
        at.append(a + had)
        to.append(np.append(a[1:], len(order)) + had)
        had += len(order)
    at, to = np.concatenate(at), np.concatenate(to)
    if len(at) != len(starts):
        raise ValueError(f"{len(starts)} restart segments where {len(at)} are due")
    scan, tables, _, _ = images[members[0]].steps[turn]
    _decode_scan(coefs, scan, tables, raw[keep], starts, at, to, np.concatenate(orders), np.concatenate(parts))


def samples(images: list[Image], coefs: np.ndarray) -> np.ndarray:
    """8x8 samples (0 to 255, row-major) of all blocks of all images."""
    tables = {}
    which = np.repeat(
        [tables.setdefault(i.quantisers[c.quantiser].tobytes(), len(tables)) for i in images for c in i.components],
        [c.blocks_wide * c.blocks_high for i in images for c in i.components],
    )
    quantisers = np.stack([np.frombuffer(t, np.int64) for t in tables]) if tables else np.zeros((0, 64))
    from_zigzag = np.ascontiguousarray(basis()[zigzag()])
    out = np.empty((len(coefs), 64), np.uint8)
    for a in range(0, len(coefs), 4096):
        x = (coefs[a : a + 4096] * quantisers[which[a : a + 4096]]).astype(np.float64) @ from_zigzag
        x += (128 << 26) + (1 << 25)
        x *= 2.0**-26  # exact, as all that went before
        out[a : a + 4096] = np.clip(np.floor(x, out=x), 0, 255, out=x)
    return out


def to_rgb(image: Image, blocks: np.ndarray) -> np.ndarray:
    """Full-resolution RGB (height x width x 3, 8 bits) from an image's blocks of samples; chroma is repeated."""
    hs, vs = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        own = blocks[c.first : c.first + c.blocks_wide * c.blocks_high].reshape(c.blocks_high, c.blocks_wide, 8, 8)
        plane = own.swapaxes(1, 2).reshape(8 * c.blocks_high, 8 * c.blocks_wide).astype(np.int32)
        planes.append((plane, vs // c.v, hs // c.h))
    if len(planes) == 1:
        return np.repeat(planes[0][0][: image.height, : image.width, None], 3, axis=2).astype(np.uint8)
    (y, cb, cr), half = (p[0] for p in planes), 1 << 15
    cb, cr = cb - 128, cr - 128
    full = lambda plane, k: np.repeat(np.repeat(plane, planes[k][1], axis=0), planes[k][2], axis=1)
    luma = full((y << 16) + half, 0)
    out = np.empty((image.height, image.width, 3), np.uint8)
    # 65536 times the JFIF conversion's 1.402, 0.344136, 0.714136, 1.772.
    if planes[1][1:] == planes[2][1:]:
        shifts = [full(91881 * cr, 2), full(-22554 * cb - 46802 * cr, 1), full(116130 * cb, 1)]
    else:
        shifts = [full(91881 * cr, 2), full(-22554 * cb, 1) + full(-46802 * cr, 2), full(116130 * cb, 1)]
    for k, shift in enumerate(shifts):
        value = (luma + shift) >> 16
        out[:, :, k] = np.clip(value, 0, 255, out=value)[: image.height, : image.width]
    return out
