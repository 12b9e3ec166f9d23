"""Media columns (operator 1): progressive JPEG to RGB tensors, and bytes stored losslessly as JPEG coefficients."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jpeg
from .common import slices

BLOCK = 64


def decode_images(images: DataFrame, column: str = "media") -> DataFrame:
    """Adds height, width, rgb (binary, height x width x 3) and error for each progressive JPEG in ``column``.

    A null, empty or undecodable value has null height, width and rgb and says why in ``error`` (null for a null
    value); columns of the input with these names are replaced. Every row is kept, in no particular order.
    """
    made = {"height": T.IntegerType(), "width": T.IntegerType(), "rgb": T.BinaryType(), "error": T.StringType()}
    kept = [f for f in images.schema.fields if f.name not in made]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 1 << 20):
            out: list[tuple] = [_rgb(x) for x in batch.column(column).to_pylist()]
            arrays = [batch.column(c) for c in names] + [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *made])

    return images.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, T.StructType([*kept, *(T.StructField(c, t) for c, t in made.items())]))


def _rgb(data: bytes | None) -> tuple:
    if data is None:
        return None, None, None, None
    try:
        found, coefs, _ = jpeg.decode([data])
        rgb = jpeg.to_rgb(found[0], jpeg.samples(found, coefs))
    except (ValueError, LookupError, TypeError, ArithmeticError, MemoryError) as why:
        return None, None, None, str(why) or type(why).__name__
    return rgb.shape[0], rgb.shape[1], rgb.tobytes(), None


def pad(raw: bytes) -> bytes:
    """``raw`` and zeros up to a positive multiple of ``BLOCK`` bytes."""
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def _shape(blocks: int) -> tuple[int, int]:
    """Rows and columns of 16x16 squares (six blocks each) for so many blocks, near a square."""
    squares = -(-blocks // 6)
    columns = max(1, int(np.sqrt(squares)))
    return -(-squares // columns), columns


def store(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEGs whose quantised coefficients are the payloads' bytes: a byte under 128 is the coefficient
    byte - 130, another one byte - 125, so none is 0 and each keeps its place. Blocks beyond the payload are zero; its
    length stands in the comment."""
    sizes = np.array([len(p) // BLOCK for p in payloads], np.int64)
    shapes = [_shape(n) for n in sizes.tolist()]
    full = np.array([6 * r * c for r, c in shapes], np.int64)
    first = np.concatenate(([0], np.cumsum(full)))
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK).astype(np.int64)
    blocks = np.zeros((int(first[-1]), BLOCK), np.int64)
    inside = np.zeros(len(blocks), bool)
    for a, n in zip(first.tolist(), sizes.tolist(), strict=False):
        inside[a : a + n] = True
    blocks[inside] = np.where(raw < 128, raw - 130, raw - 125)
    return jpeg.encode(blocks, first, shapes, [str(len(p)).encode() for p in payloads])


def read_back(files: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Payloads and RGB tensors of files that ``store`` made."""
    images, coefs, first = jpeg.decode(files)
    pixels = jpeg.samples(images, coefs)
    payloads, tensors = [], []
    for i, image in enumerate(images):
        own = coefs[first[i] : first[i + 1]]
        flat = own.ravel()[: int(image.comment)]
        payloads.append(np.where(flat < 0, flat + 130, flat + 125).astype(np.uint8).tobytes())
        tensors.append(jpeg.to_rgb(image, pixels[first[i] : first[i + 1]]))
    return payloads, tensors


def describe(rgb: np.ndarray) -> str:
    """Mean of each channel in thousandths, and 64 bits: is each of 8x8 areas' green brighter than all on average?"""
    h, w, _ = rgb.shape
    total = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    means = (1000 * total // (h * w)).tolist()
    ys, xs = np.arange(8) * h // 8, np.arange(8) * w // 8
    areas = np.add.reduceat(np.add.reduceat(rgb[:, :, 1].astype(np.int64), ys, axis=0), xs, axis=1)
    size = np.diff(np.append(ys, h))[:, None] * np.diff(np.append(xs, w))[None, :]
    bits = np.packbits((areas * (h * w) > total[1] * size).ravel()).tobytes().hex()
    return f"{w}x{h}:{means[0]}:{means[1]}:{means[2]}:{bits}"


def text_media(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Store every whole text's UTF-8 bytes as a progressive JPEG, read it back and describe its RGB tensor.

    Returns doc_id, n_bytes (unpadded), payload_bytes, payload_sha256 and tail_crc32 (of the bytes read back; the last
    64 of them), media_bytes, media_sha256, feature; ``with_media`` adds media and rgb. Null counts as empty, which is
    64 zero bytes. One row for every row of ``docs``; other columns are left out. Equal texts give equal values: the
    arithmetic is exact in integers. No shuffle; a worker holds a few MB of texts at a time, or one longer text.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary, rgb binary" if with_media else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for batch in slices(batches, "text", 3 << 20):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            media = store(list(map(pad, raw)))
            payloads, tensors = read_back(media)
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array(map(len, raw), pa.int64()),
                "payload_bytes": pa.array(map(len, payloads), pa.int64()),
                "payload_sha256": pa.array([sha(p).hexdigest() for p in payloads]),
                "tail_crc32": pa.array([zlib.crc32(p[-BLOCK:]) for p in payloads], pa.int64()),
                "media_bytes": pa.array(map(len, media), pa.int64()),
                "media_sha256": pa.array([sha(m).hexdigest() for m in media]),
                "feature": pa.array(map(describe, tensors)),
            }
            if with_media:
                columns |= {"media": pa.array(media, pa.binary()), "rgb": pa.array([t.tobytes() for t in tensors], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
