"""Language ID by compression (operator 2): the dictionary that shrinks a text most names its language.

One raw-content zstandard dictionary for each language, of whole texts from a bounded sample of labelled documents. A text
is cut into windows of ``WINDOW`` bytes, all of which are compressed with every dictionary; the smallest sum wins, and a
narrow margin over the second rejects.

Bounds of the sample: of a language's documents, about ``SAMPLE_DOCS`` are drawn, from those of up to ``TEXT_BYTES``; a
dictionary holds the first of them, whole, that fit into ``DICTIONARY_BYTES``. Learnt are the ``LANGUAGES`` languages with the
most documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

SAMPLE_DOCS, TEXT_BYTES, DICTIONARY_BYTES, LANGUAGES = 400, 8 << 10, 128 << 10, 256
WINDOW, LEVEL = 16 << 10, 9
#: A smaller lead over the second best, as a share of its size, rejects.
MARGIN = 0.01
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from; null ids are never learnt from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Dictionary content by language, from documents with text, lang and doc_id that aren't held out. A document is
    sampled where the hash of its id falls under sample_docs / (documents of the language), so the sample stays bounded
    (in expectation, and to within a few percent) at any size. Columns besides these three don't matter."""
    labelled = docs.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    labelled = labelled.withColumn("size", F.octet_length("text")).filter(F.col("size") <= TEXT_BYTES)
    top = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r.lang: r.n for r in top.collect()}
    if not counts:
        return {}
    most = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(sample_docs / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = labelled.filter(draw < most[F.col("lang")]).select("lang", draw.alias("draw"), "doc_id", "text")
    drawn: dict[str, list] = {}
    for r in sorted(sample.collect(), key=lambda r: (r.draw, r.doc_id, r.text)):
        drawn.setdefault(r.lang, []).append(r.text.lower().encode())
    return {lang: _content(texts) for lang, texts in sorted(drawn.items())}


def _content(texts: list[bytes]) -> bytes:
    """Whole texts in order, each that still fits."""
    held, size = [], 0
    for text in texts:
        if size + len(text) < DICTIONARY_BYTES:
            held.append(text)
            size += len(text) + 1
    return b"\n".join(held)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """Adds lang_pred, score (0 to 1), rejected and sizes to doc_id and held_out, one row for every row of ``docs``.

    ``und`` with score 0 for a null text or one without any letter, or if no dictionary was learnt. Ties go to the
    language that sorts first. ``rejected`` marks a lead under ``margin``; lang_pred keeps the best guess even then.
    score is the best language's share when a byte more halves a language's likelihood. Whole texts, no shuffle.
    """
    languages = sorted(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        letter = re.compile(r"[^\W\d_]").search
        compress = []
        for lang in languages:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False).compress)
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                if not languages or text is None or not letter(text):
                    out.append((UNKNOWN, 0.0, True, []))
                    continue
                raw = text.lower().encode()
                windows = [raw[a : a + WINDOW] for a in range(0, len(raw), WINDOW)]
                sizes = [sum(len(c(w)) for w in windows) for c in compress]
                best, *rest = sorted(sizes)
                score = 1 / sum(2.0 ** -min(s - best, 1000) for s in sizes)
                out.append((languages[sizes.index(best)], score, bool(rest) and rest[0] - best < margin * rest[0], sizes))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "lang_pred", "score", "rejected", "sizes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, sizes array<long>")
