"""Shared helpers: staged tables in the cluster's shared folder, and Arrow batch utilities."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage.files import clear, passing

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: A key with more than one in so many of all rows is hot: there are at most so many of them, which bounds their broadcast.
HOT_KEYS = 4096
#: The temporary folder of a local session that names none, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local session gets a temporary one (tests); on a
    cluster that would be a folder nobody else sees, so it is an error."""
    named = spark.sparkContext.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} has to name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = passing(spark, "file://" + tempfile.mkdtemp(prefix="duoplane-"))
    return _LOCAL[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here, and a lost executor only
    costs the tasks that read it. The caller's result may read it lazily, so the table stays until the process ends, or
    ``drop_staged`` is called."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete every table that ``staged`` wrote in this session; returns how many. The end of the process does so as well."""
    return clear(spark)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it (case aside)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_facts(rows: DataFrame, facts: DataFrame, key: list[str], n: str, total: int) -> DataFrame:
    """``rows``, ``total`` of them, joined with ``facts`` (one row for each ``key``; ``n`` of the rows have it), without ``n``.

    A hot key's rows are dealt over several parts by a hash of all their columns, and its facts are repeated for each part,
    so that no task gets more than one in ``HOT_KEYS`` of all rows for one key. Only the hot keys and the numbers of their
    parts are broadcast. Rows with a null key join nothing. ``facts`` is read twice: stage it where it is costly."""
    parts, salt = unused([*rows.columns, *facts.columns], "parts", "salt")
    dealt = facts.withColumn(parts, F.ceil(F.col(n) * HOT_KEYS / max(1, total)).cast("int")).drop(n)
    hot = F.broadcast(dealt.filter(F.col(parts) > 1).select(*key, parts))
    salted = rows.join(hot, key, "left").withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    each = dealt.withColumn(salt, F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col(parts)) - 1))).drop(parts)
    return salted.join(each, [*key, salt]).drop(salt)


def give_back() -> None:
    """Give freed memory back to the system: a worker process is used again by later stages, and would keep what it once had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most_bytes`` of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most_bytes
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def repeat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate the integer ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def input_partitions(df: DataFrame, least: int = 1) -> int:
    """The session's shuffle width, at least ``least``."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
