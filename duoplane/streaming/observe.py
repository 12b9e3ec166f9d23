"""Latest state by key, kept by a stream: each micro-batch rewrites the buckets of the state that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.discovery import latest

#: Buckets of a state's keys; versions of a bucket that stay: the one in use and the one before it, for a replayed batch.
BUCKETS, KEPT = 64, 2


def merge_latest(spark: SparkSession, path: str, batch: DataFrame, batch_id: int, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """Write version ``batch_id`` of the buckets that a batch touches: the last row of each key. A replayed batch rewrites
    the same version from those before it, so the result is that of one delivery."""
    columns: list[Column] = [F.col(c) for c in order]
    new = latest(batch, keys, columns).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
    try:
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most as many as there are
        held = _held(spark, path)
        before = [f"{path}/v={max(v)}/bucket={b}" for b in touched if (v := [x for x in held.get(b, []) if x < batch_id])]
        rows = new.drop("bucket")
        if before:
            rows = spark.read.schema(rows.schema).parquet(*before).unionByName(rows)
        merged = latest(rows, keys, columns).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={batch_id}")
    finally:
        new.unpersist()
    files, jpath = _files(spark, path)
    for b in touched:
        for v in sorted({*held.get(b, []), batch_id})[:-KEPT]:
            files.delete(jpath(f"{path}/v={v}/bucket={b}"), True)


def _files(spark: SparkSession, path: str) -> tuple:
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def _held(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The complete versions of each bucket."""
    files, jpath = _files(spark, path)
    out: dict[int, list[int]] = {}
    for version in files.listStatus(jpath(path)) if files.exists(jpath(path)) else []:
        if not (name := version.getPath().getName()).startswith("v=") or not files.exists(jpath(f"{path}/{name}/_SUCCESS")):
            continue
        for bucket in files.listStatus(version.getPath()):
            if (b := bucket.getPath().getName()).startswith("bucket="):
                out.setdefault(int(b[7:]), []).append(int(name[2:]))
    return out


def current(spark: SparkSession, path: str) -> DataFrame:
    """The state: the last version of every bucket."""
    return spark.read.parquet(*[f"{path}/v={max(v)}/bucket={b}" for b, v in sorted(_held(spark, path).items())])


def observe(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], interval: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the latest row of each key of a stream; with an ``interval`` (say "300 seconds") for good, else over what is
    available now. A batch rewrites the buckets that it touches: about one for every 100,000 keys keeps that small; their
    number is fixed for a state."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: merge_latest(df.sparkSession, path, df, i, keys, order, buckets))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
