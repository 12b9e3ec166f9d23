"""Tables in a total order: positions without a task that sees all rows, ids that stay, and pages that open one or two files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files

#: Spark's row ids: the partition above, the row within it below.
_ROW_BITS = 33
_ROW = (1 << _ROW_BITS) - 1
ROWS = 100_000


def write_in_order(rows: DataFrame, path: str, order: list[Column | str], rows_per_file: int = ROWS) -> DataFrame:
    """Write ``rows`` below ``path`` in files that follow each other in ``order`` (a total one), of about ``rows_per_file`` rows; returns the index: part,
    file, start (the first row's ``_at``), offset, n. A task sorts at least ``ROWS`` rows, however small their files are: for each task the driver draws
    samples and gets a result, so that small files would cost it as much as the table. Of the index, which is a table itself, it sees the parts' sums."""
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // max(rows_per_file, ROWS)))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.withColumn("_at", F.monotonically_increasing_id()).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    part, start = F.shiftright("_at", _ROW_BITS).alias("part"), F.min("_at").alias("start")
    counts = spark.read.parquet(f"{path}/rows").groupBy(part, F.input_file_name().alias("file")).agg(start, F.count("*").alias("n"))
    counts.write.parquet(f"{path}/counts")
    counts = spark.read.schema(counts.schema).parquet(f"{path}/counts")
    before, total = [], 0
    for r in sorted(counts.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.part):  # one for each task
        before.append((r.part, total))
        total += r.n
    offset = F.col("before") + F.col("start").bitwiseAND(_ROW)
    held = counts.join(F.broadcast(spark.createDataFrame(before, "part long, before long")), "part")
    held.select("part", "file", "start", offset.alias("offset"), "n").write.parquet(f"{path}/index")
    Files(spark, path).put_if_absent("index.json", {"total": total})
    return _index(spark, path).orderBy("offset")


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part long, file string, start long, offset long, n long").parquet(f"{path}/index")


def positions(rows: DataFrame, path: str, order: list[Column | str], name: str = "position", start: int = 1, rows_per_file: int = ROWS) -> DataFrame:
    """``rows`` with consecutive numbers in ``order``: rows are sorted by ranges and written once, with their place in their part; the
    parts' offsets are sums of their counts."""
    index = write_in_order(rows, path, order, rows_per_file)
    written = rows.sparkSession.read.parquet(f"{path}/rows")
    offsets = F.broadcast(index.groupBy("part").agg(F.min("offset").alias("offset")))  # a row for each part
    placed = written.withColumn("part", F.shiftright("_at", _ROW_BITS)).join(offsets, "part")
    return placed.select(*rows.columns, (F.col("offset") + F.col("_at").bitwiseAND(_ROW) + start).alias(name))


def kept_ids(rows: DataFrame, keys: list[str], path: str, previous: DataFrame | None = None, name: str = "row_id") -> DataFrame:
    """``keys`` of ``rows`` with ids that stay: a key that ``previous`` (keys, id) has keeps its id, also when it was gone for some runs; new keys get the
    next ones in key order. Returns all keys that ever had one, for the next call; null keys are keys."""
    fresh = rows.select(*keys).distinct()
    if previous is None:
        return positions(fresh, path, keys, name)
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    unknown = fresh.alias("f").join(previous.alias("p"), same, "left_anti")
    last = previous.agg(F.coalesce(F.max(name), F.lit(0))).first()[0]
    return previous.select(*keys, name).unionByName(positions(unknown, path, keys, name, last + 1))


def page(spark: SparkSession, path: str, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` up to ``offset + limit`` of a table that ``write_in_order`` has written: only the files that hold some are read, as many as
    the page spans, and of these the rows by their place."""
    chosen = _index(spark, path).filter((F.col("offset") < offset + limit) & (F.col("offset") + F.col("n") > offset)).orderBy("offset").collect()
    written = spark.read.parquet(*[r.file for r in chosen] or [f"{path}/rows"])
    columns = [c for c in written.columns if c != "_at"]
    if not chosen:
        return written.select(*columns).limit(0)
    first, last = chosen[0], chosen[-1]
    from_, to = first.start + max(0, offset - first.offset), last.start + offset + limit - last.offset
    return written.filter((F.col("_at") >= from_) & (F.col("_at") < to)).orderBy("_at").select(*columns)


def page_total(spark: SparkSession, path: str) -> int:
    """How many rows there are, from the index alone."""
    return Files(spark, path).get("index.json")["total"]
