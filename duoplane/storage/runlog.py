"""The log of collector runs: one file when a run opens, one when it closes, folded when it is read.

A run is written as opened before its provider is read, and counts as failed until it closes. A driver that dies in
between leaves that record; nobody has to tidy up after it. Either file is created once: a run that is opened again is an
error, and of two closings the first counts. Rejected rows are stored before the closing that counts them.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import FAILED, KEY
from ..operators.discovery import RUN, run_status
from .files import Files, numbered

EVENT = T.StructType([
    *[T.StructField(c, T.StringType()) for c in RUN], T.StructField("event", T.StringType()), T.StructField("at", T.TimestampType()),
    T.StructField("records_read", T.LongType()), T.StructField("records_written", T.LongType()), T.StructField("has_gap", T.BooleanType()), T.StructField("reachable", T.BooleanType()), T.StructField("why", T.StringType()),
    T.StructField("event_id", T.StringType()),
])
OPENED, CLOSED, SKIPPED = "opened", "closed", "skipped"


class RunExists(RuntimeError):
    """A run of that id has been opened before."""


def folded(events: DataFrame) -> DataFrame:
    """Run records of events (the columns of EVENT), one for each run that was opened: RUN, started_at, status, records_read,
    records_written, errors, has_gap, finished_at, skipped_attempts. Any order and repeats of events give the same records: the first opening
    and the first closing count, and a skip once by its event_id. Skips, which name no run, count against their collector's latest run that is open when it is read."""
    runs = events.filter(F.col("event").isin(OPENED, CLOSED))
    facts = F.struct("at", "records_read", "records_written", "has_gap", "reachable")
    by_run = runs.groupBy(*RUN).agg(F.min(F.when(F.col("event") == OPENED, F.col("at"))).alias("started_at"), F.min(F.when(F.col("event") == CLOSED, facts)).alias("end"))
    by_run = by_run.filter("started_at is not null")
    errors = F.col("end.records_read") - F.col("end.records_written")
    ended = F.col("end").isNotNull()
    zero = F.lit(0).cast("long")
    records = by_run.select(
        *RUN, "started_at", F.when(ended, run_status(errors, F.col("end.has_gap"), F.col("end.reachable"))).otherwise(FAILED).alias("status"),
        *[F.coalesce(c, zero).alias(n) for c, n in ((F.col("end.records_read"), "records_read"), (F.col("end.records_written"), "records_written"), (errors, "errors"))],
        F.coalesce("end.has_gap", F.lit(False)).alias("has_gap"), F.col("end.at").alias("finished_at"),
    )
    skips = events.filter(F.col("event") == SKIPPED).groupBy("tenant_id", "collector").agg(F.count_distinct("event_id").alias("skipped"))
    flying = records.filter("finished_at is null").groupBy("tenant_id", "collector").agg(F.max(F.struct("started_at", "run_id"))["run_id"].alias("run_id"))
    counted = flying.join(skips, ["tenant_id", "collector"]).select(*RUN, "skipped")
    return records.join(counted, RUN, "left").withColumn("skipped_attempts", F.coalesce("skipped", zero)).drop("skipped")


class RunLog:
    """The run log below ``path``, a folder that every driver shares."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.files = spark, Files(spark, path)

    def _event(self, tenant_id: str, collector: str, run_id: str | None, event: str, at: datetime | None, **facts: object) -> dict:
        when = (at or datetime.now(UTC)).astimezone(UTC).isoformat()
        return {"tenant_id": tenant_id, "collector": collector, "run_id": run_id, "event": event, "at": when, "event_id": uuid.uuid4().hex, **facts}

    def open(self, tenant_id: str, collector: str, run_id: str, at: datetime | None = None) -> None:
        if not self.files.put_if_absent(f"events/{tenant_id}/{collector}/{run_id}.{OPENED}.json", self._event(tenant_id, collector, run_id, OPENED, at)):
            raise RunExists(f"{tenant_id}/{collector}/{run_id} has been opened before")

    def close(self, tenant_id: str, collector: str, run_id: str, at: datetime | None = None, *, records_read: int = 0, records_written: int = 0, has_gap: bool = False, reachable: bool = True, why: str | None = None) -> bool:
        """False where the run has been closed already."""
        facts = {"records_read": records_read, "records_written": records_written, "has_gap": has_gap, "reachable": reachable, "why": why}
        return self.files.put_if_absent(f"events/{tenant_id}/{collector}/{run_id}.{CLOSED}.json", self._event(tenant_id, collector, run_id, CLOSED, at, **facts))

    def skip(self, tenant_id: str, collector: str, at: datetime | None = None) -> None:
        """An attempt that found a run in flight. Skips are files of their own, so that no two of them meet."""
        self.files.put_if_absent(f"events/{tenant_id}/{collector}/{uuid.uuid4().hex}.{SKIPPED}.json", self._event(tenant_id, collector, None, SKIPPED, at))

    def store_rejects(self, rejected: DataFrame, tenant_id: str, collector: str, run_id: str) -> None:
        """Keep the rows that a run rejects (KEY, provider_id, position, problem)."""
        rejected.write.mode("overwrite").parquet(self.files.at(f"rejects/tenant={tenant_id}/collector={collector}/run={run_id}"))

    def events(self) -> DataFrame:
        """All events: those that were packed, and the files since."""
        parts = [self.spark.read.schema(EVENT).parquet(self.files.at(f"packed/parts/{p}")) for p in self._packed()[:1]]
        if self.files.names("events"):
            parts.append(self.spark.read.schema(EVENT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(self.files.at("events")))
        out = self.spark.createDataFrame([], EVENT)
        for part in parts:
            out = out.unionByName(part)
        return out

    def _packed(self) -> list[str]:
        """The packed part in force, if there is one, and the one before it."""
        last = self.files.last_number("packed/log")
        return [self.files.get(f"packed/log/{numbered(n)}")["part"] for n in range(last, max(-1, last - 2), -1)]

    def pack(self, before: datetime) -> int:
        """Put the files of runs that have closed before a moment, and of their collectors' skips before it, into one table; returns how many files went.
        The new part holds all that the old one did, and is in force once the next numbered file names it; only then are files deleted, so a crash leaves
        events twice at most, which their records don't show. A run that is open stays a file."""
        events = self.events().withColumn("file", F.input_file_name())
        done = events.filter((F.col("event") == CLOSED) & (F.col("at") < F.lit(before.astimezone(UTC).isoformat()).cast("timestamp"))).select(*RUN).distinct().withColumn("done", F.lit(True))
        open_ = self.records().filter("finished_at is null").select("tenant_id", "collector").distinct().withColumn("open", F.lit(True))
        marked = events.join(done, RUN, "left").join(open_, ["tenant_id", "collector"], "left")
        old = F.col("file").contains("/packed/parts/")
        # a skip counts against the run that is open: while there is one, its collector's skips stay
        settled = F.col("open").isNull() & (F.col("event") == SKIPPED) & (F.col("at") < F.lit(before.astimezone(UTC).isoformat()).cast("timestamp"))
        chosen = marked.filter(old | F.col("done") | settled)
        gone = [r.file for r in chosen.filter(~old).select("file").distinct().collect()]  # the files of one interval
        if not gone:
            return 0
        part, turn = uuid.uuid4().hex, self.files.last_number("packed/log") + 1
        chosen.select(*[f.name for f in EVENT.fields]).dropDuplicates(["event_id"]).coalesce(1).write.parquet(self.files.at(f"packed/parts/{part}"))
        if not self.files.put_if_absent(f"packed/log/{numbered(turn)}", {"part": part}):
            self.files.delete(f"packed/parts/{part}")
            return 0  # another process packs
        for name in gone:
            self.files.delete("events" + unquote(name).partition("/events")[2])
        return len(gone)

    def records(self) -> DataFrame:
        return folded(self.events())

    def rejects(self) -> DataFrame:
        """Rejected rows of all runs with a record, beside their run's names."""
        schema = T.StructType([*[T.StructField(c, T.StringType()) for c in (*KEY, "provider_id")], T.StructField("position", T.LongType()), T.StructField("problem", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("tenant", "collector", "run")]])
        if not self.files.exists("rejects"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.files.at("rejects"))
