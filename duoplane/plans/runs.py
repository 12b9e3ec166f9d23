"""Whole runs: a reconciliation that is published or leaves no trace, a collection, and the tasks that a schedule calls."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.config import ComparisonSchema
from ..model import ATTRIBUTES, KEY, OPEN
from ..operators import decisions, discovery, lifecycle
from ..operators.constraints import DISCREPANCY_RULES, MATCH_RULES, STATE_RULES
from ..operators.diffing import COLUMNS
from ..operators.matching import of_tenant, present
from ..operators.revisions import committed_plane
from ..sources.recorded import ProviderUnavailable
from ..storage.estate import Estate, EstateConflict, Snapshot
from ..storage.lease import LeaseLost, Leases
from ..storage.runlog import RunLog

log = logging.getLogger(__name__)

MATCHES = ", ".join([*(f"{c} string" for c in decisions.ANCHOR), "strategy string", "confidence string", "state string"])
DISCREPANCIES = ", ".join(f"{c} {'boolean' if c.endswith('present') else 'string'}" for c in [*COLUMNS, "authoritative_plane", "state"])
#: How often a run starts anew from what another publication left.
ATTEMPTS = 3


def changes(before: DataFrame, after: DataFrame, run_id: str, at: Column) -> DataFrame:
    """What a run adds to the history of open discrepancies: those that it opened, closed, or found with other values."""
    was, now = (rows.filter(F.col("state") == OPEN).select(*lifecycle.IDENTITY, *lifecycle.VALUES, F.lit(True).alias("there")) for rows in (before, after))
    both = was.alias("w").join(now.alias("n"), [F.col(f"w.{c}").eqNullSafe(F.col(f"n.{c}")) for c in lifecycle.IDENTITY], "full_outer")
    old, new = F.col("w.there").isNotNull(), F.col("n.there").isNotNull()
    same = old & new
    for c in lifecycle.VALUES:
        same = same & F.col(f"w.{c}").eqNullSafe(F.col(f"n.{c}"))
    return both.filter(~same).select(
        F.lit(run_id).alias("run_id"), *[F.coalesce(f"w.{c}", f"n.{c}").alias(c) for c in lifecycle.IDENTITY],
        F.when(old, OPEN).otherwise("none").alias("from_state"), F.when(new, OPEN).otherwise("gone").alias("to_state"), at.alias("at"),
        *[F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"w.{c}")).alias(c) for c in lifecycle.VALUES],
    )


def seed(estate: Estate, matches: DataFrame, discrepancies: DataFrame, run_id: str = "seed") -> Snapshot:
    """Publish stored matches and discrepancies, as people and earlier runs have left them."""
    columns = [c.split()[0] for c in DISCREPANCIES.split(", ")]
    tables = {"matches": matches.select(*[c.split()[0] for c in MATCHES.split(", ")]), "discrepancies": discrepancies.select(*columns)}
    return estate.publish(estate.snapshot(), tables, run_id, rules={"matches": MATCH_RULES, "discrepancies": DISCREPANCY_RULES})


def reconcile_estate(estate: Estate, leases: Leases, planes: Callable[[], tuple[DataFrame, DataFrame]], run_id: str, at: Column, holder: str = "", seconds: float = 3600, schema: ComparisonSchema | None = None) -> bool:
    """One reconciliation of the estate's tenant: matches, discrepancies and their history are published together. False, and
    nothing is written, where another run of the tenant is at it.

    ``planes`` gives the tenant's declared and discovered plane (rows of others are left out) as they are when the run has its
    lease. A publication by someone else in the meantime (a decision, say) starts the run anew from that; one that breaks a
    rule, or comes too late for its lease, raises.
    """
    lease = leases.acquire(f"reconcile-{estate.tenant_id}", holder or uuid.uuid4().hex, seconds)
    if lease is None:
        log.info("a reconciliation of %s is under way", estate.tenant_id)
        return False
    with lease:
        for left in reversed(range(ATTEMPTS)):
            base = estate.seal(lease)
            declared, discovered = (of_tenant(p, estate.tenant_id) for p in planes())
            before = base.read("discrepancies", DISCREPANCIES)
            matches, discrepancies, _ = decisions.rewrite(declared, present(discovered), base.read("matches", MATCHES), before, schema)
            tables = {"matches": matches, "discrepancies": discrepancies}
            try:
                published = estate.publish(base, tables, run_id, lease, {"matches": MATCH_RULES, "discrepancies": DISCREPANCY_RULES}, {"history": changes(before, discrepancies, run_id, at)})
            except EstateConflict:
                if not left:
                    raise
                continue
            log.info("%s published version %s", run_id, published.version)
            return True
    return False


STATE = f"{', '.join(f'{c} string' for c in [*KEY, 'provider_id'])}, attributes {ATTRIBUTES.simpleString()}, last_seen_run string, collector string, is_absent boolean, absent_since timestamp"


def _unavailable(why: BaseException | None) -> bool:
    """Did the read fail on the driver because the provider is unavailable? (In a task, its reader says so in a row.)"""
    seen: set[int] = set()
    while why is not None and id(why) not in seen:
        if isinstance(why, ProviderUnavailable):
            return True
        seen.add(id(why))
        why = why.__cause__ or why.__context__
    return False


def run_collector(estate: Estate, runs: RunLog, leases: Leases, kinds: DataFrame, read: Callable[[], DataFrame], kind: str, run_id: str, collector: str, at: datetime, seconds: float = 3600) -> Row | None:
    """One run of a collector against the estate's ``discovered`` table: its closed record. None where another run of the collector is under
    way; that is counted as a skip of the run in flight.

    ``read`` gives normalised rows (position, KEY, provider_id, attributes, problem; a NULL position for each chain of
    pages that broke). The run is recorded as opened, which counts as failed, before anything is read; the provider is read once,
    into the log's folder; of rows with one key the last position wins; rejected rows (of an unknown kind, too) are stored;
    then the state is published, and last the record is closed. A provider of which nothing could be read fails the run and
    leaves the state alone; other failures are raised, and leave the record as it was opened.
    """
    tenant_id, spark = estate.tenant_id, estate.spark
    lease = leases.acquire(f"collect-{tenant_id}-{collector}", run_id, seconds)
    if lease is None:
        runs.skip(tenant_id, collector, at)
        return None
    with lease:
        runs.open(tenant_id, collector, run_id, at)
        try:
            fetched = read()
        except Exception as why:
            if not _unavailable(why):
                raise
            runs.close(tenant_id, collector, run_id, at, reachable=False, why=str(why))
            return _record(runs, tenant_id, collector, run_id)
        path = runs.files.at(f"fetched/{tenant_id}/{collector}/{run_id}")
        fetched.write.parquet(path)
        there = spark.read.schema(fetched.schema).parquet(path).join(kinds.select("kind").distinct().withColumn("known", F.lit(True)), "kind", "left")
        fine = F.col("position").isNotNull() & F.col("problem").isNull()
        problem = F.when(fine & ~F.col("kind").eqNullSafe(kind), discovery.foreign(kind)).when(fine & F.col("known").isNull(), "unknown kind").otherwise(F.col("problem"))
        rows = there.withColumn("problem", problem).drop("known")
        nothing = F.when(F.col("position").isNull(), F.col("problem"))
        n = rows.agg(F.count("position").alias("read"), F.count_if(fine).alias("written"), F.count_if(F.col("position").isNull()).alias("gaps"), F.min(nothing).alias("why")).first()
        if n.why is not None and not n.read:
            runs.close(tenant_id, collector, run_id, at, reachable=False, why=n.why)
            return _record(runs, tenant_id, collector, run_id)
        runs.store_rejects(rows.filter("position is not null and problem is not null").select(*KEY, "provider_id", "position", "problem"), tenant_id, collector, run_id)
        kept = discovery.latest(rows.filter(fine).select(*KEY, "position", "provider_id", "attributes"), KEY, [F.col("position")]).drop("position")
        entitled = n.read == n.written and not n.gaps
        now = F.lit(at.astimezone(UTC).isoformat()).cast("timestamp")
        for left in reversed(range(ATTEMPTS)):
            base = estate.seal(lease)
            state = discovery.merge_run(base.read("discovered", STATE), kept, F.lit(run_id), F.lit(collector), F.lit(entitled), now)
            try:
                estate.publish(base, {"discovered": state}, run_id, lease, {"discovered": STATE_RULES})
                break
            except EstateConflict:
                if not left:
                    raise
        runs.close(tenant_id, collector, run_id, at, records_read=n.read, records_written=n.written, has_gap=n.gaps > 0, why=n.why)
        return _record(runs, tenant_id, collector, run_id)


def _record(runs: RunLog, tenant_id: str, collector: str, run_id: str) -> Row:
    return runs.records().filter((F.col("tenant_id") == tenant_id) & (F.col("collector") == collector) & (F.col("run_id") == run_id)).first()


def planes_of(estate: Estate, store: str) -> tuple[DataFrame, DataFrame]:
    """The tenant's declared plane (its active revision at ``store``; empty without one) and its discovered one."""
    declared = committed_plane(estate.spark, store, estate.tenant_id)
    discovered = estate.snapshot().read("discovered", STATE)
    return (discovered.limit(0).select(*KEY, "provider_id", "attributes") if declared is None else declared), discovered


@dataclass
class Task:
    """Something that a schedule calls: it never raises. What goes wrong is logged, and the next call tries again; a task without
    work (``work`` None) does nothing."""

    name: str
    work: Callable[[], object] | None

    def __call__(self) -> object | None:
        if self.work is None:
            log.info("%s is not configured", self.name)
            return None
        try:
            found = self.work()
        except LeaseLost:
            log.warning("%s was overtaken and wrote nothing", self.name, exc_info=True)
            return None
        except Exception:
            log.exception("%s failed; the schedule goes on", self.name)
            return None
        if found is None:
            log.info("%s had nothing to do", self.name)
        return found


def on_schedule(spark: SparkSession, task: Task, interval: str, checkpoint: str) -> StreamingQuery:
    """Call a task at every trigger of a stream (``interval``, say "300 seconds"), one call at a time: a call that takes longer delays the next. It goes
    on until the query is stopped, whatever a call does."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return ticks.writeStream.queryName(task.name).option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(lambda _, __: task() and None).start()
