"""Runs of collectors: counters and status, latest state by key, and absence that only a complete run may infer."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import FAILED, KEY, PARTIAL, SUCCESS


def run_status(errors: Column, has_gap: Column, reachable: Column | None = None) -> Column:
    status = F.when((errors > 0) | has_gap, PARTIAL).otherwise(SUCCESS)
    return status if reachable is None else F.when(~reachable, FAILED).otherwise(status)


def run_statistics(records: DataFrame, run: str, accepted: Column, gap: Column) -> DataFrame:
    """For each run: records_read, records_written, errors (read = written + errors), has_gap, status."""
    counted = records.groupBy(run).agg(F.count("*").alias("records_read"), F.count_if(accepted).alias("records_written"), F.bool_or(gap).alias("has_gap"))
    counted = counted.withColumn("errors", F.col("records_read") - F.col("records_written"))
    return counted.withColumn("status", run_status(F.col("errors"), F.col("has_gap")))


def may_infer_absence(status: Column, has_gap: Column) -> Column:
    return (status == SUCCESS) & ~has_gap


def unknown_kinds(records: DataFrame, kinds: DataFrame) -> DataFrame:
    """Records whose kind isn't in the kind table."""
    return records.join(kinds.select("kind"), "kind", "left_anti")


def foreign(kind: str) -> Column:
    """Fails the use of a row of another kind than the collector's."""
    return F.raise_error(F.concat(F.lit(f"a collector of {kind} gave "), F.coalesce("kind", F.lit("no kind"))))


def of_collector(records: DataFrame, kind: str) -> DataFrame:
    """Records of a collector's one kind; a record of another kind fails the read, as the collector is wrong then."""
    return records.filter(F.when(F.col("kind").eqNullSafe(kind), True).otherwise(foreign(kind).cast("boolean")))


def seeded(kinds: DataFrame, seeds: DataFrame) -> DataFrame:
    """The kind table (kind, schema) with those of ``seeds`` that it lacks; what it has stays as it is."""
    return kinds.select("kind", "schema").unionByName(seeds.select("kind", "schema").join(kinds, "kind", "left_anti"))


def unseeded(kinds: DataFrame, seeds: DataFrame) -> DataFrame:
    return kinds.join(seeds.select("kind"), "kind", "left_anti")


def latest(records: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last record of each key (last write wins); aggregates before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in records.columns if c not in keys]
    last = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def merge_run(state: DataFrame, seen: DataFrame, run_id: Column, collector: Column, entitled: Column, now: Column) -> DataFrame:
    """State after a run, as one full outer join.

    state: KEY, provider_id, attributes, last_seen_run, collector, is_absent, absent_since; seen: KEY, provider_id,
    attributes, of this run's collector. A seen row is present; a row that the collector owns and did not see is absent
    if the run is entitled to say so, since the first run that missed it; others stay.
    """
    old, new = state.alias("o"), seen.withColumn("_seen", F.lit(True)).alias("n")
    joined = old.join(new, KEY, "full_outer")
    got = F.coalesce(F.col("n._seen"), F.lit(False))
    missed = ~got & entitled & (F.col("o.collector") == collector)
    was = F.coalesce(F.col("o.is_absent"), F.lit(False))
    pick = lambda c: F.when(got, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return joined.select(
        *KEY, pick("provider_id"), pick("attributes"),
        F.when(got, run_id).otherwise(F.col("o.last_seen_run")).alias("last_seen_run"),
        F.when(got, collector).otherwise(F.col("o.collector")).alias("collector"),
        F.when(got, F.lit(False)).when(missed, F.lit(True)).otherwise(was).alias("is_absent"),
        F.when(got, F.lit(None)).when(missed & ~was, now).otherwise(F.col("o.absent_since")).cast("timestamp").alias("absent_since"),
    )


def newly_absent(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows a run marked absent, by kind: kind, n."""
    was = before.filter("is_absent").select(*KEY)
    return after.filter("is_absent").select(*KEY).join(was, KEY, "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


def absences(seen: DataFrame, runs: DataFrame, entity: str) -> DataFrame:
    """Every absence of an entity: entity, last_seen, absent_since (the run that first missed it and was entitled to say so),
    refuted_by (the run that saw it again, NULL while it is absent).

    ``seen``: entity, run; ``runs``: run, entitled, one row for each run of a collector. Between two sightings, absence begins
    at the first entitled run after the former, which depends on that run alone: one join of sightings and runs, and one
    window over an entity's own sightings.
    """
    # one row a run, of one collector: this order is the one thing here that a single task sees
    later = Window.orderBy("run").rowsBetween(1, Window.unboundedFollowing)
    onward = runs.select(F.col("run").alias("last_seen"), F.min(F.when(F.col("entitled"), F.col("run"))).over(later).alias("absent_since"))
    mine = Window.partitionBy(entity).orderBy("last_seen")
    sightings = seen.select(entity, F.col("run").alias("last_seen")).distinct().withColumn("refuted_by", F.lead("last_seen").over(mine))
    return sightings.join(onward, "last_seen").filter("absent_since is not null and (refuted_by is null or absent_since < refuted_by)").select(entity, "last_seen", "absent_since", "refuted_by")


# ------------------------------------------------------------------------------------------------------ run records

RUN = ["tenant_id", "collector", "run_id"]


def opened(attempts: DataFrame) -> DataFrame:
    """Run records as they are opened, before anything is read: failed until a run closes, so that none is ever lost.
    attempts: RUN, started_at."""
    return attempts.select(*RUN, "started_at", F.lit(FAILED).alias("status"), *[F.lit(0).cast("long").alias(c) for c in ("records_read", "records_written", "errors")], F.lit(False).alias("has_gap"), F.lit(None).cast("timestamp").alias("finished_at"))


def closed(records: DataFrame, counts: DataFrame) -> DataFrame:
    """Run records with the counts of those that ended (counts: RUN, records_read, records_written, has_gap, reachable,
    finished_at). An unreachable provider fails the run, errors or a gap make it partial; a run without counts stays as
    it was opened."""
    found = counts.select(*RUN, *[F.col(c).alias(f"new_{c}") for c in ("records_read", "records_written", "has_gap", "reachable", "finished_at")])
    joined = records.join(found, RUN, "left")
    ended, errors = F.col("new_finished_at").isNotNull(), F.col("new_records_read") - F.col("new_records_written")
    new = {"records_read": F.col("new_records_read"), "records_written": F.col("new_records_written"), "errors": errors, "has_gap": F.col("new_has_gap"), "finished_at": F.col("new_finished_at"), "status": run_status(errors, F.col("new_has_gap"), F.col("new_reachable"))}
    return joined.select(*[F.when(ended, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in records.columns])


def in_flight(records: DataFrame) -> DataFrame:
    """The latest unfinished run of each collector."""
    return latest(records.filter("finished_at is null"), ["tenant_id", "collector"], [F.col("started_at"), F.col("run_id")])


def count_skips(records: DataFrame, skips: DataFrame) -> DataFrame:
    """Run records with skipped_attempts: skip events (tenant_id, collector) count against the run in flight. Skips are only
    appended, so two of them at a time are both counted."""
    counted = skips.groupBy("tenant_id", "collector").agg(F.count("*").alias("skips")).join(in_flight(records).select(*RUN), ["tenant_id", "collector"])
    return records.join(counted, RUN, "left").withColumn("skipped_attempts", F.coalesce("skips", F.lit(0)).cast("long")).drop("skips")


#: Run lengths of a collector's history that one task goes through.
SPAN = 64
_MICROS = 1_000_000


def _started(table: pa.Table, at: str, keys: list[str]) -> pa.Table:
    """Attempts with a time, in order: by time, then by whatever else tells them apart."""
    rest = [f.name for f in table.schema if f.name not in (at, *keys) and not pa.types.is_nested(f.type)]
    return table.sort_by([(c, "ascending") for c in (at, *rest)])


def admitted(attempts: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """``attempts`` with ``ran``: does an attempt find no run of its collector in flight? A run takes ``seconds``; one that
    doesn't start holds nothing back. An attempt without a time never runs.

    What an attempt finds depends on all before it. But a run ends within ``seconds``, so all that a stretch of history hands on
    is when its last run ends, and that depends on which of its first attempts is the first to run. So stretches of ``SPAN`` run lengths
    are summed up apart, as steps from the time at which the collector is free to the time at which it is free again; a collector's steps, few for
    each stretch as chains of runs soon meet, are put together in order; then every stretch is gone through from its own start. No task
    sees a whole history.
    """
    width = seconds * _MICROS
    names = [f.name for f in attempts.schema.fields]
    micros, block = "_at_micros", "_block"
    timed = attempts.withColumn(micros, F.unix_micros(F.col(at).cast("timestamp"))).withColumn(block, F.floor(F.col(micros) / (width * SPAN)))
    like = [attempts.schema[k] for k in keys]

    def steps(key: tuple, table: pa.Table) -> pa.Table:
        t = np.sort(table.column(micros).to_numpy())
        begin = key[-1].as_py() * width * SPAN
        onward = np.searchsorted(t, t + width)
        free = t + width
        for i in range(len(t) - 1, -1, -1):  # free again after the block, if the ith attempt is the first to run
            if onward[i] < len(t):
                free[i] = free[onward[i]]
        first = min(len(t), int(np.searchsorted(t, begin + width)) + 1)  # none after it can be the first
        last = np.flatnonzero(np.append(free[1:first] != free[: first - 1], True))
        columns = [pa.array([k.as_py()], k.type) for k in key] + [pa.array([t[:first][last].tolist()], pa.list_(pa.int64())), pa.array([free[:first][last].tolist()], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, [*keys, block, "until", "free"])

    def chain(key: tuple, table: pa.Table) -> pa.Table:
        table, free, entries = table.sort_by(block), -(2**62), []
        for until, then in zip(table.column("until").to_pylist(), table.column("free").to_pylist(), strict=True):
            entries.append(free)
            i = bisect.bisect_left(until, free)
            free = then[i] if i < len(until) else free
        return table.select([*keys, block]).append_column("entry", pa.array(entries, pa.int64()))

    def walk(key: tuple, table: pa.Table, entries: pa.Table) -> pa.Table:
        table = _started(table, at, keys)
        free, ran = entries.column("entry")[0].as_py() if len(entries) else 2**62, []
        for start in table.column(micros).to_pylist():
            ran.append(start is not None and start >= free)
            if ran[-1]:
                free = start + width
        return table.select(names).append_column("ran", pa.array(ran, pa.bool_()))

    stepped = timed.filter(F.col(micros).isNotNull()).select(*keys, block, micros).groupBy(*keys, block).applyInArrow(steps, T.StructType([*like, T.StructField(block, T.LongType()), T.StructField("until", T.ArrayType(T.LongType())), T.StructField("free", T.ArrayType(T.LongType()))]))
    entries = stepped.groupBy(*keys).applyInArrow(chain, T.StructType([*like, T.StructField(block, T.LongType()), T.StructField("entry", T.LongType())]))
    return timed.groupBy(*keys, block).cogroup(entries.groupBy(*keys, block)).applyInArrow(walk, T.StructType([*attempts.schema.fields, T.StructField("ran", T.BooleanType())]))
