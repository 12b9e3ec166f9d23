"""Precedence of planes and the lifecycle of discrepancies between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import INVALIDATED, KEY, MUTED, OPEN, RESOLVED, SUPPRESSED

#: What names the same discrepancy in every run; both kinds of orphan of a key are told apart by the type alone.
IDENTITY = [*KEY, "discrepancy_type", "field_name"]
TERMINAL = (INVALIDATED, MUTED)
VALUES = ["declared_value", "discovered_value"]


def _decided(joined: DataFrame) -> DataFrame:
    wins = F.when(F.col("operator") == "declared", F.col("declared_value")).when(F.col("operator") == "discovered", F.col("discovered_value"))
    return joined.withColumns({"winning_value": wins, "undecidable": F.col("operator").isNull()}).drop("operator")


def with_precedence(discrepancies: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule_id, winning_value and undecidable from rules (rule_id, kind, field_name, operator: declared or
    discovered), one for a kind and field at most; without a rule nothing wins."""
    return _decided(discrepancies.join(rules.select("rule_id", "kind", "field_name", "operator"), ["kind", "field_name"], "left"))


def by_recorded_rule(discrepancies: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds winning_value and undecidable by the rule whose ``rule_id`` a discrepancy carries, in force or not: what was
    decided then. A rule that isn't there, or none, decides nothing."""
    return _decided(discrepancies.join(rules.select("rule_id", "operator"), "rule_id", "left"))


def sides_left(rows: DataFrame, declared: DataFrame, discovered: DataFrame) -> DataFrame:
    """Adds declared_gone and discovered_absent: is a row's key missing from the declared plane, from the present
    discovered one?"""
    here, there = (side.select(*KEY, F.lit(True).alias(c)).distinct() for side, c in ((declared, "here"), (discovered, "there")))
    joined = rows.join(here, KEY, "left").join(there, KEY, "left")
    return joined.withColumns({"declared_gone": F.col("here").isNull(), "discovered_absent": F.col("there").isNull()}).drop("here", "there")


def next_states(existing: DataFrame, detected: DataFrame, declared: DataFrame, discovered: DataFrame, now: Column) -> DataFrame:
    """Discrepancies after a run: IDENTITY, state, expires_at, values, transition (from>to, NULL if there is none).

    existing: IDENTITY, state, expires_at, values; detected: IDENTITY, values; the planes that were compared, the
    discovered one without absent rows. What is found again: a resolved row opens; a suppressed one keeps its state and
    date with new values, which is recorded, until it has expired (never, without a date). An open row that isn't found closes
    when a side that it is about is gone: as invalidated without its declared side, as muted without its discovered side
    (a missing one has none, nor has an undeclared one a declared side); else it stays open. Invalidated and muted rows
    are history: they stay, and what is found again opens a row beside them.
    """
    ended = existing.filter(F.col("state").isin(*TERMINAL))
    active = sides_left(existing.filter(~F.col("state").isin(*TERMINAL)), declared, discovered)
    e, d = active.withColumn("known", F.lit(True)).alias("e"), detected.withColumn("found", F.lit(True)).alias("d")
    both = e.join(d, [F.col(f"e.{c}").eqNullSafe(F.col(f"d.{c}")) for c in IDENTITY], "full_outer")
    old, found, known = F.col("e.state"), F.col("d.found").isNotNull(), F.col("e.known").isNotNull()
    expired = F.coalesce(F.col("e.expires_at") < now, F.lit(False))
    kind = F.col("e.discrepancy_type")
    state = (
        F.when(~known, OPEN)
        .when(found & (old == SUPPRESSED) & ~expired, SUPPRESSED)
        .when(found, OPEN)
        .when((old == OPEN) & F.col("e.declared_gone") & (kind != "discovered_undeclared"), INVALIDATED)
        .when((old == OPEN) & F.col("e.discovered_absent") & (kind != "declared_missing"), MUTED)
        .otherwise(old)
    )
    moved = ~known | (old != state) | (found & (old == SUPPRESSED))
    after = both.select(
        *[F.coalesce(F.col(f"e.{c}"), F.col(f"d.{c}")).alias(c) for c in IDENTITY], state.alias("state"), F.col("e.expires_at").alias("expires_at"),
        *[F.when(found, F.col(f"d.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in VALUES],
        F.when(moved, F.concat_ws(">", F.coalesce(old, F.lit("none")), state)).alias("transition"),
    )
    return after.unionByName(ended.select(*IDENTITY, "state", "expires_at", *VALUES, F.lit(None).cast("string").alias("transition")))


def transitions(after: DataFrame, run_id: str, now: Column, actor: str = "system") -> DataFrame:
    """What a run adds to the history: IDENTITY, run_id, from_state, to_state, actor, at, expires_at and the values then."""
    way = F.split("transition", ">")
    return after.filter("transition is not null").select(*IDENTITY, F.lit(run_id).alias("run_id"), way[0].alias("from_state"), way[1].alias("to_state"), F.lit(actor).alias("actor"), now.alias("at"), "expires_at", *VALUES)


def append_transitions(rows: DataFrame, path: str) -> None:
    """Add a run's transitions to the history at ``path``, which is never pruned. A run that is written again replaces its own
    rows only."""
    rows.write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def retained(rows: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Rows that retention keeps: open ones, and others that have been in their state for up to ``days``."""
    old = F.coalesce(F.col("state_since") < now - F.expr(f"interval {int(days)} days"), F.lit(False))
    return rows.filter((F.col("state") == OPEN) | ~old)


def resolve(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with those listed in ``ids`` (discrepancy_id) resolved, whatever their state was."""
    hit = rows.join(ids.select("discrepancy_id").distinct().withColumn("_hit", F.lit(True)), "discrepancy_id", "left")
    return hit.withColumn("state", F.when(F.col("_hit"), RESOLVED).otherwise(F.col("state"))).select(*rows.columns)
