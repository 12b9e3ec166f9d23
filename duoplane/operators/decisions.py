"""What a reconciliation run keeps, replaces and invalidates of the stored matches and discrepancies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import ComparisonSchema
from ..model import CONFIRMED, INVALIDATED, KEY, OPEN, PROPOSED, REJECTED
from .diffing import as_open_rows, reconcile
from .matching import MatchResult, match_resources

ANCHOR = [*KEY, "provider_id"]


def decisions_of(matches: DataFrame) -> DataFrame:
    """Human decisions among the stored matches."""
    return matches.filter(F.col("state").isin(CONFIRMED, REJECTED)).select(*ANCHOR, (F.col("state") == CONFIRMED).alias("is_confirmed"))


def anchored(decisions: DataFrame) -> DataFrame:
    """Decisions, whose use fails where one names no provider id: it could never be found again."""
    named = F.when(F.col("provider_id").isNull(), F.raise_error(F.concat(F.lit("a decision without provider id: "), F.concat_ws("/", *KEY))).cast("boolean")).otherwise(True)
    return decisions.filter(named)


def invalidate_unanchored(matches: DataFrame, declared: DataFrame, discovered: DataFrame) -> DataFrame:
    """Stored matches; human decisions whose declared key or provider id is gone become invalidated, for good."""
    here = declared.select(*KEY).distinct().withColumn("_d", F.lit(True))
    there = discovered.filter("provider_id is not null").select("tenant_id", "provider_id").distinct().withColumn("_p", F.lit(True))
    joined = matches.join(here, KEY, "left").join(there, ["tenant_id", "provider_id"], "left")
    gone = F.col("state").isin(CONFIRMED, REJECTED) & (F.col("_d").isNull() | F.col("_p").isNull())
    return joined.withColumn("state", F.when(gone, INVALIDATED).otherwise(F.col("state"))).select(*matches.columns)


def proposals(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """Pairs to be proposed: those of whose declared key or discovered provider id no active decision holds."""
    active = matches.filter(F.col("state") == CONFIRMED)
    free = pairs.join(active.select(*KEY), KEY, "left_anti")
    free = free.join(active.filter("provider_id is not null").select("tenant_id", "provider_id"), ["tenant_id", "provider_id"], "left_anti")
    return free.select(*ANCHOR, "strategy", "confidence").withColumn("state", F.lit(PROPOSED))


def rewrite(declared: DataFrame, discovered: DataFrame, matches: DataFrame, discrepancies: DataFrame, schema: ComparisonSchema | None = None) -> tuple[DataFrame, DataFrame, MatchResult]:
    """Matches and discrepancies after a run: proposals and open rows are replaced, what people decided stays.

    matches: ANCHOR, strategy, confidence, state; discrepancies: the columns of ``as_open_rows``."""
    result = match_resources(declared, discovered, decisions_of(matches))
    kept = invalidate_unanchored(matches.filter(F.col("state") != PROPOSED), declared, discovered)
    new_matches = kept.unionByName(proposals(result.pairs, kept))
    fresh = as_open_rows(reconcile(result, schema))
    new_discrepancies = discrepancies.filter(F.col("state") != OPEN).unionByName(fresh)
    return new_matches, new_discrepancies, result
