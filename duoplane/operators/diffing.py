"""Typed discrepancies of matched pairs and orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compare
from ..functions.config import ComparisonSchema
from ..model import DECLARED, DECLARED_MISSING, DISCOVERED_UNDECLARED, FIELD, KEY, OPEN, VALUE
from .matching import MatchResult

COLUMNS = ["discrepancy_type", *KEY, "field_name", "declared_present", "declared_value", "discovered_present", "discovered_value"]


def attribute_pairs(pairs: DataFrame) -> DataFrame:
    """One row for each attribute that either side of a pair has: KEY, field_name, l, r (NULL where absent). Narrow: the
    pair holds both maps already."""
    both = F.map_zip_with("declared", "discovered", lambda _, l, r: F.struct(l.alias("l"), r.alias("r")))
    return pairs.select(*KEY, F.explode(both).alias("field_name", "v")).select(*KEY, "field_name", "v.l", "v.r")


def field_discrepancies(pairs: DataFrame, schema: ComparisonSchema | None = None) -> DataFrame:
    """Attributes on which a pair's sides differ: by canonical form, or as a comparison schema says."""
    rows = attribute_pairs(pairs)
    left, right = F.col("l"), F.col("r")
    agree: Column = compare.same(left, right) if schema is None else compare.agree_by_schema(F.col("kind"), F.col("field_name"), left, right, schema)
    return rows.filter(~agree).select(
        F.lit(FIELD).alias("discrepancy_type"), *KEY, "field_name",
        left.isNotNull().alias("declared_present"), left["canon"].alias("declared_value"), right.isNotNull().alias("discovered_present"), right["canon"].alias("discovered_value"),
    )


def orphan_discrepancies(side: DataFrame, kind: str) -> DataFrame:
    none = {"field_name": "string", "declared_present": "boolean", "declared_value": "string", "discovered_present": "boolean", "discovered_value": "string"}
    return side.select(F.lit(kind).alias("discrepancy_type"), *KEY, *[F.lit(None).cast(t).alias(c) for c, t in none.items()])


def reconcile(result: MatchResult, schema: ComparisonSchema | None = None) -> DataFrame:
    """All discrepancies of a match result, in one pass over its rows: an orphan is a row with one entry and no field."""
    here, there = F.col("declared").isNotNull(), F.col("discovered").isNotNull()
    both = F.map_zip_with("declared", "discovered", lambda _, l, r: F.struct(l.alias("l"), r.alias("r")))
    entries = F.transform(F.map_entries(both), lambda e: F.struct(F.lit(FIELD).alias("type"), e["key"].alias("field_name"), e["value"]["l"].alias("l"), e["value"]["r"].alias("r")))
    none = F.lit(None).cast(VALUE)
    orphan = F.array(F.struct(F.when(here, DECLARED_MISSING).otherwise(DISCOVERED_UNDECLARED).alias("type"), F.lit(None).cast("string").alias("field_name"), none.alias("l"), none.alias("r")))
    keys = [F.coalesce(k, f"discovered_{k}").alias(k) for k in KEY]
    rows = result.rows.select(*keys, F.explode(F.when(here & there, entries).otherwise(orphan)).alias("e")).select(*KEY, "e.*")
    left, right, is_field = F.col("l"), F.col("r"), F.col("type") == FIELD
    agree: Column = compare.same(left, right) if schema is None else compare.agree_by_schema(F.col("kind"), F.col("field_name"), left, right, schema)
    stated = [F.when(is_field, left.isNotNull()).alias("declared_present"), left["canon"].alias("declared_value"), F.when(is_field, right.isNotNull()).alias("discovered_present"), right["canon"].alias("discovered_value")]
    return rows.filter(~is_field | ~agree).select(F.col("type").alias("discrepancy_type"), *KEY, "field_name", *stated)


def audit(pairs: DataFrame, schema: ComparisonSchema, every: int = 100) -> DataFrame:
    """The comparisons that the fields' logging levels keep: KEY, field_name, logging, agree, declared_value,
    discovered_value. debug: all; discrepancy: those that differ; sampled: one in ``every``, chosen by a hash of key and
    field, so that a rerun keeps the same. A field without settings is kept at level error, as a discrepancy."""
    rows = attribute_pairs(pairs)
    agree = compare.agree_by_schema(F.col("kind"), F.col("field_name"), F.col("l"), F.col("r"), schema)
    level = F.lit("error")
    for (kind, field), config in schema.fields.items():
        level = F.when((F.col("kind") == kind) & (F.col("field_name") == field), config.logging).otherwise(level)
    rows = rows.select(*KEY, "field_name", level.alias("logging"), agree.alias("agree"), F.col("l")["canon"].alias("declared_value"), F.col("r")["canon"].alias("discovered_value"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("/", *KEY, "field_name").cast("binary")), 1, 8), 16, 10).cast("long") % every
    return rows.filter((F.col("logging") == "debug") | (F.col("logging").isin("discrepancy", "error") & ~F.col("agree")) | ((F.col("logging") == "sampled") & (draw == 0)))


def as_open_rows(discrepancies: DataFrame) -> DataFrame:
    """Stored form: state open, the declared plane authoritative."""
    return discrepancies.withColumns({"authoritative_plane": F.lit(DECLARED), "state": F.lit(OPEN)})


def plane_text(present: Column, shown: Column) -> Column:
    """What a review shows of one side: undetermined, not stated, or the value (null in words)."""
    return F.when(present.isNull(), "—").when(~present, "not stated").otherwise(F.coalesce(shown, F.lit("null")))
