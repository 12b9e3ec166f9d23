"""Pages of the stored planes and queues, with a total order so that pages never overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 50


def plane(name: str, declared: DataFrame, discovered: DataFrame) -> DataFrame:
    """The plane that a reader names: the declared one, or for every other name the discovered one, absent rows included."""
    return declared if name == "declared" else discovered


def resources_page(plane: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    return plane.orderBy("scope", "name", "kind", "tenant_id").offset(offset).limit(limit)


def discrepancies_page(rows: DataFrame, state: str, offset: int = 0, limit: int = PAGE) -> DataFrame:
    order = ["kind", "scope", "name", F.asc_nulls_last("field_name"), "tenant_id", "discrepancy_type"]
    return rows.filter(F.col("state") == state).orderBy(*order).offset(offset).limit(limit)


def serialised(rows: DataFrame) -> DataFrame:
    """Each side as struct(present, value)."""
    sides = [F.struct(F.col(f"{s}_present").alias("present"), F.col(f"{s}_value").alias("value")).alias(s) for s in ("declared", "discovered")]
    return rows.select(*[c for c in rows.columns if not c.endswith(("_present", "_value"))], *sides)
