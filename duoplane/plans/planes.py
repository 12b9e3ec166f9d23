"""Planes with deterministic drift, derived from the test tables, and the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import attributes, int_value, null_value, str_value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(key: Column) -> list[Column]:
    return [F.lit("Part").alias("kind"), F.lit("t").alias("tenant_id"), F.col("p_brand").alias("scope"), F.concat(F.lit("part-"), key.cast("string")).alias("name")]


def part_keys() -> list[Column]:
    return _part(F.col("p_partkey"))


def part_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand. Every eleventh isn't declared: that is the drift that a reconciliation is to find, as are those below."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").filter(k % 11 != 0)
    return rows.select(*_part(k), F.lit(None).cast("string").alias("provider_id"), attributes(size=int_value(F.col("p_size")), type=str_value(F.col("p_type"))).alias("attributes"))


def part_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventeenth isn't discovered; sizes are null or one more at times, every fifth has no type."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").filter(k % 17 != 0)
    size = F.when(k % 13 == 0, null_value()).when(k % 7 == 0, int_value(F.col("p_size") + 1)).otherwise(int_value(F.col("p_size")))
    kind = F.when(k % 5 != 0, str_value(F.col("p_type")))
    return rows.select(*_part(k), F.concat(F.lit("id-"), k.cast("string")).alias("provider_id"), attributes(size=size, type=kind).alias("attributes"))


PART_SQL = """
dec AS (SELECT p_brand AS scope, 'part-' || p_partkey AS name, p_partkey AS k, p_size, p_type FROM part WHERE p_partkey % 11 <> 0),
dis AS (SELECT p_brand AS scope, 'part-' || p_partkey AS name, p_partkey AS k, p_size, p_type FROM part WHERE p_partkey % 17 <> 0),
dec_f AS (SELECT scope, name, 'size' AS field_name, p_size::VARCHAR AS v FROM dec UNION ALL SELECT scope, name, 'type', '"' || p_type || '"' FROM dec),
dis_f AS (
  SELECT scope, name, 'size' AS field_name, CASE WHEN k % 13 = 0 THEN 'null' WHEN k % 7 = 0 THEN (p_size + 1)::VARCHAR ELSE p_size::VARCHAR END AS v FROM dis
  UNION ALL SELECT scope, name, 'type', '"' || p_type || '"' FROM dis WHERE k % 5 <> 0),
common_keys AS (SELECT scope, name FROM dec INTERSECT SELECT scope, name FROM dis),
fields AS (
  SELECT coalesce(a.scope, b.scope) AS scope, coalesce(a.name, b.name) AS name, coalesce(a.field_name, b.field_name) AS field_name, a.v AS l, b.v AS r
  FROM (SELECT dec_f.* FROM dec_f JOIN common_keys USING (scope, name)) a
  FULL JOIN (SELECT dis_f.* FROM dis_f JOIN common_keys USING (scope, name)) b ON a.scope = b.scope AND a.name = b.name AND a.field_name = b.field_name),
diffs AS (
  SELECT 'field' AS discrepancy_type, 'Part' AS kind, 't' AS tenant_id, scope, name, field_name, l IS NOT NULL AS declared_present, l AS declared_value,
         r IS NOT NULL AS discovered_present, r AS discovered_value FROM fields WHERE l IS DISTINCT FROM r
  UNION ALL SELECT 'declared_missing', 'Part', 't', scope, name, NULL, NULL, NULL, NULL, NULL FROM dec d WHERE NOT EXISTS (SELECT 1 FROM dis x WHERE x.scope = d.scope AND x.name = d.name)
  UNION ALL SELECT 'discovered_undeclared', 'Part', 't', scope, name, NULL, NULL, NULL, NULL, NULL FROM dis d WHERE NOT EXISTS (SELECT 1 FROM dec x WHERE x.scope = d.scope AND x.name = d.name))
"""


def customer_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation; every ninth isn't declared."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").filter(k % 9 != 0)
    return rows.select(F.lit("Customer").alias("kind"), F.lit("t").alias("tenant_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("scope"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("provider_id"), attributes(segment=str_value(F.col("c_mktsegment"))).alias("attributes"))


def customer_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourteenth isn't discovered, every tenth has another name."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").filter(k % 14 != 0)
    name = F.when(k % 10 == 0, F.concat(F.lit("new-"), F.col("c_name"))).otherwise(F.col("c_name"))
    return rows.select(F.lit("Customer").alias("kind"), F.lit("t").alias("tenant_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("scope"), name.alias("name"), F.concat(F.lit("c-"), k.cast("string")).alias("provider_id"), attributes(segment=str_value(F.col("c_mktsegment"))).alias("attributes"))


def customer_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed for every tenth customer, rejected where the number leaves 5 of 15; of all customers, declared or not."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").filter((k % 10 == 0) | (k % 15 == 5))
    return rows.select(F.lit("Customer").alias("kind"), F.lit("t").alias("tenant_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("scope"), F.col("c_name").alias("name"), F.concat(F.lit("c-"), k.cast("string")).alias("provider_id"), (k % 10 == 0).alias("is_confirmed"))


CUSTOMER_SQL = """
dec AS (SELECT 'n' || c_nationkey AS scope, c_name AS name, c_custkey AS k FROM customer WHERE c_custkey % 9 <> 0),
dis AS (SELECT 'n' || c_nationkey AS scope, CASE WHEN c_custkey % 10 = 0 THEN 'new-' || c_name ELSE c_name END AS name, 'c-' || c_custkey AS provider_id FROM customer WHERE c_custkey % 14 <> 0),
decisions AS (SELECT 'n' || c_nationkey AS scope, c_name AS name, 'c-' || c_custkey AS provider_id, c_custkey % 10 = 0 AS is_confirmed FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 15 = 5),
bound AS (
  SELECT d.scope, d.name, x.scope AS discovered_scope, x.name AS discovered_name, x.provider_id, 'binding' AS strategy
  FROM decisions c JOIN dec d USING (scope, name) JOIN dis x ON x.provider_id = c.provider_id WHERE c.is_confirmed),
nat AS (
  SELECT d.scope, d.name, x.scope AS discovered_scope, x.name AS discovered_name, x.provider_id, 'natural_key' AS strategy
  FROM dec d JOIN dis x USING (scope, name)
  WHERE NOT EXISTS (SELECT 1 FROM bound b WHERE b.scope = d.scope AND b.name = d.name)
    AND NOT EXISTS (SELECT 1 FROM bound b WHERE b.discovered_scope = x.scope AND b.discovered_name = x.name)
    AND NOT EXISTS (SELECT 1 FROM decisions r WHERE NOT r.is_confirmed AND r.scope = d.scope AND r.name = d.name AND r.provider_id = x.provider_id)),
pairs AS (SELECT * FROM bound UNION ALL SELECT * FROM nat)
"""
