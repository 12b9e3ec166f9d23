"""Mixing sources to target weights (operator 9), in DataFrame operations only.

Targets are one row per source. Within a source documents are put in the order of a hash of their ids and texts and cut at
the source's exact budget by distributed prefix sums: the hash's first digits are the range that a document falls in, a
table holds the sums of the ranges before it, and a window adds up the documents of one range only, so a source with a
third of all rows is spread over all tasks. There are the more ranges the more rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, unused

#: Hexadecimal digits of the hash that name a range of a source, at least, and the rows of a range beyond which there are more.
RANGE_DIGITS, RANGE_ROWS = 3, 50_000
#: Times that a source may be repeated, and the weights that its rank gives it in turn.
MOST_EPOCHS, WEIGHTS = 3, 3


def words(text: Column) -> Column:
    """Number of runs of other characters than blank, tab, line feed, vertical tab, form feed, carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size and target from one row per source (source, source_size).

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... Their targets share the total by weight; none exceeds
    ``most_epochs`` times its size, and what is over goes to the others by weight. That is one level per unit of weight:
    with sources ordered by capacity per weight, the level at which the first k are full. The sources' rows, not the
    documents, are ordered in one task.
    """
    by_name, by_level = Window.orderBy(F.col("source").isNull(), "source"), Window.orderBy("full", "source_rank")
    weighed = sizes.withColumn("source_rank", F.row_number().over(by_name)).withColumn("w", ((F.col("source_rank") - 1) % WEIGHTS + 1).cast("double"))
    level = weighed.withColumn("cap", (F.col("source_size") * most_epochs).cast("double")).withColumn("full", F.col("cap") / F.col("w"))
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("full", "source_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = level.withColumn("level", (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    level = level.withColumn("level", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "source_rank", "level"))).over(everything)["level"])
    return level.select("source", "source_size", F.least(F.col("w") * F.col("level"), F.col("cap")).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """All columns of ``docs``, size, source_size, target and taken (words that the mix takes of a document, repeats
    counted; at most ``most_epochs`` times its size).

    A source's budget is its target rounded down: every document as often as the budget holds the whole source, then
    documents in hash order until the rest is used up, the last one in part. The hash is of id and text, so neither null nor
    repeated ids gather; ties go by id (null first) and size, and rows equal in all of these are interchangeable. A null
    text has size 0 and takes nothing; a null source is a source of its own. An empty table gives an empty result. Extra
    columns pass through whatever they are called; columns named like an output are replaced.
    """
    made = ["size", "source_size", "target", "taken"]
    docs = docs.drop(*made)
    key, part, name, none, before, start = unused([*docs.columns, *made], "key", "part", "name", "none", "before", "start")
    digits, rows = RANGE_DIGITS, docs.count()
    while rows > RANGE_ROWS * 16**digits:
        digits += 1
    hashed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    sized = docs.withColumn("size", words(F.col("text")) if size is None else size).withColumn(key, hashed).withColumn(part, F.substring(key, 1, digits))
    facts = staged(sized.select("source", part, "size").groupBy("source", part).agg(F.sum("size").alias("range_size")), "ranges")
    plan = targets(facts.groupBy("source").agg(F.sum("range_size").alias("source_size")), most_epochs)
    # plain key columns, the same for the join and the window: one shuffle of the documents serves both
    plain = {name: F.coalesce("source", F.lit("")), none: F.col("source").isNull()}
    sums = Window.partitionBy(name, none).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = facts.withColumns(plain).withColumn(before, F.coalesce(F.sum("range_size").over(sums), F.lit(0))).drop("source", "range_size")
    offsets = offsets.join(plan.withColumns(plain).drop("source"), [name, none])
    keys = [name, none, part]
    placed = sized.withColumns(plain).join(offsets, keys)
    within = Window.partitionBy(*keys).orderBy(key, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn(start, F.col(before) + F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col(start)))
    return placed.withColumn("taken", taken.cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns], *made)


#: The same in DuckDB's SQL, over the view documents.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS source_rank FROM sized GROUP BY source),
capped AS (
  SELECT *, ((source_rank - 1) % 3 + 1)::DOUBLE AS w, (source_size * 3)::DOUBLE AS cap FROM weighed),
levels AS (
  SELECT *, cap / w AS full_at,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM capped),
plan AS (
  SELECT source, source_size, least(w * (SELECT arg_min(lvl, (full_at, source_rank)) FROM levels WHERE lvl <= full_at), cap) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, floor(p.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken FROM whole
"""
