"""Rules that a table has to keep, all checked in one pass, before it is published."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEY

#: Broken values that an error shows for each rule.
SHOWN = 3


@dataclass(frozen=True)
class Rule:
    """At most ``most`` rows for which ``when`` (SQL; empty: all) holds may share ``columns``; rows with a null among them
    don't count unless ``nulls``. ``most`` 0 forbids such rows."""

    name: str
    columns: tuple[str, ...]
    when: str = ""
    most: int = 1
    nulls: bool = False


class ConstraintViolation(RuntimeError):
    """A table that breaks its rules isn't published."""

    def __init__(self, table: str, broken: list[tuple[str, str, int]]) -> None:
        self.table, self.broken = table, broken
        super().__init__(f"{table}: " + "; ".join(f"{rule}: {value} ({n} rows)" for rule, value, n in broken))


_KEY = tuple(KEY)
MATCH_RULES = (
    Rule("active match of a declared key", _KEY, "state in ('proposed', 'confirmed')"),
    Rule("active match of a provider id", ("tenant_id", "provider_id"), "state in ('proposed', 'confirmed')"),
    Rule("rejection of a pairing", (*_KEY, "provider_id"), "state = 'rejected'"),
    Rule("decision without provider id", _KEY, "state in ('confirmed', 'rejected') and provider_id is null", 0),
)
DISCREPANCY_RULES = (
    Rule("open discrepancy of a field", ("discrepancy_type", *_KEY, "field_name"), "state = 'open'", nulls=True),
    Rule("declared value on a side that states nothing", (*_KEY, "field_name"), "declared_present = false and declared_value is not null", 0, True),
    Rule("discovered value on a side that states nothing", (*_KEY, "field_name"), "discovered_present = false and discovered_value is not null", 0, True),
)
#: A plane's keys; what matching asks of the present rows as well. (An absent row may share its provider id with the row that came after it.)
STATE_RULES = (Rule("key of a plane", _KEY),)
PLANE_RULES = (*STATE_RULES, Rule("provider id", ("tenant_id", "provider_id")))
REVISION_RULES = (Rule("revision of a tenant", ("tenant_id", "revision_id")), Rule("active revision", ("tenant_id",), "is_active"))


def broken(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Broken rules with their values: rule, value, n. Each row becomes one entry for each rule that it counts for; the entries of all
    rules are counted by one aggregation, summed before the one exchange, so a value of many rows costs a row a task."""

    def entry(i: int, rule: Rule) -> Column:
        counts = F.expr(rule.when) if rule.when else F.lit(True)
        if not rule.nulls:
            counts = counts & ~F.greatest(*[F.col(c).isNull() for c in rule.columns], F.lit(False))
        shown = [F.coalesce(F.col(c).cast("string"), F.lit("-")) if rule.nulls else F.col(c).cast("string") for c in rule.columns]
        # the values apart, so that a separator inside one cannot make two keys alike
        return F.when(counts, F.struct(F.lit(i).alias("at"), F.array(*[F.col(c).cast("string") for c in rule.columns]).alias("key"), F.concat_ws("/", *shown).alias("value")))

    entries = rows.select(F.explode(F.array_compact(F.array(*[entry(i, r) for i, r in enumerate(rules)]))).alias("e"))
    counted = entries.groupBy("e.at", "e.key", "e.value").agg(F.count("*").alias("n"))
    facts = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.most).alias("most")) for r in rules])
    over = counted.withColumn("rule", F.element_at(facts, F.col("at") + 1))
    return over.filter("n > rule.most").select(F.col("rule.name").alias("rule"), "value", "n")


def require(name: str, rows: DataFrame, rules: tuple[Rule, ...]) -> None:
    """ConstraintViolation with some broken values of each rule; nothing else comes to the driver."""
    samples = broken(rows, rules).orderBy("rule", "value").limit(SHOWN * len(rules))
    if bad := [(r.rule, r.value, r.n) for r in samples.collect()]:
        raise ConstraintViolation(name, bad)
