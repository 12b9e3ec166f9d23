"""Entity resolution: stored bindings first, then natural keys; what is left over on either side is an orphan.

Planes have kind, tenant_id, scope, name, provider_id, attributes; decisions have these four keys of the declared side,
provider_id and is_confirmed. What decisions bind is found on keys alone; attributes meet in one full outer join. Pairs and
orphans are rows of the one result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import BINDING, HIGH, KEY, NATURAL_KEY

_FOUND = [f"discovered_{k}" for k in KEY]
PAIR = [*KEY, *_FOUND, "provider_id", "strategy", "confidence", "declared", "discovered"]


def of_tenant(rows: DataFrame, tenant_id: str) -> DataFrame:
    """Rows of one tenant; tables partitioned by tenant_id are pruned to it."""
    return rows.filter(F.col("tenant_id") == tenant_id)


def present(discovered: DataFrame) -> DataFrame:
    """The discovered plane as matching sees it: without rows that are marked absent (a plane without such marks has none)."""
    return discovered.filter(~F.coalesce("is_absent", F.lit(False))) if "is_absent" in discovered.columns else discovered


def snapshots(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Stored rows (kind_id, ...) with their kind's name (kinds: kind_id, kind); a row without its kind fails the read."""
    joined = rows.join(kinds.select("kind_id", "kind"), "kind_id", "left")
    known = F.when(F.col("kind").isNull(), F.raise_error(F.concat(F.lit("no kind "), F.col("kind_id").cast("string"))).cast("boolean")).otherwise(True)
    return joined.filter(known).drop("kind_id")


@dataclass
class MatchResult:
    """``rows``: PAIR columns; orphans have no strategy and only their own side's columns."""

    rows: DataFrame

    @property
    def pairs(self) -> DataFrame:
        return self.rows.filter("strategy is not null")

    @property
    def declared_orphans(self) -> DataFrame:
        return self.rows.filter("strategy is null and declared is not null").select(*KEY, F.col("declared").alias("attributes"))

    @property
    def discovered_orphans(self) -> DataFrame:
        return self.rows.filter("strategy is null and discovered is not null").select(*[F.col(f"discovered_{k}").alias(k) for k in KEY], "provider_id", F.col("discovered").alias("attributes"))


def unique(rows: DataFrame, columns: list[str], rule: str) -> DataFrame:
    """``rows``, whose use fails where two have the same ``columns``. The count shares the shuffle and the order of a later
    join by the same columns."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*columns))
    shown = F.concat(F.lit(f"{rule}: more than one row of "), F.concat_ws("/", *columns))
    return rows.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(shown).cast("boolean")).otherwise(True)).drop("_n")


def refused_if(rows: DataFrame, side: DataFrame, columns: list[str], rule: str) -> DataFrame:
    """``rows``, whose use fails where two rows of ``side`` share non-null ``columns``. The values are counted apart from all other
    columns, before ``rows`` are read, so the check holds whatever a join skips."""
    repeated = violations(side.select(*columns), columns, rule).agg(F.min("value").alias("value")).scalar()
    return rows.filter(F.when(repeated.isNotNull(), F.raise_error(F.concat(F.lit(f"{rule}: more than one row of "), repeated)).cast("boolean")).otherwise(True))


def claims(declared: DataFrame, discovered: DataFrame, decisions: DataFrame) -> DataFrame:
    """What confirmed decisions bind: KEY, provider_id and the discovered row's key. A decision of which a side is missing (or
    without provider id) binds nothing. Keys only; attributes don't travel through here."""
    confirmed = decisions.filter("is_confirmed and provider_id is not null").select(*KEY, "provider_id").distinct()
    there = discovered.filter("provider_id is not null").select(F.col("tenant_id").alias("_t"), "provider_id", *[F.col(k).alias(f"discovered_{k}") for k in KEY])
    held = confirmed.join(declared.select(*KEY), KEY).withColumn("_t", F.col("tenant_id"))
    return held.join(there, ["_t", "provider_id"]).select(*KEY, "provider_id", *_FOUND)


def bound_pairs(declared: DataFrame, discovered: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs that a confirmed decision names; two confirmed decisions for either side fail."""
    return match_resources(declared, discovered, decisions).rows.filter(F.col("strategy") == BINDING)


def match_resources(declared: DataFrame, discovered: DataFrame, decisions: DataFrame | None = None) -> MatchResult:
    """Pairs of both strategies and the orphans of both sides. A rejected pair leaves both of its sides as orphans. Two rows
    of a plane with one key, two discovered rows with one provider id and two confirmed decisions for one side fail the job.

    One full outer join by key serves both strategies: a discovered row that a decision binds goes to its declared row's key, every other
    to its own. At a key that is claimed, the row that came by its own key is an orphan."""
    no = F.lit(False)
    mine = unique(declared.select(*KEY, F.col("attributes").alias("declared")), KEY, "declared key")
    theirs = discovered.select(*KEY, "provider_id", F.col("attributes").alias("discovered"))
    theirs = refused_if(theirs, discovered, ["tenant_id", "provider_id"], "provider id")
    bound, claimed, refused = no, no, no
    if decisions is None:
        theirs = unique(theirs, KEY, "discovered key").withColumns({f"discovered_{k}": F.col(k) for k in KEY})
    else:
        confirmed = decisions.filter("is_confirmed and provider_id is not null").select(*KEY, "provider_id").distinct()
        theirs = refused_if(theirs, discovered, KEY, "discovered key")
        theirs = refused_if(refused_if(theirs, confirmed, KEY, "confirmed declared key"), confirmed, ["tenant_id", "provider_id"], "confirmed provider id")
        held = claims(declared, discovered, decisions)
        mine = mine.join(held.select(*KEY, F.lit(True).alias("claimed")), KEY, "left")
        rejected = decisions.filter("not is_confirmed").groupBy(*KEY).agg(F.collect_set(F.struct("provider_id")).alias("rejected"))
        theirs = theirs.join(rejected, KEY, "left")
        to = held.select(*_FOUND, F.struct(*KEY).alias("to"))
        theirs = theirs.withColumnsRenamed({k: f"discovered_{k}" for k in KEY}).join(to, _FOUND, "left")
        theirs = theirs.withColumns({k: F.coalesce(f"to.{k}", f"discovered_{k}") for k in KEY})
        bound, claimed = F.col("to").isNotNull(), F.coalesce("claimed", no)
        refused = F.coalesce(F.exists("rejected", lambda r: r["provider_id"].eqNullSafe(F.col("provider_id"))), no)
    planes = mine.join(theirs, KEY, "full_outer")
    here, there = F.col("declared").isNotNull(), F.col("discovered").isNotNull()
    paired = here & there & F.when(bound, True).otherwise(~claimed & ~refused)

    def row(is_declared: bool, is_discovered: bool) -> Column:
        side = lambda on, c, t: (F.col(c) if on else F.lit(None).cast(t))
        values = [side(is_declared, k, "string").alias(k) for k in KEY] + [side(is_discovered, f, "string").alias(f) for f in _FOUND]
        values.append(side(is_discovered, "provider_id", "string").alias("provider_id"))
        strategy = F.when(bound, BINDING).otherwise(NATURAL_KEY) if is_declared and is_discovered else F.lit(None).cast("string")
        values += [strategy.alias("strategy"), F.lit(HIGH if is_declared and is_discovered else None).cast("string").alias("confidence")]
        kinds = dict(planes.dtypes)
        return F.struct(*values, *[side(on, c, kinds[c]).alias(c) for on, c in ((is_declared, "declared"), (is_discovered, "discovered"))])

    # a claimed row is in its pair; beside another row of its key it isn't an orphan
    single = F.array_compact(F.array(F.when(here & ~(claimed & there), row(True, False)), F.when(there, row(False, True))))
    return MatchResult(planes.select(F.explode(F.when(paired, F.array(row(True, True))).otherwise(single)).alias("r")).select("r.*").select(*PAIR))


def violations(side: DataFrame, columns: list[str], rule: str) -> DataFrame:
    """Values of ``columns`` that more than one row has (rows with a NULL in them don't count): rule, value, n."""
    stated = side.dropna(subset=columns)
    return stated.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), F.concat_ws("/", *columns).alias("value"), "n")


def check_unique(side: DataFrame, columns: list[str], rule: str) -> None:
    """Raise ValueError with the first few violations of a uniqueness rule."""
    if bad := violations(side, columns, rule).limit(3).collect():
        raise ValueError(f"{rule}: " + ", ".join(f"{r.value} ({r.n} rows)" for r in bad))


def check_inputs(declared: DataFrame, discovered: DataFrame, decisions: DataFrame | None = None) -> None:
    """What matching relies on, before it runs: unique keys on both planes, unique provider ids, one confirmed decision for
    each side."""
    check_unique(declared, KEY, "declared key")
    check_unique(discovered, KEY, "discovered key")
    check_unique(discovered, ["tenant_id", "provider_id"], "provider id")
    if decisions is not None:
        confirmed = decisions.filter("is_confirmed")
        check_unique(confirmed, KEY, "confirmed declared key")
        check_unique(confirmed, ["tenant_id", "provider_id"], "confirmed provider id")


def match_constraints(matches: DataFrame) -> DataFrame:
    """Stored matches that break a rule: rule, value, n. One active match (proposed or confirmed) for a declared key and for
    a provider id, one rejection of a pairing; a decision of a person names a provider id."""
    active, anchor = matches.filter(F.col("state").isin("proposed", "confirmed")), [*KEY, "provider_id"]
    rules = [violations(active, KEY, "active match of a declared key"), violations(active, ["tenant_id", "provider_id"], "active match of a provider id"), violations(matches.filter("state = 'rejected'"), anchor, "rejection of a pairing")]
    nameless = matches.filter("state in ('confirmed', 'rejected') and provider_id is null")
    rules.append(nameless.groupBy(*KEY).agg(F.count("*").alias("n")).select(F.lit("decision without provider id").alias("rule"), F.concat_ws("/", *KEY).alias("value"), "n"))
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out


def value_constraints(discrepancies: DataFrame) -> DataFrame:
    """Stored discrepancies with a value on a side that states nothing: plane and the row. Presence may be unknown (NULL)."""
    sides = [discrepancies.filter(F.coalesce(~F.col(f"{s}_present"), F.lit(False)) & F.col(f"{s}_value").isNotNull()).select(F.lit(s).alias("plane"), "*") for s in ("declared", "discovered")]
    return sides[0].unionByName(sides[1])


def with_row_ids(pairs: DataFrame, declared_ids: DataFrame, discovered_ids: DataFrame, name: str = "row_id") -> DataFrame:
    """Pairs with ``declared_row_id`` and ``discovered_row_id``, the ids of the rows that they join (KEY, id of either plane; a row without one
    fails nothing and has a null)."""
    mine = declared_ids.select(*KEY, F.col(name).alias("declared_row_id"))
    theirs = discovered_ids.select(*[F.col(k).alias(f"discovered_{k}") for k in KEY], F.col(name).alias("discovered_row_id"))
    return pairs.join(mine, KEY, "left").join(theirs, _FOUND, "left").select(*pairs.columns, "declared_row_id", "discovered_row_id")


def in_order(pairs: DataFrame) -> DataFrame:
    """Pairs in their total order, declared key then provider id, for whoever writes or shows them."""
    return pairs.orderBy(*KEY, F.asc_nulls_last("provider_id"))
