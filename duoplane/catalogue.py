"""Registered queries of the library over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import compare
from .functions.canon import encoded, spread
from .functions.config import ComparisonSchema, FieldConfig
from .functions.literals import bool_literal, int_literal
from .model import CONFIRMED, KEY, OPEN, PROPOSED, REJECTED, RESOLVED, SUPPRESSED, attributes, bool_value, int_value, null_value, str_value, value
from .operators import decisions as dec
from .operators import constraints, diffing, discovery, lifecycle, matching, readmodel, revisions
from .plans.planes import CUSTOMER_SQL, PART_SQL, customer_decisions, customer_declared, customer_discovered, part_declared, part_discovered, part_keys, table
from .storage import ordered
from .storage.files import passing
from .storage.runlog import CLOSED, OPENED, SKIPPED, folded


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = passing(spark, "file://" + tempfile.mkdtemp(prefix="duoplane-"))
    return _LOCAL[app]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------------------------------------ matching and diffing


def _part_match(spark: SparkSession, sf_dir: str) -> matching.MatchResult:
    return matching.match_resources(part_declared(spark, sf_dir), part_discovered(spark, sf_dir))


@query(f"WITH {PART_SQL} SELECT * FROM diffs")
def reconcile_discrepancies(spark, sf_dir):
    return diffing.reconcile(_part_match(spark, sf_dir))


@query("SELECT s.s_name AS name, n.n_name AS nation FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey")
def kind_lookup_join(spark, sf_dir):
    """N:1 lookup: the small side is broadcast by its size, which Spark checks."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(s.s_name.alias("name"), n.n_name.alias("nation"))


@query(f"WITH {PART_SQL} SELECT d.scope, d.name, 'id-' || x.k AS provider_id, 'natural_key' AS strategy, 'high' AS confidence FROM dec d JOIN dis x ON d.scope = x.scope AND d.name = x.name")
def natural_key_pairs(spark, sf_dir):
    return _part_match(spark, sf_dir).pairs.select("scope", "name", "provider_id", "strategy", "confidence")


@query(f"WITH {PART_SQL} SELECT scope, name FROM diffs WHERE discrepancy_type = 'declared_missing'")
def declared_orphans(spark, sf_dir):
    return _part_match(spark, sf_dir).declared_orphans.select("scope", "name")


@query(f"WITH {PART_SQL} SELECT scope, name FROM diffs WHERE discrepancy_type = 'discovered_undeclared'")
def discovered_orphans(spark, sf_dir):
    return _part_match(spark, sf_dir).discovered_orphans.select("scope", "name")


def _customer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return customer_declared(spark, sf_dir), customer_discovered(spark, sf_dir), customer_decisions(spark, sf_dir)


_PAIR = ["scope", "name", "discovered_scope", "discovered_name", "provider_id", "strategy"]


@query(f"WITH {CUSTOMER_SQL} SELECT * FROM bound")
def binding_pairs(spark, sf_dir):
    return matching.bound_pairs(*_customer(spark, sf_dir)).select(*_PAIR)


@query(f"WITH {CUSTOMER_SQL} SELECT * FROM pairs")
def match_with_rejections(spark, sf_dir):
    return matching.match_resources(*_customer(spark, sf_dir)).pairs.select(*_PAIR)


@query(f"""WITH {CUSTOMER_SQL}
SELECT 'declared' AS plane, scope, name FROM dec WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.scope = dec.scope AND p.name = dec.name)
UNION ALL SELECT 'discovered', scope, name FROM dis WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.discovered_scope = dis.scope AND p.discovered_name = dis.name)""")
def orphans_after_decisions(spark, sf_dir):
    found = matching.match_resources(*_customer(spark, sf_dir))
    sides = (("declared", found.declared_orphans), ("discovered", found.discovered_orphans))
    left, right = (d.select(F.lit(p).alias("plane"), "scope", "name") for p, d in sides)
    return left.unionByName(right)


@query("""SELECT a.s_name AS name, b.s_name AS discovered_name, 's-' || a.s_suppkey AS provider_id FROM supplier a JOIN supplier b ON b.s_suppkey = xor(a.s_suppkey, 1)""")
def swapped_names_bound(spark, sf_dir):
    """Two resources that swapped names stay with their provider ids."""
    s = table(spark, sf_dir, "supplier")
    base = s.select(F.lit("Supplier").alias("kind"), F.lit("t").alias("tenant_id"), F.lit("x").alias("scope"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    pid = F.concat(F.lit("s-"), F.col("k").cast("string"))
    no = attributes(k=int_value(F.col("k")))
    declared = base.select(*KEY, F.lit(None).cast("string").alias("provider_id"), no.alias("attributes"))
    other = F.concat(F.lit("s-"), F.col("k").bitwiseXOR(1).cast("string"))
    discovered = base.select(*KEY, other.alias("provider_id"), no.alias("attributes"))
    confirmed = base.select(*KEY, pid.alias("provider_id"), F.lit(True).alias("is_confirmed"))
    return matching.bound_pairs(declared, discovered, confirmed).select("name", "discovered_name", "provider_id")


_STORED_SQL = """
stored AS (
  SELECT 'n' || c_nationkey AS scope, c_name AS name, CASE WHEN c_custkey % 10 = 4 THEN NULL ELSE 'c-' || c_custkey END AS provider_id,
         CASE WHEN c_custkey % 10 = 0 THEN 'confirmed' WHEN c_custkey % 15 = 5 THEN 'rejected' ELSE 'proposed' END AS state
  FROM customer WHERE c_custkey % 10 IN (0, 4) OR c_custkey % 15 = 5)"""


def _stored_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").filter((k % 10).isin(0, 4) | (k % 15 == 5))
    return rows.select(
        F.lit("Customer").alias("kind"), F.lit("t").alias("tenant_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("scope"), F.col("c_name").alias("name"),
        F.when(k % 10 != 4, F.concat(F.lit("c-"), k.cast("string"))).alias("provider_id"), F.lit("binding").alias("strategy"), F.lit("high").alias("confidence"),
        F.when(k % 10 == 0, CONFIRMED).when(k % 15 == 5, REJECTED).otherwise(PROPOSED).alias("state"),
    )


@query(f"""WITH {CUSTOMER_SQL}, {_STORED_SQL}
SELECT scope, name, provider_id, CASE WHEN state IN ('confirmed', 'rejected') AND
  (NOT EXISTS (SELECT 1 FROM dec d WHERE d.scope = s.scope AND d.name = s.name) OR NOT EXISTS (SELECT 1 FROM dis x WHERE x.provider_id = s.provider_id)) THEN 'invalidated' ELSE state END AS state
FROM stored s""")
def invalidate_unanchored(spark, sf_dir):
    declared, discovered, _ = _customer(spark, sf_dir)
    return dec.invalidate_unanchored(_stored_matches(spark, sf_dir), declared, discovered).select("scope", "name", "provider_id", "state")


@query(f"""WITH {CUSTOMER_SQL}, held AS (SELECT scope, name, provider_id FROM decisions WHERE is_confirmed)
SELECT scope, name, provider_id, strategy FROM pairs p
WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.scope = p.scope AND h.name = p.name) AND NOT EXISTS (SELECT 1 FROM held h WHERE h.provider_id = p.provider_id)""")
def write_proposals_only(spark, sf_dir):
    declared, discovered, decided = _customer(spark, sf_dir)
    stored = decided.withColumn("state", F.when(F.col("is_confirmed"), CONFIRMED).otherwise(REJECTED))
    return dec.proposals(matching.match_resources(declared, discovered, decided).pairs, stored).select("scope", "name", "provider_id", "strategy")


@query(f"""WITH {CUSTOMER_SQL}, {_STORED_SQL},
kept AS (
  SELECT scope, name, provider_id, CASE WHEN NOT EXISTS (SELECT 1 FROM dec d WHERE d.scope = s.scope AND d.name = s.name)
    OR NOT EXISTS (SELECT 1 FROM dis x WHERE x.provider_id = s.provider_id) THEN 'invalidated' ELSE state END AS state FROM stored s WHERE state <> 'proposed')
SELECT state, count(*) AS n FROM (
  SELECT state FROM kept UNION ALL
  SELECT 'proposed' FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM kept h WHERE h.state = 'confirmed' AND h.scope = p.scope AND h.name = p.name)
    AND NOT EXISTS (SELECT 1 FROM kept h WHERE h.state = 'confirmed' AND h.provider_id = p.provider_id)) GROUP BY state""")
def rewrite_matches(spark, sf_dir):
    """Stored matches after a whole run, as it published them: decisions kept or invalidated, proposals rebuilt."""
    none = diffing.as_open_rows(diffing.orphan_discrepancies(customer_declared(spark, sf_dir), "declared_missing")).limit(0)
    return _published(spark, sf_dir, none).read("matches").groupBy("state").agg(F.count("*").alias("n"))


def _published(spark: SparkSession, sf_dir: str, discrepancies: DataFrame):
    """The estate of the customers after a run from what was stored."""
    from .plans import runs
    from .storage.estate import Estate
    from .storage.lease import Leases

    path = _folder(spark, "estate")
    estate = Estate(spark, path, "t")
    runs.seed(estate, _stored_matches(spark, sf_dir), discrepancies)
    planes = lambda: (customer_declared(spark, sf_dir), customer_discovered(spark, sf_dir))
    if not runs.reconcile_estate(estate, Leases(spark, path), planes, "run-2", F.lit("2024-06-30").cast("timestamp")):
        raise RuntimeError("another run has the lease of a new estate")
    return estate.snapshot()


@query(f"WITH {PART_SQL} SELECT scope, name, field_name, l AS declared_value, r AS discovered_value FROM fields")
def attribute_key_union(spark, sf_dir):
    rows = diffing.attribute_pairs(_part_match(spark, sf_dir).pairs)
    return rows.select("scope", "name", "field_name", F.col("l.canon").alias("declared_value"), F.col("r.canon").alias("discovered_value"))


@query(f"""WITH {PART_SQL}, s AS (SELECT CASE WHEN l IS NULL THEN 'absent' WHEN l = 'null' THEN 'null' ELSE 'value' END AS declared_state,
CASE WHEN r IS NULL THEN 'absent' WHEN r = 'null' THEN 'null' ELSE 'value' END AS discovered_state, l IS NOT DISTINCT FROM r AS agree FROM fields)
SELECT declared_state, discovered_state, agree, count(*) AS n FROM s GROUP BY ALL""")
def field_presence_matrix(spark, sf_dir):
    rows = diffing.attribute_pairs(_part_match(spark, sf_dir).pairs)
    state = lambda c: F.when(F.col(c).isNull(), "absent").when(F.col(f"{c}.kind") == "null", "null").otherwise("value")
    return rows.groupBy(state("l").alias("declared_state"), state("r").alias("discovered_state"), compare.same(F.col("l"), F.col("r")).alias("agree")).agg(F.count("*").alias("n"))


@query(f"WITH {PART_SQL} SELECT discrepancy_type, count(*) AS n FROM diffs GROUP BY 1")
def discrepancy_counts_by_type(spark, sf_dir):
    return reconcile_discrepancies(spark, sf_dir).groupBy("discrepancy_type").agg(F.count("*").alias("n"))


@query(f"""WITH {PART_SQL}, stated AS (SELECT scope, name, list(field_name) AS f FROM dis_f GROUP BY ALL)
SELECT scope, name, array_to_string(list_sort(list_filter(['color', 'size', 'type'], lambda c: NOT list_contains(f, c))), ',') AS missing,
  array_to_string(list_sort(list_filter(f, lambda c: NOT list_contains(['color', 'size', 'type'], c))), ',') AS unknown FROM stated""")
def missing_unknown_attributes(spark, sf_dir):
    schema = F.array(*[F.lit(c) for c in ("color", "size", "type")])
    missing, unknown = revisions.attribute_sets(F.map_keys("attributes"), schema)
    return part_discovered(spark, sf_dir).select("scope", "name", F.array_join(missing, ",").alias("missing"), F.array_join(unknown, ",").alias("unknown"))


@query("""SELECT o_custkey, o_orderpriority, count(*) AS n, string_agg(lpad(o_orderkey::VARCHAR, 12, '0'), ',' ORDER BY lpad(o_orderkey::VARCHAR, 12, '0')) AS sources
FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_identity(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("source", F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return revisions.duplicate_identities(rows, ["o_custkey", "o_orderpriority"])


@query("""SELECT 'order of a customer on a day' AS rule, o_custkey || '/' || strftime(o_orderdate, '%Y-%m-%d') AS value, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'customer', c_name, count(*) FROM customer GROUP BY ALL HAVING count(*) > 1""")
def uniqueness_violations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("c"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return matching.violations(orders, ["c", "d"], "order of a customer on a day").unionByName(matching.violations(table(spark, sf_dir, "customer"), ["c_name"], "customer"))


# --------------------------------------------------------------------------------------------------------- discovery

_EVENT_TYPES = ("view", "click", "purchase", "login")
_OK_SQL = "NOT (event_type = 'error' AND event_id % 3 = 0 AND day(ts) % 3 = 0)"


@query(f"SELECT event_id, event_type AS kind FROM events WHERE event_type NOT IN {_EVENT_TYPES}")
def kind_lookup_rejects(spark, sf_dir):
    kinds = spark.createDataFrame([(k,) for k in _EVENT_TYPES], "kind string")
    return discovery.unknown_kinds(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind")), kinds)


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("run", F.to_date("ts"))
    return events.withColumn("accepted", ~((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0) & (F.dayofmonth("ts") % 3 == 0)))


_RUNS_SQL = f"""runs AS (
  SELECT ts::DATE AS run, count(*) AS records_read, count(*) FILTER (WHERE {_OK_SQL}) AS records_written, count(*) FILTER (WHERE NOT ({_OK_SQL})) AS errors, day(any_value(ts)) % 7 = 0 AS has_gap
  FROM events GROUP BY 1)"""


@query(f"WITH {_RUNS_SQL} SELECT *, CASE WHEN errors > 0 OR has_gap THEN 'partial' ELSE 'success' END AS status FROM runs")
def collector_run_stats(spark, sf_dir):
    return discovery.run_statistics(_observed(spark, sf_dir), "run", F.col("accepted"), F.dayofmonth("run") % 7 == 0)


@query("SELECT user_id, event_id, event_type, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest_state(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "props")
    return discovery.latest(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


_PANEL_SQL = f"""{_RUNS_SQL}, ent AS (SELECT run, errors = 0 AND NOT has_gap AS entitled FROM runs),
seen AS (SELECT DISTINCT user_id, ts::DATE AS run FROM events),
panel AS (SELECT f.user_id, e.run, e.entitled, s.run IS NOT NULL AS seen FROM (SELECT user_id, min(run) AS first FROM seen GROUP BY 1) f JOIN ent e ON e.run >= f.first
  LEFT JOIN seen s ON s.user_id = f.user_id AND s.run = e.run),
marked AS (SELECT *, max(CASE WHEN seen THEN run END) OVER (PARTITION BY user_id ORDER BY run) AS last_seen FROM panel),
after AS (SELECT *, min(CASE WHEN NOT seen AND entitled THEN run END) OVER (PARTITION BY user_id, last_seen ORDER BY run) AS since FROM marked)"""


_ABSENCES_SQL = """absences AS (
  SELECT a.user_id, a.last_seen, min(a.since) AS absent_since, (SELECT min(s.run) FROM seen s WHERE s.user_id = a.user_id AND s.run > a.last_seen) AS refuted_by
  FROM after a WHERE a.since IS NOT NULL GROUP BY a.user_id, a.last_seen)"""


def _absences(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = collector_run_stats(spark, sf_dir).select("run", discovery.may_infer_absence(F.col("status"), F.col("has_gap")).alias("entitled"))
    return discovery.absences(_observed(spark, sf_dir).select("user_id", "run"), runs, "user_id")


@query(f"WITH {_PANEL_SQL}, {_ABSENCES_SQL} SELECT * FROM absences")
def infer_absence(spark, sf_dir):
    """Every absence of a user; the SQL goes through every user's state after every run."""
    return _absences(spark, sf_dir)


@query(f"""WITH {_PANEL_SQL}, t AS (SELECT user_id, run, since IS NOT NULL AS a, lag(since IS NOT NULL) OVER (PARTITION BY user_id ORDER BY run) AS was FROM after)
SELECT user_id, run AS refuted_by FROM t WHERE was AND NOT a""")
def refute_absence(spark, sf_dir):
    """Runs in which an absent user was seen again."""
    return _absences(spark, sf_dir).filter("refuted_by is not null").select("user_id", "refuted_by")


@query("""WITH a AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR AS skipped FROM events)
SELECT user_id, count(*) FILTER (WHERE skipped) AS skipped_attempts FROM a GROUP BY 1""")
def skipped_attempts(spark, sf_dir):
    """Attempts within an hour of the one before are skips, counted when read."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("skipped", F.col("ts") - F.lag("ts").over(w) < F.expr("interval 1 hour"))
    return rows.groupBy("user_id").agg(F.count_if("skipped").alias("skipped_attempts"))


_MERGED_SQL = """WITH s AS (SELECT user_id, event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
n AS (SELECT user_id, event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND user_id % 17 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT 'u-' || coalesce(n.user_id, s.user_id) AS name, CASE WHEN n.user_id IS NOT NULL THEN 'run-2' ELSE 'run-1' END AS last_seen_run, coalesce(n.event_id, s.event_id)::VARCHAR AS provider_id,
  n.user_id IS NULL AND s.user_id % 2 = 0 AS is_absent, CASE WHEN n.user_id IS NULL AND s.user_id % 2 = 0 THEN TIMESTAMP '2024-02-01' END AS absent_since
FROM s FULL JOIN n ON s.user_id = n.user_id"""


@query(_MERGED_SQL)
def merge_collector_run(spark, sf_dir):
    """One full outer join: upsert what a run saw, mark what its collector owns and missed, refute absence. That the second run
    misses one user in seventeen is the drift that it is to find."""
    events = table(spark, sf_dir, "events")

    def plane(rows: DataFrame) -> DataFrame:
        last = discovery.latest(rows.select("user_id", "ts", "event_id"), ["user_id"], [F.col("ts"), F.col("event_id")])
        return last.select(F.lit("User").alias("kind"), F.lit("t").alias("tenant_id"), F.lit("x").alias("scope"), F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("name"), F.col("event_id").cast("string").alias("provider_id"), attributes(id=int_value(F.col("user_id"))).alias("attributes"), "user_id")

    cut = F.lit("2024-01-15").cast("timestamp")
    owner = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    state = plane(events.filter(F.col("ts") < cut)).select(*KEY, "provider_id", "attributes", F.lit("run-1").alias("last_seen_run"), owner.alias("collector"), F.lit(False).alias("is_absent"), F.lit(None).cast("timestamp").alias("absent_since"))
    seen = plane(events.filter((F.col("ts") >= cut) & (F.col("user_id") % 17 != 0))).drop("user_id")
    merged = discovery.merge_run(state, seen, F.lit("run-2"), F.lit("even"), F.lit(True), F.lit("2024-02-01").cast("timestamp"))
    return merged.select("name", "last_seen_run", "provider_id", "is_absent", "absent_since")


@query(_MERGED_SQL)
def streaming_absence(spark, sf_dir):
    """merge_collector_run again, by keyed state of a stream: sightings in several micro-batches, runs' closings in those after them, and one delivery of each
    that comes again."""
    from .streaming import absence

    base = _folder(spark, "absence")
    events, cut = table(spark, sf_dir, "events"), F.lit("2024-01-15").cast("timestamp")
    first, user = F.col("ts") < cut, F.col("user_id")
    no = lambda t: F.lit(None).cast(t)
    sightings = events.filter(first | (user % 17 != 0)).select(
        F.lit("t").alias("tenant_id"), F.when(first & (user % 2 == 1), "odd").otherwise("even").alias("collector"), F.when(first, 1).otherwise(2).cast("long").alias("run"), F.lit(absence.SEEN).alias("event"),
        F.lit("User").alias("kind"), F.lit("x").alias("scope"), F.concat(F.lit("u-"), user.cast("string")).alias("name"), F.col("event_id").cast("string").alias("provider_id"), F.col("event_id").alias("position"), no("boolean").alias("entitled"), F.col("ts").cast("timestamp").alias("at"),
    )
    ended = spark.createDataFrame([("odd", 1, True), ("even", 1, True), ("odd", 2, False), ("even", 2, True)], "collector string, run long, entitled boolean")
    closings = ended.select(F.lit("t").alias("tenant_id"), "collector", "run", F.lit(absence.CLOSED).alias("event"), *[no("string").alias(c) for c in ("kind", "scope", "name", "provider_id")], no("long").alias("position"), "entitled", F.lit("2024-02-01").cast("timestamp").alias("at"))
    cores = spark.sparkContext.defaultParallelism
    for rows in (sightings.repartition(3 * cores), closings.coalesce(1), sightings.filter("run = 1").repartition(cores), closings.coalesce(1)):
        rows.write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(absence.OBSERVATION).option("maxFilesPerTrigger", 2 * cores).parquet(f"{base}/in")
    absence.observe_plane(stream, f"{base}/log", 16 * cores, lambda changes, _: changes.write.mode("append").parquet(f"{base}/changes"), tasks=2 * cores).awaitTermination()
    plane = absence.plane_of(spark, f"{base}/log")
    return plane.select("name", F.concat(F.lit("run-"), F.col("last_seen_run").cast("string")).alias("last_seen_run"), "provider_id", "is_absent", "absent_since")


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS revision FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def active_revision_plane(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("t").alias("tenant_id"), F.year("o_orderdate").alias("revision_id"))
    known = orders.groupBy("tenant_id", "revision_id").count()
    newest = known.groupBy("tenant_id").agg(F.max("revision_id").alias("newest"))
    table_ = known.join(newest, "tenant_id").select("tenant_id", "revision_id", (F.col("revision_id") == F.col("newest")).alias("is_active"))
    return revisions.active_plane(orders, table_).select("o_orderkey", F.col("revision_id").alias("revision"))


# -------------------------------------------------------------------------------------------------------- read model


@query(f"WITH {PART_SQL} SELECT scope, name FROM dis ORDER BY scope, name LIMIT 50 OFFSET 50")
def resources_page(spark, sf_dir):
    return readmodel.resources_page(part_discovered(spark, sf_dir), 50).select("scope", "name")


@query(f"WITH {PART_SQL} SELECT discrepancy_type, scope, name, field_name FROM diffs ORDER BY kind, scope, name, field_name NULLS LAST, tenant_id, discrepancy_type LIMIT 50 OFFSET 50")
def discrepancies_page(spark, sf_dir):
    return readmodel.discrepancies_page(diffing.as_open_rows(reconcile_discrepancies(spark, sf_dir)), OPEN, 50).select("discrepancy_type", "scope", "name", "field_name")


@query(f"WITH {PART_SQL} SELECT count(*) AS total FROM diffs")
def page_total(spark, sf_dir):
    return reconcile_discrepancies(spark, sf_dir).agg(F.count("*").alias("total"))


@query(f"""WITH {PART_SQL} SELECT scope, name, field_name, CASE WHEN declared_present IS NULL THEN '—' WHEN NOT declared_present THEN 'not stated' ELSE declared_value END AS declared,
CASE WHEN discovered_present IS NULL THEN '—' WHEN NOT discovered_present THEN 'not stated' ELSE discovered_value END AS discovered FROM diffs""")
def plane_text(spark, sf_dir):
    shown = [diffing.plane_text(F.col(f"{s}_present"), F.col(f"{s}_value")).alias(s) for s in ("declared", "discovered")]
    return reconcile_discrepancies(spark, sf_dir).select("scope", "name", "field_name", *shown)


@query(f"WITH {PART_SQL} SELECT scope, name, field_name, declared_present AS present, discovered_value AS value FROM diffs")
def serialised_rows(spark, sf_dir):
    rows = readmodel.serialised(reconcile_discrepancies(spark, sf_dir))
    return rows.select("scope", "name", "field_name", F.col("declared.present").alias("present"), F.col("discovered.value").alias("value"))


@query("SELECT l_orderkey * 10 + l_linenumber AS discrepancy_id, count(*) AS n, max(CASE WHEN l_orderkey % 5 = 0 THEN 'resolved' ELSE 'open' END) AS state FROM lineitem GROUP BY 1")
def resolve_by_id(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("discrepancy_id"), F.lit(OPEN).alias("state"), (F.col("l_orderkey") % 5 == 0).alias("hit"))
    ids = rows.filter("hit").select("discrepancy_id")
    return lifecycle.resolve(rows, ids).groupBy("discrepancy_id").agg(F.count("*").alias("n"), F.max("state").alias("state"))


# ------------------------------------------------------------------------------------------------------- comparisons


def _verdicts(rows: DataFrame, keys: list[str], left: Column, right: Column, config: FieldConfig) -> DataFrame:
    pairs = rows.select(*keys, left.alias("l"), right.alias("r"))
    return pairs.select(*keys, compare.agree(F.col("l"), F.col("r"), config).alias("agree"))


def _compared(name: str, rows: Callable, keys: list[str], config: FieldConfig, sql: str) -> None:
    """Register the comparison of ``rows(spark, sf_dir)``, which gives (frame, left, right)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame, left, right = rows(spark, sf_dir)
        return _verdicts(frame, keys, left, right, config)

    query(sql, name)(run)


_LINE = ["l_orderkey", "l_linenumber"]


def _quantities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    """Quantity as an integer; on the other side more by one at times, a float's text, a quoted number, null, or absent."""
    q, k = F.col("l_quantity").cast("int"), F.col("l_orderkey")
    text = q.cast("string")
    right = F.when(k % 7 == 0, int_value(q + 1)).when(k % 7 == 1, value("float", F.concat(text, F.lit(".0")), num=q)).when(k % 7 == 2, value("str", F.concat(F.lit('"'), text, F.lit('"')), text, q)).when(k % 7 == 3, null_value()).when(k % 7 != 4, int_value(q))
    left = F.when(k % 2 == 0, int_value(q)).when(k % 3 == 0, null_value()).otherwise(int_value(q))
    return table(spark, sf_dir, "lineitem"), left, right


#: Kind, canonical text, text and number of either side, then the rule: both state something and {}, or both are alike in
#: stating nothing.
_VERDICT_SQL = "CASE WHEN lk IN ('absent', 'null') OR rk IN ('absent', 'null') THEN lk = rk ELSE coalesce({}, FALSE) END AS agree"
_QUANTITY_SQL = f"""WITH q AS (SELECT l_orderkey, l_linenumber, l_orderkey AS k, l_quantity::INTEGER AS q FROM lineitem),
kinds AS (SELECT *, CASE WHEN k % 2 <> 0 AND k % 3 = 0 THEN 'null' ELSE 'int' END AS lk, ['int', 'float', 'str', 'null', 'absent', 'int', 'int'][k % 7 + 1] AS rk, CASE WHEN k % 7 = 0 THEN q + 1 ELSE q END AS rn FROM q),
x AS (SELECT *, q::VARCHAR AS lt, q::VARCHAR AS lc, CASE rk WHEN 'float' THEN rn || '.0' ELSE rn::VARCHAR END AS rt, CASE rk WHEN 'float' THEN rn || '.0' WHEN 'str' THEN '"' || rn || '"' ELSE rn::VARCHAR END AS rc FROM kinds)
SELECT l_orderkey, l_linenumber, {_VERDICT_SQL} FROM x"""
_compared("numeric_exact_value", _quantities, _LINE, FieldConfig("numeric", "exact_value"), _QUANTITY_SQL.format("lc = rc"))
_compared("numeric_exact_string", _quantities, _LINE, FieldConfig("numeric", "exact_string"), _QUANTITY_SQL.format("lt = rt"))
_compared("numeric_tolerance", _quantities, _LINE, FieldConfig("numeric", "tolerance(0.5)"), _QUANTITY_SQL.format("abs(q - rn) <= 0.5"))
_compared("numeric_tolerance_wide", _quantities, _LINE, FieldConfig("numeric", "tolerance(1)"), _QUANTITY_SQL.format("abs(q - rn) <= 1"))


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    """Part names; on the other side in capitals, between odd white space, with doubled blanks, or as they are."""
    k, n = F.col("p_partkey"), F.col("p_name")
    other = F.when(k % 4 == 0, F.upper(n)).when(k % 4 == 1, F.concat(F.lit("\t 　"), n, F.lit("  \x1f"))).when(k % 4 == 2, F.replace(n, F.lit(" "), F.lit("  \n"))).otherwise(n)
    return table(spark, sf_dir, "part"), value("str", F.to_json(F.array(n)), n), value("str", F.to_json(F.array(other)), other)


_W = "[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0  -     　]"
_NAME_SQL = """WITH x AS (SELECT p_partkey, p_name AS l, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN chr(9) || ' ' || chr(12288) || p_name || chr(160) || ' ' || chr(31)
WHEN 2 THEN replace(p_name, ' ', '  ' || chr(10)) ELSE p_name END AS r FROM part) SELECT p_partkey, {} AS agree FROM x"""
_strip_sql = lambda c: f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"
_norm_sql = lambda c: f"regexp_replace({_strip_sql(f'lower({c})')}, '{_W}+', ' ', 'g')"
_compared("string_exact", _names, ["p_partkey"], FieldConfig("string", "exact"), _NAME_SQL.format("l = r"))
_compared("string_lowercase", _names, ["p_partkey"], FieldConfig("string", "lowercase"), _NAME_SQL.format("lower(l) = lower(r)"))
_compared("string_trim", _names, ["p_partkey"], FieldConfig("string", "trim"), _NAME_SQL.format(f"{_strip_sql('l')} = {_strip_sql('r')}"))
_compared("string_normalize", _names, ["p_partkey"], FieldConfig("string", "normalize"), _NAME_SQL.format(f"{_norm_sql('l')} = {_norm_sql('r')}"))


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    """A customer's order keys; on the other side reversed, with its first one twice, without its last, or the same."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("a")).withColumn("a", F.transform("a", lambda x: x.cast("string")))
    k, a = F.col("o_custkey"), F.col("a")
    b = F.when(k % 4 == 0, F.reverse(a)).when(k % 4 == 1, F.concat(a, F.slice(a, 1, 1))).when(k % 4 == 2, F.slice(a, 1, F.size(a) - 1)).otherwise(a)

    def as_list(x: Column) -> Column:
        canon = F.concat(F.lit("["), F.array_join(x, ", "), F.lit("]"))
        return value("list", canon).withField("elems", x)

    return rows, as_list(a), as_list(b)


_LIST_SQL = """WITH x AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a FROM orders GROUP BY 1), y AS (SELECT o_custkey, a, CASE o_custkey % 4 WHEN 0 THEN list_reverse(a)
WHEN 1 THEN list_append(a, a[1]) WHEN 2 THEN a[1:len(a) - 1] ELSE a END AS b FROM x) SELECT o_custkey, {} AS agree FROM y"""
_compared("list_ordered", _lists, ["o_custkey"], FieldConfig("list", "ordered", element_comparison="exact"), _LIST_SQL.format("a = b"))
_compared("list_multiset", _lists, ["o_custkey"], FieldConfig("list", "unordered_multiset", element_comparison="exact"), _LIST_SQL.format("list_sort(a) = list_sort(b)"))
_compared("list_set", _lists, ["o_custkey"], FieldConfig("list", "set", element_comparison="exact"), _LIST_SQL.format("list_sort(list_distinct(a)) = list_sort(list_distinct(b))"))


def _moments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    """Event times; on the other side 37 seconds, 20 minutes or 5 hours later, or an hour ahead with that zone named."""
    k, ts = F.col("event_id"), F.col("ts")
    later = lambda s: F.date_format(ts + F.expr(f"interval {s}"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    right = F.when(k % 4 == 0, later("37 seconds")).when(k % 4 == 1, later("20 minutes")).when(k % 4 == 2, later("5 hours")).otherwise(F.date_format(ts + F.expr("interval 1 hour"), "yyyy-MM-dd'T'HH:mm:ss'+01:00'"))
    as_text = lambda x: value("str", F.concat(F.lit('"'), x, F.lit('"')), x)
    return table(spark, sf_dir, "events"), as_text(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")), as_text(right)


_TIME_SQL = """WITH x AS (SELECT event_id, date_trunc('second', ts) AS a, date_trunc('second', ts) + CASE event_id % 4 WHEN 0 THEN INTERVAL 37 SECOND WHEN 1 THEN INTERVAL 20 MINUTE WHEN 2 THEN INTERVAL 5 HOUR
ELSE INTERVAL 0 SECOND END AS b FROM events),
t AS (SELECT *, strftime(a, '%Y-%m-%dT%H:%M:%SZ') AS ltext, CASE event_id % 4 WHEN 3 THEN strftime(b + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S+01:00') ELSE strftime(b, '%Y-%m-%dT%H:%M:%SZ') END AS rtext FROM x)
SELECT event_id, {} AS agree FROM t"""
_compared("timestamp_string", _moments, ["event_id"], FieldConfig("timestamp", "string"), _TIME_SQL.format("ltext = rtext"))
for _p in ("day", "hour", "minute", "second"):
    _compared(f"timestamp_utc_{_p}", _moments, ["event_id"], FieldConfig("timestamp", "semantic_utc", precision=_p), _TIME_SQL.format(f"date_trunc('{_p}', a) = date_trunc('{_p}', b)"))
_compared("timestamp_resource_tz", _moments, ["event_id"], FieldConfig("timestamp", "semantic_resource_tz", precision="hour"), _TIME_SQL.format("date_trunc('hour', a) = date_trunc('hour', b)"))


def _objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    """{"id": k, "version": value's whole part, "x": {"y": user}}; on the other side another version as text, no id, or
    another y, encoded by the barricade."""
    k, v, u = F.col("event_id").cast("string"), F.floor("value").cast("string"), F.col("user_id")
    doc = lambda i, w, y: F.concat(F.lit('{"v": {'), i, F.lit('"version": '), w, F.lit(', "x": {"y": '), y.cast("string"), F.lit("}}}"))
    ident = F.concat(F.lit('"id": '), k, F.lit(", "))
    m = F.col("event_id") % 4
    left = doc(ident, v, u)
    right = F.when(m == 0, doc(ident, F.concat(F.lit('"'), v, F.lit('"')), u)).when(m == 1, doc(F.lit(""), v, u)).when(m == 2, doc(ident, v, u + 1)).otherwise(left)
    rows = table(spark, sf_dir, "events").select("event_id", encoded(left)["attributes"]["v"].alias("a"), encoded(right)["attributes"]["v"].alias("b"))
    return rows, F.col("a"), F.col("b")


_OBJECTS_SQL = """parts AS (SELECT event_id, floor(value)::BIGINT AS v, user_id AS u, event_id % 4 AS m FROM events),
x AS (SELECT event_id, m, '{"id": ' || event_id || ', "version": ' || v || ', "x": {"y": ' || u || '}}' AS l,
  '{' || CASE m WHEN 1 THEN '' ELSE '"id": ' || event_id || ', ' END || '"version": ' || CASE m WHEN 0 THEN '"' || v || '"' ELSE v::VARCHAR END || ', "x": {"y": ' || CASE m WHEN 2 THEN u + 1 ELSE u END || '}}' AS r FROM parts)"""
_OBJECT_SQL = f"WITH {_OBJECTS_SQL.replace('{', '{{').replace('}', '}}')} SELECT event_id, {{}} AS agree FROM x"
_STATED = "json_extract_string(l, '$.{0}') IS NOT DISTINCT FROM json_extract_string(r, '$.{0}')"
for _mode, _sql in (("opaque", "l = r"), ("version", _STATED.format("version")), ("identity", _STATED.format("id")), ("ignore", "TRUE"), ("recurse(1)", "l = r")):
    _compared(f"object_{_mode.split('(')[0]}", _objects, ["event_id"], FieldConfig("object", _mode), _OBJECT_SQL.format(_sql))


@query(f"""WITH {_OBJECTS_SQL} SELECT event_id, CASE WHEN json_extract(l, '$.id') IS DISTINCT FROM json_extract(r, '$.id') THEN 'id' WHEN json_extract(l, '$.version') IS DISTINCT FROM json_extract(r, '$.version') THEN 'version'
WHEN json_extract(l, '$.x.y') IS DISTINCT FROM json_extract(r, '$.x.y') THEN 'x.y' END AS path FROM x""")
def object_recurse_path(spark, sf_dir):
    rows, left, right = _objects(spark, sf_dir)
    return rows.select("event_id", compare.first_divergence(left["canon"], right["canon"], F.lit(2)).alias("path"))


@query("""WITH x AS (SELECT event_id, 'bool' AS lk, (value > 50)::VARCHAR AS lc, CASE event_id % 5 WHEN 1 THEN 'int' WHEN 2 THEN 'null' ELSE 'bool' END AS rk,
CASE event_id % 5 WHEN 1 THEN (value > 50)::INTEGER::VARCHAR WHEN 2 THEN 'null' ELSE (value > 50 + event_id % 5)::VARCHAR END AS rc FROM events)
SELECT event_id, CASE WHEN lk = 'bool' AND rk = 'bool' THEN lc = rc ELSE lk = rk AND rk IN ('absent', 'null') END AS agree FROM x""")
def boolean_exact(spark, sf_dir):
    m, b = F.col("event_id") % 5, F.col("value") > 50
    right = F.when(m == 1, int_value(b.cast("int"))).when(m == 2, null_value()).otherwise(bool_value(F.col("value") > 50 + m))
    return _verdicts(table(spark, sf_dir, "events"), ["event_id"], bool_value(b), right, FieldConfig("boolean", "exact"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(t, '^[+-]?(0|[1-9][0-9]*)$') THEN ltrim(t, '+') END AS literal FROM (
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '+' || p_size WHEN 1 THEN '0' || p_size WHEN 2 THEN '-' || p_size WHEN 3 THEN p_size || '.0' ELSE p_size::VARCHAR END AS t FROM part)""")
def declared_int_literal(spark, sf_dir):
    m, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(m == 0, F.concat(F.lit("+"), s)).when(m == 1, F.concat(F.lit("0"), s)).when(m == 2, F.concat(F.lit("-"), s)).when(m == 3, F.concat(s, F.lit(".0"))).otherwise(s)
    return table(spark, sf_dir, "part").select("p_partkey", int_literal(text).alias("literal"))


@query("""SELECT p_partkey, CASE ['true', 'false', 'yes', 'True', '1'][p_partkey % 5 + 1] WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS literal FROM part""")
def declared_bool_literal(spark, sf_dir):
    spelt = F.array(*[F.lit(x) for x in ("true", "false", "yes", "True", "1")])
    return table(spark, sf_dir, "part").select("p_partkey", bool_literal(F.element_at(spelt, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("literal"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS canon, 'int' AS kind FROM events")
def json_barricade(spark, sf_dir):
    """JSON texts through the barricade: kind and canonical form of a value."""
    rows = table(spark, sf_dir, "events").select("event_id", encoded(F.col("props"))["attributes"]["k"].alias("v"))
    return rows.select("event_id", F.col("v.canon").alias("canon"), F.col("v.kind").alias("kind"))


@query(r"""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"k": NaN}' WHEN 1 THEN '{"k": "a\u0000b"}' ELSE props END AS text FROM events)
SELECT event_id, CASE WHEN regexp_matches(text, ': *NaN') THEN 'k: nan is not a finite number' WHEN contains(text, '\u0000') THEN 'k: U+0000 cannot be stored' END AS problem FROM x""")
def json_barricade_problems(spark, sf_dir):
    m = F.col("event_id") % 4
    text = F.when(m == 0, F.lit('{"k": NaN}')).when(m == 1, F.lit('{"k": "a\\u0000b"}')).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", encoded(text)["problem"].alias("problem"))


# -------------------------------------------------------------------------------------------- precedence and lifecycle

_RULES = [(1, "Part", "size", "declared"), (2, "Part", "type", "discovered")]


def _precedence(active: list) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = spark.createDataFrame(active, "rule_id int, kind string, field_name string, operator string")
        return lifecycle.with_precedence(reconcile_discrepancies(spark, sf_dir), rules).select("scope", "name", "field_name", "rule_id", "winning_value", "undecidable")

    return run


_DECIDED_SQL = """SELECT d.scope, d.name, d.field_name, {} AS rule_id, CASE r.operator WHEN 'declared' THEN declared_value WHEN 'discovered' THEN discovered_value END AS winning_value, r.operator IS NULL AS undecidable
FROM {} d LEFT JOIN (VALUES {}) r(rule_id, kind, field_name, operator) ON {}"""


def _decided_sql(active: list) -> str:
    return f"WITH {PART_SQL} " + _DECIDED_SQL.format("r.rule_id::INTEGER", "diffs", ", ".join(map(str, active)), "r.kind = d.kind AND r.field_name = d.field_name")


query(_decided_sql(_RULES), "precedence_current")(_precedence(_RULES))
_RECORDED_SQL = "(SELECT *, CASE field_name WHEN 'size' THEN 1 WHEN 'type' THEN CASE WHEN length(name) % 2 = 0 THEN 2 ELSE 9 END END::INTEGER AS decided_by FROM diffs)"


@query(f"WITH {PART_SQL} " + _DECIDED_SQL.format("d.decided_by", _RECORDED_SQL, ", ".join(map(str, [*_RULES, (9, "Part", "type", "declared")])), "r.rule_id = d.decided_by"))
def precedence_historical(spark, sf_dir):
    """By the rule that each discrepancy was decided by, also one no longer in force (9)."""
    rules = spark.createDataFrame([*_RULES, (9, "Part", "type", "declared")], "rule_id int, kind string, field_name string, operator string")
    by = F.when(F.col("field_name") == "size", 1).when(F.col("field_name") == "type", F.when(F.length("name") % 2 == 0, 2).otherwise(9)).cast("int")
    return lifecycle.by_recorded_rule(reconcile_discrepancies(spark, sf_dir).withColumn("rule_id", by), rules).select("scope", "name", "field_name", "rule_id", "winning_value", "undecidable")


_NOW = "2024-06-30"


def _estate_sql(name: str, declared: str, discovered: str) -> str:
    """Discrepancies of the part estate as CTEs: those parts on each side, and one pairing in nineteen rejected."""
    return f"""{name}_dec AS (SELECT * FROM dec WHERE {declared}), {name}_dis AS (SELECT * FROM dis WHERE {discovered}),
{name}_pairs AS (SELECT d.scope, d.name FROM {name}_dec d JOIN {name}_dis x ON x.scope = d.scope AND x.name = d.name WHERE d.k % 19 <> 3),
{name} AS (
  SELECT 'field' AS discrepancy_type, f.scope, f.name, field_name, l AS declared_value, r AS discovered_value FROM fields f JOIN {name}_pairs USING (scope, name) WHERE l IS DISTINCT FROM r
  UNION ALL SELECT 'declared_missing', scope, name, NULL, NULL, NULL FROM {name}_dec d WHERE NOT EXISTS (SELECT 1 FROM {name}_pairs p WHERE p.scope = d.scope AND p.name = d.name)
  UNION ALL SELECT 'discovered_undeclared', scope, name, NULL, NULL, NULL FROM {name}_dis x WHERE NOT EXISTS (SELECT 1 FROM {name}_pairs p WHERE p.scope = x.scope AND p.name = x.name))"""


_NEXT_SQL = f"""WITH {PART_SQL}, {_estate_sql('before', 'TRUE', 'TRUE')}, {_estate_sql('detected', 'k % 4 <> 1', 'k % 5 <> 2')},
existing AS (
  SELECT *, ['open', 'resolved', 'suppressed', 'suppressed', 'invalidated', 'muted', 'suppressed', 'open'][h + 1] AS state, CASE h WHEN 2 THEN TIMESTAMP '2024-01-01' WHEN 3 THEN TIMESTAMP '2025-01-01' END AS expires_at
  FROM (SELECT *, split_part(name, '-', 2)::BIGINT % 8 AS h FROM before)),
active AS (
  SELECT *, NOT EXISTS (SELECT 1 FROM detected_dec d WHERE d.scope = e.scope AND d.name = e.name) AS gone, NOT EXISTS (SELECT 1 FROM detected_dis x WHERE x.scope = e.scope AND x.name = e.name) AS absent
  FROM existing e WHERE state NOT IN ('invalidated', 'muted')),
joined AS (
  SELECT coalesce(e.discrepancy_type, d.discrepancy_type) AS discrepancy_type, coalesce(e.scope, d.scope) AS scope, coalesce(e.name, d.name) AS name, coalesce(e.field_name, d.field_name) AS field_name,
    e.state AS old, d.name IS NOT NULL AS found, e.expires_at, e.gone, e.absent FROM active e FULL JOIN detected d
    ON e.discrepancy_type = d.discrepancy_type AND e.scope = d.scope AND e.name = d.name AND e.field_name IS NOT DISTINCT FROM d.field_name),
moved AS (
  SELECT *, CASE WHEN old IS NULL THEN 'open' WHEN found AND old = 'suppressed' AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{_NOW}') THEN 'suppressed' WHEN found THEN 'open'
    WHEN old = 'open' AND gone AND discrepancy_type <> 'discovered_undeclared' THEN 'invalidated' WHEN old = 'open' AND absent AND discrepancy_type <> 'declared_missing' THEN 'muted' ELSE old END AS state FROM joined),
nxt AS (
  SELECT discrepancy_type, scope, name, field_name, state, CASE WHEN old IS DISTINCT FROM state OR (found AND old = 'suppressed') THEN coalesce(old, 'none') || '>' || state END AS transition FROM moved
  UNION ALL SELECT discrepancy_type, scope, name, field_name, state, NULL FROM existing WHERE state IN ('invalidated', 'muted'))
SELECT * FROM nxt"""


def _next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run over the estate, whose discrepancies people and earlier runs have put in all states, then a second one
    over an estate from which parts have gone on either side. Of a rejected pairing both sides are orphans of one key."""
    declared, discovered = part_declared(spark, sf_dir), part_discovered(spark, sf_dir)
    k = F.split("name", "-")[1].cast("long")
    refused = table(spark, sf_dir, "part").filter("p_partkey % 19 = 3").select(*part_keys(), F.concat(F.lit("id-"), F.col("p_partkey").cast("string")).alias("provider_id"), F.lit(False).alias("is_confirmed"))

    def found(d: DataFrame, x: DataFrame) -> DataFrame:
        return diffing.reconcile(matching.match_resources(d, x, refused))

    states = [OPEN, RESOLVED, SUPPRESSED, SUPPRESSED, "invalidated", "muted", SUPPRESSED, OPEN]
    existing = found(declared, discovered).withColumns({
        "state": F.element_at(F.array(*map(F.lit, states)), (k % 8 + 1).cast("int")),
        "expires_at": F.when(k % 8 == 2, F.lit("2024-01-01").cast("timestamp")).when(k % 8 == 3, F.lit("2025-01-01").cast("timestamp")),
    })
    now_declared, now_discovered = declared.filter(k % 4 != 1), matching.present(discovered.withColumn("is_absent", k % 5 == 2))
    return lifecycle.next_states(existing, found(now_declared, now_discovered), now_declared, now_discovered, F.lit(_NOW).cast("timestamp"))


_STATE = ["discrepancy_type", "scope", "name", "field_name", "state", "transition"]


@query(_NEXT_SQL)
def lifecycle_next_states(spark, sf_dir):
    return _next(spark, sf_dir).select(*_STATE)


@query(f"SELECT * FROM ({_NEXT_SQL}) WHERE transition = 'resolved>open' OR transition = 'none>open'")
def lifecycle_rediscovery(spark, sf_dir):
    return _next(spark, sf_dir).select(*_STATE).filter(F.col("transition").isin("resolved>open", "none>open"))


@query(f"SELECT * FROM ({_NEXT_SQL}) WHERE state = 'suppressed' OR transition = 'suppressed>open'")
def lifecycle_expiry(spark, sf_dir):
    return _next(spark, sf_dir).select(*_STATE).filter("state = 'suppressed' or transition = 'suppressed>open'")


@query(f"SELECT * FROM ({_NEXT_SQL}) WHERE state IN ('invalidated', 'muted')")
def lifecycle_closure(spark, sf_dir):
    return _next(spark, sf_dir).select(*_STATE).filter(F.col("state").isin("invalidated", "muted"))


@query(f"SELECT discrepancy_type, scope, name, field_name, split_part(transition, '>', 1) AS from_state, split_part(transition, '>', 2) AS to_state, 'system' AS actor, 'run-2' AS run_id FROM ({_NEXT_SQL}) WHERE transition IS NOT NULL")
def lifecycle_transitions(spark, sf_dir):
    """What the second run appends to the history."""
    rows = lifecycle.transitions(_next(spark, sf_dir), "run-2", F.lit(_NOW).cast("timestamp"))
    return rows.select("discrepancy_type", "scope", "name", "field_name", "from_state", "to_state", "actor", "run_id")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'muted' END AS state FROM events WHERE event_id % 3 = 0 OR NOT ts < TIMESTAMP '2024-04-15' - INTERVAL 90 DAY""")
def retention_purge(spark, sf_dir):
    m = F.col("event_id") % 3
    rows = table(spark, sf_dir, "events").select("event_id", F.when(m == 0, OPEN).when(m == 1, RESOLVED).otherwise("muted").alias("state"), F.col("ts").alias("state_since"))
    return lifecycle.retained(rows, F.lit("2024-04-15").cast("timestamp")).drop("state_since")


_SIZES, _TYPES = FieldConfig("numeric", "tolerance(1)"), FieldConfig("string", "exact")
_SIZE_SQL, _TYPE_SQL = "coalesce(abs(TRY_CAST(l AS INTEGER) - TRY_CAST(r AS INTEGER)) <= 1, FALSE)", "(l IS NOT NULL AND r IS NOT NULL AND l = r)"


@query(f"""WITH {PART_SQL}, judged AS (SELECT *, CASE field_name WHEN 'size' THEN {_SIZE_SQL} ELSE {_TYPE_SQL} END AS agree FROM fields)
SELECT scope, name, field_name, l AS declared_value, agree, CASE field_name WHEN 'size' THEN 'discrepancy' ELSE 'debug' END AS logging FROM judged WHERE field_name = 'type' OR NOT agree""")
def audit_by_logging_level(spark, sf_dir):
    """What the audit keeps by the fields' own levels: every comparison at debug, only differences at discrepancy."""
    schema = ComparisonSchema({("Part", "size"): _SIZES, ("Part", "type"): FieldConfig("string", "exact", logging="debug")})
    return diffing.audit(_part_match(spark, sf_dir).pairs, schema).select("scope", "name", "field_name", "declared_value", "agree", "logging")


@query(f"""WITH {PART_SQL}, judged AS (SELECT *, field_name = 'type' AND {_TYPE_SQL} AS agree, ('0x' || substr(md5('Part/t/' || scope || '/' || name || '/' || field_name), 1, 8))::BIGINT % 10 = 0 AS drawn FROM fields)
SELECT scope, name, field_name, agree, CASE field_name WHEN 'type' THEN 'sampled' ELSE 'error' END AS logging FROM judged WHERE (field_name = 'type' AND drawn) OR field_name = 'size'""")
def audit_sampled(spark, sf_dir):
    """One comparison in ten of a sampled field; all of a field without settings, as discrepancies."""
    schema = ComparisonSchema({("Part", "type"): FieldConfig("string", "exact", logging="sampled")})
    return diffing.audit(_part_match(spark, sf_dir).pairs, schema, 10).select("scope", "name", "field_name", "agree", "logging")


@query(f"WITH {PART_SQL} SELECT scope, name, field_name FROM fields WHERE NOT CASE field_name WHEN 'size' THEN {_SIZE_SQL} ELSE {_TYPE_SQL} END")
def schema_driven_diff(spark, sf_dir):
    """Sizes may differ by one, types have to be equal."""
    schema = ComparisonSchema({("Part", "size"): _SIZES, ("Part", "type"): _TYPES})
    return diffing.field_discrepancies(_part_match(spark, sf_dir).pairs, schema).select("scope", "name", "field_name")


@query(f"WITH {PART_SQL} SELECT 'Part' AS kind, field_name, count(*) AS n FROM fields WHERE field_name <> 'size' GROUP BY ALL")
def schema_missing_settings(spark, sf_dir):
    """Fields that a schema forgets: what a run logs about them."""
    return compare.missing_settings(diffing.attribute_pairs(_part_match(spark, sf_dir).pairs), ComparisonSchema({("Part", "size"): _SIZES}))


@query(f"WITH {PART_SQL} SELECT scope, name, field_name FROM fields WHERE field_name <> 'size' OR NOT {_SIZE_SQL}")
def schema_missing_diff(spark, sf_dir):
    """Values of a field without settings are discrepancies, equal or not."""
    return diffing.field_discrepancies(_part_match(spark, sf_dir).pairs, ComparisonSchema({("Part", "size"): _SIZES})).select("scope", "name", "field_name")


@query("""WITH d AS (SELECT 'part-' || p_partkey || '.yaml' AS source, p_brand AS scope, 'part-' || (p_partkey - p_partkey % 50 % 2) AS name, CASE WHEN p_partkey % 10 = 3 THEN '007' ELSE p_size::VARCHAR END AS size FROM part),
judged AS (SELECT *, regexp_matches(size, '^[+-]?(0|[1-9][0-9]*)$') AS good FROM d)
SELECT source, 7::INTEGER AS line, 'attributes.size: ''' || size || ''' is not an integer' AS message FROM judged WHERE NOT good
UNION ALL SELECT min(source), NULL, 'declared more than once: Part/t/' || scope || '/' || name || ' in ' || string_agg(source, ',' ORDER BY source) FROM judged WHERE good GROUP BY scope, name HAVING count(*) > 1""")
def yaml_barricade(spark, sf_dir):
    """Documents made of parts, some broken, through the per-document checks and the check of the whole set."""
    from .sources.documents import parse_documents, revision_errors

    k = F.col("p_partkey")
    body = F.concat(F.lit("apiVersion: planes.example/v1\nkind: Part\nmetadata:\n  name: part-"), (k - k % 50 % 2).cast("string"), F.lit("\n  scope: "), F.col("p_brand"), F.lit("\nattributes:\n  size: "), F.when(k % 10 == 3, F.lit("007")).otherwise(F.col("p_size").cast("string")), F.lit("\n"))
    docs = table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), k.cast("string"), F.lit(".yaml")).alias("source"), F.encode(body, "UTF-8").alias("content"))
    return revision_errors(parse_documents(docs, "t", "planes.example/v1", {"Part": {"size": "int"}}))


# ------------------------------------------------------------------------------------ orders, pages and ids that stay


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder of a query, deleted when the process ends."""
    return passing(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


#: Line numbers repeat within an order, so that the order needs a third column; rows that agree in all of them are alike.
_PAGED = ["l_orderkey", "l_linenumber", "l_quantity"]


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity LIMIT 50 OFFSET 50000")
def page_by_index(spark, sf_dir):
    """Page 1000 of all line items: they are written in order once, and the page opens the files that its index names."""
    path = _folder(spark, "pages")
    ordered.write_in_order(table(spark, sf_dir, "lineitem").select(*_PAGED), path, _PAGED, 5000)
    return ordered.page(spark, path, _PAGED, 50_000, 50)


@query("SELECT count(*) AS total, count(*) - (SELECT count(*) FROM lineitem WHERE l_orderkey % 2 = 0) AS odd FROM lineitem")
def page_totals_by_index(spark, sf_dir):
    """Totals of two tables from their indexes."""
    rows = table(spark, sf_dir, "lineitem").select(*_PAGED)
    totals = []
    for part in (rows, rows.filter("l_orderkey % 2 = 1")):
        ordered.write_in_order(part, path := _folder(spark, "totals"), _PAGED, 5000)
        totals.append(ordered.page_total(spark, path))
    return spark.createDataFrame([tuple(totals)], "total long, odd long")


@query(f"""WITH {CUSTOMER_SQL} SELECT row_number() OVER (ORDER BY scope, name, provider_id) AS position, scope, name, provider_id FROM decisions WHERE is_confirmed""")
def ordered_decisions(spark, sf_dir):
    """Confirmed decisions by declared key, then provider id."""
    rows = customer_decisions(spark, sf_dir).filter("is_confirmed").drop("is_confirmed")
    return ordered.positions(rows, _folder(spark, "decisions"), [*KEY, "provider_id"], rows_per_file=200).select("position", "scope", "name", "provider_id")


@query(f"""WITH {CUSTOMER_SQL},
o AS (SELECT 'declared' AS plane, scope, name FROM dec WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.scope = dec.scope AND p.name = dec.name)
  UNION ALL SELECT 'discovered', scope, name FROM dis WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.discovered_scope = dis.scope AND p.discovered_name = dis.name))
SELECT row_number() OVER (ORDER BY plane, scope, name) AS position, plane, scope, name FROM o""")
def ordered_orphans(spark, sf_dir):
    """Orphans of both sides, each in key order."""
    return ordered.positions(orphans_after_decisions(spark, sf_dir), _folder(spark, "orphans"), ["plane", "scope", "name"], rows_per_file=50)


@query(f"WITH {PART_SQL} SELECT row_number() OVER (ORDER BY scope, name, field_name) AS position, scope, name, field_name, l AS declared_value, r AS discovered_value FROM fields")
def ordered_fields(spark, sf_dir):
    """Every field of every pair: pairs by key, fields by name inside a pair."""
    rows = diffing.attribute_pairs(_part_match(spark, sf_dir).pairs).select(*KEY, "field_name", F.col("l.canon").alias("declared_value"), F.col("r.canon").alias("discovered_value"))
    return ordered.positions(rows, _folder(spark, "fields"), [*KEY, "field_name"], rows_per_file=500).drop("kind", "tenant_id")


@query("""WITH runs AS (SELECT c_nationkey % 3 AS run, c_mktsegment AS segment, c_name AS name FROM customer),
firsts AS (SELECT segment, name, min(run) AS run FROM runs GROUP BY ALL)
SELECT segment, name, row_number() OVER (ORDER BY run, segment, name) AS row_id FROM firsts""")
def row_ids(spark, sf_dir):
    """Three runs over different customers, the first one again at the end: ids are given once, and stay."""
    keys, ids = ["segment", "name"], None
    rows = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).alias("run"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    for run in (0, 1, 2, 0):
        ids = ordered.kept_ids(rows.filter(F.col("run") == run), keys, _folder(spark, "ids"), ids)
    return ids


@query(f"""WITH {CUSTOMER_SQL}, d AS (SELECT *, row_number() OVER (ORDER BY scope, name) AS id FROM dec), x AS (SELECT *, row_number() OVER (ORDER BY scope, name) AS id FROM dis)
SELECT p.scope, p.name, p.provider_id, d.id AS declared_row_id, x.id AS discovered_row_id FROM pairs p JOIN d ON d.scope = p.scope AND d.name = p.name JOIN x ON x.scope = p.discovered_scope AND x.name = p.discovered_name""")
def pair_row_ids(spark, sf_dir):
    """Pairs carry the ids of the two rows that they join."""
    declared, discovered, decided = _customer(spark, sf_dir)
    ids = [ordered.kept_ids(side, KEY, _folder(spark, "ids")) for side in (declared, discovered)]
    return matching.with_row_ids(matching.match_resources(declared, discovered, decided).pairs, *ids).select("scope", "name", "provider_id", "declared_row_id", "discovered_row_id")


# ------------------------------------------------------------------------------------- documents and provider payloads

_GOOD = ["apiVersion: planes.example/v1", "kind: Part", "metadata:", "  name: {name}", "  scope: {scope}", "attributes:", "  size: {size}", '  label: "{type}"', "  fragile: {fragile}"]
_V = "planes.example/v1"
_TEXT = "is not a text of 1 to 253 characters"


def _edited(drop: range | tuple = (), **lines: str) -> str:
    """The good document without the lines ``drop``, with others (n1="...": line 1) replaced, the last one (add="...") added; lines count from 1."""
    out = [lines.get(f"n{i}", line) for i, line in enumerate(_GOOD, 1) if i not in drop]
    return "\n".join([*out, *([lines["add"]] if "add" in lines else [])]) + "\n"


#: A document with every fault that one can have, the line and what is said about it (None: it is good).
_DOCUMENTS: list[tuple[str, int | None, str | None]] = [
    (_edited(), None, None),
    (_edited(n7="  size: null"), None, None),
    (_edited(n8="  label: '007'", n7='  size: "12"'), None, None),
    (_edited(n1="apiVersion: planes.example/v2"), 1, f"apiVersion is not {_V}"),
    (_edited((1,)), 1, f"apiVersion is not {_V}"),
    (_edited(add="provider_id: x"), 10, "provider_id cannot be declared"),
    (_edited(n5="  scope: {scope}\n  provider_id: x"), 6, "metadata.provider_id cannot be declared"),
    (_edited(range(3, 6)), 1, "metadata is missing"),
    (_edited((4,)), 4, "metadata.name is missing"),
    (_edited(n4="  name: 007"), 4, f"metadata.name {_TEXT}"),
    (_edited(n4='  name: ""'), 4, f"metadata.name {_TEXT}"),
    (_edited(n5="  scope: " + "x" * 254), 5, f"metadata.scope {_TEXT}"),
    (_edited((4, 5), n3="metadata: text"), 3, "metadata is not a mapping"),
    (_edited(add="---\nkind: Part"), None, "2 documents where one is due"),
    ("", None, "0 documents where one is due"),
    (_edited(add="kind: Part"), 10, "the document repeats the key kind"),
    (_edited(n5="  scope: {scope}\n  <<: {{a: 1}}"), 6, "metadata uses a merge key"),
    (_edited(n6="attributes: !x"), 6, "attributes has the tag !x"),
    (_edited(add="? [a]\n: b"), 10, "the document has a structure as a key"),
    (_edited(n2="kind: Gadget"), 2, "unknown kind Gadget"),
    (_edited(n9="  color: red"), 6, "missing attributes: fragile; unknown attributes: color"),
    (_edited((8, 9), n2="kind: Odd"), 7, "the kind gives attributes.size the unknown type decimal"),
    (_edited(n7="  size: [1]"), 7, "attributes.size is not a scalar"),
    (_edited(n7="  size:"), 7, "attributes.size is empty; write null or a quoted text"),
    (_edited(n7="  size: 0{size}"), 7, "attributes.size: '0{size}' is not an integer"),
    (_edited(n9="  fragile: yes"), 9, "attributes.fragile: 'yes' is neither true nor false"),
    (_edited(range(6, 10)), 1, "attributes is missing"),
    (_edited(add="notes: &a {{b: *a}}"), 10, "notes.b is nested in itself"),
    (_edited(n8='  label: "a\\0b"'), 6, "label: U+0000 cannot be stored"),
    ("- a\n", 1, "the document is not a mapping"),
    (_edited(n3="metadata: ["), None, "unparseable YAML"),
    (_edited(add="notes: *nowhere"), 10, "unparseable YAML"),
]


def _filled(text: str) -> Column:
    """A text with the part's values in its braces."""
    values = {"name": F.concat(F.lit("part-"), F.col("p_partkey").cast("string")), "scope": F.col("p_brand"), "size": F.col("p_size").cast("string"), "type": F.col("p_type"), "fragile": (F.col("p_size") % 2 == 0).cast("string")}
    pieces = [(before, field) for before, field, _, _ in string.Formatter().parse(text)]
    return F.concat(F.lit(""), *[x for before, field in pieces for x in (F.lit(before), *([values[field]] if field else []))])


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of each part; of the texts, only the row's own is put together (an array of them would make all 32 for each row, before rows are spread)."""
    body = F.coalesce(*[F.when(F.col("p_partkey") % len(_DOCUMENTS) == i, _filled(text)) for i, (text, _, _) in enumerate(_DOCUMENTS)])
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.lit(".yaml")).alias("source"), F.encode(body, "UTF-8").alias("content"))


_PART_KINDS = {"Part": {"size": "int", "label": "str", "fragile": "bool"}, "Odd": {"size": "decimal"}}
_FAULTS_SQL = ", ".join(f"({i}, {'NULL' if line is None else line}::INTEGER, '{why.replace(chr(39), chr(39) * 2)}')" for i, (_, line, why) in enumerate(_DOCUMENTS) if why)


@query(f"""SELECT 'part-' || p_partkey || '.yaml' AS source, CASE WHEN message LIKE 'unparseable%' THEN NULL ELSE line END AS line, replace(message, '{{size}}', p_size::VARCHAR) AS message
FROM part JOIN (VALUES {_FAULTS_SQL}) f(fault, line, message) ON p_partkey % {len(_DOCUMENTS)} = fault""")
def broken_documents(spark, sf_dir):
    """Every fault that a document can have, by source and line; what a YAML parser says itself is left out."""
    from .sources.documents import parse_documents

    bad = parse_documents(_documents(spark, sf_dir), "t", _V, _PART_KINDS).filter("error is not null")
    unparseable = F.col("error").startswith("unparseable YAML")
    return bad.select("source", F.when(~unparseable, F.col("line")).alias("line"), F.when(unparseable, "unparseable YAML").otherwise(F.col("error")).alias("message"))


@query(f"""SELECT p_brand AS scope, 'part-' || p_partkey AS name, CASE p_partkey % {len(_DOCUMENTS)} WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'null' ELSE '12' END AS size,
  CASE p_partkey % {len(_DOCUMENTS)} WHEN 2 THEN '"007"' ELSE '"' || p_type || '"' END AS label, (p_size % 2 = 0)::VARCHAR AS fragile, 'r1' AS revision_id FROM part WHERE p_partkey % {len(_DOCUMENTS)} < 3""")
def ingested_revision(spark, sf_dir):
    """The plane of a revision of good documents, ingested, committed and read again."""
    from .sources.documents import ingest_and_commit

    store = _folder(spark, "ingested")
    good = _documents(spark, sf_dir).filter(F.regexp_extract("source", "([0-9]+)", 1).cast("long") % len(_DOCUMENTS) < 3)
    if not ingest_and_commit(spark, "", store, "t", "r1", _V, _PART_KINDS, good) or ingest_and_commit(spark, "", store, "t", "r1", _V, _PART_KINDS, good):
        raise RuntimeError("a revision is committed once")
    plane = revisions.committed_plane(spark, store, "t")
    return plane.select("scope", "name", *[F.col("attributes")[c]["canon"].alias(c) for c in ("size", "label", "fragile")], "revision_id")


def _json_text(x: Column) -> Column:
    """A text as JSON writes it."""
    listed = F.to_json(F.array(x))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _supplier_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a provider, one in eight as it should be; the others lack something, have it elsewhere, or are something else."""
    k = F.col("s_suppkey")
    name, uid, place, n = _json_text(F.col("s_name")), F.concat(F.lit('"u-'), k.cast("string"), F.lit('"')), F.concat(F.lit('"n'), F.col("s_nationkey").cast("string"), F.lit('"')), (k % 5).cast("string")
    meta = lambda u: F.concat(F.lit('{"metadata": {"namespace": '), place, F.lit(', "name": '), name, F.lit(', "uid": '), u, F.lit('}, "spec": '))
    spec = lambda x: F.concat(F.lit('{"replicas": '), x, F.lit("}}"))
    forms = [F.concat(meta(uid), spec(n)), F.concat(meta(uid), F.lit("{}}")), F.concat(F.lit('{"metadata": {}, "spec": '), spec(n)), k.cast("string"), F.concat(meta(uid), spec(F.lit("null"))), F.concat(meta(uid), spec(F.lit("NaN"))), F.concat(meta(k.cast("string")), spec(n)), F.concat(meta(uid), F.lit('"x"}'))]
    return table(spark, sf_dir, "supplier").select(k.alias("position"), F.element_at(F.array(*forms), (k % 8 + 1).cast("int")).alias("record"))


_SUPPLIER_SQL = """s AS (SELECT s_suppkey AS k, s_suppkey % 8 AS m, 'n' || s_nationkey AS place, s_name, s_nationkey FROM supplier),
normal AS (SELECT *, CASE m WHEN 1 THEN 'missing fields: spec.replicas' WHEN 2 THEN 'missing fields: metadata.name, metadata.namespace, metadata.uid' WHEN 3 THEN 'the record is not a mapping'
  WHEN 4 THEN 'missing fields: spec.replicas' WHEN 5 THEN 'replicas: nan is not a finite number' WHEN 7 THEN 'missing fields: spec.replicas' END AS problem FROM s)"""


@query(f"""WITH {_SUPPLIER_SQL} SELECT k AS position, CASE WHEN problem IS NULL THEN place END AS scope, CASE WHEN problem IS NULL THEN s_name END AS name, CASE WHEN problem IS NULL THEN CASE m WHEN 6 THEN k::VARCHAR ELSE 'u-' || k END END AS provider_id,
  CASE WHEN problem IS NULL THEN (k % 5)::VARCHAR END AS replicas, problem FROM normal""")
def normalised_records(spark, sf_dir):
    """Provider records to resources, or to what is wrong with them."""
    from .sources.recorded import DEPLOYMENTS, normalised

    rows = normalised(_supplier_records(spark, sf_dir), DEPLOYMENTS, "t")
    return rows.select("position", "scope", "name", "provider_id", F.col("attributes")["replicas"]["canon"].alias("replicas"), "problem")


@query("""SELECT p_partkey AS position, CASE WHEN p_partkey % 3 <> 2 THEN p_brand END AS scope, CASE WHEN p_partkey % 3 <> 2 THEN 'p-' || p_partkey END AS provider_id, CASE WHEN p_partkey % 3 <> 2 THEN '"' || p_type || '"' END AS shape,
  CASE p_partkey % 3 WHEN 0 THEN p_size || '.0' WHEN 1 THEN p_size::VARCHAR END AS ocpus, CASE WHEN p_partkey % 3 = 2 THEN 'missing fields: id, shape-config.ocpus' END AS problem FROM part""")
def normalised_instances(spark, sf_dir):
    """Instances of another provider: numbers keep how they are written, and nothing else of a record is kept."""
    from .sources.recorded import INSTANCES, normalised

    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    ident = F.when(k % 3 == 2, "null").otherwise(quoted(F.concat(F.lit("p-"), k.cast("string"))))
    config = F.when(k % 3 == 0, F.concat(F.lit('{"ocpus": '), size, F.lit(".0}"))).when(k % 3 == 1, F.concat(F.lit('{"ocpus": '), size, F.lit("}"))).otherwise("null")
    record = F.concat(F.lit('{"compartment-id": '), quoted(F.col("p_brand")), F.lit(', "display-name": '), _json_text(F.col("p_name")), F.lit(', "id": '), ident, F.lit(', "shape": '), quoted(F.col("p_type")), F.lit(', "lifecycle-state": "RUNNING", "shape-config": '), config, F.lit("}"))
    rows = normalised(table(spark, sf_dir, "part").select(k.alias("position"), record.alias("record")), INSTANCES, "t")
    return rows.select("position", "scope", "provider_id", *[F.col("attributes")[c]["canon"].alias(c) for c in ("shape", "ocpus")], "problem")


@query(f"""WITH {_SUPPLIER_SQL}, files AS (SELECT s_nationkey % 5 AS form, count(*) AS n, count(*) FILTER (problem IS NULL) AS good FROM normal GROUP BY s_nationkey)
SELECT sum(CASE form WHEN 0 THEN n WHEN 4 THEN n ELSE 0 END)::BIGINT AS records_read, sum(CASE WHEN form IN (0, 4) THEN good ELSE 0 END)::BIGINT AS records_written, count(*) FILTER (form = 1) AS without_list, count(*) FILTER (form = 2) AS no_json,
  count(*) FILTER (form = 3) AS null_list FROM files""")
def recorded_payloads(spark, sf_dir):
    """Recorded files, one for each nation, of which three in five cannot be read; each says so, and the others are."""
    from .sources.recorded import DEPLOYMENTS, collector

    path = _folder(spark, "recorded")
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("position"), "s_nationkey")
    items = _supplier_records(spark, sf_dir).join(nations, "position").groupBy("s_nationkey").agg(F.array_join(F.collect_list("record"), ", ").alias("items"))
    whole = F.concat(F.lit('{"items": ['), F.col("items"), F.lit("]}"))
    form = F.element_at(F.array(whole, F.lit('{"data": []}'), F.lit('{"items": ['), F.lit('{"items": null}'), whole), (F.col("s_nationkey") % 5 + 1).cast("int"))
    items.select(form.alias("value"), "s_nationkey").write.partitionBy("s_nationkey").text(path)
    rows, why = collector(spark, DEPLOYMENTS, "t", path), F.col("problem")
    gap = F.col("position").isNull()
    counts = rows.agg(F.count("position").alias("records_read"), F.count_if(~gap & why.isNull()).alias("records_written"), F.count_if(gap & why.startswith("no list")).alias("lists"), F.count_if(gap & why.startswith("not JSON")).alias("no_json"))
    # a list that isn't there and one that is null are told alike: by the files themselves
    forms = items.agg(F.count_if(F.col("s_nationkey") % 5 == 1).alias("without_list"), F.count_if(F.col("s_nationkey") % 5 == 3).alias("null_list"))
    return counts.join(forms, F.col("lists") == F.col("without_list") + F.col("null_list")).drop("lists")


@query(f"""WITH {_SUPPLIER_SQL}, n AS (SELECT s_nationkey, s_nationkey % 5 AS form, count(*) AS n FROM s GROUP BY ALL)
SELECT 'n' || s_nationkey AS namespace, CASE form WHEN 1 THEN least(n, 3) WHEN 2 THEN 0 ELSE n END::BIGINT AS records, (form = 2 OR (form = 1 AND n > 3)) AS gap, form = 2 AS unavailable FROM n""")
def paged_scan(spark, sf_dir):
    """Pages of three records for each nation, read by a task each; of one nation in five only the first page is there, of another none."""
    from .sources.paged import read_paged

    path = _folder(spark, "pages")
    k = F.col("s_nationkey")
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("position"), "s_nationkey")
    page = F.floor((F.row_number().over(Window.partitionBy("s_nationkey").orderBy("position")) - 1) / 3)
    rows = _supplier_records(spark, sf_dir).join(nations, "position").withColumn("page", page)
    pages = rows.groupBy("s_nationkey", "page").agg(F.array_join(F.collect_list("record"), ", ").alias("items"))
    more = F.lead("page").over(Window.partitionBy("s_nationkey").orderBy("page"))
    token = F.coalesce(F.concat(F.lit('"'), more.cast("string"), F.lit('"')), F.lit("null"))
    text = F.concat(F.lit('{"items": ['), "items", F.lit('], "metadata": {"continue": '), token, F.lit("}}"))
    kept = pages.withColumn("text", text).filter(~((k % 5 == 1) & (F.col("page") > 0)) & (k % 5 != 2))

    def write(rows) -> None:
        from pathlib import Path

        for r in rows:
            folder = Path(urlparse(path).path, f"n{r.s_nationkey}")
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"{r.page}.json").write_text(r.text)

    kept.foreachPartition(write)
    names = [f"n{r.s_nationkey}" for r in nations.select("s_nationkey").distinct().collect()]  # nations
    found = read_paged(spark, "duoplane.sources.paged:FolderPages", ",".join(names), folder=urlparse(path).path)
    return found.groupBy("namespace").agg(F.count("position").alias("records"), F.bool_or("gap").alias("gap"), F.bool_or(F.col("unavailable").isNotNull()).alias("unavailable"))


@query(_MERGED_SQL)
def collector_runs(spark, sf_dir):
    """merge_collector_run once more, by whole runs: recorded, under a lease, with published states."""
    from datetime import UTC, datetime

    from .plans import runs
    from .sources.recorded import NORMALISED
    from .storage.estate import Estate
    from .storage.lease import Leases
    from .storage.runlog import RunLog

    path = _folder(spark, "collected")
    estate, log, leases = Estate(spark, path, "t"), RunLog(spark, path), Leases(spark, path)
    events, cut, user = table(spark, sf_dir, "events"), F.lit("2024-01-15").cast("timestamp"), F.col("user_id")
    kinds = spark.createDataFrame([("User",)], "kind string")

    def seen(rows: DataFrame) -> DataFrame:
        last = discovery.latest(rows.select("user_id", "ts", "event_id"), ["user_id"], [F.col("ts"), F.col("event_id")])
        values = {"position": F.col("event_id"), "kind": F.lit("User"), "tenant_id": F.lit("t"), "scope": F.lit("x"), "name": F.concat(F.lit("u-"), user.cast("string")), "provider_id": F.col("event_id").cast("string"), "attributes": attributes(id=int_value(user)), "problem": F.lit(None).cast("string")}
        return last.select(*[values[f.name].alias(f.name) for f in NORMALISED.fields])

    first, second = events.filter(F.col("ts") < cut), events.filter((F.col("ts") >= cut) & (user % 17 != 0))
    for run_id, collector, rows, at in (("run-1", "odd", first.filter(user % 2 == 1), 15), ("run-1", "even", first.filter(user % 2 == 0), 15), ("run-2", "even", second, 32)):
        when = datetime(2024, 1, at, tzinfo=UTC) if at < 32 else datetime(2024, 2, 1, tzinfo=UTC)
        if runs.run_collector(estate, log, leases, kinds, lambda rows=rows: seen(rows), "User", run_id, collector, when).status != "success":
            raise RuntimeError(f"{run_id} of {collector} failed")
    return estate.snapshot().read("discovered").select("name", "last_seen_run", "provider_id", "is_absent", "absent_since")


@query("""WITH s AS (SELECT event_id, event_id % 12 AS m, floor(value)::BIGINT AS v, value > 50 AS high FROM events)
SELECT event_id, CASE m WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN v > 0 THEN 'InvalidModeParameter' END WHEN 2 THEN 'InvalidModeParameter' WHEN 3 THEN 'InvalidComparisonMode' WHEN 4 THEN 'InvalidFieldType' WHEN 5 THEN CASE WHEN high THEN 'InvalidModeParameter' END
  WHEN 6 THEN CASE WHEN high THEN 'InvalidModeParameter' END WHEN 7 THEN 'InvalidLoggingLevel' WHEN 8 THEN NULL WHEN 9 THEN CASE WHEN v > 1 THEN 'InvalidModeParameter' END WHEN 10 THEN 'InvalidComparisonMode' WHEN 11 THEN 'InvalidModeParameter' END AS error FROM s""")
def settings_checked(spark, sf_dir):
    """Comparison settings kept as a table, with events' values as parameters: which cannot be used, and why."""
    from .functions.config import checked

    m, v, high = F.col("event_id") % 12, F.floor("value").cast("string"), F.col("value") > 50
    call = lambda f, x: F.concat(F.lit(f"{f}("), x, F.lit(")"))
    minus = F.concat(F.lit("-"), v)
    rows = {  # field type, mode, precision, element comparison, logging
        0: ("numeric", call("tolerance", v), None, None, None), 1: ("numeric", call("tolerance", minus), None, None, None), 2: ("numeric", call("tolerance", F.concat(v, F.lit("x"))), None, None, None), 3: ("string", call("tolerance", v), None, None, None),
        4: ("number", F.lit("exact"), None, None, None), 5: ("timestamp", F.lit("semantic_utc"), F.when(high, "week").otherwise("day"), None, None), 6: ("list", F.lit("set"), None, F.when(~high, "exact"), None), 7: ("string", F.lit("trim"), None, None, "loud"),
        8: ("object", call("recurse", v), None, None, "sampled"), 9: ("object", call("recurse", minus), None, None, None), 10: ("boolean", F.lit("lowercase"), None, None, "debug"), 11: ("object", call("recurse", F.concat(v, F.lit(".5"))), None, None, None),
    }

    def column(at: int) -> Column:
        out = F.lit(None).cast("string")
        for i, row in rows.items():
            out = F.when(m == i, row[at] if isinstance(row[at], Column) else F.lit(row[at]).cast("string")).otherwise(out)
        return out

    names = ("field_type", "mode", "precision", "element_comparison", "logging")
    return checked(table(spark, sf_dir, "events").select("event_id", *[column(i).alias(c) for i, c in enumerate(names)])).select("event_id", "error")


# ------------------------------------------------------------------------------- filters, constraints, runs, revisions


@query(f"""WITH {PART_SQL}, seen AS (SELECT * FROM dis WHERE k % 6 <> 5)
SELECT 'pair' AS outcome, d.scope, d.name FROM dec d JOIN seen x ON d.scope = x.scope AND d.name = x.name
UNION ALL SELECT 'declared_missing', scope, name FROM dec d WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.scope = d.scope AND x.name = d.name)
UNION ALL SELECT 'discovered_undeclared', scope, name FROM seen x WHERE NOT EXISTS (SELECT 1 FROM dec d WHERE x.scope = d.scope AND x.name = d.name)""")
def present_only_match(spark, sf_dir):
    """Rows that a collector has marked absent don't match; what they were declared as is missing."""
    marked = part_discovered(spark, sf_dir).withColumn("is_absent", F.split("name", "-")[1].cast("long") % 6 == 5)
    found = matching.match_resources(part_declared(spark, sf_dir), matching.present(marked))
    sides = (("pair", found.pairs), ("declared_missing", found.declared_orphans), ("discovered_undeclared", found.discovered_orphans))
    pair, missing, extra = (d.select(F.lit(o).alias("outcome"), "scope", "name") for o, d in sides)
    return pair.unionByName(missing).unionByName(extra)


@query("""WITH dec AS (SELECT c_nationkey % 3 AS tenant, 'n' || c_nationkey AS scope, c_name AS name FROM customer WHERE c_custkey % 9 <> 0), dis AS (SELECT c_nationkey % 3 AS tenant, 'n' || c_nationkey AS scope, c_name AS name FROM customer WHERE c_custkey % 14 <> 0),
joined AS (SELECT coalesce(d.tenant, x.tenant) AS tenant, coalesce(d.name, x.name) AS name, d.name AS mine, x.name AS theirs FROM dec d FULL JOIN dis x ON d.tenant = x.tenant AND d.scope = x.scope AND d.name = x.name)
SELECT name, CASE WHEN theirs IS NULL THEN 'declared_missing' WHEN mine IS NULL THEN 'discovered_undeclared' ELSE 'pair' END AS outcome FROM joined WHERE tenant = 1""")
def tenant_scoped_match(spark, sf_dir):
    """One tenant's match in tables that hold three: names are unique by tenant only, so nothing may cross."""
    tenant = (F.substring("scope", 2, 9).cast("int") % 3).cast("string")
    sides = [d.withColumn("tenant_id", tenant).withColumn("name", F.regexp_replace("name", "^new-", "")) for d in (customer_declared(spark, sf_dir), customer_discovered(spark, sf_dir))]
    found = matching.match_resources(*[matching.of_tenant(d, "1") for d in sides])
    outcome = F.when(F.col("strategy").isNotNull(), "pair").when(F.col("declared").isNotNull(), "declared_missing").otherwise("discovered_undeclared")
    return found.rows.select(F.coalesce("name", "discovered_name").alias("name"), outcome.alias("outcome"))


@query("SELECT 'Nation-' || n_name AS kind, s_name AS name, s_suppkey::VARCHAR AS provider_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def stored_snapshots(spark, sf_dir):
    """Stored rows become snapshots by the join with their kinds."""
    kinds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("kind_id"), F.concat(F.lit("Nation-"), "n_name").alias("kind"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("kind_id"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("provider_id"))
    return matching.snapshots(rows, kinds).select("kind", "name", "provider_id")


_MATCHES_SQL = """m AS (SELECT o_custkey::VARCHAR AS scope, o_orderpriority AS name, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate::DATE::VARCHAR END AS provider_id,
  CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'proposed' ELSE 'rejected' END AS state FROM orders)"""


@query(f"""WITH {_MATCHES_SQL}, active AS (SELECT * FROM m WHERE state IN ('confirmed', 'proposed'))
SELECT 'active match of a declared key' AS rule, 'Order/t/' || scope || '/' || name AS value, count(*) AS n FROM active GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'active match of a provider id', 't/' || provider_id, count(*) FROM active WHERE provider_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'rejection of a pairing', 'Order/t/' || scope || '/' || name || '/' || provider_id, count(*) FROM m WHERE state = 'rejected' AND provider_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'decision without provider id', 'Order/t/' || scope || '/' || name, count(*) FROM m WHERE state <> 'proposed' AND provider_id IS NULL GROUP BY ALL""")
def match_constraints(spark, sf_dir):
    """Every broken rule of a table of stored matches that orders stand for."""
    return matching.match_constraints(_order_matches(spark, sf_dir))


def _order_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", CONFIRMED).when(F.col("o_orderstatus") == "O", PROPOSED).otherwise(REJECTED)
    provider = F.when(F.col("o_orderkey") % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select(F.lit("Order").alias("kind"), F.lit("t").alias("tenant_id"), F.col("o_custkey").cast("string").alias("scope"), F.col("o_orderpriority").alias("name"), provider.alias("provider_id"), state.alias("state"))


@query(f"""WITH {_MATCHES_SQL}, active AS (SELECT * FROM m WHERE state IN ('confirmed', 'proposed'))
SELECT 'active match of a declared key' AS rule, 'Order/t/' || scope || '/' || name AS value, count(*) AS n FROM active GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'active match of a provider id', 't/' || provider_id, count(*) FROM active WHERE provider_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'rejection of a pairing', 'Order/t/' || scope || '/' || name || '/' || provider_id, count(*) FROM m WHERE state = 'rejected' AND provider_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'decision without provider id', 'Order/t/' || scope || '/' || name, count(*) FROM m WHERE state <> 'proposed' AND provider_id IS NULL GROUP BY ALL""")
def publish_gate(spark, sf_dir):
    """The rules that a publication of matches has to keep, in one pass with one exchange."""
    return constraints.broken(_order_matches(spark, sf_dir), constraints.MATCH_RULES)


@query(f"""WITH {PART_SQL}, stored AS (SELECT scope, name, field_name, CASE WHEN length(name) % 3 = 0 THEN NULL ELSE declared_present END AS dp, CASE WHEN length(scope) % 2 = 0 THEN 'x' ELSE declared_value END AS dv,
  discovered_present AS xp, CASE WHEN length(name) % 2 = 0 THEN 'y' ELSE discovered_value END AS xv FROM diffs)
SELECT 'declared' AS plane, scope, name, field_name, dv AS value FROM stored WHERE dp = FALSE AND dv IS NOT NULL
UNION ALL SELECT 'discovered', scope, name, field_name, xv FROM stored WHERE xp = FALSE AND xv IS NOT NULL""")
def value_constraints(spark, sf_dir):
    """Rows with a value on a side that states nothing; unknown presence is allowed."""
    rows = reconcile_discrepancies(spark, sf_dir).withColumns({
        "declared_present": F.when(F.length("name") % 3 != 0, F.col("declared_present")), "declared_value": F.when(F.length("scope") % 2 == 0, "x").otherwise(F.col("declared_value")),
        "discovered_value": F.when(F.length("name") % 2 == 0, "y").otherwise(F.col("discovered_value")),
    })
    return matching.value_constraints(rows).select("plane", "scope", "name", "field_name", F.when(F.col("plane") == "declared", F.col("declared_value")).otherwise(F.col("discovered_value")).alias("value"))


@query(f"""WITH {CUSTOMER_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY scope, name, provider_id) AS position FROM pairs) SELECT position, scope, name, provider_id FROM p WHERE position <= 100""")
def ordered_pairs(spark, sf_dir):
    """The first hundred pairs in their total order."""
    first = matching.in_order(matching.match_resources(*_customer(spark, sf_dir)).pairs).limit(100)
    return first.withColumn("position", F.row_number().over(Window.orderBy("scope", "name", "provider_id")).cast("long")).select("position", "scope", "name", "provider_id")


@query(f"""WITH {CUSTOMER_SQL}, {_STORED_SQL}, stored_rows AS (SELECT scope, name, CASE WHEN length(name) % 2 = 0 THEN 'open' ELSE 'resolved' END AS state FROM dec WHERE k % 10 < 5),
after AS (SELECT 'declared_missing' AS discrepancy_type, scope, name, state FROM stored_rows WHERE state <> 'open'
  UNION ALL SELECT 'declared_missing', scope, name, 'open' FROM dec WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.scope = dec.scope AND p.name = dec.name)
  UNION ALL SELECT 'discovered_undeclared', scope, name, 'open' FROM dis WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.discovered_scope = dis.scope AND p.discovered_name = dis.name))
SELECT discrepancy_type, scope, name, state FROM after""")
def rewrite_discrepancies(spark, sf_dir):
    """Stored discrepancies after a whole run: open rows are replaced, resolved ones stay, even beside a new open one."""
    declared = customer_declared(spark, sf_dir)
    stored = diffing.as_open_rows(diffing.orphan_discrepancies(declared.filter(F.substring("name", -1, 1).cast("int") < 5), "declared_missing"))
    stored = stored.withColumn("state", F.when(F.length("name") % 2 == 0, OPEN).otherwise(RESOLVED))
    return _published(spark, sf_dir, stored).read("discrepancies").select("discrepancy_type", "scope", "name", "state")


@query(f"""WITH {CUSTOMER_SQL}, was AS (SELECT 'declared_missing' AS discrepancy_type, scope, name FROM dec WHERE k % 10 < 5 AND length(name) % 2 = 0),
now AS (SELECT 'declared_missing' AS discrepancy_type, scope, name FROM dec WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.scope = dec.scope AND p.name = dec.name)
  UNION ALL SELECT 'discovered_undeclared', scope, name FROM dis WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.discovered_scope = dis.scope AND p.discovered_name = dis.name)),
gone AS (SELECT * FROM was EXCEPT SELECT * FROM now), came AS (SELECT * FROM now EXCEPT SELECT * FROM was)
SELECT 'run-2' AS run_id, 'open' AS from_state, 'gone' AS to_state, * FROM gone UNION ALL SELECT 'run-2', 'none', 'open', * FROM came""")
def rewrite_history(spark, sf_dir):
    """What the same run published beside them: the open rows that it found anew, and those that it didn't find again."""
    stored = diffing.as_open_rows(diffing.orphan_discrepancies(customer_declared(spark, sf_dir).filter(F.substring("name", -1, 1).cast("int") < 5), "declared_missing"))
    stored = stored.withColumn("state", F.when(F.length("name") % 2 == 0, OPEN).otherwise(RESOLVED))
    return _published(spark, sf_dir, stored).read("history").select("run_id", "from_state", "to_state", "discrepancy_type", "scope", "name")


_DAYS_SQL = """days AS (SELECT event_type AS collector, ts::DATE::VARCHAR AS run_id, min(ts) AS started_at, count(*) AS records_read, count(*) FILTER (WHERE event_id % 50 <> 0) AS records_written,
  bool_or(event_id % 211 = 0) AS has_gap, min(user_id) % 7 <> 0 AS reachable, max(ts) AS finished_at, day(min(ts)) % 5 <> 0 AS ends FROM events GROUP BY 1, 2)"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, e = F.col("ts"), F.col("event_id")
    aggregates = [F.min(ts).alias("started_at"), F.count("*").alias("records_read"), F.count_if(e % 50 != 0).alias("records_written"), F.bool_or(e % 211 == 0).alias("has_gap"), (F.min("user_id") % 7 != 0).alias("reachable"), F.max(ts).alias("finished_at"), (F.dayofmonth(F.min(ts)) % 5 != 0).alias("ends")]
    return table(spark, sf_dir, "events").groupBy(F.lit("t").alias("tenant_id"), F.col("event_type").alias("collector"), F.date_format("ts", "yyyy-MM-dd").alias("run_id")).agg(*aggregates)


@query(f"""WITH {_DAYS_SQL} SELECT collector, run_id, CASE WHEN NOT ends OR NOT reachable THEN 'failed' WHEN records_read > records_written OR has_gap THEN 'partial' ELSE 'success' END AS status,
CASE WHEN ends THEN records_read ELSE 0 END AS records_read, CASE WHEN ends THEN records_read - records_written ELSE 0 END AS errors, ends AND has_gap AS has_gap, ends AS is_finished FROM days""")
def run_records(spark, sf_dir):
    """Runs opened as failed and closed with their counts; one in five never closes and stays failed."""
    days = _days(spark, sf_dir)
    records = discovery.closed(discovery.opened(days), days.filter("ends"))
    return records.select("collector", "run_id", "status", "records_read", "errors", "has_gap", F.col("finished_at").isNotNull().alias("is_finished"))


@query(f"""WITH {_DAYS_SQL}, flying AS (SELECT collector, arg_max(run_id, (started_at, run_id)) AS run_id FROM days WHERE NOT ends GROUP BY 1),
skips AS (SELECT event_type AS collector, count(*) AS n FROM events GROUP BY 1)
SELECT d.collector, d.run_id, CASE WHEN f.run_id IS NOT NULL THEN coalesce(s.n, 0) ELSE 0 END AS skipped_attempts FROM days d LEFT JOIN flying f ON f.collector = d.collector AND f.run_id = d.run_id LEFT JOIN skips s ON s.collector = d.collector""")
def skips_of_runs(spark, sf_dir):
    """Skipped attempts (here every event is one) count against their collector's latest unfinished run."""
    days = _days(spark, sf_dir)
    records = discovery.closed(discovery.opened(days), days.filter("ends"))
    skips = table(spark, sf_dir, "events").select(F.lit("t").alias("tenant_id"), F.col("event_type").alias("collector"))
    return discovery.count_skips(records, skips).select("collector", "run_id", "skipped_attempts")


@query(f"""WITH {_DAYS_SQL}, flying AS (SELECT collector, arg_max(run_id, (started_at, run_id)) AS run_id FROM days WHERE NOT ends GROUP BY 1), skips AS (SELECT event_type AS collector, count(*) AS n FROM events GROUP BY 1)
SELECT d.collector, d.run_id, CASE WHEN NOT ends OR NOT reachable THEN 'failed' WHEN records_read > records_written OR has_gap THEN 'partial' ELSE 'success' END AS status,
  CASE WHEN ends THEN records_read ELSE 0 END AS records_read, CASE WHEN ends THEN records_read - records_written ELSE 0 END AS errors, ends AS is_finished, CASE WHEN f.run_id IS NOT NULL THEN coalesce(s.n, 0) ELSE 0 END AS skipped_attempts
FROM days d LEFT JOIN flying f ON f.collector = d.collector AND f.run_id = d.run_id LEFT JOIN skips s ON s.collector = d.collector""")
def run_log(spark, sf_dir):
    """Openings, closings (some of them twice) and skips of a log, in no order, folded to records."""
    days, no = _days(spark, sf_dir), lambda t: F.lit(None).cast(t)
    facts = [no("long").alias("records_read"), no("long").alias("records_written"), no("boolean").alias("has_gap"), no("boolean").alias("reachable"), no("string").alias("event_id")]
    opens = days.select(*discovery.RUN, F.lit(OPENED).alias("event"), F.col("started_at").cast("timestamp").alias("at"), *facts)
    closes = days.filter("ends").select(*discovery.RUN, F.lit(CLOSED).alias("event"), F.col("finished_at").cast("timestamp").alias("at"), "records_read", "records_written", "has_gap", "reachable", no("string").alias("event_id"))
    late = closes.filter("records_read % 2 = 0").withColumns({"at": F.col("at") + F.expr("interval 1 hour"), "records_read": F.col("records_read") + 1})
    skips = table(spark, sf_dir, "events").select(F.lit("t").alias("tenant_id"), F.col("event_type").alias("collector"), no("string").alias("run_id"), F.lit(SKIPPED).alias("event"), F.col("ts").cast("timestamp").alias("at"), *facts[:-1], F.col("event_id").cast("string").alias("event_id"))
    records = folded(skips.unionByName(late).unionByName(closes).unionByName(opens).unionByName(opens))
    return records.select("collector", "run_id", "status", "records_read", "errors", F.col("finished_at").isNotNull().alias("is_finished"), "skipped_attempts")


@query("""WITH RECURSIVE a AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
walk AS (SELECT event_type, event_id, i, TRUE AS ran, ts + INTERVAL 6 HOUR AS free FROM a WHERE i = 1
  UNION ALL SELECT a.event_type, a.event_id, a.i, a.ts >= w.free, CASE WHEN a.ts >= w.free THEN a.ts + INTERVAL 6 HOUR ELSE w.free END FROM walk w JOIN a ON a.event_type = w.event_type AND a.i = w.i + 1)
SELECT event_type, event_id, ran FROM walk""")
def overlapping_runs(spark, sf_dir):
    """Attempts of five collectors whose runs take six hours: one that finds a run in flight is skipped, not queued."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    return discovery.admitted(rows, ["event_type"], "ts", 6 * 3600).select("event_type", "event_id", "ran")


@query("""SELECT 'User' AS kind, count(*) AS n FROM (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id % 2 = 0 EXCEPT SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND user_id % 17 <> 0) HAVING count(*) > 0""")
def rows_marked_absent(spark, sf_dir):
    """How many rows the second run of merge_collector_run marks absent."""
    after = merge_collector_run(spark, sf_dir).select(F.lit("User").alias("kind"), F.lit("t").alias("tenant_id"), F.lit("x").alias("scope"), "name", "is_absent")
    return discovery.newly_absent(after.withColumn("is_absent", F.lit(False)), after)


@query("""WITH c AS (SELECT o_custkey::VARCHAR AS tenant_id, o_orderpriority AS revision_id, min(o_orderdate) AS since FROM orders GROUP BY 1, 2)
SELECT tenant_id, revision_id, row_number() OVER (PARTITION BY tenant_id ORDER BY since DESC, revision_id DESC) = 1 AS is_active FROM c""")
def revision_replay(spark, sf_dir):
    """Commits that come again and again: each revision is there once, and one of a tenant's is active."""
    commits = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("tenant_id"), F.col("o_orderpriority").alias("revision_id"), F.col("o_orderdate").alias("at"))
    return revisions.replayed(commits).select("tenant_id", "revision_id", "is_active")


@query("""SELECT 'revision of a tenant' AS rule, o_custkey || '/' || o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'active revision', o_custkey::VARCHAR, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL HAVING count(*) > 1""")
def revision_constraints(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("tenant_id"), F.col("o_orderpriority").alias("revision_id"), (F.col("o_orderstatus") == "F").alias("is_active"))
    return revisions.revision_constraints(rows)


@query("""WITH first AS (SELECT 'part-' || p_partkey AS name, p_size AS size FROM part WHERE p_partkey % 11 <> 0), second AS (SELECT 'part-' || p_partkey AS name, p_size + 1 AS size FROM part)
SELECT 2::BIGINT AS commits, 1::BIGINT AS replays, name, size::VARCHAR AS size FROM second""")
def commit_revisions(spark, sf_dir):
    """Two revisions are committed and the second again: what is read is the second, whole."""
    base = _folder(spark, "revisions")
    second = table(spark, sf_dir, "part").select(*part_keys(), attributes(size=int_value(F.col("p_size") + 1)).alias("attributes"))
    done = [revisions.commit(part_declared(spark, sf_dir).select(*KEY, "attributes"), base, "t", "r1", None), revisions.commit(second, base, "t", "r2", "r1"), revisions.commit(second, base, "t", "r2", "r1")]
    plane = revisions.committed_plane(spark, base, "t")
    return plane.select(F.lit(sum(done)).cast("long").alias("commits"), F.lit(done.count(False)).cast("long").alias("replays"), "name", F.col("attributes")["size"]["canon"].alias("size"))


@query("SELECT o_orderpriority AS revision_id, 1::BIGINT AS commits, 1::BIGINT AS repeats, count(*) AS n FROM orders GROUP BY 1")
def concurrent_commits(spark, sf_dir):
    """Every revision is committed by two writers at once, all revisions at the same time: each is there once, whole."""
    from concurrent.futures import ThreadPoolExecutor

    base, orders = _folder(spark, "race"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    revisions_ = sorted(r.o_orderpriority for r in orders.select("o_orderpriority").distinct().collect())  # five
    plane = lambda r: orders.filter(F.col("o_orderpriority") == r)
    with ThreadPoolExecutor(2 * len(revisions_)) as writers:
        done = list(writers.map(lambda r: (r, revisions.commit(plane(r), base, "t", r, turns=64)), revisions_ * 2))
    order = revisions.committed(spark, base, "t")
    rows = [revisions.revision_plane(spark, base, "t", r).select(F.lit(r).alias("revision_id"), F.lit(order.count(r)).cast("long").alias("commits"), F.lit(done.count((r, False))).cast("long").alias("repeats"), "o_orderkey") for r in revisions_]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.groupBy("revision_id", "commits", "repeats").agg(F.count("*").alias("n"))


@query("""SELECT n_name AS kind, CASE WHEN n_regionkey = 1 THEN '{"old": "int"}' ELSE '{"size": "int"}' END AS schema FROM nation WHERE n_regionkey <> 2""")
def kind_seeding(spark, sf_dir):
    """Kinds of four regions are seeded over those of one, which keep their schemas; those of another are taken out."""
    nation = table(spark, sf_dir, "nation")
    have = nation.filter("n_regionkey = 1").select(F.col("n_name").alias("kind"), F.lit('{"old": "int"}').alias("schema"))
    seeds = nation.select(F.col("n_name").alias("kind"), F.lit('{"size": "int"}').alias("schema"))
    return discovery.unseeded(discovery.seeded(have, seeds), nation.filter("n_regionkey = 2").select(F.col("n_name").alias("kind")))


@query(f"""WITH {PART_SQL} SELECT 'declared' AS asked, scope, name FROM dec UNION ALL SELECT 'observed', scope, name FROM dis""")
def plane_by_name(spark, sf_dir):
    """A reader that asks for another plane than the declared one gets the discovered one."""
    sides = part_declared(spark, sf_dir), part_discovered(spark, sf_dir)
    first, second = (readmodel.plane(asked, *sides).select(F.lit(asked).alias("asked"), "scope", "name") for asked in ("declared", "observed"))
    return first.unionByName(second)


#: Levels and digits beside the event's own number: many, more than JSON's encoder nests, as many digits as it writes, one more, few.
_LIMITS = (2000, 100_000, 4300, 4301, 3)


@query("""WITH x AS (SELECT event_id, event_id % 5 AS m, length(event_id::VARCHAR) AS d FROM events)
SELECT event_id, CASE m WHEN 1 THEN 'deep' WHEN 3 THEN 'integer' ELSE 'none' END AS found, CASE m WHEN 0 THEN 4000 + d WHEN 2 THEN 4300 WHEN 4 THEN 6 + d END::INTEGER AS length FROM x""")
def json_barricade_limits(spark, sf_dir):
    """Event numbers inside many lists, and behind so many digits: what the encoder takes is stored, however deep; length is that of the stored
    form. Texts are made after their numbers are spread over all cores."""
    m, e = F.col("event_id") % 5, F.col("event_id").cast("string")
    nested = lambda n: F.concat(F.lit('{"k": ' + "[" * n), e, F.lit("]" * n + "}"))
    digits = lambda n: F.concat(F.lit('{"k": 1'), F.lpad(e, n - 1, "0"), F.lit("}"))
    text = F.when(m == 0, nested(_LIMITS[0])).when(m == 1, nested(_LIMITS[1])).when(m == 2, digits(_LIMITS[2])).when(m == 3, digits(_LIMITS[3])).otherwise(nested(_LIMITS[4]))
    events = spread(table(spark, sf_dir, "events").select("event_id"), "event_id")
    rows = events.select("event_id", encoded(text).alias("x"))
    why = F.col("x.problem")
    found = F.when(why.isNull(), "none").when(why.contains("recursion") | why.contains("deep"), "deep").when(why.contains("digits"), "integer").otherwise(why)
    return rows.select("event_id", found.alias("found"), F.length(F.col("x.attributes")["k"]["canon"]).alias("length"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def streaming_upsert(spark, sf_dir):
    """The latest state again, kept by a stream over the events that are there."""
    from .streaming.observe import current, observe

    base = _folder(spark, "stream")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a glob may be a file or a folder
    observe(stream.select("user_id", "ts", "event_id"), f"{base}/state", f"{base}/log", ["user_id"], ["ts", "event_id"]).awaitTermination()
    return current(spark, f"{base}/state").select("user_id", "event_id")


