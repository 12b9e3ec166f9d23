"""The reconciliation library on small, hand-made planes, and its queries against their SQL."""

import itertools
import json
import math
import random
from datetime import UTC, datetime, timedelta

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duoplane import catalogue
from duoplane.functions import canon, compare, config, literals
from duoplane.model import KEY
from duoplane.operators import decisions as decisions_module
from duoplane.operators import diffing, discovery, lifecycle, matching, revisions
from duoplane.plans import runs
from duoplane.sources import documents, paged, recorded
from duoplane.storage.estate import Estate
from duoplane.storage.lease import Leases
from duoplane.storage.runlog import RunLog
from duoplane.streaming import observe

DATA = "/root/testdata/sf0.001"
ROW = "kind string, tenant_id string, scope string, name string, provider_id string, a string"


def plane(spark, *rows):
    """(name, provider id, attributes) rows in scope default."""
    frame = spark.createDataFrame([("Deployment", "t", "default", n, p, json.dumps(a)) for n, p, a in rows], ROW)
    return frame.select(*KEY, "provider_id", canon.encoded(F.col("a"))["attributes"].alias("attributes"))


def decisions(spark, *rows):
    return spark.createDataFrame([("Deployment", "t", "default", n, p, c) for n, p, c in rows], "kind string, tenant_id string, scope string, name string, provider_id string, is_confirmed boolean")


def outcome(spark, declared, discovered, decided=()):
    found = matching.match_resources(plane(spark, *declared), plane(spark, *discovered), decisions(spark, *decided))
    pairs = sorted((r.name, r.discovered_name, r.provider_id, r.strategy) for r in found.pairs.collect())
    return pairs, sorted(r.name for r in found.declared_orphans.collect()), sorted(r.name for r in found.discovered_orphans.collect())


@pytest.mark.parametrize(
    "declared, discovered, decided, expected",
    [
        (["web"], [("web", "1")], [], ([("web", "web", "1", "natural_key")], [], [])),
        (["web"], [], [], ([], ["web"], [])),
        ([], [("ghost", "9")], [], ([], [], ["ghost"])),
        (["web"], [("web", "1")], [("web", "1", True)], ([("web", "web", "1", "binding")], [], [])),
        (["api"], [("web", "1")], [("web", "1", True)], ([], ["api"], ["web"])),
        (["web"], [("web", "1")], [("web", "1", False)], ([], ["web"], ["web"])),
        (["web"], [("web", "2")], [("web", "1", True)], ([("web", "web", "2", "natural_key")], [], [])),
        (["web", "api"], [("api", "w"), ("web", "a")], [("web", "w", True), ("api", "a", True)], ([("api", "web", "a", "binding"), ("web", "api", "w", "binding")], [], [])),
        (["web"], [("web", None)], [("web", None, True)], ([("web", "web", None, "natural_key")], [], [])),
        (["web"], [("api", "1")], [("web", "1", True)], ([("web", "api", "1", "binding")], [], [])),
    ],
)
def test_matching_truth_table(spark, declared, discovered, decided, expected):
    assert outcome(spark, [(n, None, {}) for n in declared], [(n, p, {}) for n, p in discovered], decided) == expected


def test_duplicates_are_refused(spark):
    with pytest.raises(ValueError, match="declared key"):
        matching.check_inputs(plane(spark, ("web", None, {}), ("web", None, {})), plane(spark, ("web", "1", {})))
    one, two, ids = plane(spark, ("web", None, {})), plane(spark, ("web", "1", {}), ("web", "2", {})), plane(spark, ("web", "1", {}), ("api", "1", {}))
    for declared, discovered in ((two, one), (one, two)):
        with pytest.raises(Exception, match="key: more than one row of Deployment/t/default/web"):
            matching.match_resources(declared, discovered).pairs.select("name").collect()
    with pytest.raises(Exception, match="confirmed provider id"):
        matching.match_resources(one, plane(spark, ("web", "1", {})), decisions(spark, ("web", "1", True), ("api", "1", True))).rows.collect()
    with pytest.raises(ValueError, match="provider id"):
        matching.check_inputs(one, ids)
    for decided in (None, decisions(spark), decisions(spark, ("web", "1", True)), decisions(spark, ("web", "2", False))):
        with pytest.raises(Exception, match="provider id: more than one row of t/1"):
            matching.match_resources(one, ids, decided).pairs.select("name").collect()
    nameless = plane(spark, ("web", None, {}), ("api", None, {}))
    assert matching.match_resources(one, nameless).rows.count() == 2  # rows without an id share none
    with pytest.raises(Exception, match="without provider id"):
        decisions_module.anchored(decisions(spark, ("web", None, True))).collect()


def test_absent_rows_and_other_tenants_stay_out(spark):
    declared, discovered = plane(spark, ("web", None, {}), ("api", None, {})), plane(spark, ("web", "1", {}), ("api", "2", {}))
    marked = discovered.withColumn("is_absent", F.when(F.col("name") == "web", True))
    found = matching.match_resources(declared, matching.present(marked))
    assert [r.name for r in found.pairs.collect()] == ["api"] and [r.name for r in found.declared_orphans.collect()] == ["web"]
    other = declared.withColumn("tenant_id", F.lit("u"))
    assert matching.match_resources(matching.of_tenant(declared.unionByName(other), "t"), discovered).pairs.count() == 2


VALUES = st.one_of(st.none(), st.booleans(), st.integers(0, 3), st.sampled_from([3.0, "", "3", [1], {}]))
SIDE = st.dictionaries(st.sampled_from("ab"), VALUES)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(SIDE, SIDE), min_size=1, max_size=5))
def test_field_differences_keep_absent_null_and_types_apart(spark, pairs):
    left = plane(spark, *[(f"r{i}", None, a) for i, (a, _) in enumerate(pairs)])
    right = plane(spark, *[(f"r{i}", f"p{i}", b) for i, (_, b) in enumerate(pairs)])
    got = {(r.name, r.field_name, r.declared_present, r.declared_value, r.discovered_present, r.discovered_value) for r in diffing.reconcile(matching.match_resources(left, right)).collect()}
    want = set()
    for i, (a, b) in enumerate(pairs):
        for k in {*a, *b}:
            x, y = (json.dumps(s[k], sort_keys=True) if k in s else None for s in (a, b))
            if x != y:
                want.add((f"r{i}", k, k in a, x, k in b, y))
    assert got == want


ABSENT = object()
CASES = [
    ("numeric", "exact_value", 3, 3, True), ("numeric", "exact_value", 3, 3.0, False), ("numeric", "exact_string", 3, "3", True), ("numeric", "tolerance(0.5)", 3, 3.5, True),
    ("numeric", "tolerance(0.5)", 3, "1_000", False), ("numeric", "tolerance(1)", True, 1, True), ("numeric", "exact_value", ABSENT, ABSENT, True), ("numeric", "exact_value", None, ABSENT, False), ("numeric", "exact_value", None, None, True),
    ("string", "exact", "a", "A", False), ("string", "lowercase", "a", "A", True), ("string", "trim", "　a\x1f", "a", True), ("string", "normalize", " A  b\n", "a B", True), ("string", "exact", True, "True", True), ("string", "exact", "", ABSENT, False),
    ("list", "ordered", [1, 2], [2, 1], False), ("list", "unordered_multiset", [1, 2, 2], [2, 1, 2], True), ("list", "unordered_multiset", [1, 2], [2, 1, 2], False), ("list", "set", [1, 2], [2, 1, 2], True), ("list", "ordered", "x", "x", False), ("list", "set", [None], [], False),
    ("object", "opaque", {"a": 1, "b": 2}, {"b": 2, "a": 1}, True), ("object", "version", {"version": 1}, {"version": "1"}, True), ("object", "version", {}, {"version": None}, False), ("object", "version", {"version": [1]}, {"version": "[1]"}, False),
    ("object", "identity", {"id": "x", "q": 1}, {"id": "x"}, True), ("object", "ignore", ABSENT, 3, True), ("object", "recurse(-1)", {"a": {"b": 1}}, {"a": {"b": 2}}, False),
    ("boolean", "exact", True, True, True), ("boolean", "exact", True, 1, False), ("timestamp", "semantic_utc", "2026-07-30T18:00:00Z", "2026-07-30T20:00:00+02:00", True), ("timestamp", "semantic_utc", "July 30, 2026 6pm", "20260730T180000", True), ("timestamp", "semantic_utc", "soon", "soon", False), ("timestamp", "string", "a", "a", True),
]


def test_comparison_modes(spark):
    rows = [(i, *(json.dumps({} if v is ABSENT else {"v": v}) for v in (a, b))) for i, (_, _, a, b, _) in enumerate(CASES)]
    frame = spark.createDataFrame(rows, "i int, a string, b string").select("i", canon.encoded(F.col("a"))["attributes"]["v"].alias("l"), canon.encoded(F.col("b"))["attributes"]["v"].alias("r")).cache()
    for i, (kind, mode, a, b, want) in enumerate(CASES):
        setting = config.FieldConfig(kind, mode, precision="second" if kind == "timestamp" else None, element_comparison="exact" if kind == "list" else None)
        got = frame.filter(F.col("i") == i).select(compare.audited(F.col("l"), F.col("r"), setting).alias("x")).first().x
        assert got.agree is want, (kind, mode, a, b)


def test_settings_are_checked():
    assert config.parse_mode("numeric", "tolerance(-1)").problem.startswith("Unusable") and config.parse_mode("numeric", "tolerance").problem
    assert config.parse_mode("object", "recurse(2)").parameter == 2 and config.parse_mode("string", "recurse(2)").problem.startswith("Unknown")
    for bad in (("x", "exact"), ("numeric", "about"), ("timestamp", "semantic_utc"), ("list", "set")):
        with pytest.raises(config.SchemaError):
            config.FieldConfig(*bad)
    with pytest.raises(config.MissingFieldConfig):
        config.ComparisonSchema({}).get("a", "b")
    assert compare.divergence({"a": {"b": 1}}, {"a": {"b": 2}}, -1) == "a.b" and compare.divergence({"a": {"b": 1}}, {"a": {"b": 2}}, 1) == "a" and compare.divergence([1], [2], 3) == "<root>"


def test_barricade():
    assert canon.problem_of({"a": [1, {"b": math.nan}]}) == "a[1].b: nan is not a finite number"
    assert "U+0000" in canon.problem_of({"a": "x\0"}) and "U+D800" in canon.problem_of({"a": "\ud800"}) and "U+0000" in canon.problem_of({"a": {"k\0": 1}})
    assert canon.problem_of({"b": [math.inf], "a": "\0"}).startswith("a:") and "no text" in canon.problem_of({"a": {1: 2}}) and "set" in canon.problem_of({"a": {1}}) and canon.problem_of({"a": (1, None, True, 2.5)}) is None
    assert canon.problem_of({"a": 10**4299}) is None and "digits" in canon.problem_of({"a": 10**4300})
    loop = []
    loop.append(loop)
    assert "Circular" in canon.problem_of({"a": loop}) and canon.encode_text('{"a": ' + "[" * 400 + "]" * 400 + "}")["problem"] is None
    for depth in (600, 5000):  # what the encoder takes is stored, however deep
        assert canon.encode_text('{"a": ' + "[" * depth + "]" * depth + "}")["attributes"][0][1]["canon"] == "[" * depth + "]" * depth
    deep = []
    for _ in range(100_000):
        deep = [deep]
    assert "deep" in canon.problem_of({"a": deep}) and "recursion" in canon.encode_text('{"a": ' + "[" * 100_000 + "]" * 100_000 + "}")["problem"]
    while deep:  # taken apart by hand, as its destructor recurses
        deep = deep.pop()
    assert canon.encode_text("[1]")["problem"] and canon.encode_text(None)["problem"] and canon.encode_text("{")["problem"] and canon.encode_text('{"a":1,"a":2}')["attributes"][0][1]["canon"] == "2"
    assert literals.parse_int("-0") == 0 and literals.parse_bool("true") is True
    for bad in ("007", "1.0", "", "0x1", "9" * 5000):
        with pytest.raises(literals.Unacceptable):
            literals.parse_int(bad)


GOOD = "apiVersion: planes.example/v1\nkind: Deployment\nmetadata:\n  name: web\n  scope: default\nattributes:\n  replicas: {}\n"


def doc(text):
    return documents.parse_document(text.encode(), "planes.example/v1", {"Deployment": {"replicas": "int"}})


def test_documents():
    assert doc(GOOD.format("3"))["attributes"] == {"replicas": 3} and doc(GOOD.format("null"))["attributes"] == {"replicas": None} and doc(GOOD.format('"3"'))["attributes"] == {"replicas": 3}
    bad = [GOOD.format(""), GOOD.format("007"), GOOD.format('"null"'), GOOD.format("[1]"), GOOD.format("3") + "  other: 1\n", GOOD.format("3").replace("v1", "v2"), GOOD.format("3") + "provider_id: x\n", GOOD.format("3").replace("name: web", "name: 007"), GOOD.format("3") + "---\n" + GOOD.format("3"), "", "[", GOOD.format("3") + "kind: Deployment\n", GOOD.format("3").replace("attributes:", "attributes: !x"), GOOD.format("3").replace("  scope", "  <<: {a: 1}\n  scope"), "a: &a {b: *a}\n" + GOOD.format("3")]
    for text in bad:
        with pytest.raises(documents.InvalidDocument):
            doc(text)
    with pytest.raises(documents.InvalidDocument) as found:
        doc(GOOD.format("x"))
    assert found.value.line == 7
    for text, line in ((GOOD.format("3").replace("  name: web\n", ""), 4), (GOOD.format("3").replace("kind: Deployment\n", ""), 1), (GOOD.format("3").replace("attributes:\n  replicas: 3\n", ""), 1)):
        with pytest.raises(documents.InvalidDocument, match="is missing") as found:
            doc(text)
        assert found.value.line == line
    assert doc("labels: &x {on: [1, 2.5, null]}\nmore: *x\n" + GOOD.format("3"))["envelope"]["more"] == {"on": [1, 2.5, None]}
    levels = "l0: &l0 [x]\n" + "".join(f"l{i}: &l{i} [{', '.join([f'*l{i - 1}'] * 6)}]\n" for i in range(1, 10))
    assert doc(levels + GOOD.format("1"))["name"] == "web"  # shared nodes are looked at once


def test_revision_is_all_or_nothing(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(GOOD.format("3"))
    (tmp_path / "b.yml").write_text(GOOD.format("9").replace("web", "api"))
    kinds = {"Deployment": {"replicas": "int"}}
    plane_ = documents.ingest_revision(spark, str(tmp_path), "t", "r1", "planes.example/v1", kinds)
    assert sorted((r.name, r.attributes["replicas"].canon) for r in plane_.collect()) == [("api", "9"), ("web", "3")]
    (tmp_path / "b.yml").write_text(GOOD.format("9"))
    (tmp_path / "c.yaml").write_text("[")
    with pytest.raises(documents.InvalidRevision) as found:
        documents.ingest_revision(spark, str(tmp_path), "t", "r2", "planes.example/v1", kinds)
    assert len(found.value.errors) == 2 and "declared more than once" in str(found.value)


def test_recorded_payloads(spark, tmp_path):
    records = [{"metadata": {"name": n, "namespace": "default", "uid": n + "-1"}, "spec": s} for n, s in (("api", {"replicas": 2}), ("broken", {}), ("worker", {"replicas": 4}))]
    (tmp_path / "d.json").write_text(json.dumps({"items": [*records, 7]}))
    rows = recorded.normalised(recorded.read_recorded(spark, str(tmp_path / "d.json"), "items"), recorded.DEPLOYMENTS, "t")
    assert {r.name for r in rows.filter("problem is null").collect()} == {"api", "worker"} and rows.filter("problem like '%spec.replicas%'").count() == 1
    assert tuple(recorded.run_summary(rows).first()) == (4, 2, 2, "partial")
    with pytest.raises(recorded.ProviderUnavailable):
        recorded.records_in('{"data": []}', "items")


def deployments(*rows):
    return [{"metadata": {"name": n, "namespace": "default", "uid": u}, "spec": {"replicas": r}} for n, u, r in rows]


def broken_client():
    return Pages(0, 410, 9)


def two_pages(namespace=""):
    """A list API of two pages, the second with a token that nothing follows."""

    def fetch(path, query):
        assert path == (f"namespaces/{namespace}/deployments" if namespace else "deployments") and query["limit"] == 200
        first = "continue" not in query
        return json.dumps({"items": deployments(("web", "1", 3), ("web", "2", 4)) if first else deployments(("api", "3", None)), "metadata": {"continue": "next"} if first else {}})

    return paged.ListClient(fetch, "deployments", namespace=namespace)


def gap_client():
    return Pages(1, 410, 9)


def test_a_collector_run(spark, tmp_path):
    """Each run starts from the same state, in an estate of its own."""
    kinds = spark.createDataFrame([("Deployment", "{}")], "kind string, schema string")
    state = plane(spark, ("web", "0", {}), ("old", "9", {})).select("*", F.lit("r0").alias("last_seen_run"), F.lit("c").alias("collector"), F.lit(False).alias("is_absent"), F.lit(None).cast("timestamp").alias("absent_since"))
    at, count = datetime(2024, 1, 1, tzinfo=UTC), itertools.count()

    def collect(read, kind="Deployment", known=kinds):
        path = f"file://{tmp_path}/{next(count)}"
        estate, log = Estate(spark, path, "t"), RunLog(spark, path)
        estate.publish(estate.snapshot(), {"discovered": state}, "r0")
        try:
            record = runs.run_collector(estate, log, Leases(spark, path), known, read, kind, "r1", "c", at)
        except Exception:
            left = log.records().first()  # as it was opened
            assert (left.status, left.finished_at) == ("failed", None) and estate.snapshot().read("discovered").count() == 2
            raise
        return {r.name: (r.provider_id, r.is_absent) for r in estate.snapshot().read("discovered").collect()}, record, log.rejects().collect()

    def run(client, adapter=recorded.DEPLOYMENTS, namespace="", known=kinds):
        return collect(lambda: recorded.collector(spark, adapter, "t", client=f"tests.test_reconciliation:{client}", namespace=namespace), adapter.kind, known)

    for namespace in ("", "default"):
        after, record, rejected = run("two_pages", namespace=namespace)
        assert after == {"web": ("2", False), "old": ("9", False)} and (record.records_read, record.records_written, record.errors, record.status, record.has_gap) == (3, 2, 1, "partial", False)
        assert [(r.position, r.run, r.problem) for r in rejected] == [(2, "r1", "missing fields: spec.replicas")]
    every = recorded.Adapter("Deployment", "items", ("metadata", "namespace"), ("metadata", "name"), ("metadata", "uid"), {"replicas": ("spec", "replicas")}, frozenset({"replicas"}))
    after, record, _ = run("two_pages", every)
    assert after == {"web": ("2", False), "api": ("3", False), "old": ("9", True)} and record.status == "success" and record.finished_at is not None
    after, record, rejected = run("two_pages", every, known=kinds.limit(0))
    assert after == {"web": ("0", False), "old": ("9", False)} and {r.problem for r in rejected} == {"unknown kind"} and len(rejected) == 3
    assert (record.records_read, record.records_written, record.errors, record.status) == (3, 0, 3, "partial")
    after, record, _ = run("gap_client")
    assert record.status == "partial" and record.has_gap and not any(gone for _, gone in after.values())

    def unreadable():
        try:
            raise recorded.ProviderUnavailable("gone")
        except recorded.ProviderUnavailable as why:
            raise RuntimeError("wrapped") from why

    after, record, rejected = collect(unreadable)
    assert len(after) == 2 and record.status == "failed" and not rejected
    after, record, rejected = run("broken_client")
    assert after == {"web": ("0", False), "old": ("9", False)} and (record.status, record.records_read) == ("failed", 0) and not rejected
    (tmp_path / "no.json").write_text("{")
    assert collect(lambda: recorded.collector(spark, every, "t", f"{tmp_path}/no.json"))[1].status == "failed"

    def mistaken():  # an error that only mentions the class
        raise RuntimeError("ProviderUnavailable is not what this is")

    with pytest.raises(RuntimeError, match="is not what"):
        collect(mistaken)
    with pytest.raises(Exception, match="no_such_client"):
        run("no_such_client")
    with pytest.raises(Exception, match="a collector of Other gave Deployment"):
        collect(lambda: recorded.collector(spark, every, "t", client="tests.test_reconciliation:two_pages"), "Other")
    (row,) = recorded.collector(spark, recorded.DEPLOYMENTS, "t", client="tests.test_reconciliation:broken_client").collect()
    assert row.position is None and "no page could be read" in row.problem
    with pytest.raises(Exception, match="a collector of Other gave Deployment"):
        discovery.of_collector(plane(spark, ("web", "1", {})), "Other").collect()


def test_instances(spark, tmp_path):
    record = {"compartment-id": "c", "display-name": "vm", "id": "i-1", "shape": "small", "shape-config": {"ocpus": 2.0}, "lifecycle-state": "RUNNING"}
    (tmp_path / "i.json").write_text(json.dumps({"data": [record, {**record, "shape-config": None, "id": None}]}))
    good, bad = sorted(recorded.collector(spark, recorded.INSTANCES, "t", str(tmp_path / "i.json")).collect(), key=lambda r: r.position)
    assert (good.kind, good.scope, good.name, good.provider_id) == ("ComputeInstance", "c", "vm", "i-1") and {k: v.canon for k, v in good.attributes.items()} == {"shape": '"small"', "ocpus": "2.0"}
    assert bad.problem == "missing fields: id, shape-config.ocpus"


def test_revisions_are_committed_once(spark, tmp_path):
    store, docs = f"file://{tmp_path}/store", tmp_path / "docs"
    docs.mkdir()
    (docs / "a.yaml").write_text(GOOD.format("3"))
    take = lambda rev: documents.ingest_and_commit(spark, str(docs), store, "t", rev, "planes.example/v1", {"Deployment": {"replicas": "int"}})
    assert revisions.committed_plane(spark, store, "t") is None and take("r1") and not take("r1")
    (docs / "a.yaml").write_text(GOOD.format("4"))
    assert take("r2") and not take("r1") and revisions.active_revision(spark, store, "t") == "r2" and revisions.active_revision(spark, store, "u") is None
    assert [r.attributes["replicas"].canon for r in revisions.committed_plane(spark, store, "t").collect()] == ["4"]
    with pytest.raises(revisions.RevisionConflict):  # it saw r1 as active, but r2 came in between
        revisions.commit(plane(spark, ("x", None, {})), store, "t", "r3", "r1")
    (docs / "a.yaml").write_text("[")
    with pytest.raises(documents.InvalidRevision):
        take("r4")
    assert revisions.active_revision(spark, store, "t") == "r2"
    table = revisions.activate(spark.createDataFrame([("t", "a", True), ("u", "b", True)], "tenant_id string, revision_id string, is_active boolean"), "t", "c")
    assert {(r.revision_id, r.is_active) for r in table.collect()} == {("a", False), ("b", True), ("c", True)}


def test_state_in_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    rows = lambda *x: spark.createDataFrame(x, "k long, at long, v string")
    observe.merge_latest(spark, path, rows(*[(i, 1, "a") for i in range(40)]), 0, ["k"], ["at"], 8)
    for _ in range(2):  # a batch that comes again changes nothing
        observe.merge_latest(spark, path, rows((1, 2, "b"), (50, 1, "c"), (2, 0, "late")), 1, ["k"], ["at"], 8)
    for i in range(2, 6):
        observe.merge_latest(spark, path, rows((1, i, f"v{i}")), i, ["k"], ["at"], 8)
    found = {r.k: r.v for r in observe.current(spark, path).collect()}
    assert len(found) == 41 and found[1] == "v5" and found[50] == "c" and found[2] == "a"
    assert all(len(v) <= observe.KEPT for v in observe._held(spark, path).values())


def test_a_stream_at_an_interval(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k long, at long").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, at long").parquet(f"{tmp_path}/in")
    running = observe.observe(stream, f"{tmp_path}/state", f"{tmp_path}/log", ["k"], ["at"], "1 second")
    running.processAllAvailable()
    running.stop()
    assert {(r.k, r.at) for r in observe.current(spark, f"{tmp_path}/state").collect()} == {(1, 2), (2, 1)}


def test_moments_do_not_depend_on_the_session_zone(spark):
    pairs = [("2026-07-30T01:00:00", "2026-07-30T01:00:00Z", True), ("20260730T010000", "2026-07-30T01:00:00", True), ("2026-03-08T02:30:00", "2026-03-08 02:30:00Z", True), ("2026-07-30T23:30:00-04:00", "2026-07-31T03:30:00", True), ("2026-07-30T23:59:59Z", "2026-07-31T00:00:00Z", False), ("1969-12-31T23:00:00Z", "1969-12-31T01:00:00Z", True)]
    rows = [(i, json.dumps({"v": a}), json.dumps({"v": b})) for i, (a, b, _) in enumerate(pairs)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/New_York", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            frame = spark.createDataFrame(rows, "i int, a string, b string").select("i", canon.encoded(F.col("a"))["attributes"]["v"].alias("l"), canon.encoded(F.col("b"))["attributes"]["v"].alias("r"))
            got = {r.i: r.x for r in frame.select("i", compare.audited(F.col("l"), F.col("r"), config.FieldConfig("timestamp", "semantic_utc", precision="day")).alias("x")).collect()}
            assert [got[i].agree for i in range(len(pairs))] == [p[2] for p in pairs], tz
            assert got[3].declared_transformed == "2026-07-31 00:00:00+00:00" and got[5].declared_transformed == "1969-12-31 00:00:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_lifecycle_keeps_history(spark, tmp_path):
    key, now = ("Deployment", "t", "default"), F.lit("2024-06-01").cast("timestamp")
    schema = "kind string, tenant_id string, scope string, name string, discrepancy_type string, field_name string, state string, expires_at timestamp, declared_value string, discovered_value string"
    rows = [("a", "declared_missing", None, "open"), ("a", "discovered_undeclared", None, "open"), ("b", "field", "x", "invalidated"), ("c", "field", "x", "muted"), ("d", "field", "x", "open"), ("e", "field", "x", "open"), ("f", "field", "x", "open"), ("g", "field", "x", "suppressed")]
    existing = spark.createDataFrame([(*key, n, t, f, s, None, "1", "2") for n, t, f, s in rows], schema)
    again = spark.createDataFrame([(*key, n, t, f, "open", None, "3", "4") for n, t, f, _ in rows if n in "abcg"], schema).drop("state", "expires_at")
    declared, discovered = plane(spark, *[(n, None, {}) for n in "abcdfg"]), plane(spark, *[(n, n, {}) for n in "abcdeg"])
    after = lifecycle.next_states(existing, again, declared, discovered, now)
    found = sorted((r.name, r.discrepancy_type, r.state, r.transition or "", r.declared_value) for r in after.collect())
    assert found == sorted([
        ("a", "declared_missing", "open", "", "3"), ("a", "discovered_undeclared", "open", "", "3"), ("b", "field", "invalidated", "", "1"), ("b", "field", "open", "none>open", "3"), ("c", "field", "muted", "", "1"), ("c", "field", "open", "none>open", "3"),
        ("d", "field", "open", "", "1"), ("e", "field", "invalidated", "open>invalidated", "1"), ("f", "field", "muted", "open>muted", "1"), ("g", "field", "suppressed", "suppressed>suppressed", "3"),
    ])
    path = f"{tmp_path}/history"
    for run in ("r1", "r2", "r2"):
        lifecycle.append_transitions(lifecycle.transitions(after, run, now), path)
    assert {(r.run_id, r["count"]) for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {("r1", 5), ("r2", 5)}


def test_settings_as_a_table(spark):
    rows = [("D", "n", "numeric", "tolerance(1)", None, None, None), ("D", "t", "timestamp", "semantic_utc", "day", None, "debug")]
    frame = spark.createDataFrame(rows, "kind string, field string, field_type string, mode string, precision string, element_comparison string, logging string")
    assert config.schema_of(frame).fields == {("D", "n"): config.FieldConfig("numeric", "tolerance(1)"), ("D", "t"): config.FieldConfig("timestamp", "semantic_utc", "day", logging="debug")}
    bad = frame.withColumn("precision", F.lit(None).cast("string"))
    assert [(r.field, r.error) for r in config.checked(bad).orderBy("field").collect()] == [("n", None), ("t", "InvalidModeParameter")] and config.checked(frame.limit(0)).count() == 0
    with pytest.raises(config.InvalidModeParameter):
        config.schema_of(bad)


def test_settings_fit_what_kinds_declare():
    settings_ = config.ComparisonSchema({("D", "n"): config.FieldConfig("numeric", "exact_value"), ("D", "s"): config.FieldConfig("object", "opaque")})
    settings_.check_declared({"D": {"n": "int"}})
    for kinds in ({"D": {"n": "str"}}, {"D": {"s": "str"}}):
        with pytest.raises(config.InvalidFieldType):
            settings_.check_declared(kinds)


class Pages:
    def __init__(self, fail_at=None, status=503, times=1):
        self.fail_at, self.status, self.times = fail_at, status, times

    def page(self, token):
        at = int(token or 0)
        if at == self.fail_at and self.times:
            self.times -= 1
            raise type("Http", (Exception,), {"status": self.status})()
        return [{"n": at}], str(at + 1) if at < 2 else None


def test_paged_source():
    slept = []
    assert len(list(paged.pages(Pages(1), slept.append))) == 3 and slept == [0.5]
    assert list(paged.pages(Pages(1, 410), slept.append))[-1] == (None, None, True)
    with pytest.raises(Exception):  # noqa: B017
        list(paged.pages(Pages(0, 410), slept.append))
    assert list(paged.pages(Pages(1, 503, 9), lambda _: None))[-1][2]


def test_overlapping_attempts_are_skipped(spark, monkeypatch):
    """Stretches put together give what one walk through the whole history gives."""
    rnd = random.Random(5)
    rows = [(k, datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=s), i) for k, n, reach in (("dense", 900, 9000), ("sparse", 60, 500_000), (None, 40, 3000)) for i, s in enumerate(sorted(rnd.choices(range(reach), k=n)))]
    rows += [("dense", None, 1), ("sparse", None, 2)]
    want = {}
    for name in ("dense", "sparse", None):
        free = None
        for _, at, i in sorted((r for r in rows if r[0] == name and r[1]), key=lambda r: (r[1], r[2])):
            want[name, at, i] = free is None or at >= free
            if want[name, at, i]:
                free = at + timedelta(seconds=60)
    frame = spark.createDataFrame(rows, "collector string, at timestamp, i int").repartition(3)
    for span in (64, 1, 3):
        monkeypatch.setattr(discovery, "SPAN", span)
        found = discovery.admitted(frame, ["collector"], "at", 60).collect()
        assert {(r.collector, r["at"].replace(tzinfo=UTC), r.i): r.ran for r in found if r["at"]} == want and [r.ran for r in found if not r["at"]] == [False, False]
    assert discovery.admitted(frame.limit(0), ["collector"], "at", 60).count() == 0


def test_absence_needs_a_complete_run(spark):
    base = plane(spark, ("web", "1", {}), ("api", "2", {}))
    state = base.select("*", F.lit("r1").alias("last_seen_run"), F.lit("c").alias("collector"), F.lit(False).alias("is_absent"), F.lit(None).cast("timestamp").alias("absent_since"))
    now = F.lit("2024-01-01").cast("timestamp")
    for entitled, collector, gone in ((True, "c", True), (False, "c", False), (True, "other", False)):
        after = discovery.merge_run(state, plane(spark, ("web", "1", {})), F.lit("r2"), F.lit(collector), F.lit(entitled), now)
        assert {r.name: r.is_absent for r in after.collect()} == {"web": False, "api": gone}


SAMPLE = ["concurrent_commits", "paged_scan", "collector_runs", "settings_checked", "pair_row_ids", "broken_documents", "ingested_revision", "normalised_records", "normalised_instances", "recorded_payloads", "page_by_index", "page_totals_by_index", "ordered_decisions", "ordered_orphans", "ordered_fields", "row_ids", "rewrite_discrepancies", "rewrite_history", "run_log", "publish_gate", "streaming_absence", "json_barricade_limits", "orphans_after_decisions", "swapped_names_bound", "reconcile_discrepancies", "match_with_rejections", "rewrite_matches", "infer_absence", "merge_collector_run", "list_set", "object_version", "timestamp_utc_hour", "lifecycle_next_states", "discrepancies_page", "streaming_upsert", "present_only_match", "run_records", "overlapping_runs", "match_constraints", "yaml_barricade", "audit_sampled", "commit_revisions"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "customer", "orders", "events", "lineitem", "supplier", "nation"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    plain = lambda v: v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    got = sorted(repr(tuple(map(plain, r))) for r in found.select(*columns).collect())
    want = sorted(repr(tuple(map(plain, r))) for r in con.sql(f"select {', '.join(columns)} from ({catalogue.ORACLES[name]})").fetchall())
    assert got == want


def test_documents_of_parts_are_for_all_cores(spark):
    """The part table is one file, and one task if nothing spreads it."""
    assert catalogue.broken_documents(spark, DATA).rdd.getNumPartitions() > 4


def test_of_a_parts_texts_one_is_put_together(spark, tmp_path, monkeypatch):
    """Parts that take the first text don't meet the others, which fail here."""
    filled, first = catalogue._filled, catalogue._DOCUMENTS[0][0]
    monkeypatch.setattr(catalogue, "_filled", lambda text: filled(text) if text == first else F.raise_error(F.lit("put together")).cast("string"))
    n = len(catalogue._DOCUMENTS)
    spark.read.parquet(f"{DATA}/part.parquet").filter(F.col("p_partkey") % n == 0).write.parquet(f"{tmp_path}/part.parquet")
    rows = catalogue._documents(spark, str(tmp_path)).collect()
    assert rows and all(bytes(r.content).startswith(b"apiVersion") for r in rows)


def test_barricade_is_linear_in_depth(spark):
    """Twice the depth, about twice the steps, with the same forms and paths as of shallow values; the query's texts are for all cores."""
    import sys

    from duoplane.functions.canon import encode_text, problem_of, written

    def steps(depth: int) -> int:
        n, text = 0, '{"k": ' + "[" * depth + '{"a": 1}' + "]" * depth + "}"

        def count(frame, event, arg):
            nonlocal n
            n += 1 if event == "line" else 0
            return count

        had = sys.gettrace()
        sys.settrace(count)
        try:
            encode_text(text)
        finally:
            sys.settrace(had)
        return n

    assert steps(400) < 2.2 * steps(200)
    for value in ([], {}, [1, [2.5, None, True], {"a'": ["x"], "b": {}}], {"k": [[]]}, [(1, [2])], "it's", 3, None, ["it's", '"', "\n"]):
        assert written(value) == str(value)
    assert problem_of({"k": [1, {"a": [{"b": [0, "\x00"]}]}]}) == "k[1].a[0].b[1]: U+0000 cannot be stored"
    assert problem_of({"k": [[{"a\x00": float("nan")}]]}) == "k[0][0].a\\x00: U+0000 cannot be stored" and problem_of({"k": [float("inf")]}) == "k[0]: inf is not a finite number"
    assert problem_of({"k": [{5: 1}]}) == "k[0].5: a name that is no text" and problem_of({"k": ["\ud800"]}) == "k[0]: U+D800 cannot be stored" and problem_of({"k": ["😀", "NaN", "{"]}) is None
    assert catalogue.json_barricade_limits(spark, DATA).rdd.getNumPartitions() > 4


def test_barricade_neither_walks_nor_moves_what_it_need_not(spark, monkeypatch):
    """Long integers and lists that hold one list each are stored as they are written; of a text that opens more lists than the decoder takes, only those lists
    go to Python. Forms and problems are those of the decoder, the encoder and str."""
    import json

    from duoplane.functions import canon

    lists = lambda n, x: "[" * n + x + "]" * n
    big = "1" + "0" * 4299
    bodies = [big, "-" + big[1:].replace("0", "7"), lists(2000, "5"), lists(500, big), lists(40, '"null"'), lists(40, '1, null, "it\'s"'), lists(40, '{"b": [true], "a": []}'), lists(40, ""), lists(33, "[1], [2]"), "null", "[true, null]", '["true"]', "-0", "1e5"]
    for body in bodies:
        value, (_, got) = json.loads(body), canon.encode_text('{"k": ' + body + "}")["attributes"][0]
        elems = [json.dumps(x, sort_keys=True) for x in value] if isinstance(value, list) else None
        assert (got["kind"], got["canon"], got["text"], got["elems"]) == (canon.kind_of(value), json.dumps(value, sort_keys=True), canon.written(value), elems)
    for body, why in ((lists(50, "NaN"), "k" + "[0]" * 50 + ": nan is not a finite number"), (lists(50, '"\\u0000"'), "k" + "[0]" * 50 + ": U+0000 cannot be stored"), (lists(50, "1") + ", 2", "not JSON"), (lists(50, "1]"), "not JSON"), (big + "0", "digits"), (lists(50, big + "0"), "digits")):
        assert why in canon.encode_text('{"k": ' + body + "}")["problem"]

    texts = ['{"k": ' + lists(100_000, "1") + "}", ' {\n"a:[" :' + lists(100_000, "1"), '{"k": 1, "l": ' + lists(100_000, "1") + "}", '{"k" ' + lists(100_000, "1"), '{"k": ' + lists(300, '"' + "x" * 30_000 + '"') + "}"]
    plain = []
    for t in texts:
        try:
            plain.append(json.loads(t) and None)
        except (ValueError, RecursionError) as wrong:
            plain.append(f"not JSON: {wrong}")
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.length("t").alias("n"), F.length(canon._settled(F.col("t"))).alias("moved"), canon.encoded(F.col("t"))["problem"].alias("why"))
    rows = frame.orderBy("i").collect()
    assert [r.why for r in rows] == plain and [r.moved < 50_000 for r in rows] == [True, True, False, False, True] and [r.moved == r.n for r in rows] == [False, False, True, True, True]

    monkeypatch.setattr(canon.json, "dumps", None)
    monkeypatch.setattr(canon, "written", None)
    for body in bodies[:3]:
        assert canon.encode_text('{"k": ' + body + "}")["attributes"][0][1]["canon"] == body
