"""Run log, leases, the published estate, commits, Git and paged sources: crashes, races and takeovers."""

import json
import os
import subprocess
import sys
import threading
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from duoplane.functions import canon
from duoplane.model import KEY
from duoplane.operators import constraints, diffing, matching, revisions
from duoplane.plans import runs as plans
from duoplane.sources import git as git_source
from duoplane.sources import paged, recorded
from duoplane.storage import estate as estates
from duoplane.storage import files as stored
from duoplane.storage import lease as leasing
from duoplane.storage import ordered, runlog
from duoplane.streaming import absence
from duoplane.streaming import revisions as following

AT = datetime(2024, 1, 1, tzinfo=UTC)
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ROW = "kind string, tenant_id string, scope string, name string, provider_id string, a string"


def plane(spark, *rows, tenant="t"):
    frame = spark.createDataFrame([("Deployment", tenant, "default", n, p, json.dumps(a)) for n, p, a in rows], ROW)
    return frame.select(*KEY, "provider_id", canon.encoded(F.col("a"))["attributes"].alias("attributes"))


def test_one_writer_creates_a_file(spark, tmp_path):
    store = stored.Files(spark, f"file://{tmp_path}/files")
    won = []

    def write(i):
        if store.put_if_absent("a/b", {"by": i}):
            won.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and store.get("a/b") == {"by": won[0]} and store.names("a") == ["b"] and store.get("a/c") is None and store.names("z") == []
    store._local = None  # as on a store without local paths
    assert store.put_if_absent("a/c", {"x": "é"}) and not store.put_if_absent("a/c", {"x": 2}) and store.get("a/c") == {"x": "é"} and store.names("a") == ["b", "c"]


# ---------------------------------------------------------------------------------------------------------- run log


def test_a_run_whose_driver_dies_is_recorded_as_failed(spark, tmp_path):
    script = f"""
import os, sys
sys.path.insert(0, {ROOT!r})
from datetime import UTC, datetime
from pyspark.sql import SparkSession
from duoplane.plans import runs
from duoplane.storage import estate, lease, runlog
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
path = "file://{tmp_path}"
runs.run_collector(estate.Estate(spark, path + "/e", "t"), runlog.RunLog(spark, path + "/log"), lease.Leases(spark, path + "/l"), None, lambda: os._exit(9), "Deployment", "r1", "c", datetime(2024, 1, 1, tzinfo=UTC), 1e-9)
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, timeout=120, check=False)
    assert done.returncode == 9, done.stderr.decode()[-2000:]
    log, leases, estate = runlog.RunLog(spark, f"file://{tmp_path}/log"), leasing.Leases(spark, f"file://{tmp_path}/l"), estates.Estate(spark, f"file://{tmp_path}/e", "t")
    (r,) = log.records().collect()
    assert (r.run_id, r.status, r.finished_at, r.records_read) == ("r1", "failed", None, 0) and estate.snapshot().version == -1
    log.skip("t", "c")  # counts against the run that never closed
    assert log.records().first().skipped_attempts == 1
    kinds = spark.createDataFrame([("Deployment",)], "kind string")
    rows = spark.createDataFrame([], recorded.NORMALISED)
    assert plans.run_collector(estate, log, leases, kinds, lambda: rows, "Deployment", "r2", "c", AT).status == "success"
    with pytest.raises(runlog.RunExists):
        plans.run_collector(estate, log, leases, kinds, lambda: rows, "Deployment", "r2", "c", AT)
    assert log.close("t", "c", "r1", AT, records_read=5) and not log.close("t", "c", "r1", AT, records_read=6)
    assert {(x.run_id, x.records_read, x.skipped_attempts) for x in log.records().collect()} == {("r1", 5, 0), ("r2", 0, 0)}


def test_folding_does_not_depend_on_order_or_repeats(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s, tzinfo=UTC)
    events = [("t", "c", "a", "opened", at(1), None, None, None, None, None, "1"), ("t", "c", "a", "closed", at(5), 4, 3, False, True, None, "2"), ("t", "c", "a", "closed", at(9), 9, 9, False, True, None, "3"), ("t", "c", "b", "opened", at(2), None, None, None, None, None, "4"), ("t", "c", None, "skipped", at(3), None, None, None, None, None, "5"), ("t", "d", "x", "closed", at(3), 1, 1, True, True, None, "6")]
    for rows in (events, events[::-1], events + events[:5]):
        found = {(r.run_id, r.status, r.errors, r.skipped_attempts) for r in runlog.folded(spark.createDataFrame(rows, runlog.EVENT)).collect()}
        assert found == {("a", "partial", 1, 0), ("b", "failed", 0, 1)}
    assert runlog.folded(spark.createDataFrame([], runlog.EVENT)).count() == 0


def test_old_events_are_packed(spark, tmp_path):
    log, day = runlog.RunLog(spark, f"file://{tmp_path}"), lambda d: AT.replace(day=d)
    for i in range(1, 5):
        log.open("t", "c", f"r{i}", day(i))
        if i < 4:
            log.close("t", "c", f"r{i}", day(i), records_read=i, records_written=i)
    log.open("t", "d", "x", day(1))
    log.close("t", "d", "x", day(1))
    log.skip("t", "c", day(4))  # counts against r4, which is open
    log.skip("t", "d", day(1))
    before = sorted(map(tuple, log.records().collect()))
    files = lambda: sum(len(f) for _, _, f in os.walk(tmp_path / "events"))
    assert files() == 11 and log.pack(day(3)) == 7 and files() == 4  # r1, r2 and x with its collector's skip
    assert sorted(map(tuple, log.records().collect())) == before and log.pack(day(3)) == 0
    log.close("t", "c", "r4", day(5))
    assert log.pack(day(9)) == 5 and files() == 0 and log.pack(day(9)) == 0
    assert {(r.run_id, r.status) for r in log.records().collect()} == {("r1", "success"), ("r2", "success"), ("r3", "success"), ("r4", "success"), ("x", "success")}


# ----------------------------------------------------------------------------------------------------------- leases


def test_leases_rise_and_end(spark, tmp_path):
    now = [100.0]
    leases = leasing.Leases(spark, f"file://{tmp_path}", lambda: now[0])
    a = leases.acquire("x", "a", 10)
    assert a.number == 0 and leases.acquire("x", "b", 10) is None and leases.acquire("y", "b", 10).number == 0
    now[0] = 109
    a.renew(10)
    now[0] = 115
    assert leases.acquire("x", "b", 10) is None
    now[0] = 120
    b = leases.acquire("x", "b", 10)
    assert b.number == 1
    for call in (a.check, lambda: a.renew(5)):
        with pytest.raises(leasing.LeaseLost):
            call()
    b.release()
    assert leases.acquire("x", "c", 10).number == 2


def test_two_runs_at_once_and_a_holder_that_slept(spark, tmp_path):
    now, path = [0.0], f"file://{tmp_path}"
    leases, log, estate = leasing.Leases(spark, path, lambda: now[0]), runlog.RunLog(spark, path), estates.Estate(spark, path, "t")
    kinds, inner = spark.createDataFrame([("Deployment",)], "kind string"), []

    def rows(*names):
        return spark.createDataFrame([(i, "Deployment", "t", "s", n, n, {}, None) for i, n in enumerate(names)], recorded.NORMALISED)

    def run(run_id, read):
        return plans.run_collector(estate, log, leases, kinds, read, "Deployment", run_id, "c", AT, 10)

    def while_another_starts():
        inner.append(run("r2", lambda: rows("other")))
        return rows("web")

    assert run("r1", while_another_starts).skipped_attempts == 0 and inner == [None]  # what it skipped is counted while it is in flight
    assert [r.name for r in estate.snapshot().read("discovered").collect()] == ["web"] and {r.run_id for r in log.records().collect()} == {"r1"}

    def overslept():
        now[0] = 50
        assert run("r4", lambda: rows("new")).status == "success"  # takes over and publishes
        return rows("stale")

    with pytest.raises(leasing.LeaseLost):
        run("r3", overslept)
    state = {r.name: r.is_absent for r in estate.snapshot().read("discovered").collect()}
    assert state == {"web": True, "new": False} and {(r.run_id, r.status) for r in log.records().collect()} == {("r1", "success"), ("r4", "success"), ("r3", "failed")}
    # a holder that has looked, and is overtaken before it publishes, is refused though nothing else was published
    lease = leases.acquire("z", "a", 10)
    base = estate.seal(lease)
    now[0] = 100
    estate.seal(leases.acquire("z", "b", 10))
    lease.check = lambda: None
    with pytest.raises(leasing.LeaseLost):
        estate.publish(base, {"discovered": estate.snapshot().read("discovered")}, "late", lease)


# ----------------------------------------------------------------------------------------------------------- estate

MATCH = "kind string, tenant_id string, scope string, name string, provider_id string, strategy string, confidence string, state string"


def matches(spark, *rows):
    return spark.createDataFrame([("Deployment", "t", "default", n, p, "binding", "high", s) for n, p, s in rows], MATCH)


def content(estate):
    s = estate.snapshot()
    return sorted(map(tuple, s.read("matches").select("name", "provider_id", "state").collect())), sorted((r.name, r.discrepancy_type, r.state) for r in s.read("discrepancies").collect()), sorted((r.run_id, r.name, r.to_state) for r in (s.read("history").collect() if "history" in s.tables else []))


def test_a_reconciliation_is_published_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}"
    estate, leases = estates.Estate(spark, path, "t"), leasing.Leases(spark, path)
    none = diffing.as_open_rows(diffing.orphan_discrepancies(plane(spark), "declared_missing"))
    plans.seed(estate, matches(spark, ("web", "1", "confirmed"), ("gone", "7", "confirmed")), none)
    declared, discovered = plane(spark, ("web", None, {"n": 1}), ("lost", None, {})), plane(spark, ("web2", "1", {"n": 2}), ("ghost", "5", {})).unionByName(plane(spark, ("web", "1", {}), tenant="u"))
    before = content(estate)
    now = F.lit("2024-06-01").cast("timestamp")

    def run(run_id):
        return plans.reconcile_estate(estate, leases, lambda: (declared, discovered), run_id, now)

    class Died(BaseException):
        pass

    real_require, real_put, real_parquet = estates.require, stored.Files.put_if_absent, type(none.write).parquet
    calls = []

    def dying(step, real):
        def call(*args, **kwargs):
            calls.append(1)
            if len(calls) > step:
                raise Died
            return real(*args, **kwargs)

        return call

    for target, name, real, steps in ((type(none.write), "parquet", real_parquet, range(3)), (estates, "require", real_require, range(3)), (stored.Files, "put_if_absent", real_put, range(1, 3))):
        for step in steps:
            calls.clear()
            monkeypatch.setattr(target, name, dying(step, real))
            with pytest.raises(Died):
                run("r1")
            monkeypatch.setattr(target, name, real)
            assert content(estate) == before, (name, step)
            for lease in stored.Files(spark, path).names("leases/reconcile-t"):  # the dead holder's time is up
                stored.Files(spark, path).put_if_absent(f"leases/reconcile-t/over-{lease}", {})
    assert run("r1")
    after = content(estate)
    assert after[0] == [("gone", "7", "invalidated"), ("web", "1", "confirmed")]
    assert after[1] == [("ghost", "discovered_undeclared", "open"), ("lost", "declared_missing", "open"), ("web", "field", "open")]
    assert after[2] == [("r1", "ghost", "open"), ("r1", "lost", "open"), ("r1", "web", "open")]
    discovered = plane(spark, ("web2", "1", {"n": 1}), ("ghost", "5", {}))
    assert run("r2") and [h for h in content(estate)[2] if h[0] == "r2"] == [("r2", "web", "gone")] and len(content(estate)[2]) == 4
    assert estate.vacuum(1, 0) >= 5 and len(content(estate)[2]) == 4  # drafts of the dead runs and old versions
    # the second of two runs at once writes nothing
    lease = leases.acquire("reconcile-t", "other", 60)
    version = estate.snapshot().version
    assert run("r3") is False and estate.snapshot().version == version
    lease.release()
    decided = []

    def planes_while_someone_decides():
        if not decided:
            decided.append(plans.seed(estate, matches(spark, ("lost", "5", "confirmed")), none, "decision"))
        return declared, discovered

    assert plans.reconcile_estate(estate, leases, planes_while_someone_decides, "r4", now)  # starts anew from the decision
    assert ("lost", "5", "confirmed") in content(estate)[0] and ("web", None, "proposed") not in content(estate)[0]


def test_history_parts_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(estates, "PARTS", 3)
    estate = estates.Estate(spark, f"file://{tmp_path}", "t")
    for i in range(8):
        estate.publish(estate.snapshot(), {}, f"r{i}", appended={"history": spark.createDataFrame([("t", i)], "tenant_id string, i int")})
    assert len(estate.snapshot().tables["history"]) <= 3 and sorted(r.i for r in estate.snapshot().read("history").collect()) == list(range(8))


def test_bad_tables_are_not_published(spark, tmp_path):
    estate = estates.Estate(spark, f"file://{tmp_path}", "t")
    none = diffing.as_open_rows(diffing.orphan_discrepancies(plane(spark), "declared_missing"))
    plans.seed(estate, matches(spark, ("web", "1", "confirmed"), ("web", "1", "rejected"), ("old", "1", "invalidated"), ("a", None, "proposed"), ("b", None, "proposed")), none)
    good = content(estate)
    bad = {
        "active match of a declared key": matches(spark, ("web", "1", "confirmed"), ("web", "2", "proposed")),
        "active match of a provider id": matches(spark, ("web", "1", "confirmed"), ("api", "1", "proposed")),
        "rejection of a pairing": matches(spark, ("web", "1", "rejected"), ("web", "1", "rejected")),
        "decision without provider id": matches(spark, ("web", None, "confirmed")),
        "row of another tenant": matches(spark, ("web", "1", "confirmed")).withColumn("tenant_id", F.lit("u")),
    }
    for rule, rows in bad.items():
        with pytest.raises(constraints.ConstraintViolation, match=rule):
            plans.seed(estate, rows, none)
        assert content(estate) == good
    row = diffing.as_open_rows(spark.createDataFrame([("field", "K", "t", "s", "n", "f", False, "1", None, "2")], ", ".join(f"{c} {'boolean' if c.endswith('present') else 'string'}" for c in diffing.COLUMNS)))
    for rule, rows in (("declared value on a side that states nothing", row), ("open discrepancy of a field", row.withColumn("declared_present", F.lit(None).cast("boolean")).unionByName(row.withColumn("declared_present", F.lit(True))))):
        with pytest.raises(constraints.ConstraintViolation, match=rule):
            plans.seed(estate, matches(spark), rows)
    plan = constraints.broken(matches(spark, ("web", "1", "confirmed")), constraints.MATCH_RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
    both = matching.match_constraints(bad["rejection of a pairing"]).collect()
    assert [tuple(r) for r in both] == [tuple(r) for r in constraints.broken(bad["rejection of a pairing"], constraints.MATCH_RULES).collect()]


def test_eight_writers_commit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(revisions, "LISTED", 4)
    path, rows, done, failed = f"file://{tmp_path}/store", plane(spark, ("web", None, {})), [], []

    def write(i):
        try:
            done.append((f"r{i // 2}", revisions.commit(rows.withColumn("scope", F.lit(f"r{i // 2}")), path, "t", f"r{i // 2}", turns=32)))
        except Exception as why:
            failed.append(why)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(16)]  # each of eight revisions twice
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(r for r, new in done if new) == [f"r{i}" for i in range(8)]
    order = revisions.committed(spark, path, "t")
    assert sorted(order) == [f"r{i}" for i in range(8)] and revisions.active_revision(spark, path, "t") == order[-1]
    assert [r.scope for r in revisions.committed_plane(spark, path, "t").collect()] == [order[-1]] and revisions.abandoned(spark, path, "t") == []
    with pytest.raises(revisions.RevisionConflict):
        revisions.commit(rows, path, "t", "r9", expected="nothing like it")
    assert not revisions.is_committed(spark, path, "t", "r9") and revisions.abandoned(spark, path, "t") == []


def test_pages_open_the_files_that_hold_them(spark, tmp_path):
    order = [F.asc_nulls_last("a"), "b"]
    rows = spark.createDataFrame([(None if i % 10 == 0 else i // 3, i) for i in range(1000)], "a int, b int").repartition(5)
    path = f"file://{tmp_path}/pages"
    index = ordered.write_in_order(rows, path, order, 100).collect()
    assert [r.offset for r in index] == sorted(r.offset for r in index) and sum(r.n for r in index) == 1000 == ordered.page_total(spark, path) and len(index) >= 8
    want = [tuple(r) for r in rows.orderBy(*order).collect()]
    for offset, limit in ((0, 50), (95, 30), (500, 50), (990, 50), (1000, 50), (5000, 1), (0, 1000)):
        found = ordered.page(spark, path, order, offset, limit)
        assert [tuple(r) for r in found.collect()] == want[offset : offset + limit]
        if limit <= 50:
            assert len(found.inputFiles()) <= 2
    numbered = ordered.positions(rows, f"file://{tmp_path}/p", order, rows_per_file=64)
    assert [(r.a, r.b) for r in sorted(numbered.collect(), key=lambda r: r.position)] == want and "Window" not in numbered._jdf.queryExecution().toString()
    none = rows.limit(0)
    assert ordered.positions(none, f"file://{tmp_path}/n", order).count() == 0 and ordered.page(spark, f"file://{tmp_path}/n", order, 0, 5).count() == 0


def test_row_ids_stay(spark, tmp_path):
    rows = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    first = ordered.kept_ids(rows("b", "a", None, "b"), ["k"], f"file://{tmp_path}/1")
    assert {r.k: r.row_id for r in first.collect()} == {None: 1, "a": 2, "b": 3}
    second = ordered.kept_ids(rows("c", "a", None, "0"), ["k"], f"file://{tmp_path}/2", first)
    again = ordered.kept_ids(rows("b", "c"), ["k"], f"file://{tmp_path}/3", second)
    assert {r.k: r.row_id for r in again.collect()} == {None: 1, "a": 2, "b": 3, "0": 4, "c": 5} == {r.k: r.row_id for r in second.collect()}


def sightings(*rows):
    """(run, collector, name, provider id) for a sighting, (run, collector, entitled) for a closing."""
    out = []
    for i, r in enumerate(rows):
        seen = len(r) == 4
        out.append(("t", r[1], r[0], "seen" if seen else "closed", "K" if seen else None, "s" if seen else None, r[2] if seen else None, r[3] if seen else None, i if seen else None, None if seen else r[2], None if seen else datetime(2024, 1, r[0], tzinfo=UTC)))
    return out


def test_a_stream_knows_what_is_absent(spark, tmp_path):
    batches = [
        sightings((1, "c", "web", "1"), (1, "c", "api", "2"), (1, "d", "other", "9")),
        sightings((1, "c", True), (2, "c", "web", "5"), (2, "c", "web", "6")),
        sightings((2, "c", True)),  # api is missed by an entitled run
        sightings((3, "c", False), (2, "c", True), (2, "c", "web", "5")),  # not entitled; a delivery that comes again
        sightings((4, "c", True), (4, "c", "api", "7"), (1, "c", "web", "old")),  # refuted within the batch; an old sighting says nothing
    ]
    names, expected = {}, [{}, {}, {"api": 2}, {"api": 2}, {"web": 4}]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, absence.OBSERVATION).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(absence.OBSERVATION).parquet(f"{tmp_path}/in")
        query = absence.observe_plane(stream, f"{tmp_path}/log", 3, lambda changes, batch: names.setdefault(batch, sorted(r.name for r in changes.collect())))
        query.awaitTermination()  # each time a new query goes on from the checkpoint
        state = absence.plane_of(spark, f"{tmp_path}/log").collect()
        assert {r.name: r.absent_since.day for r in state if r.is_absent} == expected[i]
    assert {r.name: (r.provider_id, r.last_seen_run, r.collector) for r in state} == {"web": ("6", 2, "c"), "api": ("7", 4, "c"), "other": ("9", 1, "d")}
    assert names[2] == ["api"] and names[3] == []  # what a batch didn't touch isn't written


def test_tasks_never_raise(caplog):
    assert plans.Task("none", None)() is None and plans.Task("fine", lambda: "sha")() == "sha"
    for why in (ValueError("x"), leasing.LeaseLost("y")):

        def work(why=why):
            raise why

        assert plans.Task("bad", work)() is None
    assert "overtaken" in caplog.text and "bad failed" in caplog.text


def test_a_schedule_outlives_its_task(spark, tmp_path):
    calls, enough = [], threading.Event()

    def work():
        calls.append(1)
        if len(calls) == 3:
            enough.set()
        raise ValueError("again")

    query = plans.on_schedule(spark, plans.Task("failing", work), "1 second", f"{tmp_path}/log")
    assert enough.wait(60) and query.isActive and query.exception() is None
    query.stop()


# ------------------------------------------------------------------------------------------------------ Git and pages

GOOD = "apiVersion: planes.example/v1\nkind: Deployment\nmetadata:\n  name: web\n  scope: default\nattributes:\n  replicas: {}\n"


def run_git(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", "-c", "commit.gpgsign=false", *args], check=True, capture_output=True)


def new_revision(repo, files):
    for name, text in files.items():
        (repo / name).parent.mkdir(parents=True, exist_ok=True)
        (repo / name).write_text(text)
    run_git(repo, "add", "-A")
    run_git(repo, "commit", "-qm", "x", "--allow-empty")
    return subprocess.run(["git", "-C", str(repo), "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()


def test_revisions_of_a_branch_are_ingested_once(spark, tmp_path):
    repo, store, kinds = tmp_path / "repo", f"file://{tmp_path}/store", {"Deployment": {"replicas": "int"}}
    repo.mkdir()
    run_git(repo, "init", "-q", "-b", "main")
    first = new_revision(repo, {"a.yaml": GOOD.format("1"), "deep/b.yml": GOOD.format("2").replace("web", "api"), "note.txt": "no"})
    second = new_revision(repo, {"a.yaml": GOOD.format("7")})

    def follow():
        query = following.follow(spark, str(repo), store, f"{tmp_path}/log", "t", "planes.example/v1", kinds, branch="main", start="earliest", partBytes="10")
        query.awaitTermination()
        assert query.exception() is None

    follow()
    assert revisions.committed(spark, store, "t") == [first, second]
    third = new_revision(repo, {"a.yaml": "["})  # refused
    fourth = new_revision(repo, {"a.yaml": GOOD.format("9")})
    follow()  # a new query from the same checkpoint
    assert revisions.committed(spark, store, "t") == [first, second, fourth]
    assert {(r.name, r.attributes["replicas"].canon) for r in revisions.committed_plane(spark, store, "t").collect()} == {("web", "9"), ("api", "2")}
    outcomes = stored.Files(spark, store).names("outcomes/t")
    assert sorted(outcomes) == sorted([f"{first}.ingested.json", f"{second}.ingested.json", f"{third}.refused.json", f"{fourth}.ingested.json"])
    hidden = tmp_path / "hidden"
    os.rename(repo, hidden)
    follow()  # unreachable: the stream tells and ends as usual
    os.rename(hidden, repo)
    (repo / "a.yaml").unlink()
    (repo / "deep/b.yml").unlink()
    last = new_revision(repo, {})
    follow()
    assert revisions.active_revision(spark, store, "t") == last and revisions.committed_plane(spark, store, "t").count() == 0


def test_git_batch_mirror_and_errors(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    run_git(repo, "init", "-q", "-b", "main")
    sha = new_revision(repo, {"x/a.yaml": "one", "b.yml": "two\n", ".github/c.yaml": "three", "d.yaml/e.txt": "no"})
    os.symlink("b.yml", repo / "link.yml")
    new_revision(repo, {})
    for options in ({}, {"mirror": str(tmp_path / "mirror")}):
        rows = git_source.read_git(spark, str(repo), revision=sha, partBytes="3", **options)
        assert rows.rdd.getNumPartitions() == 4 and {(r.source, bytes(r.content)) for r in rows.filter("source is not null").collect()} == {("x/a.yaml", b"one"), ("b.yml", b"two\n"), (".github/c.yaml", b"three")}
    with pytest.raises(git_source.RepositoryUnavailable, match="root"):
        git_source.synced(str(repo / "x"))
    with pytest.raises(git_source.RepositoryUnavailable):
        git_source.head(str(repo), "nowhere")
    assert list(git_source.read_part(git_source.Part(str(tmp_path / "none"), sha, [("a", "0" * 40)])))[0][3].startswith("documents of")


def many_namespaces(namespace="", name=""):
    def fetch(path, query):
        place = path.split("/")[1]
        wanted = query.get("fieldSelector", "=").partition("=")[2]
        if place == "broken":
            raise type("Http", (Exception,), {"status": 410})()
        if place == "torn" and "continue" in query:
            raise type("Http", (Exception,), {"status": 410})()
        names = [n for n in ("web", "api", "job") if not wanted or n == wanted]
        records = [{"metadata": {"name": n, "namespace": place, "uid": f"{place}-{n}"}, "spec": {"replicas": 1}} for n in names]
        return json.dumps({"items": records, "metadata": {"continue": "more"} if place == "torn" else {}})

    return paged.ListClient(fetch, "deployments", namespace=namespace, name=name)


def test_namespaces_are_read_by_tasks_of_their_own(spark):
    client, places = "tests.test_storage:many_namespaces", "a,b,torn,broken"
    rows = paged.read_paged(spark, client, places)
    assert rows.rdd.getNumPartitions() == 4
    found = rows.collect()
    assert sorted(r.namespace for r in found if r.record) == sorted(["a"] * 3 + ["b"] * 3 + ["torn"] * 3)
    assert {(r.namespace, r.unavailable is not None) for r in found if r.gap} == {("torn", False), ("broken", True)}
    one = rows.filter("namespace = 'b' and name = 'api'")
    assert one.rdd.getNumPartitions() == 1 and [(r.namespace, r.name) for r in one.collect()] == [("b", "api")]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert "Filter" not in plan(one) and "Filter" in plan(rows.filter("name like 'w%'"))  # the source took both filters, and tells Spark so
    assert rows.filter("namespace in ('a', 'torn')").rdd.getNumPartitions() == 2 and rows.filter("namespace in ('a', 'torn')").count() == 7
    assert rows.filter("namespace = 'c'").count() == 0 and rows.filter("name = 'x' and name = 'y'").count() == 0 and rows.filter("name in ('web', 'job') and not gap").count() == 6
    every = recorded.collector(spark, recorded.DEPLOYMENTS, "t", client=client, namespace=places)
    assert every.filter("position is null").count() == 2 and every.filter("position is null and problem is not null").count() == 1


# ------------------------------------------------------------------------------------------------------- whole slices


def test_from_a_branch_and_a_provider_to_the_queue(spark, tmp_path):
    """Two kinds of documents in a repository, recorded payloads of two providers: what is matched, what differs, what is gone."""
    path, repo = f"file://{tmp_path}/data", tmp_path / "repo"
    kinds = {"Deployment": {"replicas": "int"}, "ComputeInstance": {"shape": "str", "ocpus": "int"}}
    known = spark.createDataFrame([(k,) for k in kinds], "kind string")
    estate, log, leases = estates.Estate(spark, path, "t"), runlog.RunLog(spark, path), leasing.Leases(spark, path)
    repo.mkdir()
    run_git(repo, "init", "-q", "-b", "main")
    instance = "apiVersion: planes.example/v1\nkind: ComputeInstance\nmetadata:\n  name: web-1\n  scope: c1\nattributes:\n  shape: small\n  ocpus: 2\n"

    def declare(files):
        new_revision(repo, files)
        following.follow(spark, str(repo), path, f"{tmp_path}/log", "t", "planes.example/v1", kinds, branch="main").awaitTermination()

    def collect(adapter, run_id, day, records):
        file = tmp_path / f"{run_id}.json"
        file.write_text(json.dumps({adapter.envelope: records}))
        return plans.run_collector(estate, log, leases, known, lambda: recorded.collector(spark, adapter, "t", str(file)), adapter.kind, run_id, adapter.kind, AT.replace(day=day))

    def reconcile(run_id):
        assert plans.reconcile_estate(estate, leases, lambda: plans.planes_of(estate, path), run_id, F.lit("2024-02-01").cast("timestamp"))
        s = estate.snapshot()
        found = sorted(tuple("" if v is None else v for v in r) for r in s.read("discrepancies").select("discrepancy_type", "name", "field_name", "declared_value", "discovered_value").collect())
        return found, sorted((r.name, r.strategy, r.state) for r in s.read("matches").collect())

    assert reconcile("r0") == ([], [])  # neither plane is there yet
    deployment = lambda n, replicas: {"metadata": {"name": n, "namespace": "default", "uid": f"u-{n}"}, "spec": {"replicas": replicas}}
    vm = lambda n: {"compartment-id": "c1", "display-name": n, "id": f"i-{n}", "shape": "small", "shape-config": {"ocpus": 2}, "lifecycle-state": "RUNNING"}
    declare({"web.yaml": GOOD.format(3), "vm.yaml": instance})
    assert collect(recorded.DEPLOYMENTS, "k1", 2, [deployment("web", 5)]).status == "success"
    record = collect(recorded.INSTANCES, "o1", 2, [vm("web-1"), {**vm("bad"), "shape-config": None}, vm("db-1")])
    assert (record.records_read, record.records_written, record.errors, record.status) == (3, 2, 1, "partial")
    first = ([("discovered_undeclared", "db-1", "", "", ""), ("field", "web", "replicas", "3", "5")], [("web", "natural_key", "proposed"), ("web-1", "natural_key", "proposed")])
    assert reconcile("r1") == first == reconcile("r2")
    declare({"web.yaml": GOOD.format(5)})  # declared as it is
    assert reconcile("r3")[0] == first[0][:1]
    assert collect(recorded.DEPLOYMENTS, "k2", 3, [deployment("web2", 1)]).status == "success"  # web is gone, and that may be said
    assert reconcile("r4")[0] == [("declared_missing", "web", "", "", ""), ("discovered_undeclared", "db-1", "", "", ""), ("discovered_undeclared", "web2", "", "", "")]
    assert collect(recorded.INSTANCES, "o2", 3, [vm("db-1"), 7]).status == "partial"  # web-1 isn't there, which an incomplete run doesn't tell
    assert reconcile("r5")[0] == reconcile("r4b")[0] and {r.name for r in estate.snapshot().read("discovered").collect() if r.is_absent} == {"web"}
    history = [(r.run_id, r.name, r.to_state) for r in estate.snapshot().read("history").collect()]
    assert sorted(h for h in history if h[0] in ("r3", "r4")) == [("r3", "web", "gone"), ("r4", "web", "open"), ("r4", "web2", "open")]
    assert not [h for h in history if h[0] in ("r2", "r5", "r4b")]  # a run that finds nothing new adds nothing


def test_documents_are_parsed_by_many_tasks_and_once(spark, tmp_path):
    """A file of a table is one task's; documents of one are spread before they are parsed, and errors of the set parse none again."""
    from duoplane.sources.documents import parse_documents, revision_errors

    good = "apiVersion: v1\nkind: Part\nmetadata:\n  name: {}\n  scope: s\nattributes:\n  size: {}\n"
    texts = [(f"d-{i:04d},x.yaml", good.format(f"n{i - i % 50 % 2}", "007" if i % 10 == 3 else i)) for i in range(400)]
    frame = spark.createDataFrame(texts, "source string, text string").coalesce(1).select("source", F.encode("text", "UTF-8").alias("content"))
    parsed = parse_documents(frame, "t", "v1", {"Part": {"size": "int"}})
    assert parsed.rdd.getNumPartitions() > 4
    shown = revision_errors(parsed)
    assert str(shown._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1
    rows = [(r.source, r.line, r.message) for r in shown.collect()]
    want = [(s, 7, "attributes.size: '007' is not an integer") for i, (s, _) in enumerate(texts) if i % 10 == 3]
    want += [(texts[i][0], None, f"declared more than once: Part/t/s/n{i} in {texts[i][0]},{texts[i + 1][0]}") for i in range(0, 400, 2) if (i + 1) % 10 != 3]
    assert rows == sorted(want)


def test_both_yaml_parsers_say_the_same():
    import yaml

    from duoplane.sources import documents

    def shape(n):
        if isinstance(n, yaml.ScalarNode):
            return n.tag, n.value, n.style or None, n.start_mark.line
        return n.tag, n.start_mark.line, [tuple(map(shape, x)) if isinstance(x, tuple) else shape(x) for x in n.value]

    deep = "[" * 200 + "]" * 200 + "\n"
    for text in ("a: 1\nb: 'x'\nc: [1, {d: e}]\n", "---", "a:\n---\n  ", 'a: "\\u00e9"\n', "- - - x\n", "a: &b c\nd: *b\n", "k: !!str 1\n", "é: ü\n", "a: |\n  b\n", "", "a: b: c\n", "a:\t1\n", deep):
        told = []
        for read in (documents._nodes, lambda t: list(yaml.compose_all(t, Loader=yaml.SafeLoader))):
            try:
                told.append([shape(n) for n in read(text)])
            except yaml.YAMLError as why:
                told.append(str(why))
        assert told[0] == told[1], text


def test_small_files_in_order_take_few_tasks(spark, tmp_path, monkeypatch):
    """Files are as small as asked for, but tasks are of ``ROWS`` rows: the driver draws a sample and gets a result for each."""
    monkeypatch.setattr(ordered, "ROWS", 1000)
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id"))
    index = ordered.write_in_order(rows, path := f"file://{tmp_path}/t", ["k"], 10).orderBy("offset").collect()
    assert len({r.part for r in index}) <= 5 and len(index) >= 500 and max(r.n for r in index) <= 10
    assert [r.offset for r in index] == [sum(r.n for r in index[:i]) for i in range(len(index))]
    for offset, limit in ((0, 3), (995, 2010), (4990, 100), (5000, 1), (37, 0)):
        assert [r.k for r in ordered.page(spark, path, ["k"], offset, limit).collect()] == list(range(offset, min(5000, offset + limit)))
    assert ordered.page_total(spark, path) == 5000
    placed = ordered.positions(rows, f"file://{tmp_path}/p", ["k"], rows_per_file=10)
    assert placed.count() == 5000 and placed.filter("position != k + 1").count() == 0
    none = ordered.positions(rows.limit(0), f"file://{tmp_path}/none", ["k"], rows_per_file=10)
    assert none.count() == 0 and ordered.page(spark, f"file://{tmp_path}/none", ["k"], 0, 5).count() == 0


def test_a_bucket_takes_its_rows_piece_by_piece(monkeypatch):
    """A batch's rows of a bucket are never held together, and in pieces they come to what they come to run by run."""
    import random
    import weakref

    import pandas as pd

    class Entries(dict):
        getValue, updateValue = dict.get, dict.__setitem__  # noqa: N815

        def iterator(self):
            return iter(list(self.items()))

    def plain(rows, state):
        for run in sorted({r["run"] for r in rows}):
            mine = [r for r in rows if r["run"] == run]
            for r in mine:
                name, entry = (r["kind"], r["scope"], r["name"]), (run, int(r["at"].timestamp() * 1_000_000), r["position"], r["collector"], r["provider_id"], None)
                if r["event"] == absence.SEEN and (name not in state or state[name][:3] < entry[:3]):
                    state[name] = entry
            for r in mine:
                for name, e in list(state.items()) if r["event"] == absence.CLOSED and r["entitled"] else []:
                    if e[3] == r["collector"] and e[0] < run and e[5] is None:
                        state[name] = (*e[:5], r["at"].to_pydatetime())

    draw, alive = random.Random(5), []
    for held in (absence.HELD, 8, 1):
        monkeypatch.setattr(absence, "HELD", held)
        bucket, want = absence.Plane(), {}
        bucket.entries = Entries()
        for _ in range(3):
            rows = [{"tenant_id": "t", "collector": draw.choice("ab"), "run": draw.randrange(1, 6), "event": absence.SEEN, "kind": "k", "scope": "s", "name": f"n{draw.randrange(60)}", "provider_id": draw.choice(["p", None]), "position": i, "entitled": None, "at": pd.Timestamp(2024, 1, draw.randrange(1, 28))} for i in range(300)]
            rows += [rows[0] | {"event": absence.CLOSED, "collector": c, "run": r, "entitled": draw.random() < 0.7, "at": pd.Timestamp(2024, 2, r)} for c in "ab" for r in range(1, 7) if draw.random() < 0.6]
            draw.shuffle(rows)
            most = 0

            def pieces(rows=rows):
                nonlocal most
                for i in range(0, len(rows), 10):
                    piece = pd.DataFrame(rows[i : i + 10])
                    alive.append(weakref.ref(piece))
                    most = max(most, sum(x() is not None for x in alive))
                    yield piece
                    del piece

            list(bucket.handleInputRows(("t", 0), pieces(), None))
            plain(rows, want)
            assert bucket.entries == want and most < 20


def test_a_bucket_gets_and_reads_its_rows_in_bulk(monkeypatch):
    """What tasks read is packed, with the last sighting of each key alone, and comes to the same state; entries aren't asked for one by one where there are few."""
    import random

    import pandas as pd

    class Entries(dict):
        updateValue, asked = dict.__setitem__, 0  # noqa: N815

        def getValue(self, name):  # noqa: N802
            self.asked += 1
            return self.get(name)

        def iterator(self):
            return iter(list(self.items()))

    draw, buckets = random.Random(3), 4
    for gathered in (100_000, 30):
        monkeypatch.setattr(absence, "_GATHERED", gathered)
        plain, bulk = ({b: absence.Plane() for b in range(buckets)}, {b: absence.PackedPlane() for b in range(buckets)})
        for p in (*plain.values(), *bulk.values()):
            p.entries = Entries()
        for batch in range(3):
            rows = [{"tenant_id": "t", "bucket": i % 40 % buckets, "collector": draw.choice("ab"), "run": draw.randrange(1, 6), "event": absence.SEEN, "kind": "k", "scope": "s", "name": f"n{i % 40}", "provider_id": draw.choice(["p", None]), "position": i, "entitled": None, "at": draw.choice([pd.Timestamp(2024, 1, draw.randrange(1, 28)), pd.NaT])} for i in range(400)]
            rows += [rows[0] | {"bucket": b, "event": absence.CLOSED, "kind": None, "scope": None, "name": None, "position": None, "collector": "a", "run": r, "entitled": True, "at": pd.Timestamp(2024, 2, r)} for r in (2, 4) for b in range(buckets)]
            draw.shuffle(rows)
            pieces = [pd.DataFrame(rows[i : i + 50]) for i in range(0, len(rows), 50)]
            packed = pd.concat(list(absence.packed(iter(pieces))), ignore_index=True)
            sizes = [len(absence.unpacked(x).query("event == 'seen'")) for x in packed["observations"]]
            assert gathered < 100 or (max(sizes) == 10 and sum(n > 0 for n in sizes) == buckets)
            for b in range(buckets):
                list(plain[b].handleInputRows(("t", b), (x[x["bucket"] == b].drop(columns="bucket") for x in pieces), None))
                changed = list(bulk[b].handleInputRows(("t", b), iter([packed[packed["bucket"] == b]]), None))
                assert batch or sum(map(len, changed)) == 10
            tables = [{k: v for p in side.values() for k, v in p.entries.items()} for side in (plain, bulk)]
            assert tables[0] == tables[1] and len(tables[1]) == 40 and not sum(p.entries.asked for p in bulk.values())


def test_state_is_kept_by_as_many_tasks_as_asked_for(spark, tmp_path):
    """Each opens and writes a store in every batch, which for each of a shuffle's partitions takes longer than the rows."""
    spark.createDataFrame(sightings((1, "c", "web", "1"), (1, "c", True)), absence.OBSERVATION).coalesce(1).write.parquet(f"{tmp_path}/in")
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        stream = spark.readStream.schema(absence.OBSERVATION).parquet(f"{tmp_path}/in")
        absence.observe_plane(stream, f"{tmp_path}/log", 6, lambda changes, batch: changes.count(), tasks=2).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "7"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    assert sorted(p.name for p in (tmp_path / "log/state/0").iterdir() if p.name.isdigit()) == ["0", "1"]
    assert [r.name for r in absence.plane_of(spark, f"{tmp_path}/log").collect()] == ["web"]
