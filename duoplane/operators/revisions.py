"""Declared revisions: append-only planes, one active revision a tenant, and checks over a whole set of documents."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import KEY
from ..storage.files import Files, numbered
from .matching import violations


def duplicate_identities(documents: DataFrame, keys: list[str] = KEY, source: str = "source") -> DataFrame:
    """Keys that several documents declare: keys, n, sources (sorted, comma-joined). Only theirs are gathered."""
    counted = documents.select(*keys, F.col(source).alias("s")).withColumn("n", F.count("*").over(Window.partitionBy(*keys))).filter("n > 1")
    found = counted.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list("s")).alias("s"))
    return found.select(*keys, "n", F.array_join("s", ",").alias("sources"))


def attribute_sets(stated: Column, schema: Column) -> tuple[Column, Column]:
    """(missing, unknown) attribute names of a document, sorted."""
    return F.array_sort(F.array_except(schema, stated)), F.array_sort(F.array_except(stated, schema))


def active_plane(rows: DataFrame, revisions: DataFrame) -> DataFrame:
    """Rows of each tenant's active revision; a tenant without one has none."""
    active = revisions.filter("is_active").select("tenant_id", "revision_id")
    return rows.join(active, ["tenant_id", "revision_id"], "left_semi")


def activate(revisions: DataFrame, tenant_id: str, revision_id: str) -> DataFrame:
    """The revision table with one active revision of the tenant; a revision that is there already is only activated."""
    mine = F.col("tenant_id") == tenant_id
    new = revisions.sparkSession.createDataFrame([(tenant_id, revision_id)], "tenant_id string, revision_id string")
    known = revisions.withColumn("is_active", F.when(mine, F.col("revision_id") == revision_id).otherwise(F.col("is_active")))
    fresh = new.join(revisions, ["tenant_id", "revision_id"], "left_anti").withColumn("is_active", F.lit(True))
    return known.select("tenant_id", "revision_id", "is_active").unionByName(fresh)


def replayed(commits: DataFrame) -> DataFrame:
    """The revision table after all commits (tenant_id, revision_id, at): one row for each revision, however often it came;
    active is the one that came first last, as one that comes again is a no-op."""
    once = commits.groupBy("tenant_id", "revision_id").agg(F.min("at").alias("at"))
    last = once.groupBy("tenant_id").agg(F.max(F.struct("at", "revision_id")).alias("last"))
    return once.join(last, "tenant_id").select("tenant_id", "revision_id", "at", (F.col("revision_id") == F.col("last.revision_id")).alias("is_active"))


def revision_constraints(revisions: DataFrame) -> DataFrame:
    """Broken rules of the revision table: rule, value, n. A revision once for each tenant, one active one."""
    once = violations(revisions, ["tenant_id", "revision_id"], "revision of a tenant")
    return once.unionByName(violations(revisions.filter("is_active"), ["tenant_id"], "active revision"))


class RevisionConflict(RuntimeError):
    """Another writer has activated another revision in the meantime."""


#: Commits after which one lists all revisions before it, so that a reader opens at most as many files; turns that a writer tries for.
LISTED, TURNS = 64, 8
#: Whatever revision is active.
ANY = object()


@dataclass(frozen=True)
class _Log:
    """A tenant's commits: numbered files, each created by one writer and never changed."""

    files: Files
    tenant_id: str

    def read(self) -> tuple[int, str | None, str | None, set[str]]:
        """(last number, active revision, its folder, all revisions)."""
        last = self.files.last_number(f"active/{self.tenant_id}")
        known: set[str] = set()
        newest = None
        for n in range(last, -1, -1):
            held = self.files.get(f"active/{self.tenant_id}/{numbered(n)}")
            newest = newest or held
            known.add(held["revision"])
            if "before" in held:
                known |= set(held["before"])
                break
        return (last, None, None, known) if newest is None else (last, newest["revision"], newest["folder"], known)

    def add(self, n: int, revision_id: str, folder: str, known: set[str]) -> bool:
        before = {"before": sorted(known)} if n % LISTED == 0 else {}
        return self.files.put_if_absent(f"active/{self.tenant_id}/{numbered(n)}", {"revision": revision_id, "folder": folder, **before})


def commit(plane: DataFrame, path: str, tenant_id: str, revision_id: str, expected: object = ANY, turns: int = TURNS) -> bool:
    """Write a revision's plane below ``path`` and make it the tenant's active one; False, and nothing is written, where the
    revision is there already.

    Rows are written first, into a folder of this writer's own. The commit is the creation of the next numbered file, which one writer
    can do; who loses the turn reads what won and decides again: the same revision is there now (False), another one is active, and
    either the writer saw ``expected`` there, which has changed (RevisionConflict), or it takes the turn after it. So a
    reader sees the old plane or the new one, whole; rows without a commit are read by nobody (``abandoned`` lists them).
    """
    log = _Log(Files(plane.sparkSession, path), tenant_id)
    if revision_id in log.read()[3]:
        return False
    folder = f"planes/{tenant_id}/{revision_id}-{uuid.uuid4().hex}"
    plane.write.parquet(log.files.at(folder))
    for _ in range(turns):
        last, active, _, known = log.read()
        if revision_id in known:
            log.files.delete(folder)
            return False
        if expected is not ANY and active != expected:
            break
        if log.add(last + 1, revision_id, folder, known):
            return True
    log.files.delete(folder)
    raise RevisionConflict(f"{log.read()[1]} was activated for {tenant_id} while {revision_id} was written")


def is_committed(spark: SparkSession, path: str, tenant_id: str, revision_id: str) -> bool:
    return revision_id in _Log(Files(spark, path), tenant_id).read()[3]


def committed(spark: SparkSession, path: str, tenant_id: str) -> list[str]:
    """Revisions in the order of their commits."""
    files = Files(spark, path)
    return [files.get(f"active/{tenant_id}/{n}")["revision"] for n in files.names(f"active/{tenant_id}")]


def active_revision(spark: SparkSession, path: str, tenant_id: str) -> str | None:
    return _Log(Files(spark, path), tenant_id).read()[1]


def committed_plane(spark: SparkSession, path: str, tenant_id: str) -> DataFrame | None:
    """The tenant's active plane; None without an active revision."""
    folder = _Log(Files(spark, path), tenant_id).read()[2]
    return None if folder is None else spark.read.parquet(f"{path}/{folder}")


def revision_plane(spark: SparkSession, path: str, tenant_id: str, revision_id: str) -> DataFrame | None:
    """The plane of a committed revision, active or not; None where it isn't committed."""
    files = Files(spark, path)
    for n in files.names(f"active/{tenant_id}"):
        held = files.get(f"active/{tenant_id}/{n}")
        if held["revision"] == revision_id:
            return spark.read.parquet(files.at(held["folder"]))
    return None


def abandoned(spark: SparkSession, path: str, tenant_id: str) -> list[str]:
    """Folders of planes that no commit names: of writers that died, or that still write."""
    files = Files(spark, path)
    used = {files.get(f"active/{tenant_id}/{n}")["folder"].rpartition("/")[2] for n in files.names(f"active/{tenant_id}")}
    return [n for n in files.names(f"planes/{tenant_id}") if n not in used]
