"""Revisions of a Git branch, ingested as they come."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.revisions import RevisionConflict
from ..sources.documents import InvalidRevision, ingest_and_commit
from ..sources.git import git, stream_git
from ..storage.files import Files

log = logging.getLogger(__name__)
INGESTED, REPEATED, REFUSED = "ingested", "repeated", "refused"
#: How often a revision is tried while others commit.
ATTEMPTS = 5


def ingest_batch(batch: DataFrame, repo: str, store: str, tenant_id: str, api_version: str, kinds: dict[str, dict[str, str]]) -> dict[str, str]:
    """Commit every revision of a batch, oldest first; what became of each is kept at ``store`` as well. A bad revision is refused and the next one
    is tried; a document that could not be read refuses its revision, as a plane is whole or not there."""
    files, done = Files(batch.sparkSession, store), {}
    batch = batch.persist()
    try:
        for r in batch.filter("revision_id is null").select("error").distinct().collect():
            log.warning("the repository is unavailable: %s", r.error)
        heads = [r.revision_id for r in batch.filter("revision_id is not null").select("revision_id").distinct().collect()]
        for revision in _oldest_first(repo, heads):
            mine = batch.filter(F.col("revision_id") == revision)
            why = mine.filter("error is not null").agg(F.min("error")).first()[0]
            if why is None:
                done[revision], why = _tried(mine, store, tenant_id, revision, api_version, kinds)
            else:
                done[revision] = REFUSED
            files.put_if_absent(f"outcomes/{tenant_id}/{revision}.{done[revision]}.json", {"revision": revision, "outcome": done[revision], "why": why})
    finally:
        batch.unpersist()
    return done


def _tried(mine: DataFrame, store: str, tenant_id: str, revision: str, api_version: str, kinds: dict[str, dict[str, str]]) -> tuple[str, str | None]:
    documents = mine.filter("source is not null").select("source", "content")
    why: Exception | None = None
    for _ in range(ATTEMPTS):
        try:
            new = ingest_and_commit(mine.sparkSession, "", store, tenant_id, revision, api_version, kinds, documents)
            return (INGESTED if new else REPEATED), None
        except InvalidRevision as bad:
            return REFUSED, str(bad)
        except RevisionConflict as conflict:
            why = conflict
    return REFUSED, str(why)


def _oldest_first(repo: str, revisions: list[str]) -> list[str]:
    if len(revisions) < 2:
        return revisions
    order = git(repo, "rev-list", "--topo-order", "--reverse", *revisions).decode().split()
    return sorted(revisions, key=order.index)


def follow(spark: SparkSession, repo: str, store: str, checkpoint: str, tenant_id: str, api_version: str, kinds: dict[str, dict[str, str]], interval: str | None = None, **options: str) -> StreamingQuery:
    """Ingest a branch's revisions: with an ``interval`` (say "300 seconds") for good, else those that are there now."""
    path = options.get("mirror") or repo
    stream = stream_git(spark, repo, **options)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: ingest_batch(df, path, store, tenant_id, api_version, kinds))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
