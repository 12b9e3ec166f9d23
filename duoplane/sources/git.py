"""A Git branch as a source: its documents at one revision, or a stream of its revisions.

The stream's offsets are commit ids, so a restarted query goes on after the last revision that it finished, and each revision
comes once. Every revision gives a row without a document that announces it (one without documents is a valid, empty plane),
and its documents, read in parts of about ``PART_BYTES`` by tasks of their own. A repository that cannot be reached gives a row with the
error; the stream goes on and asks again at its next trigger.

``repo`` is a repository that driver and executors reach by path; one behind a URL needs ``mirror``, a path that they share, into which
the driver clones it and fetches.
"""

from __future__ import annotations

import os
import subprocess
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of documents that a task reads, at least one document; seconds that a command of Git may take.
PART_BYTES, PATIENCE = 32 << 20, 600
SUFFIXES = (".yaml", ".yml")


class RepositoryUnavailable(RuntimeError):
    """Git could not do what it was asked to."""


def git(path: str | None, *args: str, given: bytes = b"") -> bytes:
    """The output of a Git command at ``path``; RepositoryUnavailable with what it said."""
    at = ["-C", path] if path else []
    try:
        done = subprocess.run(["git", *at, *args], input=given, capture_output=True, timeout=PATIENCE, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"}, check=False)
    except (OSError, subprocess.TimeoutExpired) as why:
        raise RepositoryUnavailable(f"git {args[0]}: {why}") from why
    if done.returncode:
        raise RepositoryUnavailable(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def synced(repo: str, mirror: str = "") -> str:
    """The path to read from: ``repo`` itself, or its mirror, cloned or brought up to date."""
    if not mirror:
        _is_root(repo)
        return repo
    if os.path.exists(os.path.join(mirror, "HEAD")):
        git(mirror, "fetch", "--prune", "--quiet", "origin")
    else:
        git(None, "clone", "--mirror", "--quiet", repo, mirror)
    return mirror


def _is_root(path: str) -> None:
    """A folder inside a repository is not that repository."""
    found = os.path.realpath(git(path, "rev-parse", "--absolute-git-dir").decode().strip())
    if found not in (os.path.realpath(path), os.path.realpath(os.path.join(path, ".git"))):
        raise RepositoryUnavailable(f"{path} is not the root of a repository")


def head(path: str, branch: str) -> str:
    """The commit that a branch is at."""
    return git(path, "rev-parse", "--verify", "--quiet", f"refs/heads/{branch}^{{commit}}" if branch != "HEAD" else "HEAD^{commit}").decode().strip()


@dataclass
class Part(InputPartition):
    """Documents of a revision (path and blob), or, without any, its announcement or an error."""

    path: str
    revision: str | None
    blobs: list[tuple[str, str]] = field(default_factory=list)
    error: str | None = None


def parts(path: str, revision: str, most_bytes: int = PART_BYTES) -> list[Part]:
    """The announcement of a revision and its documents, by tasks."""
    out, size = [Part(path, revision)], 0
    for entry in git(path, "ls-tree", "-r", "-l", "-z", revision).split(b"\0"):
        if not entry:
            continue
        facts, _, name = entry.partition(b"\t")
        mode, kind, blob, length = facts.split()
        source = name.decode("utf-8", "surrogateescape")
        if kind != b"blob" or mode == b"120000" or not source.endswith(SUFFIXES) or ".git" in source.split("/"):
            continue
        if len(out) == 1 or size + int(length) > most_bytes:
            out.append(Part(path, revision))
            size = 0
        out[-1].blobs.append((source.encode("utf-8", "replace").decode(), blob.decode()))
        size += int(length)
    return out


def read_part(part: Part) -> Iterator[tuple]:
    """revision_id, source, content, error."""
    if not part.blobs:
        yield part.revision, None, None, part.error
        return
    try:
        held, at = git(part.path, "cat-file", "--batch", given="".join(f"{b}\n" for _, b in part.blobs).encode()), 0
        for source, _ in part.blobs:
            line = held.index(b"\n", at)
            size = int(held[at:line].split()[-1])
            yield part.revision, source, held[line + 1 : line + 1 + size], None
            at = line + 2 + size
    except (RepositoryUnavailable, ValueError) as why:
        yield part.revision, None, None, f"documents of {part.revision} could not be read: {why}"


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.mirror = options["repo"], options.get("mirror", "")
        self.branch, self.revision = options.get("branch", "HEAD"), options.get("revision")
        self.bytes = int(options.get("partBytes", PART_BYTES))

    def partitions(self) -> list[Part]:
        path = synced(self.repo, self.mirror)
        return parts(path, self.revision or head(path, self.branch), self.bytes)

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from read_part(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets: the commit up to which revisions have come, and when the repository last failed."""

    def __init__(self, options: dict) -> None:
        self.repo, self.mirror = options["repo"], options.get("mirror", "")
        self.branch, self.earliest = options.get("branch", "HEAD"), options.get("start", "latest") == "earliest"
        self.bytes = int(options.get("partBytes", PART_BYTES))
        self.known, self.failure = "", ("", "")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commit": "", "failed": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        try:
            self.known = head(synced(self.repo, self.mirror), self.branch)
        except RepositoryUnavailable as why:
            self.failure = (repr(time.time()), str(why))
        return {"commit": self.known, "failed": self.failure[0]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        path, out = self.mirror or self.repo, []
        if end["failed"] and end["failed"] != start["failed"]:
            out.append(Part(path, None, error=self.failure[1] if self.failure[0] == end["failed"] else "the repository could not be reached"))
        if not end["commit"] or end["commit"] == start["commit"]:
            return out
        try:
            for revision in self._between(path, start["commit"], end["commit"]):
                out += parts(path, revision, self.bytes)
        except RepositoryUnavailable as why:
            out.append(Part(path, end["commit"], error=f"{end['commit']} could not be listed: {why}"))
        return out

    def _between(self, path: str, start: str, end: str) -> list[str]:
        """Revisions after ``start`` up to ``end``, oldest first; the last one alone at the start of a stream, and where history was rewritten."""
        if start:
            try:
                git(path, "merge-base", "--is-ancestor", start, end)
            except RepositoryUnavailable:
                return [end]
            return git(path, "rev-list", "--reverse", "--first-parent", f"{start}..{end}").decode().split()
        return git(path, "rev-list", "--reverse", "--first-parent", end).decode().split() if self.earliest else [end]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from read_part(partition)

    def commit(self, end: dict) -> None:
        pass


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return "revision_id string, source string, content binary, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)


def read_git(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    """Documents of one revision (``revision``, else the branch's last): revision_id, source, content, error."""
    spark.dataSource.register(GitSource)
    return spark.read.format("git").options(repo=repo, **options).load()


def stream_git(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    """Revisions as they come; ``start="earliest"`` begins with the branch's first one."""
    spark.dataSource.register(GitSource)
    return spark.readStream.format("git").options(repo=repo, **options).load()
