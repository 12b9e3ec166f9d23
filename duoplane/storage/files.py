"""Small files in a shared folder that are created whole or not at all, and by one writer only."""

from __future__ import annotations

import atexit
import contextlib
import json
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Files:
    """A folder of small JSON files, through Spark's file systems.

    ``put_if_absent`` is what all else here stands on: of any number of writers of one name one wins, and no reader ever
    sees part of a file. A file is written under a name of its own first; then it takes its name: by a hard link where the folder is a
    local path (which fails if the name is taken), else by a rename that does not overwrite (which the file system has to do in
    one step, as HDFS does)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        parsed = urlparse(self.root)
        self._local = unquote(parsed.path) if parsed.scheme == "file" else self.root if not parsed.scheme else None
        self._fs = self._path("").getFileSystem(self._conf)
        if self._local is not None and self._fs.getUri().getScheme() != "file":  # a path without a scheme on another default store
            self._local = None

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def put_if_absent(self, name: str, value: dict) -> bool:
        """Create ``name``; False, and nothing is changed, where it is there already."""
        text = json.dumps(value, sort_keys=True)
        if self._local is not None:
            path = os.path.join(self._local, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            held, draft = tempfile.mkstemp(dir=os.path.dirname(path), prefix="_")
            try:
                with os.fdopen(held, "w") as f:
                    f.write(text)
                    f.flush()
                    os.fsync(f.fileno())
                os.link(draft, path)
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        path = self._path(name)
        draft = self._jvm.org.apache.hadoop.fs.Path(path.getParent(), f"_{uuid.uuid4().hex}")
        self._fs.mkdirs(path.getParent())
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self._conf).rename(draft, path, options)
        except Exception:
            if not self.exists(name):
                raise
            return False
        finally:
            self._fs.delete(draft, False)
        return True

    def get(self, name: str) -> dict | None:
        """A file's value; None where there is none."""
        if not self.exists(name):
            return None
        source = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted, without drafts; none where there is no folder."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(path))
        return sorted(n for n in found if not n.startswith(("_", ".")))

    def last_number(self, folder: str) -> int:
        """The largest number that a file of the folder is named by; -1 where there is none."""
        return max((int(n) for n in self.names(folder) if n.isdigit()), default=-1)

    def modified(self, name: str) -> float:
        """When a file or folder was last written, in seconds."""
        return self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"


#: Folders to be deleted when this process ends, by application.
_PASSING: dict[str, list[str]] = {}


def passing(spark: SparkSession, path: str) -> str:
    """``path``, a folder of the shared storage that is deleted when this process ends (or by ``clear``)."""
    app = spark.sparkContext.applicationId
    if app not in _PASSING:
        _PASSING[app] = []
        atexit.register(_at_end, app)
    _PASSING[app].append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete the passing folders of this application; returns how many there were."""
    paths = _PASSING.get(spark.sparkContext.applicationId, [])
    jvm, n = spark.sparkContext._jvm, len(paths)
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def _at_end(app: str) -> None:
    with contextlib.suppress(Exception):  # the cluster may be gone already; what is left is the storage's to expire
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext.applicationId == app:
            clear(spark)


def numbered(n: int) -> str:
    return f"{n:012d}"
