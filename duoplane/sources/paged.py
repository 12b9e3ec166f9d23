"""A Python data source for paged provider APIs: pages of a token chain, retried while an error is transient.

The client is any object with ``page(token) -> (records, next token or None)``, named as ``module:factory`` so that a task
can make it. A chain stops for good on an error: records in hand are kept and the last row says that there is a gap. Chains
of different namespaces are read by tasks of their own, and one that breaks leaves the others alone.
"""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from .recorded import ProviderUnavailable, dig, records_in

#: Attempts of a page, the first delay in seconds and its growth; HTTP statuses that may pass. Fixed values.
ATTEMPTS, DELAY, GROWTH = 4, 0.5, 2
TRANSIENT = (429, 500, 502, 503, 504)


def is_transient(error: BaseException) -> bool:
    return getattr(error, "status", None) in TRANSIENT


def with_retry(call: Callable[[], object], transient: Callable[[BaseException], bool] = is_transient, sleep: Callable[[float], None] = time.sleep) -> object:
    """What ``call`` gives; an error that may pass is waited out a few times, ever longer."""
    delay = DELAY
    for left in reversed(range(ATTEMPTS)):
        try:
            return call()
        except Exception as why:
            if not left or not transient(why):
                raise
        sleep(delay)
        delay *= GROWTH


def next_token(payload: dict) -> str | None:
    """The continuation token of a page's envelope, None on the last page."""
    metadata = payload.get("metadata")
    return (metadata.get("continue") or None) if isinstance(metadata, dict) else None


class ListClient:
    """Pages of a list API: ``fetch(path, query)`` gives the text of one page, of a namespace or of all, of one name or of all."""

    def __init__(self, fetch: Callable[[str, dict], str], resource: str, envelope: str = "items", namespace: str = "", name: str = "", page_size: int = 200) -> None:
        self._fetch, self._envelope = fetch, envelope
        self._query = {"limit": page_size} | ({"fieldSelector": f"metadata.name={name}"} if name else {})
        self._path = f"namespaces/{namespace}/{resource}" if namespace else resource

    def page(self, token: str | None) -> tuple[list, str | None]:
        text = self._fetch(self._path, self._query | ({"continue": token} if token else {}))
        return records_in(text, self._envelope), next_token(json.loads(text))


class FolderPages:
    """Recorded pages of a provider: ``folder/namespace/0.json``, ``1.json``, ... with the envelope of a live one, in a folder that all tasks reach by
    path. A page that isn't there is a read that failed."""

    def __init__(self, folder: str, namespace: str = "", name: str = "", envelope: str = "items") -> None:
        self._folder, self._envelope, self._name = os.path.join(folder, namespace), envelope, name

    def page(self, token: str | None) -> tuple[list, str | None]:
        with open(os.path.join(self._folder, f"{token or 0}.json"), encoding="utf-8") as f:
            text = f.read()
        return records_in(text, self._envelope), next_token(json.loads(text))


def pages(client: object, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[int | None, str | None, bool]]:
    """(position, record, gap) of a whole chain; ProviderUnavailable if the first page fails already. A page that comes but
    cannot be read has failed as well."""
    token, at = None, 0
    while True:
        try:
            records, token = with_retry(lambda t=token: client.page(t), sleep=sleep)
        except Exception as why:
            if not at:
                raise ProviderUnavailable(f"no page could be read: {type(why).__name__} {why}") from why
            yield None, None, True
            return
        for record in records:
            yield at, json.dumps(record), False
            at += 1
        if not token:
            return


@dataclass
class Chain(InputPartition):
    """One token chain: of a namespace, or (empty) of all."""

    namespace: str


class _Reader(DataSourceReader):
    """One task for each namespace; a filter on namespaces chooses the tasks, one on a name goes to the provider."""

    def __init__(self, options: dict) -> None:
        self.client, self.args = options["client"], json.loads(options.get("args", "{}"))
        self.namespaces = [n for n in options.get("namespace", "").split(",") if n]
        self.names: set[str] | None = None
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        taken: dict[int, str] = {}
        for i, f in enumerate(filters):
            column = getattr(f, "attribute", None)
            if isinstance(f, EqualTo) and column == ("name",) and f.value:
                self.names = {f.value} if self.names is None else self.names & {f.value}
                taken[i] = "name"
            elif isinstance(f, EqualTo | In) and column == ("namespace",):
                values = ({f.value} if isinstance(f, EqualTo) else set(f.value)) - {None, ""}
                self.only = values if self.only is None else self.only & values
                taken[i] = "namespace"
        for i, f in enumerate(filters):
            if i not in taken and not (isinstance(f, IsNotNull) and f.attribute[0] in taken.values()):
                yield f

    def partitions(self) -> list[InputPartition]:
        wanted = self.namespaces
        if self.only is not None:
            wanted = [n for n in wanted if n in self.only] if wanted else sorted(self.only)
        elif not wanted:
            return [Chain("")]
        if not wanted or self.names == set():
            return [Chain(None)]  # nothing can pass the filters
        return [Chain(n) for n in wanted]

    def read(self, partition: Chain) -> Iterator[tuple]:
        if partition.namespace is None:
            return
        module, _, factory = self.client.partition(":")
        make = getattr(importlib.import_module(module), factory)
        chosen = {"namespace": partition.namespace} if partition.namespace else {}
        only = min(self.names) if self.names else None
        try:
            chain = pages(make(**self.args, **chosen, **({"name": only} if only else {})))
            for at, record, gap in chain:
                found = dig(json.loads(record), ("metadata", "name")) if record else None
                name = only if gap else found if isinstance(found, str) else None
                if gap or only is None or name == only:
                    yield partition.namespace or None, name, at, record, gap, None
        except ProviderUnavailable as why:
            yield partition.namespace or None, only, None, None, True, str(why)


class PagedSource(DataSource):
    """``read_paged``, or ``spark.read.format("paged").option("client", "module:factory")``. The factory runs in the task, with
    ``namespace`` and ``name`` where they are asked for and the JSON object ``args`` besides, so credentials are read there.

    A chain that breaks ends with a row that says so: ``gap``, without position and record; one of which no page could be
    read says why in ``unavailable``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "namespace string, name string, position long, record string, gap boolean, unavailable string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def read_paged(spark: SparkSession, client: str, namespaces: str = "", **args: object) -> DataFrame:
    """Records of a paged provider: of ``namespaces`` (comma-separated; a task each), or of all in one chain. ``args`` go to
    the client's factory."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged").option("client", client).option("namespace", namespaces).option("args", json.dumps(args)).load()
