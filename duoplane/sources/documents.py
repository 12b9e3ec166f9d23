"""Intent documents: YAML files of a tree, each checked on its own inside a task, the whole set by DataFrame operations.

A document states ``apiVersion``, ``kind``, ``metadata`` (name, scope) and ``attributes``; nothing else decides. Scalars
under ``attributes`` are read as written: quoted text goes to the declared type's parser as it is, a plain ``null`` is
null, an empty value is refused.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import ENCODED_ARROW, _VALUE_ARROW, encode, problem_of, spread
from ..functions.literals import DECLARED_TYPES, Unacceptable
from ..model import ATTRIBUTES, KEY
from ..operators.revisions import active_revision, commit, is_committed
from ..storage.files import Files

LONGEST_NAME = 253
PARSED = T.StructType([T.StructField(c, T.StringType()) for c in ("source", "kind", "tenant_id", "scope", "name")] + [T.StructField("attributes", ATTRIBUTES), T.StructField("line", T.IntegerType()), T.StructField("error", T.StringType())])


class InvalidDocument(ValueError):
    def __init__(self, message: str, node: object = None) -> None:
        super().__init__(message)
        mark = getattr(node, "start_mark", None)
        self.line = mark.line + 1 if mark else None


#: Errors of a set that are shown; ``revision_errors`` has them all.
SHOWN = 1000


class InvalidRevision(ValueError):
    """The first errors of a document set, ordered by source."""

    def __init__(self, errors: list[tuple[str, int | None, str]]) -> None:
        self.errors = errors
        super().__init__("\n".join(f"{s}:{n}: {m}" if n else f"{s}: {m}" for s, n, m in errors))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """source (path) and content (bytes) of every .yaml and .yml file below ``path``, without any in a .git folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(F.col("path").rlike(r"\.ya?ml$") & ~F.col("path").contains("/.git/")).select(F.col("path").alias("source"), "content")


def _mapping(node: object, what: str) -> dict[str, tuple[object, object]]:
    """Entries (key node, value node) of a mapping by their keys' text."""
    import yaml

    if not isinstance(node, yaml.MappingNode):
        raise InvalidDocument(f"{what} is not a mapping", node)
    if node.tag != "tag:yaml.org,2002:map":
        raise InvalidDocument(f"{what} has the tag {node.tag}", node)
    out: dict[str, tuple[object, object]] = {}
    for key, value in node.value:
        if not isinstance(key, yaml.ScalarNode):
            raise InvalidDocument(f"{what} has a structure as a key", key)
        if key.tag == "tag:yaml.org,2002:merge":
            raise InvalidDocument(f"{what} uses a merge key", key)
        if key.value in out:
            raise InvalidDocument(f"{what} repeats the key {key.value}", key)
        out[key.value] = (key, value)
    return out


def _built(node: object, what: str, done: dict[int, object], within: tuple[int, ...] = ()) -> object:
    """The value of an envelope's node, whose mappings all obey the same rules. A shared node is built once, so aliases of
    aliases cost nothing; a cycle is refused."""
    import yaml

    if id(node) in within:
        raise InvalidDocument(f"{what} is nested in itself", node)
    if id(node) in done:
        return done[id(node)]
    inside = (*within, id(node))
    if isinstance(node, yaml.ScalarNode):
        try:
            value = yaml.constructor.SafeConstructor().construct_object(node)
        except (yaml.YAMLError, ValueError) as why:
            raise InvalidDocument(f"{what} cannot be read: {why}".replace("\n", " "), node) from None
    elif isinstance(node, yaml.MappingNode):
        value = {k: _built(v, f"{what}.{k}", done, inside) for k, (_, v) in _mapping(node, what).items()}
    elif node.tag != "tag:yaml.org,2002:seq":
        raise InvalidDocument(f"{what} has the tag {node.tag}", node)
    else:
        value = [_built(v, f"{what}[{i}]", done, inside) for i, v in enumerate(node.value)]
    done[id(node)] = value
    return value


def _identifier(holder: object, entries: dict, key: str, what: str) -> str:
    import yaml

    if key not in entries:
        raise InvalidDocument(f"{what} is missing", holder)
    node = entries[key][1]
    if not isinstance(node, yaml.ScalarNode) or node.tag != "tag:yaml.org,2002:str" or not 1 <= len(node.value) <= LONGEST_NAME:
        raise InvalidDocument(f"{what} is not a text of 1 to {LONGEST_NAME} characters", node)
    return node.value


def _stated(node: object, name: str, type_name: str) -> object:
    import yaml

    parse = DECLARED_TYPES.get(type_name)
    if parse is None:
        raise InvalidDocument(f"the kind gives attributes.{name} the unknown type {type_name}", node)
    if not isinstance(node, yaml.ScalarNode):
        raise InvalidDocument(f"attributes.{name} is not a scalar", node)
    if not node.style:  # None or "", by the parser
        if node.value == "":
            raise InvalidDocument(f"attributes.{name} is empty; write null or a quoted text", node)
        if node.value == "null":
            return None
    try:
        return parse(node.value)
    except Unacceptable as why:
        raise InvalidDocument(f"attributes.{name}: {why}", node) from None


#: Characters that both of the YAML library's parsers take for the same; a tab, an escape, a tag, an alias or a block text makes a document one for the
#: plain parser, as do a scalar without a type (= or <<), a last line without an end, more brackets or longer runs of what nests than ``_DEEPEST``.
_ALIKE = re.compile(r"[\n -~\xa0-\u2027\u202a-\ud7ff\ue000-\ufefe\uff00-\ufffd\U00010000-\U0010ffff]*")
_DEEPEST = 50
_UNLIKE = re.compile(r"[!%&*?>@\\`|]|<<|(?<![^\s,\[{])=(?![^\s,\]}])|[ :-]{" + str(_DEEPEST) + "}")


def _nodes(text: str) -> list:
    """The documents of a text. The library's compiled parser takes a tenth of the time; texts in which it could differ, and those that it refuses, are for
    the plain one, whose words and lines count."""
    import yaml

    fast = getattr(yaml, "CSafeLoader", None)
    if fast and text.endswith("\n") and text.count("[") + text.count("{") <= _DEEPEST and _ALIKE.fullmatch(text) and not _UNLIKE.search(text):
        try:
            return list(yaml.compose_all(text, Loader=fast))
        except yaml.YAMLError:
            pass
    return list(yaml.compose_all(text, Loader=yaml.SafeLoader))


def parse_document(content: bytes, api_version: str, kinds: dict[str, dict[str, str]]) -> dict:
    """kind, scope, name, attributes and envelope (all but the attributes, as plain values) of one document; raises
    InvalidDocument with the first thing wrong and its line, for what is missing that of what should hold it."""
    import yaml

    try:
        nodes = _nodes(content.decode("utf-8"))
    except (yaml.YAMLError, UnicodeDecodeError, RecursionError) as why:
        mark = getattr(why, "problem_mark", None)
        error = InvalidDocument(f"unparseable YAML: {why}".replace("\n", " "))
        error.line = mark.line + 1 if mark else None
        raise error from None
    if len(nodes) != 1 or nodes[0] is None:
        raise InvalidDocument(f"{len(nodes)} documents where one is due" if len(nodes) != 1 else "the document is empty")
    root = _mapping(nodes[0], "the document")
    done: dict[int, object] = {}
    try:
        envelope = {key: _built(value, key, done) for key, (_, value) in root.items() if key != "attributes"}
    except RecursionError:
        raise InvalidDocument("the envelope is nested too deep", nodes[0]) from None
    version = root.get("apiVersion", (None, nodes[0]))[1]
    if getattr(version, "value", None) != api_version:
        raise InvalidDocument(f"apiVersion is not {api_version}", version)
    if "provider_id" in root:
        raise InvalidDocument("provider_id cannot be declared", root["provider_id"][0])
    if "metadata" not in root:
        raise InvalidDocument("metadata is missing", nodes[0])
    metadata = _mapping(root["metadata"][1], "metadata")
    if "provider_id" in metadata:
        raise InvalidDocument("metadata.provider_id cannot be declared", metadata["provider_id"][0])
    below = root["metadata"][1]
    kind, name, scope = _identifier(nodes[0], root, "kind", "kind"), _identifier(below, metadata, "name", "metadata.name"), _identifier(below, metadata, "scope", "metadata.scope")
    if "attributes" not in root:
        raise InvalidDocument("attributes is missing", nodes[0])
    attributes = _mapping(root["attributes"][1], "attributes")
    if kind not in kinds:
        raise InvalidDocument(f"unknown kind {kind}", root["kind"][1])
    missing, unknown = sorted(kinds[kind].keys() - attributes), sorted(attributes.keys() - kinds[kind].keys())
    if missing or unknown:
        raise InvalidDocument("; ".join(f"{word} attributes: {', '.join(x)}" for word, x in (("missing", missing), ("unknown", unknown)) if x), root["attributes"][0])
    values = {k: _stated(node, k, kinds[kind][k]) for k, (_, node) in attributes.items()}
    if why := problem_of(values):
        raise InvalidDocument(why, root["attributes"][0])
    return {"kind": kind, "scope": scope, "name": name, "attributes": values, "envelope": envelope}


def parse_documents(documents: DataFrame, tenant_id: str, api_version: str, kinds: dict[str, dict[str, str]]) -> DataFrame:
    """One row for each document: its resource, or line and error. Documents are spread over all cores first, by their sources: a file of a table can pack a
    million of them, and would be one task's."""
    names = [f.name for f in PARSED.fields]
    types = [pa.string()] * 5 + [pa.map_(pa.string(), _VALUE_ARROW), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, content in zip(batch.column("source").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    d = parse_document(content or b"", api_version, kinds)
                    rows.append((source, d["kind"], tenant_id, d["scope"], d["name"], [(k, encode(v)) for k, v in d["attributes"].items()], None, None))
                except InvalidDocument as why:
                    rows.append((source, None, tenant_id, None, None, None, why.line, str(why)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)

    return spread(documents.select("source", "content"), "source").mapInArrow(run, PARSED)


def revision_errors(parsed: DataFrame) -> DataFrame:
    """source, line, message of every bad document and of every key that several documents declare, ordered by source. One exchange serves both, so that
    documents are parsed once."""
    bad = F.col("bad").isNotNull()
    rows = parsed.select(*KEY, F.when(F.col("error").isNotNull(), F.col("source")).alias("bad"), "line", "error", "source")
    groups = rows.groupBy(*KEY, "bad", "line", "error").agg(F.sort_array(F.collect_list("source")).alias("s")).filter(bad | (F.size("s") > 1))
    clash = F.concat(F.lit("declared more than once: "), F.concat_ws("/", *KEY), F.lit(" in "), F.array_join("s", ","))
    said = groups.select(F.explode(F.when(bad, F.col("s")).otherwise(F.slice("s", 1, 1))).alias("source"), "line", F.when(bad, F.col("error")).otherwise(clash).alias("message"))
    return said.orderBy("source", F.asc_nulls_last("line"), "message")


def ingest_revision(spark: SparkSession, path: str, tenant_id: str, revision_id: str, api_version: str, kinds: dict[str, dict[str, str]], staging: str = "", documents: DataFrame | None = None) -> DataFrame:
    """The declared plane of a revision (of the documents below ``path``, or of ``documents``), whole or not at all: raises InvalidRevision with
    every error. No documents are a valid, empty plane. Parsed rows are written to ``staging`` (a new folder of the shared
    storage) and read from there for both uses; without one, documents are parsed for each. Of the errors, which a person is to
    read, the first ``SHOWN`` come to the driver."""
    parsed = parse_documents(read_documents(spark, path) if documents is None else documents, tenant_id, api_version, kinds)
    if staging:
        parsed.write.parquet(staging)
        parsed = spark.read.schema(PARSED).parquet(staging)
    errors = [(r.source, r.line, r.message) for r in revision_errors(parsed).limit(SHOWN).collect()]
    if errors:
        raise InvalidRevision(errors)
    return parsed.select(*KEY, F.lit(None).cast("string").alias("provider_id"), "attributes", F.lit(revision_id).alias("revision_id"))


def ingest_and_commit(spark: SparkSession, path: str, store: str, tenant_id: str, revision_id: str, api_version: str, kinds: dict[str, dict[str, str]], documents: DataFrame | None = None) -> bool:
    """Make a revision's documents the tenant's active plane at ``store``; False where the revision is there already: the
    same commit may come any number of times. Another revision that is activated meanwhile is a RevisionConflict."""
    if is_committed(spark, store, tenant_id, revision_id):
        return False
    seen = active_revision(spark, store, tenant_id)
    files, staging = Files(spark, store), f"parsed/{tenant_id}/{revision_id}-{uuid.uuid4().hex}"
    try:
        return commit(ingest_revision(spark, path, tenant_id, revision_id, api_version, kinds, files.at(staging), documents), store, tenant_id, revision_id, seen)
    finally:
        files.delete(staging)


def kinds_of(table: DataFrame) -> dict[str, dict[str, str]]:
    """The kind table (kind, schema as JSON text) as a dictionary; a handful of rows."""
    return {r.kind: json.loads(r.schema) for r in table.collect()}


__all__ = ["ENCODED_ARROW", "InvalidDocument", "InvalidRevision", "ingest_and_commit", "ingest_revision", "kinds_of", "parse_document", "parse_documents", "read_documents", "revision_errors"]
