"""Recorded provider payloads: JSON files whose records lie in a list under one key, normalised record by record."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import _VALUE_ARROW, encode, problem_of
from ..model import ATTRIBUTES


class ProviderUnavailable(RuntimeError):
    """A payload that cannot be read; not the same as an empty estate."""


@dataclass(frozen=True)
class Adapter:
    """How a provider's records become resources: paths from a record's root."""

    kind: str
    envelope: str
    scope: tuple[str, ...]
    name: tuple[str, ...]
    provider_id: tuple[str, ...]
    attributes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    optional: frozenset[str] = frozenset()  # attributes that a record may lack


DEPLOYMENTS = Adapter("Deployment", "items", ("metadata", "namespace"), ("metadata", "name"), ("metadata", "uid"), {"replicas": ("spec", "replicas")})
INSTANCES = Adapter("ComputeInstance", "data", ("compartment-id",), ("display-name",), ("id",), {"shape": ("shape",), "ocpus": ("shape-config", "ocpus")})

NORMALISED = T.StructType([T.StructField("position", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("kind", "tenant_id", "scope", "name", "provider_id")] + [T.StructField("attributes", ATTRIBUTES), T.StructField("problem", T.StringType())])


def dig(record: object, path: tuple[str, ...]) -> object:
    """What lies at a path; None as soon as a parent is no mapping."""
    for key in path:
        if not isinstance(record, dict):
            return None
        record = record.get(key)
    return record


def normalise(record: object, adapter: Adapter) -> dict:
    """scope, name, provider_id and attributes of one record; raises ValueError that names all missing fields."""
    if not isinstance(record, dict):
        raise ValueError("the record is not a mapping")
    paths = {"scope": adapter.scope, "name": adapter.name, "provider_id": adapter.provider_id} | adapter.attributes
    found = {k: dig(record, p) for k, p in paths.items()}
    if missing := sorted(".".join(paths[k]) for k, v in found.items() if v is None and k not in adapter.optional):
        raise ValueError("missing fields: " + ", ".join(missing))
    attributes = {k: found[k] for k in adapter.attributes if found[k] is not None}
    if why := problem_of(attributes):
        raise ValueError(why)
    return {k: str(found[k]) for k in ("scope", "name", "provider_id")} | {"attributes": attributes}


def records_in(text: str, envelope: str) -> list:
    """Records of a payload; raises ProviderUnavailable where it is no JSON or has no list of that name."""
    try:
        found = json.loads(text)
    except (ValueError, RecursionError) as why:
        raise ProviderUnavailable(f"not JSON: {why}") from None
    records = found.get(envelope) if isinstance(found, dict) else None
    if not isinstance(records, list):
        raise ProviderUnavailable(f"no list under {envelope}")
    return records


def read_recorded(spark: SparkSession, path: str, envelope: str) -> DataFrame:
    """position, record (JSON text) and unavailable of recorded payload files. A payload that cannot be read is a row
    without a record that says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("value").to_pylist():
                try:
                    records, why = [json.dumps(r) for r in records_in(text, envelope)], None
                except ProviderUnavailable as error:
                    records, why = [None], str(error)
                at = range(len(records)) if why is None else [None]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(records, pa.string()), pa.array([why] * len(records), pa.string())], ["position", "record", "unavailable"])

    return spark.read.text(path, wholetext=True).mapInArrow(run, "position long, record string, unavailable string")


def normalised(records: DataFrame, adapter: Adapter, tenant_id: str) -> DataFrame:
    """One row for each record: the resource, or the problem for which it is rejected."""
    names = [f.name for f in NORMALISED.fields]
    types = [pa.int64()] + [pa.string()] * 5 + [pa.map_(pa.string(), _VALUE_ARROW), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, text in zip(batch.column("position").to_pylist(), batch.column("record").to_pylist(), strict=True):
                try:
                    r = normalise(json.loads(text), adapter)
                    rows.append((at, adapter.kind, tenant_id, r["scope"], r["name"], r["provider_id"], [(k, encode(v)) for k, v in r["attributes"].items()], None))
                except ValueError as why:
                    rows.append((at, adapter.kind, tenant_id, None, None, None, None, str(why)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return records.select("position", "record").mapInArrow(run, NORMALISED)


def collector(spark: SparkSession, adapter: Adapter, tenant_id: str, path: str = "", client: str = "", namespace: str = "") -> DataFrame:
    """Normalised rows of one read: of recorded payloads at ``path``, else live through ``client`` (``module:factory``), of
    the comma-separated namespaces or of all. A chain of pages that broke, and a payload or a chain of which nothing could
    be read, gives one row with a NULL position; its problem says why nothing could be read."""
    if path:
        read = read_recorded(spark, path, adapter.envelope)
    else:
        from .paged import read_paged

        read = read_paged(spark, client, namespace)
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in NORMALISED.fields if f.name != "problem"]
    gaps = read.filter("position is null").select(*nulls, F.col("unavailable").alias("problem"))
    return normalised(read.filter("position is not null"), adapter, tenant_id).unionByName(gaps)


def run_summary(rows: DataFrame, has_gap: bool = False) -> DataFrame:
    """records_read, records_written, errors and status of one read."""
    from ..operators.discovery import run_status

    counted = rows.agg(F.count("*").alias("records_read"), F.count_if(F.col("problem").isNull()).alias("records_written"))
    counted = counted.withColumn("errors", F.col("records_read") - F.col("records_written"))
    return counted.withColumn("status", run_status(F.col("errors"), F.lit(has_gap)))
