"""Comparison settings of fields, checked and parsed once on the driver."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The modes of each field type, timestamp precisions, logging levels.
MODES = {
    "numeric": ("exact_value", "exact_string", "tolerance"),
    "string": ("exact", "lowercase", "trim", "normalize"),
    "timestamp": ("string", "semantic_utc", "semantic_resource_tz"),
    "boolean": ("exact",),
    "list": ("ordered", "unordered_multiset", "set"),
    "object": ("opaque", "version", "identity", "ignore", "recurse"),
}
PRECISIONS = ("day", "hour", "minute", "second")
LOGGING = ("debug", "discrepancy", "sampled")
#: Types that a declared attribute can have, for each field type; lists and objects are only discovered.
DECLARED_BY_FIELD = {"numeric": ("int",), "string": ("str",), "timestamp": ("str",), "boolean": ("bool",), "list": (), "object": ()}


class SchemaError(ValueError):
    """A comparison setting that cannot be used."""


class MissingFieldConfig(SchemaError): ...


class InvalidFieldType(SchemaError): ...


class InvalidComparisonMode(SchemaError): ...


class InvalidLoggingLevel(SchemaError): ...


class InvalidModeParameter(SchemaError): ...


@dataclass(frozen=True)
class Mode:
    """A mode and its parameter; ``problem`` says why the mode never agrees."""

    name: str
    parameter: float | int | None = None
    problem: str | None = None


def parse_mode(field_type: str, text: str) -> Mode:
    """``tolerance(N)`` takes a finite N from 0 on, ``recurse(N)`` a whole N from -1 on; other modes take nothing."""
    found = re.fullmatch(r"(\w+)\((.*)\)", text, re.DOTALL)
    name, raw = (found[1], found[2]) if found else (text, None)
    takes = {"tolerance", "recurse"}
    if name not in MODES.get(field_type, ()) or (found and name not in takes):
        return Mode(text, problem=f"Unknown mode: {text}")
    if name not in takes:
        return Mode(name)
    try:
        number = float(raw) if name == "tolerance" else int(raw)
        good = math.isfinite(number) and number >= (0 if name == "tolerance" else -1)
    except (TypeError, ValueError, OverflowError):
        good = False
    return Mode(name, number) if good else Mode(name, problem=f"Unusable mode parameter: {text}")


@dataclass(frozen=True)
class FieldConfig:
    field_type: str
    mode: str
    precision: str | None = None
    element_comparison: str | None = None
    logging: str = "discrepancy"

    def __post_init__(self) -> None:
        if self.field_type not in MODES:
            raise InvalidFieldType(f"unknown field type {self.field_type!r}")
        parsed = parse_mode(self.field_type, self.mode)
        if parsed.problem:
            raise (InvalidModeParameter if parsed.problem.startswith("Unusable") else InvalidComparisonMode)(parsed.problem)
        if self.field_type == "timestamp" and self.mode != "string" and self.precision not in PRECISIONS:
            raise InvalidModeParameter(f"a timestamp needs a precision of {', '.join(PRECISIONS)}")
        if self.field_type == "list" and not self.element_comparison:
            raise InvalidModeParameter("a list needs element_comparison")
        if self.logging not in LOGGING:
            raise InvalidLoggingLevel(f"unknown logging level {self.logging!r}")


class ComparisonSchema:
    """Settings by (kind, field)."""

    def __init__(self, fields: dict[tuple[str, str], FieldConfig]) -> None:
        self.fields = dict(fields)

    def get(self, kind: str, field: str) -> FieldConfig:
        try:
            return self.fields[kind, field]
        except KeyError:
            raise MissingFieldConfig(f"no comparison for {kind}.{field}") from None

    def check_declared(self, kinds: dict[str, dict[str, str]]) -> None:
        """Raise InvalidFieldType where a kind declares an attribute with a type that its field type cannot be compared as.
        Attributes that are only discovered aren't declared, so any field type is theirs."""
        for (kind, field), config in self.fields.items():
            declared = kinds.get(kind, {}).get(field)
            if declared is not None and declared not in DECLARED_BY_FIELD[config.field_type]:
                raise InvalidFieldType(f"{kind}.{field} is declared as {declared}, which {config.field_type} does not compare")


SETTING = ("field_type", "mode", "precision", "element_comparison", "logging")


def checked(settings: DataFrame) -> DataFrame:
    """A table of settings (SETTING and whatever names them) with ``error``, the class of what is wrong, and ``problem``, in words;
    both null where a setting can be used. A null logging level is the usual one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_problem(*row) for row in zip(*(batch.column(c).to_pylist() for c in SETTING), strict=True)]
            columns = [pa.array(c, pa.string()) for c in (zip(*found, strict=True) if found else ([], []))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "error", "problem"])

    return settings.mapInArrow(run, T.StructType([*settings.schema.fields, T.StructField("error", T.StringType()), T.StructField("problem", T.StringType())]))


def _problem(field_type: str, mode: str, precision: str | None, element_comparison: str | None, logging: str | None) -> tuple[str | None, str | None]:
    try:
        FieldConfig(field_type, mode or "", precision, element_comparison, logging or "discrepancy")
    except SchemaError as why:
        return type(why).__name__, str(why)
    return None, None


def schema_of(settings: DataFrame) -> ComparisonSchema:
    """The schema that a table of settings (kind, field and SETTING) states; raises for the first that cannot be used. A table of settings is
    a row for each field of a kind: as small as the kinds are."""
    rows = settings.select("kind", "field", *SETTING).orderBy("kind", "field").collect()
    return ComparisonSchema({(r.kind, r.field): FieldConfig(r.field_type, r.mode, r.precision, r.element_comparison, r.logging or "discrepancy") for r in rows})
