"""Comparisons of two encoded values as columns: the verdict (boolean, never NULL) of each field type and mode."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import WHITESPACE
from .config import ComparisonSchema, FieldConfig, Mode, parse_mode

#: What parts a timestamp leaves out are taken from this moment, so that verdicts don't depend on the day.
DEFAULT_MOMENT = datetime(2000, 1, 1)
_PRESENT = {"list": ("list",), "object": ("object",), "boolean": ("bool",)}


def stated(v: Column, field_type: str) -> Column:
    """Does a side state a value of the kind that the field type compares?"""
    kinds = _PRESENT.get(field_type)
    return F.coalesce(v["kind"].isin(*kinds) if kinds else v["kind"] != "null", F.lit(False))


def unstated_agree(left: Column, right: Column) -> Column:
    """Where a side states nothing to compare: both absent, or both null."""
    return (left.isNull() & right.isNull()) | F.coalesce((left["kind"] == "null") & (right["kind"] == "null"), F.lit(False))


def same(left: Column, right: Column) -> Column:
    """Equality of statements: presence and canonical form (3 and 3.0 differ, absent and null differ)."""
    return left["canon"].eqNullSafe(right["canon"])


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def normalized(x: Column) -> Column:
    return F.regexp_replace(stripped(F.lower(x)), f"{WHITESPACE}+", " ")


#: Microseconds of what a precision keeps.
UNITS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}
_ISO, _ZONE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?", r"(Z|[+-]\d{2}:\d{2})$"


def instant(text: Column) -> Column:
    """The moment of a timestamp text in microseconds since 1970 UTC, NULL where it is none; texts without a zone are UTC,
    whatever the session's zone is."""

    @F.arrow_udf("long")
    def parse(texts: pa.Array) -> pa.Array:
        from dateutil import parser

        start, out = datetime(1970, 1, 1, tzinfo=UTC), []
        for t in texts.to_pylist():
            try:
                found = None if t is None else parser.parse(t, default=DEFAULT_MOMENT)
                out.append(None if found is None else ((found if found.tzinfo else found.replace(tzinfo=UTC)) - start) // timedelta(microseconds=1))
            except (ValueError, OverflowError, TypeError):
                out.append(None)
        return pa.array(out, pa.int64())

    # a full ISO text needs no Python; the rest goes through the lenient parser
    zoned = F.when(text.rlike(_ISO + _ZONE), text).when(text.rlike(_ISO + "$"), F.concat(text, F.lit("Z")))
    quick = F.unix_micros(F.try_to_timestamp(zoned))
    return F.coalesce(quick, parse(F.when(quick.isNull(), text)))


def truncated(micros: Column, precision: str) -> Column:
    return micros - F.pmod(micros, F.lit(UNITS[precision]))


def utc_text(micros: Column) -> Column:
    """A moment, given to the second, as YYYY-MM-DD HH:MM:SS+00:00."""
    second = F.pmod(F.floor(micros / UNITS["second"]), F.lit(86_400)).cast("int")
    day = F.date_from_unix_date(F.floor(micros / UNITS["day"]).cast("int"))
    clock = [F.lpad(x.cast("int").cast("string"), 2, "0") for x in (F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)]
    return F.concat(day.cast("string"), F.lit(" "), F.concat_ws(":", *clock), F.lit("+00:00"))


def first_divergence(left: Column, right: Column, depth: Column) -> Column:
    """Dotted path of the first difference of two canonical objects in sorted key order (``<root>`` at the top); NULL
    where they are equal. Depth -1 drills without bound, 0 not at all; lists are compared whole."""

    @F.arrow_udf("string")
    def path(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None or x == y else divergence(json.loads(x), json.loads(y), k) for x, y, k in zip(a.to_pylist(), b.to_pylist(), n.to_pylist(), strict=True)], pa.string())

    differ = left != right
    return path(F.when(differ, left), F.when(differ, right), depth)


def divergence(a: object, b: object, depth: int) -> str:
    at: list[str] = []
    while isinstance(a, dict) and isinstance(b, dict) and depth != 0:
        for key in sorted({*a, *b}):
            if key not in a or key not in b:
                return ".".join([*at, key])
            if json.dumps(a[key], sort_keys=True) != json.dumps(b[key], sort_keys=True):
                at.append(key)
                a, b, depth = a[key], b[key], depth - 1
                break
        else:
            break
    return ".".join(at) or "<root>"


def _numeric(left: Column, right: Column, mode: Mode, _: FieldConfig) -> Column:
    if mode.name == "exact_value":
        return left["canon"] == right["canon"]
    if mode.name == "exact_string":
        return left["text"] == right["text"]
    return F.abs(left["num"] - right["num"]) <= mode.parameter


def _string(left: Column, right: Column, mode: Mode, _: FieldConfig) -> Column:
    how: dict[str, Callable[[Column], Column]] = {"exact": lambda x: x, "lowercase": F.lower, "trim": stripped, "normalize": normalized}
    return how[mode.name](left["text"]) == how[mode.name](right["text"])


def _list(left: Column, right: Column, mode: Mode, _: FieldConfig) -> Column:
    how = {"ordered": lambda x: x, "unordered_multiset": F.array_sort, "set": lambda x: F.array_sort(F.array_distinct(x))}
    return how[mode.name](left["elems"]) == how[mode.name](right["elems"])


def _timestamp(left: Column, right: Column, mode: Mode, config: FieldConfig) -> Column:
    if mode.name == "string":
        return left["text"] == right["text"]
    return truncated(instant(left["text"]), config.precision) == truncated(instant(right["text"]), config.precision)


def _object(left: Column, right: Column, mode: Mode, _: FieldConfig) -> Column:
    if mode.name in ("version", "identity"):
        key = "version" if mode.name == "version" else "id"
        return left["keyed"][key].eqNullSafe(right["keyed"][key])
    return left["canon"] == right["canon"]


def _boolean(left: Column, right: Column, _mode: Mode, _: FieldConfig) -> Column:
    return left["canon"] == right["canon"]


BY_TYPE = {"numeric": _numeric, "string": _string, "list": _list, "timestamp": _timestamp, "object": _object, "boolean": _boolean}


def agree(left: Column, right: Column, config: FieldConfig) -> Column:
    """Do two statements agree under a field's settings?"""
    mode = parse_mode(config.field_type, config.mode)
    if mode.problem:
        return F.lit(False)
    if mode.name == "ignore":
        return F.lit(True)
    both = stated(left, config.field_type) & stated(right, config.field_type)
    verdict = BY_TYPE[config.field_type](left, right, mode, config)
    return F.when(both, F.coalesce(verdict, F.lit(False))).otherwise(unstated_agree(left, right))


def audited(left: Column, right: Column, config: FieldConfig) -> Column:
    """The verdict with what was compared: struct(agree, mode, declared, discovered, declared_transformed,
    discovered_transformed, step)."""
    mode = parse_mode(config.field_type, config.mode)

    def shown(v: Column) -> Column:
        if mode.name == "ignore":
            return F.lit("<ignored>")
        inner = v["text"]
        if config.field_type == "string":
            inner = {"lowercase": F.lower, "trim": stripped, "normalize": normalized}.get(mode.name, lambda x: x)(v["text"])
        elif mode.name == "opaque":
            inner = F.sha2(v["canon"], 256)
        elif mode.name == "recurse":
            inner = v["canon"]
        elif mode.name in ("version", "identity"):
            inner = F.coalesce(v["keyed"]["version" if mode.name == "version" else "id"]["rendering"], F.lit("<missing>"))
        elif mode.name.startswith("semantic"):
            inner = F.coalesce(utc_text(truncated(instant(v["text"]), config.precision or "second")), v["text"])
        kind = F.when(v.isNull(), "absent").when(v["kind"] == "null", "null").when(~stated(v, config.field_type), F.concat(F.lit("value:"), v["kind"]))
        return F.coalesce(kind, inner)

    step = F.lit(mode.problem) if mode.problem else F.lit(f"Mode: {config.mode}")
    if mode.name == "recurse" and not mode.problem:
        step = F.coalesce(F.concat(F.lit("Diverged at: "), first_divergence(left["canon"], right["canon"], F.lit(int(mode.parameter)))), step)
    fields = {"agree": agree(left, right, config), "mode": F.lit(config.mode), "declared": left["canon"], "discovered": right["canon"], "declared_transformed": shown(left), "discovered_transformed": shown(right), "step": step}
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def agree_by_schema(kind: Column, field: Column, left: Column, right: Column, schema: ComparisonSchema) -> Column:
    """The verdict under the settings of (kind, field). A field without settings never agrees, so that it is seen; see
    ``missing_settings``."""
    out = F.lit(False)
    for (k, f), config in schema.fields.items():
        out = F.when((kind == k) & (field == f), agree(left, right, config)).otherwise(out)
    return out


def missing_settings(rows: DataFrame, schema: ComparisonSchema) -> DataFrame:
    """kind, field_name and n (compared values) of fields in ``rows`` (kind, field_name) that have no settings: what a run logs."""
    known = F.lit(False)
    for k, f in schema.fields:
        known = known | ((F.col("kind") == k) & (F.col("field_name") == f))
    return rows.filter(~known).groupBy("kind", "field_name").agg(F.count("*").alias("n"))
