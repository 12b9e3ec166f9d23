"""Row types of the two planes and the vocabularies of their results.

A value is absent where its attribute has no key in the map; JSON null is a value (kind ``null``), and so is the empty
text. SQL NULL stands for absence only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["kind", "tenant_id", "scope", "name"]

KEYED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("rendering", T.StringType())])
VALUE = T.StructType([
    T.StructField("kind", T.StringType()),  # null, bool, int, float, str, list, object
    T.StructField("canon", T.StringType()),  # JSON with sorted keys: the identity of a value
    T.StructField("text", T.StringType()),
    T.StructField("num", T.DoubleType()),
    T.StructField("elems", T.ArrayType(T.StringType())),  # canonical elements of a list
    T.StructField("keyed", T.MapType(T.StringType(), KEYED)),  # what an object states under version and id
])
ATTRIBUTES = T.MapType(T.StringType(), VALUE)

# The strings of stored results.
BINDING, NATURAL_KEY = "binding", "natural_key"
HIGH = "high"
PROPOSED, CONFIRMED, REJECTED, INVALIDATED = "proposed", "confirmed", "rejected", "invalidated"
FIELD, DECLARED_MISSING, DISCOVERED_UNDECLARED = "field", "declared_missing", "discovered_undeclared"
OPEN, RESOLVED, SUPPRESSED, MUTED = "open", "resolved", "suppressed", "muted"
DECLARED, DISCOVERED = "declared", "discovered"
SUCCESS, PARTIAL, FAILED = "success", "partial", "failed"

#: Fixed value: the 29 code points that Python strips, as a Java character class.
WHITESPACE = r"[\t\n\u000b\f\r\u001c-\u001f \u0085   -     　]"


def value(kind: str, canon: Column, text: Column | None = None, num: Column | None = None) -> Column:
    """A scalar value built from columns; SQL NULL (absent) where ``canon`` is."""
    fields = [F.lit(kind).alias("kind"), canon.alias("canon"), (canon if text is None else text).alias("text")]
    fields += [(F.lit(None) if num is None else num).cast("double").alias("num"), F.lit(None).cast("array<string>").alias("elems")]
    fields.append(F.lit(None).cast("map<string,struct<kind:string,rendering:string>>").alias("keyed"))
    return F.when(canon.isNotNull(), F.struct(*fields))


def int_value(x: Column) -> Column:
    return value("int", x.cast("string"), num=x)


def str_value(x: Column) -> Column:
    """For text that JSON writes as it is (no quotes, backslashes, controls, or characters beyond ASCII)."""
    return value("str", F.concat(F.lit('"'), x, F.lit('"')), x)


def bool_value(x: Column) -> Column:
    return value("bool", x.cast("string"), F.initcap(x.cast("string")), x.cast("int"))


def null_value() -> Column:
    return value("null", F.lit("null"), F.lit("None"))


def attributes(**values: Column) -> Column:
    """A map of the values that are not NULL."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
