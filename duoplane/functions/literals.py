"""Declared scalars: the texts that each declared type accepts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An integer literal, and the digits that an interpreter converts.
INTEGER, MOST_DIGITS = r"^[+-]?(0|[1-9][0-9]*)$", 4300
_INTEGER = re.compile(INTEGER)


class Unacceptable(ValueError):
    """A text that its declared type does not accept."""


def parse_int(text: str) -> int:
    if not _INTEGER.search(text) or len(text.strip("+-\n")) > MOST_DIGITS:
        raise Unacceptable(f"{text[:40]!r} is not an integer")
    return int(text)


def parse_bool(text: str) -> bool:
    if text not in ("true", "false"):
        raise Unacceptable(f"{text[:40]!r} is neither true nor false")
    return text == "true"


#: Declared types by name; add an entry to extend it.
DECLARED_TYPES: dict[str, Callable[[str], object]] = {"int": parse_int, "str": str, "bool": parse_bool}


def int_literal(text: Column) -> Column:
    """The canonical text of an integer literal, NULL where it is none. Stays text: literals exceed every integer type."""
    digits = F.regexp_extract(text, r"^[+-]?([0-9]+)", 1)
    good = text.rlike(INTEGER) & (F.length(digits) <= MOST_DIGITS)
    return F.when(good, F.when(text.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits))


def bool_literal(text: Column) -> Column:
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))
