"""The barricade: JSON text to encoded attribute maps, with the reason where a value cannot be stored."""

from __future__ import annotations

import functools
import json
import math
import re
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ATTRIBUTES

ENCODED = T.StructType([T.StructField("attributes", ATTRIBUTES), T.StructField("problem", T.StringType())])
#: Keys of an object that the keyed comparisons look at.
KEYED_BY = ("version", "id")


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True)


def kind_of(value: object) -> str:
    if value is None:
        return "null"
    for kind, types in (("bool", bool), ("int", int), ("float", float), ("str", str), ("list", (list, tuple)), ("object", dict)):
        if isinstance(value, types):
            return kind
    return type(value).__name__


def _number(value: object) -> float | None:
    try:
        return float(value) if isinstance(value, bool | int | float | str) else None
    except (ValueError, OverflowError):
        return None


def _keyed(value: dict) -> list[tuple[str, dict]]:
    out = []
    for key in KEYED_BY:
        if key in value:
            stated = value[key]
            structured = isinstance(stated, dict | list)
            kind = "null" if stated is None else "structured" if structured else "scalar"
            out.append((key, {"kind": kind, "rendering": "<null>" if stated is None else canonical(stated) if structured else str(stated)}))
    return out


def written(value: object) -> str:
    """``str`` of a JSON value. Python's own goes through all that holds a list or an object when it comes to one, which for deep values takes the square of
    their depth."""
    if not isinstance(value, list | dict):
        return str(value)
    out: list[str] = []
    todo: list[object] = [(value,)]  # texts as they are, values in tuples
    while todo:
        x = todo.pop()
        if type(x) is str:
            out.append(x)
            continue
        (x,) = x
        if type(x) is list and x:
            todo.append("]")
            for y in reversed(x[1:]):
                todo += ((y,), ", ")
            todo.append((x[0],))
            out.append("[")
        elif type(x) is dict and x:
            todo.append("}")
            items = list(x.items())
            for k, y in reversed(items[1:]):
                todo += ((y,), f", {k!r}: ")
            todo.append((items[0][1],))
            out.append(f"{{{items[0][0]!r}: ")
        else:
            out.append(repr(x))
    return "".join(out)


class _Digits(str):
    """An integer of more than ``_MANY`` digits as JSON has it."""


class _Within:
    """A value within so many lists, each of which holds nothing else."""

    def __init__(self, value: object, lists: int) -> None:
        self.value, self.lists = value, lists

    def around(self, text: str, but: int = 0) -> str:
        return "[" * (self.lists - but) + text + "]" * (self.lists - but)


#: Digits up to which integers are numbers; a float holds fewer.
_MANY = 400


def encode(value: object, text: str | None = None) -> dict:
    """The stored form of one JSON value; ``text`` is what JSON's encoder writes of it, where that is known."""
    if isinstance(value, _Digits):
        return {"kind": "int", "canon": str(value), "text": str(value), "num": None, "elems": None, "keyed": None}
    if isinstance(value, _Within):
        inner = encode(value.value, text)
        plain = repr(value.value) if isinstance(value.value, str) else inner["text"]
        return {"kind": "list", "canon": value.around(inner["canon"]), "text": value.around(plain), "num": None, "elems": [value.around(inner["canon"], 1)], "keyed": None}
    if text is None or "{" in text:  # in objects names are sorted
        elems = [canonical(x) for x in value] if isinstance(value, list | tuple) else None
        canon, plain = canonical(value) if elems is None else f"[{', '.join(elems)}]", written(value)
    else:
        elems = None if not isinstance(value, list) else [text[1:-1]] if len(value) == 1 else [canonical(x) for x in value]
        # but for texts, str differs from JSON in three words
        canon, plain = text, written(value) if '"' in text else text.replace("null", "None").replace("true", "True").replace("false", "False")
    return {
        "kind": kind_of(value), "canon": canon, "text": plain, "num": _number(value),
        "elems": elems,
        "keyed": _keyed(value) if isinstance(value, dict) else None,
    }


#: Characters that a stored text cannot hold: U+0000, and halves of surrogate pairs.
_UNSTORABLE = re.compile("[\x00\ud800-\udfff]")


def _unfit_text(text: str) -> str:
    found = _UNSTORABLE.search(text)
    return f"U+{ord(found[0]):04X} cannot be stored" if found else ""


def _unfit_name(name: object) -> str:
    return _unfit_text(name) if isinstance(name, str) else "a name that is no text"


def _unfit(value: object) -> str:
    """What is wrong with a value itself, whatever it contains."""
    match value:
        case None | int() | list() | tuple() | dict():
            return ""
        case str():
            return _unfit_text(value)
        case float():
            return "" if math.isfinite(value) else f"{value} is not a finite number"
    return f"a {type(value).__name__} has no JSON form"


def _path(at: tuple | None) -> str:
    """The path of a place: what holds it, its name or number in it, and the form in which that is written."""
    steps = []
    while at is not None:
        at, step, form = at
        steps.append(form.format(step))
    return "".join(reversed(steps)).removeprefix(".")


def _refusal(value: object, write: Callable[[object], str]) -> tuple[str | None, str]:
    """What JSON's own encoder has against a value (depth, cycles, integers of too many digits, types without a form), and what it wrote."""
    try:
        return None, write(value)
    except RecursionError:
        return "nested too deep to be written as JSON", ""
    except (TypeError, ValueError) as why:
        return f"JSON cannot write it: {why}", ""


def _doubtful(text: str) -> bool:
    """Whether what the encoder wrote has something of all that cannot be stored; where there are objects, their names have to be looked at, too."""
    return "{" in text or "NaN" in text or "Infinity" in text or ("\\u" in text and ("\\u0000" in text or "\\ud" in text))


def problem_of(attributes: dict) -> str | None:
    """Why attributes cannot be stored, as path and reason; None if they can. What the encoder takes is walked level by level,
    so the first one named is one of those nearest the top; all names of a level come before its values. There is no limit
    besides the encoder's."""
    return _examined(attributes, json.dumps)[0]


def _examined(attributes: dict, write: Callable[[object], str]) -> tuple[str | None, list[str]]:
    """The problem of attributes and, if they have none, what the encoder ``write`` wrote of each."""
    doubtful, texts = False, []
    for name, value in attributes.items():
        if not isinstance(name, str):
            doubtful = True
            continue
        bare = value.value if isinstance(value, _Within) else value
        why, text = (None, str(bare)) if isinstance(bare, _Digits) else _refusal(bare, write)
        if why:
            return ascii(name)[1:-1] + ": " + why, []
        doubtful = doubtful or _doubtful(text) or bool(_unfit_text(name))
        texts.append(text)
    return _walked(attributes) if doubtful else None, texts


def _walked(attributes: dict) -> str | None:
    level: list[tuple[object, tuple | None]] = [(attributes, None)]
    while level:
        below: list[tuple[object, tuple | None]] = []
        named = False
        for value, at in level:
            if isinstance(value, dict):
                named = True
                below += [(part, (at, name, ".{}")) for name, part in value.items()]
            elif isinstance(value, list | tuple):
                below += [(part, (at, i, "[{}]")) for i, part in enumerate(value)]
        wrong = next(((at, why) for _, at in below if at[2] == ".{}" and (why := _unfit_name(at[1]))), None) if named else None
        wrong = wrong or next(((at, why) for value, at in below if (why := _unfit(value))), None)
        if wrong:
            return ascii(_path(wrong[0]))[1:-1] + ": " + wrong[1]
        level = [x for x in below if isinstance(x[0], dict | list | tuple)]
    return None


#: JSON's encoder for what its decoder gave, which has no cycles.
_WRITE = json.JSONEncoder(check_circular=False).encode

#: How a text begins, up to the lists of its first attribute.
_START = r'^[ \t\n\r]*\{[ \t\n\r]*"[^"\\\x00-\x1f]*"[ \t\n\r]*:[ \t\n\r]*\['


@functools.cache
def _too_deep() -> tuple[int, str] | None:
    """So many lists within one another that JSON's decoder doesn't take them, a fourth more than it refused when it was tried; and what it says then."""
    n = 1024
    while n <= 2**20:
        try:
            json.loads('{"k": ' + "[" * n + "]" * n + "}")
        except RecursionError as why:
            return n * 5 // 4, str(why)
        n = n * 5 // 4
    return None


@functools.cache
def _opens_too_many() -> Callable[[str], object]:
    """Whether a text's first attribute opens more lists, one after another, than the decoder takes; it goes no further than there, whatever follows."""
    return re.compile(f"{_START}{{{_too_deep()[0]}}}").match if _too_deep() else lambda _: None


def _read(text: str) -> object:
    """``json.loads``; integers of many digits that are attributes stay as they are written, as to make numbers of them and write those again takes the square
    of their digits."""
    if len(text) <= _MANY:
        return json.loads(text)
    kept = 0

    def integer(digits: str) -> int | str:
        nonlocal kept
        if len(digits) <= _MANY or 0 < sys.get_int_max_str_digits() < len(digits):
            return int(digits)
        kept += 1
        return _Digits(digits)

    found = json.loads(text, parse_int=integer)
    if kept and not (isinstance(found, dict) and sum(isinstance(v, _Digits) for v in found.values()) == kept):
        return json.loads(text)
    return found


_LISTS = re.compile(_START + r"+")
_BLANK = " \t\n\r"


def _unwrapped(text: str) -> dict | None:
    """``_read`` of an object with one attribute, a value within some dozens of lists with nothing else in them: the value is read without those, through which
    decoder and encoder would go one by one. None for all others, also for what isn't JSON, cannot be stored or may come near to the decoder's depth."""
    begun = _LISTS.match(text)
    if not begun or not text.endswith("}") or not _too_deep():
        return None
    body = text[begun.end() : -1].rstrip(_BLANK)
    opened = begun[0].count("[", begun[0].rindex(":"))
    bare = body.rstrip("]")
    lists = min(opened, len(body) - len(bare))
    rest = "[" * (opened - lists) + body[: len(body) - lists]
    if lists < 32 or lists + rest.count("[") + rest.count("{") > _too_deep()[0] // 4:
        return None
    try:
        [name] = json.loads(text[: begun.end() - opened] + "0}")
        value = json.loads(rest)
    except (ValueError, RecursionError):
        return None
    return {name: _Within(value, lists)}


def encode_text(text: str | None) -> dict:
    """Attributes of one JSON object as text; a NULL text or something else than an object has a problem instead."""
    if text is None:
        return {"attributes": None, "problem": "no attributes"}
    if len(text) > 1024 and _opens_too_many()(text):
        return {"attributes": None, "problem": f"not JSON: {_too_deep()[1]}"}
    why = found = _unwrapped(text)
    if found:
        why, texts = _examined(found, _WRITE)
    if why or not found:
        try:
            found = _read(text)
        except (ValueError, RecursionError) as wrong:
            return {"attributes": None, "problem": f"not JSON: {wrong}"}
        if not isinstance(found, dict):
            return {"attributes": None, "problem": f"attributes are {kind_of(found)}, not an object"}
        why, texts = _examined(found, _WRITE)
    return {"attributes": None if why else [(k, encode(v, t)) for (k, v), t in zip(found.items(), texts, strict=True)], "problem": why}


_VALUE_ARROW = pa.struct([
    ("kind", pa.string()), ("canon", pa.string()), ("text", pa.string()), ("num", pa.float64()), ("elems", pa.list_(pa.string())),
    ("keyed", pa.map_(pa.string(), pa.struct([("kind", pa.string()), ("rendering", pa.string())]))),
])
ENCODED_ARROW = pa.struct([("attributes", pa.map_(pa.string(), _VALUE_ARROW)), ("problem", pa.string())])


def _settled(json_text: Column) -> Column:
    """The text, or as much of it as settles it: where the first attribute opens more lists than the decoder takes, those. The rest of such a text, however
    long, isn't moved to Python."""
    if not _too_deep():
        return json_text
    start, lists = F.substring(json_text, 1, 256), "[" * _too_deep()[0]
    head = F.concat(start, F.lit(lists))
    deep = (F.octet_length(json_text) > len(lists)) & start.rlike(_START + r"\[*\z") & json_text.startswith(head)
    return F.when(deep, head).otherwise(json_text)


def encoded(json_text: Column) -> Column:
    """struct(attributes, problem) of JSON text; one of the two is NULL. Texts may be long: of a batch a few are there as Python's values at a time."""

    @F.arrow_udf(ENCODED)
    def barricade(texts: pa.Array) -> pa.Array:
        parts = [pa.array([encode_text(t.as_py()) for t in texts.slice(i, 256)], ENCODED_ARROW) for i in range(0, len(texts), 256)]
        return pa.concat_arrays(parts) if parts else pa.array([], ENCODED_ARROW)

    return barricade(_settled(json_text))


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` by the hash of ``by`` over four tasks for each core, for steps that cost far more than to move their rows: files that pack many rows are read
    by few tasks."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)
