"""Splitting text into pre-tokens exactly as the public tokenizer libraries do.

``'s|'t|... | ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``: the standard ``re`` module, which has no
``\\p``, gives the same pieces about twice as fast for texts without the few characters that its classes sort
differently; other texts go through ``regex``. Letters that ``regex`` knows and the tokenizer libraries don't
(newer Unicode) are masked while splitting.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import regex

#: Same classes in the ``re`` module's terms.
_FAST = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
_MASK = "͸"  # unassigned: neither letter, number nor space for any of the libraries


def _ranges(chars: list[str]) -> str:
    out: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if out and out[-1][1] == cp - 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@functools.lru_cache(1)
def odd_characters() -> tuple[str, str]:
    """Character classes (as ``re`` source) of the characters that need ``regex``, and of those to be masked.
    Found by asking each library; takes about a second, so the driver does it once and sends the result."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    letters, numbers, spaces = (set(regex.findall(p, every)) for p in (r"\p{L}", r"\p{N}", r"\s"))
    newer = [c for c in letters | numbers if unicodedata.category(c) == "Cn"]
    masked = [c for c in newer if len(split(("a" if c in letters else "1") + c)) > 1]
    letters.difference_update(masked)
    numbers.difference_update(masked)
    odd = (letters ^ set(re.findall(r"[^\W\d_]", every))) | (numbers ^ set(re.findall(r"\d", every))) | (spaces ^ set(re.findall(r"\s", every)))
    # One range for all beyond the basic plane: the re module searches such a class by table.
    return _ranges([c for c in {*odd, *masked} if c < "\U00010000"]) + "\U00010000-\U0010ffff", _ranges(masked)


class Splitter:
    """``split(text)`` gives the pre-tokens of a text; their concatenation is the text."""

    def __init__(self, pattern: str, odd: str, masked: str) -> None:
        self._fast = re.compile(_FAST).findall
        self._odd = re.compile(f"[{odd}]").search if odd else lambda text: None
        self._masked = re.compile(f"[{masked}]") if masked else None
        self._exact = regex.compile(pattern)

    def split(self, text: str) -> list[str]:
        if not self._odd(text):
            return self._fast(text)
        if self._masked is None or not self._masked.search(text):
            return self._exact.findall(text)
        return [text[m.start() : m.end()] for m in self._exact.finditer(self._masked.sub(_MASK, text))]


@functools.lru_cache(4)
def splitter(pattern: str, odd: str, masked: str) -> Splitter:
    return Splitter(pattern, odd, masked)
