"""Text as symbols of a printable byte alphabet, wrapped so that merging is one string replacement.

A word is O s1 C O s2 C ... with the private-use signs O and C, which are outside the alphabet. Replacing
'O l C O r C' by 'O lr C' merges from left to right without overlap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE, BETWEEN = "\ue000", "\ue001", "\ue002"


def alphabet() -> list[str]:
    """The sign of each byte: itself where Latin-1 prints it, else U+0100 and up in the order of the bytes."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in printed else chr(0x100 + next(rest)) for b in range(256)]


ALPHABET = alphabet()
_LATIN1, _SIGNS = "".join(map(chr, range(256))), "".join(ALPHABET)


def to_symbols(word: Column) -> Column:
    """UTF-8 bytes of the word as signs of the alphabet."""
    return F.translate(F.decode(F.encode(word, "utf-8"), "iso-8859-1"), _LATIN1, _SIGNS)


def wrapped(word: Column) -> Column:
    return F.regexp_replace(to_symbols(word), "(?s)(.)", f"{OPEN}$1{CLOSE}")


def wrapped_words(words: Column) -> Column:
    """The symbols of all words in one string, with a sign between words that no merge crosses."""
    return F.regexp_replace(F.array_join(F.transform(words, to_symbols), BETWEEN), f"([^{BETWEEN}])", f"{OPEN}$1{CLOSE}")


def merge(symbols: Column, left: str | Column, right: str | Column) -> Column:
    o, c = F.lit(OPEN), F.lit(CLOSE)
    left, right = (F.lit(x) if isinstance(x, str) else x for x in (left, right))
    return F.replace(symbols, F.concat(o, left, c, o, right, c), F.concat(o, left, right, c))


def unwrapped(symbols: Column) -> Column:
    """The symbols as an array."""
    return F.regexp_extract_all(symbols, F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), F.lit(1))


def to_text(symbols: Column) -> Column:
    """Signs of the alphabet back to text; malformed UTF-8 is replaced. (translate would delete what becomes NUL.)"""
    plain = F.replace(F.translate(symbols, _SIGNS[1:], _LATIN1[1:]), F.lit(_SIGNS[0]), F.lit("\0"))
    return F.make_valid_utf8(F.encode(plain, "iso-8859-1").cast("string"))
