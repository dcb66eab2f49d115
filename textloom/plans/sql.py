"""Pieces of SQL that several oracles share."""

from __future__ import annotations

from ..functions import text as X

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
MARK = ""
_SCRIPTS = "".join(X.SCRIPTS)
_PRETOKEN = "|".join([*(c.replace("'", "''") for c in X.CONTRACTIONS), *(f" ?[{s}]+" for s in X.SCRIPTS), f" ?[^{WS}{_SCRIPTS}{MARK}]+", f"[{WS}]+"])


def pretokens(text: str) -> str:
    """The list of pretokens. A mark before a last white space stands in for the lookahead that this engine lacks."""
    return f"regexp_extract_all(regexp_replace({text}, '([{WS}])([^{WS}])', '{MARK}\\1\\2', 'g'), '{_PRETOKEN}')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sentences(text: str, ends: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '[^{ends}]*[{ends}]|[^{ends}]+'), lambda s: {strip('s')}), lambda s: s <> '')"


#: Byte value (0 to 255) of two hexadecimal digits h, and the sign of a byte value b.
BYTE = "('0x' || h)::INT"
SIGN = "chr(CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 THEN b WHEN b < 33 THEN 256 + b WHEN b < 161 THEN 256 + 33 + b - 127 ELSE 256 + 67 END)"


def byte_list(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: {BYTE})"


def sign_list(text: str) -> str:
    return f"list_transform({byte_list(text)}, lambda b: {SIGN})"
