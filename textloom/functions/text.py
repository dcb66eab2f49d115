"""Column builders for text: white space, scripts, sentences, names, n-grams and the rule penalties.

Regular expressions name white space explicitly (WS): Java's own class is ASCII only, and its Unicode variant differs
in U+001C to U+001F and U+0085.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, sentence ends and weights of the engine's rules.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WS}]", c))
LATIN = "A-Za-zＡ-Ｚａ-ｚ"
DIGIT = "0-9０-９"
HIRAGANA = "ぁ-ゖゝゞー"
KATAKANA = "ァ-ヺーヽヾｦ-ﾟ"
KANJI = "一-鿿㐀-䶿々〆"
SCRIPTS = (LATIN, DIGIT, HIRAGANA, KATAKANA, KANJI)
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SENTENCE_ENDS = "。！？!?」"
GOOD_ENDINGS = ("。", "！", "？", "」", "!", "?")
NAME = "[ァ-ヺー]{2,}"
REPLACEMENT = "\ufffd"
WEIGHTS = {"repeated_sentences": 0.35, "repeated_ngrams": 0.25, "bad_ending": 0.2, "broken_text": 0.1, "lost_protagonist": 0.1, "too_short": 0.1}

OTHER = f"[^{WS}{''.join(SCRIPTS)}]"
PRETOKEN = "|".join([*CONTRACTIONS, *(f" ?[{s}]+" for s in SCRIPTS), f" ?{OTHER}+", f"[{WS}]+(?![^{WS}])", f"[{WS}]+"])


def _c(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once: inside a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(_c(text), F.lit(SPACES))


def newlines(text: Column | str) -> Column:
    """Line ends of text files as Python's text mode reads them."""
    return F.regexp_replace(_c(text), "\r\n?", "\n")


def latin_ratio(text: Column | str) -> Column:
    """Share of ASCII letters among the characters of the stripped text; null for texts without a character."""
    t = strip(text)
    return F.when(F.length(t) > 0, F.length(F.regexp_replace(t, "[^A-Za-z]+", "")) / F.length(t))


def keep_story(text: Column | str, max_latin_ratio: float = 0.05) -> Column:
    return F.coalesce(latin_ratio(text) <= F.lit(float(max_latin_ratio)), F.lit(False))


def pretokens(text: Column | str) -> Column:
    """Script-aware pretokens in order; together they are the text."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(PRETOKEN), F.lit(0))


def char_classes(char: Column | str) -> Column:
    """Numbers of the script classes of a character; 5 if it has none. The long-vowel mark has two."""
    c = _c(char)
    found = F.array_compact(F.array(*[F.when(c.rlike(f"^[{s}]$"), F.lit(i)) for i, s in enumerate(SCRIPTS)]))
    return F.when(F.size(found) == 0, F.array(F.lit(len(SCRIPTS)))).otherwise(found)


def safe_split(text: Column | str, at: Column | int) -> Column:
    """Whether pretokens don't change if the text is cut before the character with this (0-based) index."""
    at = F.lit(at) if isinstance(at, int) else at
    a, b = F.substring(_c(text), at, F.lit(1)), F.substring(_c(text), at + 1, F.lit(1))
    space = lambda c: c.rlike(f"^[{WS}]$")
    return (a != "'") & ~space(a) & ~space(b) & ~F.arrays_overlap(char_classes(a), char_classes(b))


def sentences(text: Column | str, ends: str = SENTENCE_ENDS) -> Column:
    """Stripped, non-empty sentences; a sentence ends behind each of `ends`."""
    return F.filter(F.transform(F.split(_c(text), f"(?<=[{ends}])"), strip), lambda s: s != "")


def character_names(prompt: Column | str) -> Column:
    """Katakana words of two or more characters, but for those that say one half twice."""
    def doubled(w: Column) -> Column:
        half = (F.length(w) / 2).cast("int")
        return (F.length(w) % 2 == 0) & (F.substring(w, F.lit(1), half) == F.substring(w, half + 1, half))

    return F.filter(F.regexp_extract_all(_c(prompt), F.lit(NAME), F.lit(0)), lambda w: ~doubled(w))


def opening(text: Column | str, end: str = "。", low: int = 5, high: int = 80) -> Column:
    """The stripped text up to its first `end`, if that stands at a 0-based index from low to high; else null."""
    t = strip(F.coalesce(_c(text), F.lit("")))
    at = F.instr(t, end)
    return F.when((at - 1).between(low, high), F.substring(t, F.lit(1), at))


def repeated_sentence_ratio(text: Column | str, ends: str = SENTENCE_ENDS) -> Column:
    """1 - different / all sentences; 0 for fewer than two."""
    return bound(sentences(text, ends), lambda s: F.when(F.size(s) < 2, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(s)) / F.size(s)))


def ngrams(text: Column | str, n: int = 6) -> Column:
    """All character n-grams, overlapping."""
    return F.regexp_extract_all(_c(text), F.lit("(?s)(?=(.{" + str(n) + "}))"), F.lit(1))


def _repeated(text: str, n: int) -> float:
    """The ratio of one text: its n-grams as numbers, sorted. Numbers of 64 bits hold runs of small code points; else runs are doubled, each time numbered anew."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < n:
        return 0.0
    grams, width, bits = points, 1, max(1, int(points.max()).bit_length())
    while width < n:
        step = min(width, n - width)
        if bits * 2 > 64:
            grams = np.unique(grams, return_inverse=True)[1].astype(np.uint64)
            bits = max(1, int(grams.max()).bit_length())
        grams = grams[:-step] << np.uint64(bits) | grams[step:]
        width, bits = width + step, bits * 2
    grams = np.sort(grams)
    same = grams[1:] == grams[:-1]
    again = np.zeros(len(grams), bool)
    again[1:] |= same
    again[:-1] |= same
    return int(again.sum()) / len(grams)


def repeated_ngram_ratio(text: Column | str, n: int = 6) -> Column:
    """Share of n-grams that stand more than once; 0 if there are none. Sorted inside the row as numbers, in Arrow batches."""

    @F.arrow_udf("double")
    def ratio(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _repeated(t, n) for t in (x.as_py() for x in texts)], pa.float64())

    return ratio(_c(text))


def penalties(prompt: Column | str, text: Column | str, min_chars: int = 80) -> dict[str, Column]:
    """The six penalties, each from 0 to 1, of a continuation."""
    t, names = strip(text), character_names(prompt)
    named = lambda ns: F.when((F.size(ns) > 0) & ~F.exists(ns, lambda w: F.contains(t, w)), 1.0).otherwise(0.0)
    return {
        "repeated_sentences": F.least(F.lit(1.0), 2 * repeated_sentence_ratio(t)),
        "repeated_ngrams": F.least(F.lit(1.0), F.greatest(F.lit(0.0), repeated_ngram_ratio(t) - F.lit(0.15)) / F.lit(0.35)),
        "bad_ending": F.when(F.substring(t, -1, 1).isin(*GOOD_ENDINGS), 0.0).otherwise(1.0),
        "broken_text": F.when(F.contains(t, F.lit(REPLACEMENT)), 1.0).otherwise(0.0),
        "lost_protagonist": bound(names, named),
        "too_short": F.greatest(F.lit(0.0), 1 - F.length(t) / F.lit(float(min_chars))),
    }


def score(penalty: dict[str, Column]) -> Column:
    total = sum((F.lit(WEIGHTS[k]) * v for k, v in penalty.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - total)


def penalty_map(penalty: dict[str, Column]) -> Column:
    """Only the penalties above 0."""
    whole = F.create_map(*[x for k, v in penalty.items() for x in (F.lit(k), v)])
    return F.map_filter(whole, lambda k, v: v > 0)
