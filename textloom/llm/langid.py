"""Language identification with a string kernel: blended spectrum, n-gram presence, Nyström landmarks, ridge regression.

Two texts are as similar as the number of character n-grams (N_GRAMS lengths, over letters in lower case, everything
else one space) that both hold, over the root of the product of their own numbers: presence, not counts, so length and
repetition matter little. LANDMARKS texts of the bounded fitting sample span the feature space (Nyström: similarities
to the landmarks times the inverse root of the landmarks' own kernel matrix; n-grams of fewer than two landmarks are
left out of the kernel). One ridge regression for each language, against the rest, is solved in it. Scoring multiplies
a batch's presence matrix with the landmarks' n-grams folded into the regressions: the same product, associated so
that whole texts cost a look-up for each n-gram. Products run over blocks of COLUMNS n-grams, so their number, which grows
with the landmarks' texts, has no cap.

Defined cases: null texts and those without a letter are `und` with score 0, as is everything where no labelled text
was found. Texts whose n-grams the landmarks don't hold get the language of the largest intercept. Ties: first language by code point.
Columns named lang_pred and score are replaced, all others passed through.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, sampled_ids, texts_of

N_GRAMS, LANDMARKS, LIMIT, RIDGE, SHARPNESS = (2, 3, 4), 256, 4_000, 1.0, 6.0
UNKNOWN = "und"

_P = np.uint64(0x9E3779B97F4A7C15)
COLUMNS, SPARE = 1 << 16, 8  # n-grams of a block; slots of the look-up table for each n-gram


def _letters() -> np.ndarray:
    """For each code point, of all planes, its lower-case letter, or a space; built from Python's own character data."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for code, c in enumerate(map(chr, range(len(out)))):
        if c.isalpha():
            out[code] = ord(c.lower()[0])
    return out


class Grams:
    """Hashes of a text's n-grams."""

    def __init__(self):
        self._letter = _letters()

    def codes(self, text: str) -> np.ndarray:
        """Letters and single spaces, a space at either end; empty if the text has no letter."""
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self._letter[raw]
        if not (codes != 32).any():
            return np.zeros(0, np.uint64)
        codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
        return codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]

    def hashes(self, text: str) -> list[np.ndarray]:
        codes = self.codes(text)
        out, h = [], codes
        for n in range(2, max(N_GRAMS) + 1):
            if len(h) < 2:
                break
            h = (h[:-1] + np.uint64(1)) * _P + codes[n - 1 :]
            if n in N_GRAMS:
                out.append(h)
        return out


def _ranged(hits: list[np.ndarray], size: int):
    """The hits (sorted places, a row's each) as dense 0/1 matrices over blocks of COLUMNS places: (first place, last, matrix)."""
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    place = np.concatenate([*hits, np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[order], np.arange(0, size + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        start, stop, at = k * COLUMNS, min(size, (k + 1) * COLUMNS), order[a:b]
        if b > a:
            held = np.zeros((len(hits), stop - start), np.float32)
            held[row[at], place[at] - start] = 1
            yield start, stop, held


def _scale(hits: list[np.ndarray]) -> np.ndarray:
    """One over the root of each row's number of hits, as a column."""
    return 1 / np.sqrt(np.maximum([[len(h)] for h in hits], 1).reshape(-1, 1))


class Model:
    def __init__(self, languages: list[str], grams: np.ndarray, weights: np.ndarray, intercept: np.ndarray):
        """grams: sorted hashes; weights: a row for each of them, a column for each language."""
        self.languages, self.grams, self.weights, self.intercept = languages, grams, weights, intercept
        self._reader = None

    def __getstate__(self):
        return self.__dict__ | {"_reader": None}

    def hits(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """The places of the grams that each text holds, sorted, and whether the text has a letter."""
        if self._reader is None:  # an open-addressing table over the grams' hashes, made once in each worker
            bits = max(int(len(self.grams) * SPARE).bit_length(), 10)
            table = np.full(1 << bits, -1, np.int32)
            left, probe = np.arange(len(self.grams)), 0
            while len(left):
                slot = _slot(self.grams[left], probe, bits)
                free = table[slot] < 0
                table[slot[free]] = left[free]
                left, probe = left[table[slot] != left], probe + 1
            self._reader = Grams(), table, probe, bits
        grams, table, probes, bits = self._reader
        found, lettered = [], np.zeros(len(texts), bool)
        for row, text in enumerate(texts):
            own = []
            for h in grams.hashes(text):
                lettered[row] = True
                for probe in range(probes):
                    at = table[_slot(h, probe, bits)]
                    hit = self.grams[at] == h
                    own.append(at[hit])
                    h = h[~hit & (at >= 0)]
                    if not len(h):
                        break
            found.append(np.unique(np.concatenate(own)) if own else np.zeros(0, np.int32))
        return found, lettered

    def margins(self, hits: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(hits), len(self.languages)))
        for start, stop, held in _ranged(hits, len(self.grams)):
            out += held @ self.weights[start:stop]
        return out * _scale(hits) + self.intercept

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        found, lettered = self.hits([t or "" for t in texts])
        margins = self.margins(found)
        chance = np.exp(SHARPNESS * (margins - margins.max(1, keepdims=True)))
        chance /= chance.sum(1, keepdims=True)
        best = chance.argmax(1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return names, np.where(lettered, chance[np.arange(len(texts)), best], 0.0).astype(float)


def _slot(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    mixed = h * _P if not probe else ((h ^ np.uint64(probe)) * _P) * _P
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def fit_texts(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on texts and their languages. The landmarks are the first texts of each language in turn."""
    grams = Grams()
    usable = [i for i, t in enumerate(texts) if len(grams.codes(t or ""))]
    texts, languages = [texts[i] for i in usable], [languages[i] for i in usable]
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros(0))
    queues = [[i for i, x in enumerate(languages) if x == name] for name in names]
    chosen = [q[k] for k in range(max(map(len, queues))) for q in queues if k < len(q)][:landmarks]
    every, n = np.unique(np.concatenate([np.unique(np.concatenate(grams.hashes(texts[i]))) for i in chosen]), return_counts=True)
    model = Model(names, every[n > 1] if (n > 1).any() else every, np.zeros((0, len(names)), np.float32), np.zeros(len(names)))
    own, _ = model.hits([texts[i] for i in chosen])
    scale = _scale(own)
    kernel = sum((held @ held.T for _, _, held in _ranged(own, len(model.grams))), np.zeros((len(own), len(own)))) * scale * scale.T
    value, vector = np.linalg.eigh(kernel.astype(float))
    root = (vector / np.sqrt(np.maximum(value, 1e-6 * value.max()))) @ vector.T
    near = np.zeros((len(texts), len(own)))
    for at in range(0, len(texts), 128):
        some, _ = model.hits(texts[at : at + 128])
        for (_, _, held), landmark in _together(some, own, len(model.grams)):
            near[at : at + 128] += held @ landmark.T
        near[at : at + 128] *= _scale(some) * scale.T
    x = near @ root
    y = np.where(np.array(languages)[:, None] == np.array(names)[None], 1.0, -1.0)
    mean, centre = y.mean(0), x.mean(0)
    solved = np.linalg.solve((x - centre).T @ (x - centre) + ridge * np.eye(x.shape[1]), (x - centre).T @ (y - mean))
    folded = scale * (root @ solved)  # of each landmark and language
    model.weights = np.zeros((len(model.grams), len(names)), np.float32)
    for start, stop, held in _ranged(own, len(model.grams)):
        model.weights[start:stop] = held.T @ folded
    model.intercept = mean - centre @ solved
    return model


def _together(some: list[np.ndarray], own: list[np.ndarray], size: int):
    """The blocks of both lists of hits that both have."""
    landmarks = _ranged(own, size)
    there = next(landmarks, None)
    for block in _ranged(some, size):
        while there is not None and there[0] < block[0]:
            there = next(landmarks, None)
        if there is not None and there[0] == block[0]:
            yield block, there[2]


def fit(docs: DataFrame, keep: Column, limit: int = LIMIT) -> Model:
    """Fit on at most `limit` documents that have a language and BYTES of text, by the order of md5(doc_id)."""
    sample = texts_of(docs, sampled_ids(docs, keep & F.col("text").isNotNull(), "lang", limit, "string"), limit)
    return fit_texts(sample["text"].tolist(), sample["label"].tolist())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with lang_pred and score."""

    def predicted(batches):
        for batch in batches:
            for part in parts(batch, 64):
                names, score = model.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score)], names=[*part.schema.names, "lang_pred", "score"])

    own = docs.drop("lang_pred", "score")
    return own.mapInArrow(predicted, T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
