"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

A sentence's logit is a bias plus the weights of its different words (a word's weight: its own and those of its
beginnings, none below zero, since a sentence isn't made harmless by harmless words); a document is toxic if any of its sentences is, so its
probability is the noisy-or 1 - prod(1 - p). Only documents bear labels: the gradient of the document's log loss runs
through the noisy-or to its sentences. The fitted sentence model then locates the offending sentences of a document.

Fitting takes at most `limit` labelled rows and BYTES of text (see common.texts_of), by the order of md5(doc_id); scoring reads every whole text once, in
Arrow batches, with the weights of the words as a broadcast table.

Words are runs of letters, digits and underscores, in lower case; a sentence ends at one of . ! ? or a line break.
Features in fewer than `least` documents of label 1, or not clearly more frequent there, weigh nothing. The bias is learned
with the weights; `start` is where it begins.

A sentence's probability is taken over that of one without any weighty word, so length alone makes no document toxic.

Defined cases: null and empty texts, and texts without a word, score 0. Without
labelled rows of both classes nothing can be learned and all scores are 0. Rows repeat as they come; null ids are scored.
A column of the name of a result is replaced; all others are passed through, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, sampled_ids, texts_of, tidy

LIMIT, LEAST, LIFT, STEPS, PENALTY, NOISE, START = 4_000, 4, 2.0, 200, 3e-4, 0.02, -7.0
MEMO = 400_000  # words whose weight a worker remembers

_TOKENS = re.compile(r"\w+|[.!?\n]")
_ENDS = {".", "!", "?", "\n"}
_END, _WORDS = re.compile(r"[.!?\n]|\Z"), re.compile(r"\w+")


def features(word: str) -> list[str]:
    """A word and its beginnings of 4 to 8 characters, which its inflected forms share."""
    return [word, *(f"{word[:k]}-" for k in range(4, min(9, len(word))))]


class Model:
    """Weights by word and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._known: dict[str, float] = {}

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(x, 0.0) for x in features(word))

    def _learned(self, words) -> None:
        """Weigh the words not met before; the table is emptied when it's large."""
        known = self._known
        if len(known) > MEMO:
            known.clear()
        known.update((w, self.word(w)) for w in set(words).difference(known))

    def sentence(self, words) -> float:
        return float(-np.expm1(self._quiet(sum(map(self.word, sorted(set(words)))))))

    def _quiet(self, weight: float) -> float:
        """Log of the chance that a sentence of this weight isn't toxic, over that of one without weight."""
        return min(0.0, float(np.logaddexp(0, self.bias) - np.logaddexp(0, self.bias + weight)))

    def documents(self, texts: list[str]) -> np.ndarray:
        """Noisy-or of the sentences of each text. Only weight speaks: a sentence without any adds nothing, however many there are."""
        return np.array([x[0] for x in self.located(texts)])

    def located(self, texts: list[str]) -> list[tuple[float, list[tuple[int, float]]]]:
        """For each text its probability, and (number from 0, probability) of its sentences with any weight."""
        known, out = self._known, []
        for text in texts:
            tokens = _TOKENS.findall(text.lower())
            self._learned(tokens)
            hits = np.flatnonzero(np.fromiter(map(known.__getitem__, tokens), float, len(tokens)))
            ends = np.flatnonzero(np.fromiter(map(_ENDS.__contains__, tokens), bool, len(tokens)))
            found: dict[int, set[str]] = {}
            for k, s in zip(hits.tolist(), np.searchsorted(ends, hits).tolist(), strict=True):
                found.setdefault(s, set()).add(tokens[k])
            quiet = {s: self._quiet(sum(map(known.__getitem__, sorted(x)))) for s, x in found.items()}
            whole = min(1.0, max(0.0, float(-np.expm1(sum(quiet.values())))))
            out.append((whole, [(s, float(-np.expm1(q))) for s, q in quiet.items()]))
        return out


def _sentences(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in _TOKENS.findall(text.lower()):
        if t in _ENDS:
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x] or [[]]


def fit_texts(texts: list[str], labels, least: int = LEAST, steps: int = STEPS, penalty: float = PENALTY, noise: float = NOISE, start: float = START) -> Model:
    """Fit word weights to document labels through the noisy-or on the whole (bounded) sample.

    Accelerated proximal gradient steps with an L1 penalty; each feature has its own step, from a bound on its curvature.
    `noise` is the chance that a label 1 stands on a text without a cause, so such labels pull only weakly.
    """
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({}, start)
    numbers: dict[str, int] = {}
    bags = [[np.fromiter({numbers.setdefault(w, len(numbers)) for w in s}, np.int32) for s in _sentences(t)] for t in texts]
    words, held = list(numbers), [np.unique(np.concatenate(bag)).tolist() for bag in bags]
    of_document = lambda d: {x for w in held[d] for x in features(words[w])}
    toxic = Counter(chain.from_iterable(of_document(d) for d in np.flatnonzero(y == 1).tolist()))
    toxic = {x: n for x, n in toxic.items() if n >= least}
    seen = Counter(chain.from_iterable(of_document(d) & toxic.keys() for d in range(len(y))))
    ids = {x: i for i, x in enumerate(sorted(x for x, n in toxic.items() if n > LIFT * y.mean() * seen[x]))}
    of = {k: found for k, w in enumerate(words) if (found := [ids[x] for x in features(w) if x in ids])}
    word, sentence, document, at = [], [], [], 0
    for d, bag in enumerate(bags):
        for s in bag:
            known = sorted(set(chain.from_iterable(of[w] for w in s.tolist() if w in of)))
            word += known
            sentence += [at] * len(known)
            document.append(d)
            at += 1
    word, sentence, document = (np.asarray(x, np.int64) for x in (word, sentence, document))
    bound = 0.5 * np.bincount(word, minlength=len(ids)) / len(y) + 1e-5
    w = last = np.zeros(len(ids))
    b, pace = start, 1.0
    for _ in range(steps):
        paced = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, pace = w + (pace - 1) / paced * (w - last), paced
        z = b + np.bincount(sentence, ahead[word], at)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(document, -np.logaddexp(0, z), len(y)))  # the chance that no sentence is toxic
        chance = noise + (1 - noise) * (1 - none)
        pull = np.where(y == 1, -(1 - noise) * none / chance, 1.0) / len(y)
        grad = np.bincount(word, (pull[document] * p)[sentence], len(ids))
        last, w = w, ahead - grad / bound
        w = np.maximum(w - penalty / bound, 0)
        slope, bend = float(pull[document] @ p), float(np.abs(pull[document]) @ (p * (1 - p)))
        b -= float(np.clip(slope / (bend + 1e-4), -0.25, 0.25))  # a damped Newton step
    return Model({x: float(w[i]) for x, i in ids.items() if w[i] > 1e-3}, b)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", limit: int = LIMIT) -> Model:
    sample = texts_of(docs, sampled_ids(labels, keep, label, limit), limit)
    return fit_texts(sample["text"].tolist(), sample["label"].tolist())


def score(docs: DataFrame, model: Model, name: str = "score", offences: str | None = None, threshold: float = 0.5) -> DataFrame:
    """The documents with the probability that they are toxic and, if `offences` names a column for them, the numbers of
    their offending sentences (from 0, at or above the threshold by themselves) in order."""

    def scored(batches):
        for batch in batches:
            for part in parts(batch, 1024):
                found = model.located([t or "" for t in part.column("text").to_pylist()])
                columns, names = [*part.columns, pa.array([x[0] for x in found], pa.float64())], [*part.schema.names, name]
                if offences:
                    columns.append(pa.array([sorted(s for s, p in x[1] if p >= threshold) for x in found], pa.list_(pa.int32())))
                    names.append(offences)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    own = docs.drop(*[n for n in (name, offences) if n])
    fields = [*own.schema.fields, T.StructField(name, T.DoubleType())]
    if offences:
        fields.append(T.StructField(offences, T.ArrayType(T.IntegerType())))
    return own.mapInArrow(tidy(scored), T.StructType(fields))


def offending(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, sentence_no, start, end, sentence, probability) of every sentence at or above the threshold.

    Sentences are numbered as in `score`; offsets count code points.
    """

    def located(batches):
        for batch in (part for whole in batches for part in parts(whole, 1024)):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start, text = 0, text or ""
                for number, m in enumerate(_END.finditer(text)):
                    sentence = text[start : m.end()]
                    p = model.sentence(_WORDS.findall(sentence.lower()))
                    if p >= threshold:
                        rows.append({"doc_id": doc_id, "sentence_no": number, "start": start, "end": m.end(), "sentence": sentence, "probability": p})
                    start = m.end()
            types = [("doc_id", batch.schema.field("doc_id").type), ("sentence_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("sentence", pa.string()), ("probability", pa.float64())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(types))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(located), f"doc_id {kind}, sentence_no int, start int, end int, sentence string, probability double")
