"""Quality classification: random-indexing word vectors pooled per document, then a small calibrated network.

Tokens are runs of word characters or runs of other visible characters. Those of fewer than LEAST fitting documents
become their shape (capitals, small letters, digits, or the first sign of a run). Random indexing: every token has a
sparse index vector of +1 and -1, drawn from its hash; a token's vector is the sum of the index vectors around it
(WINDOW to each side) over the fitting sample, scaled to length one, plus its own index vector. A document is the mean of
its tokens' vectors. A two-layer network (tanh, then a logistic unit) is trained by Adam in numpy; a temperature that
minimises the log loss of the sample's validation part divides the logits.

Fitting takes at most `limit` labelled rows and BYTES of text (see common.texts_of), by the order of md5(doc_id). Scoring reads whole texts once.

Defined cases: null and empty texts are pooled as zeros and get the network's answer to that. Without labelled rows of
both classes every score is the share of label 1, or 0.5. A column of the result's name is replaced, further ones are passed
through; repeated rows are scored as they come.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, sampled_ids, texts_of

LIMIT, LEAST, SIZE, SIGNS, WINDOW, HIDDEN, EPOCHS, DECAY = 4_000, 4, 128, 8, 2, 32, 400, 1e-3
MEMO = 400_000

_TOKENS = re.compile(r"\w+|[^\w\s]+")


def shape(token: str) -> str:
    if token.isupper():
        return "<A>" if len(token) > 1 else "<A1>"
    if token.isalpha():
        return "<Aa>" if token[0].isupper() else "<a>"
    return "<0>" if token.isdigit() else "<a0>" if token[0].isalnum() or token[0] == "_" else f"<{token[0]}>"


def index_vector(token: str) -> np.ndarray:
    draws = np.random.default_rng(xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")))
    out = np.zeros(SIZE, np.float32)
    out[draws.choice(SIZE, SIGNS, replace=False)] = np.where(draws.random(SIGNS) < 0.5, -1, 1)
    return out / np.sqrt(SIGNS)


class Model:
    def __init__(self, ids: dict[str, int], inner: np.ndarray, bias: np.ndarray, outer: np.ndarray, last: float, temperature: float):
        """inner: the tokens' vectors times the first layer, a row for each id; the last row is for unknown shapes."""
        self.ids, self.inner, self.bias, self.outer, self.last, self.temperature = ids, inner, bias, outer, last, temperature
        self._memo: dict[str, int] = {}

    def _tokens(self, text: str) -> np.ndarray:
        tokens, memo, ids = _TOKENS.findall(text), self._memo, self.ids
        if len(memo) > MEMO:
            memo.clear()
        for t in set(tokens).difference(memo):
            k = ids.get(t)
            memo[t] = ids.get(shape(t), len(ids)) if k is None else k
        return np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))

    def logits(self, texts: list[str]) -> np.ndarray:
        first = np.stack([self.inner[x].mean(0) if len(x := self._tokens(t)) else np.zeros(len(self.bias), np.float32) for t in texts])
        return (np.tanh(first + self.bias) @ self.outer + self.last) / self.temperature

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -40, 40))).astype(float)


def fit_texts(texts: list[str], labels, epochs: int = EPOCHS) -> Model:
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-9), 1 - 1e-9)
        return Model({}, np.zeros((1, 1), np.float32), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), 1.0)
    split = [_TOKENS.findall(t) for t in texts]
    seen = Counter(t for tokens in split for t in set(tokens))
    split = [[t if seen[t] >= LEAST else shape(t) for t in tokens] for tokens in split]
    names = sorted({t for tokens in split for t in tokens})
    ids = {t: i for i, t in enumerate(names)}
    index = np.stack([index_vector(t) for t in names])
    vectors, rows = np.zeros_like(index), []
    for tokens in split:
        k = np.fromiter((ids[t] for t in tokens), np.int64, len(tokens))
        for step in range(1, WINDOW + 1):
            if len(k) > step:
                pairs, n = np.unique(np.concatenate((k[:-step] * len(names) + k[step:], k[step:] * len(names) + k[:-step])), return_counts=True)
                np.add.at(vectors, pairs // len(names), index[pairs % len(names)] * n[:, None].astype(np.float32))
        rows.append(k)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    vectors += index
    x = np.stack([vectors[k].mean(0) if len(k) else np.zeros(SIZE, np.float32) for k in rows]).astype(float)
    centre, spread = x.mean(0), x.std(0) + 1e-3
    x = (x - centre) / spread
    draws = np.random.default_rng(7)
    part = draws.random(len(y)) < 0.2  # for the temperature
    if not (0 < y[part].mean() < 1 and 0 < y[~part].mean() < 1 if part.any() and not part.all() else False):
        part[:] = False
    net = _train(x[~part], y[~part], epochs, draws)
    z = _forward(net, x)[0]
    at = part if part.any() else np.ones(len(y), bool)
    grid = np.geomspace(0.25, 16, 60)
    temperature = float(grid[np.argmin([np.logaddexp(0, -z[at] / t * (2 * y[at] - 1)).mean() for t in grid])])
    inner, bias, outer, last = net
    scaled = inner / spread[:, None]
    table = np.vstack([vectors @ scaled, np.zeros((1, HIDDEN))]).astype(np.float32)
    return Model(ids, table, bias - centre @ scaled, outer, float(last[0]), temperature)


def _forward(net, x):
    hidden = np.tanh(x @ net[0] + net[1])
    return hidden @ net[2] + net[3][0], hidden


def _train(x: np.ndarray, y: np.ndarray, epochs: int, draws) -> list[np.ndarray]:
    """Adam on the whole sample, with weight decay."""
    net = [draws.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draws.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    for step in range(1, epochs + 1):
        z, hidden = _forward(net, x)
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        back = g[:, None] * net[2] * (1 - hidden * hidden)
        grads = [x.T @ back + DECAY * net[0], back.sum(0), hidden.T @ g + DECAY * net[2], np.array([g.sum()])]
        for k, grad in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
            net[k] = net[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", limit: int = LIMIT) -> Model:
    sample = texts_of(docs, sampled_ids(labels, keep, label, limit), limit)
    return fit_texts(sample["text"].tolist(), sample["label"].tolist())


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The documents with the probability of label 1."""

    def scored(batches):
        for batch in batches:
            for part in parts(batch, 512):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score([t or "" for t in part.column("text").to_pylist()]))], names=[*part.schema.names, name])

    own = docs.drop(name)
    return own.mapInArrow(scored, T.StructType([*own.schema.fields, T.StructField(name, T.DoubleType())]))
