"""Operator 4: toxicity by FTRL-proximal logistic regression.

Features of a text: its distinct word n-grams (one and two words) and skip-grams
(two words with one or two words between them), hashed to ``2**BITS`` numbers.
FTRL-proximal keeps a learning rate for each coordinate and, by its L1 term,
exact zeros for most: the weights that are left (some thousands at most) are
broadcast as two short arrays. Words are runs of letters and digits, A-Z in
lower case; other bytes of ASCII separate them.

Bounded sample: at most ``sample`` labelled rows of each label, those with the
smallest hash of their id, as far as their whole texts keep within ``size`` bytes
together. All whole texts are scored, in one map without a shuffle.

Null and empty texts get the score of the bias alone. Long texts are read to their
end; a feature counts once however often it stands. Equal texts get equal scores,
repeated rows too. An empty table gives an empty result; without labelled rows every
score is 0.5. Which labels teach, null ids and clashing columns: as in the quality
classifier.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import SAMPLE_BYTES, U64, Words, batches, mix
from .quality import labelled, logistic

BITS = 20
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_GRAMS = (1, 2, 3)  # distance of the second word of a pair


def hashed(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature number) of all n-grams and skip-grams."""
    w = Words([(t or "").encode("utf-8", "replace").translate(_TABLE) for t in texts], lower=True)
    h = w.hash
    doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
    who, what = [doc], [h]
    for d in _GRAMS:
        if len(h) > d:
            same = doc[d:] == doc[:-d]
            who.append(doc[d:][same])
            what.append(mix(h[:-d] * U64(0x9E3779B97F4A7C15) + h[d:] + U64(d))[same])
    return np.concatenate(who), (np.concatenate(what) >> U64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal: z and n for each coordinate; coordinate 2**BITS is the bias."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 15.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0
        return w

    def learn(self, at: np.ndarray, y: int, weight: float) -> None:
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g


class ToxicityModel:
    """The weights that aren't zero, in order of their numbers."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, bias: float):
        self.at, self.weight, self.bias = at, weight, bias

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_dense"}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not hasattr(self, "_dense"):
            self._dense = np.zeros(2**BITS)
            self._dense[self.at] = self.weight
        out = np.full(len(texts), self.bias)
        for a, b in batches(texts):
            who, what = hashed(texts[a:b])
            hit = self._dense[what] != 0
            pair = np.unique((who[hit] << BITS) | what[hit])
            out[a:b] += np.bincount(pair >> BITS, weights=self._dense[pair & (2**BITS - 1)], minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(rows: list[tuple[str, int, float]], epochs: int = 4) -> ToxicityModel:
    """Three rows of four train the weights, the fourth calibrates them: a slope
    and an offset of the log-odds, both labels weighing alike."""
    m, bias = Ftrl(), np.array([2**BITS])
    learn, held = [r for i, r in enumerate(rows) if i % 4], rows[::4]
    sets = []
    for a, b in batches(texts := [r[0] for r in learn]):
        who, what = hashed(texts[a:b])
        pair = np.unique((who << BITS) | what)
        edge = np.searchsorted(pair >> BITS, np.arange(b - a + 1))
        sets += [np.concatenate([pair[i:j] & (2**BITS - 1), bias]) for i, j in zip(edge[:-1], edge[1:])]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(learn)):
            m.learn(sets[i], learn[i][1], 1.0)
    w = m.weights(np.arange(2**BITS + 1))
    at = np.flatnonzero(w[:-1])
    model = ToxicityModel(at, w[at], float(w[-1]))
    y = np.array([r[1] for r in held], dtype=float)
    if len(held) and 0 < y.mean() < 1:
        p = np.clip(model.score([r[0] for r in held]), 1e-9, 1 - 1e-9)
        x = np.column_stack([np.ones(len(p)), np.log(p / (1 - p))])
        offset, slope = logistic(x, y, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
        if slope > 0:
            model = ToxicityModel(at, w[at] * slope, float(w[-1] * slope + offset))
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, train, label: str = "toxic", sample: int = 3000, text: str = "text", key: str = "doc_id", size: int = SAMPLE_BYTES) -> ToxicityModel:
    return fit(labelled(docs, labels, label, train, sample, text, key, size))
