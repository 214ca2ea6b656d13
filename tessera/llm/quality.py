"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are the one- and two-word grams of a text's words and of their shapes (letters, capitals and digits folded,
runs collapsed), hashed to one index space; a feature's value is its share of the text's words times a constant. A
score is the sparse dot product with the weights, through the logistic function.

Cases: a null text counts as empty; an empty text has no features and gets the score of the bias; very long texts are
scored whole; repeated rows each get their score, and of several texts of one id the smallest one trains; without
labelled rows the model scores 0.5 everywhere; an empty table gives no rows; extra columns stay, but a column that has
the name of the score is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import labelled
from .textarrays import SOLID, Texts, ngrams, passes

BITS = 18
SCALE = 30.0
SHAPE = np.array([88 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else 120 if b >= 128 or 97 <= b <= 122 else b for b in range(256)], dtype=np.uint8)


def streams(texts: Texts) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(text index, feature index) of each kind of gram, and the number of words of each text."""
    s, e, doc = texts.words(SOLID)
    out = []
    if len(s):
        shaped = SHAPE[texts.buf]
        keep = np.ones(len(shaped), bool)
        np.not_equal(shaped[1:], shaped[:-1], out=keep[1:])
        keep[s] = True
        upto = np.concatenate(([0], np.cumsum(keep)))
        small = Texts(shaped[keep], np.array([0, int(upto[-1])]))
        for salt, h in ((1, texts.hashes(s, e)), (2, small.hashes(upto[s], upto[e]))):
            for n in (1, 2):
                g, d = ngrams(h + np.uint64(salt), doc, n)
                out.append((d, (g >> np.uint64(64 - BITS)).astype(np.int64)))
    return out, np.bincount(doc, minlength=len(texts))[: len(texts)]


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def scores(self, texts: Texts) -> np.ndarray:
        grams, n = streams(texts)
        f = np.zeros(len(texts))
        for d, i in grams:
            f += np.bincount(d, weights=self.weights[i], minlength=len(texts))[: len(texts)]
        f = self.bias + SCALE * f / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int = 4, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """FTRL-proximal over sparse rows (indices, values); the bias has no penalty."""
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i, x = rows[r]
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2))
            b = -zb / ((beta + nb**0.5) / alpha)
            g0 = 1 / (1 + np.exp(-np.clip(w @ x + b, -30, 30))) - y[r]
            g = g0 * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[i] = ni + g * g
            zb, nb = zb + g0 - ((nb + g0 * g0) ** 0.5 - nb**0.5) / alpha * b, nb + g0 * g0
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, -zb / ((beta + nb**0.5) / alpha)


def train_quality(documents: DataFrame, labels: DataFrame, limit: int = 4000, mod: int = 4, hold: int = 2) -> QualityModel:
    """Fit on at most ``limit`` labelled training texts; rows whose crc32 remainder is ``hold`` are never read."""
    table = labelled(documents, labels, "quality", limit, mod, hold).toArrow()
    if not table.num_rows:
        return QualityModel(np.zeros(1 << BITS, np.float32), 0.0)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for batch, texts in passes(iter(table.to_batches())):
        grams, n = streams(texts)
        if not grams:
            rows += [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
            continue
        pair, count = np.unique(np.concatenate([(d << BITS) | i for d, i in grams]), return_counts=True)
        d, i = pair >> BITS, pair & ((1 << BITS) - 1)
        cuts = np.searchsorted(d, np.arange(len(texts) + 1))
        rows += [(i[a:b], SCALE * count[a:b] / max(k, 1)) for a, b, k in zip(cuts[:-1], cuts[1:], n, strict=True)]
    w, b = fit_ftrl(rows, table["y"].to_numpy(), 1 << BITS)
    return QualityModel(w.astype(np.float32), float(b))


def score_quality(documents: DataFrame, model: QualityModel, score: str = "score") -> DataFrame:
    """``documents`` with a column ``score`` (0 to 1) appended, in place of one of that name."""
    documents = documents.drop(score)
    schema = documents.select("*", F.lit(0.0).alias(score)).schema
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in passes(batches):
            s = held.value.scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, score])

    return documents.mapInArrow(run, schema)
