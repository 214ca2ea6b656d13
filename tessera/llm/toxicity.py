"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of hashed words and five-byte windows is fitted in numpy from confirmed toxic texts and unlabelled
texts. The risk is ``prior * R+(P) + max(0, R-(U) - prior * R-(P))`` with the sigmoid loss; where the corrected
negative part falls below zero its gradient is reversed. Labels of non-toxic rows are never used as negatives; they
only enter the class prior, together with the positives.

Cases: a null text counts as empty; an empty text has no words and gets the score of the bias alone; very long texts
are scored whole; repeated rows each get their score, and of several texts of one id the smallest one trains; without
any confirmed positive or any unlabelled text the model is the prior alone; an empty table gives no rows; extra columns
stay, but a column that has the name of the score is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import remainder, sampled, training_ids
from .textarrays import ALNUM, LOWER, Texts, passes

BITS = 20
WINDOW = 5
#: Bytes of text in one pass: each byte starts a window, so passes are small.
PASS = 1 << 19
FLAT = np.where(ALNUM, LOWER, 32).astype(np.uint8)


@dataclass
class ToxicityModel:
    """Weights of the selected hashed words (``keys`` sorted) and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: Texts) -> np.ndarray:
        doc, key = presence(texts, self.keys)
        f = self.bias + np.bincount(doc, weights=self.weights[key], minlength=len(texts))[: len(texts)]
        return logistic(f)


def feature_keys(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every word and of every window of ``WINDOW`` bytes, ASCII case folded.

    Words are runs of letters and digits; in windows every other byte counts as a space, so they see word starts.
    """
    s, e, doc = texts.words(ALNUM)
    flat = Texts(FLAT[texts.buf], texts.offsets)
    at = np.arange(max(len(flat.buf) - WINDOW + 1, 0))
    owner = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    at = at[owner[: len(at)] == owner[WINDOW - 1 :][: len(at)]] if len(at) else at
    h = np.concatenate([texts.hashes(s, e, LOWER), flat.hashes(at, at + WINDOW) ^ np.uint64(0x5BD1E9955BD1E995)])
    return np.concatenate([doc, owner[at] if len(at) else at]), (h >> np.uint64(64 - BITS)).astype(np.int64)


def presence(texts: Texts, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, position in ``keys``) of the known features."""
    doc, h = feature_keys(texts)
    if not len(keys) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.full(1 << BITS, -1, np.int32)
    at[keys] = np.arange(len(keys), dtype=np.int32)
    k = at[h]
    on = k >= 0
    pair = np.unique(doc[on] * len(keys) + k[on])
    return pair // len(keys), pair % len(keys)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 500, rate: float = 0.05, decay: float = 1e-4, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights that minimise the non-negative risk over dense rows ``p`` (positive) and ``u`` (unlabelled), and the bias.

    The bias is set last, so that the mean score of the unlabelled rows is the prior.
    """
    d = p.shape[1]
    w, b = np.zeros(d, np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        sp, su = logistic(p @ w + b), logistic(u @ w + b)
        gp, gu = sp * (1 - sp) / len(p), su * (1 - su) / len(u)  # of the losses of predicting positive
        if su.mean() - prior * sp.mean() >= -beta:
            cp, cu = -2 * prior * gp, gu
        else:
            cp, cu = prior * gp, -gu
        # Rows and weights are single precision throughout: no copy of the rows is made in a step.
        g = np.append(cp.astype(np.float32) @ p + cu.astype(np.float32) @ u + np.float32(decay) * w, cp.sum() + cu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - step[-1]
    f, low, high = u @ w, -60.0, 60.0
    for _ in range(80):
        b = (low + high) / 2
        low, high = (low, b) if logistic(f + b).mean() > prior else (b, high)
    return w.astype(float), float(b)


def train_toxicity(documents: DataFrame, labels: DataFrame, max_positive: int = 2500, max_unlabelled: int = 5000, words: int = 1024, mod: int = 4, hold: int = 2) -> ToxicityModel:
    """Fit on at most ``max_positive`` confirmed toxic and ``max_unlabelled`` unlabelled training texts.

    Both bounds are on ids in the order of their hash, and ``samples.SAMPLE_BYTES`` on their texts; rows whose crc32
    remainder is ``hold`` are never read.
    At most ``words`` hashed features that differ most between the two samples are used.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", mod) != hold))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    n, n_pos = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = min(max(n_pos / n, 0.001), 0.9) if n else 0.001
    pos = training_ids(known.where("y = 1").select("doc_id"), max_positive, mod, hold).select("doc_id", F.lit(1).alias("y"))
    unl = training_ids(documents.select("doc_id").distinct(), max_unlabelled, mod, hold).select("doc_id", F.lit(0).alias("y"))
    ids = pos.unionByName(unl).groupBy("doc_id").agg(F.max("y").alias("pos"), F.min("y").alias("unl"))
    rows = sampled(documents, ids)
    table = rows.select("text", "pos", "unl").toArrow()
    text, is_p, is_u = table["text"], table["pos"].to_numpy() == 1, table["unl"].to_numpy() == 0
    none = ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not is_p.any() or not is_u.any():
        return none
    size = 1 << BITS
    cp, cu = np.zeros(size), np.zeros(size)
    batches = lambda: passes(iter(pa.table({"text": text}).to_batches()), size=PASS // 2)
    at = 0
    for _, part in batches():
        doc, h = feature_keys(part)
        pair = np.unique((doc << BITS) | h)
        doc, h = (pair >> BITS) + at, pair & (size - 1)
        cp += np.bincount(h[is_p[doc]], minlength=size)
        cu += np.bincount(h[is_u[doc]], minlength=size)
        at += len(part)
    np_, nu = int(is_p.sum()), int(is_u.sum())
    mean = (cp + cu) / (np_ + nu)
    z = np.abs(cp / np_ - cu / nu) / np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / np_ + 1 / nu))
    z[mean * (np_ + nu) < 3] = 0
    keys = np.sort(np.argsort(-z, kind="stable")[:words])
    keys = keys[z[keys] > 0]
    if not len(keys):
        return none
    x = np.zeros((len(text), len(keys)), np.float32)
    at = 0
    for _, part in batches():
        doc, key = presence(part, keys)
        x[doc + at, key] = 1
        at += len(part)
    p, u = x[is_p], x[is_u]
    del x, table, text
    w, b = fit_nnpu(p, u, prior)
    return ToxicityModel(keys, w, b)


def score_toxicity(documents: DataFrame, model: ToxicityModel, score: str = "score", drop_from: float | None = None) -> DataFrame:
    """``documents`` with a column ``score`` (0 to 1) in place of one of that name; with ``drop_from``, only rows scored below it, as they are."""
    if drop_from is None:
        documents = documents.drop(score)
    schema = documents.schema if drop_from is not None else documents.select("*", F.lit(0.0).alias(score)).schema

    def run(batches):
        for batch, texts in passes(batches, size=PASS):
            s = model.scores(texts)
            if drop_from is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, score])
            elif (s < drop_from).any():
                yield batch.filter(pa.array(s < drop_from))

    return documents.mapInArrow(run, schema)
