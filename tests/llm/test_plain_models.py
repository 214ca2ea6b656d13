"""Models against plain loops: the same rule written out feature by feature, without arrays or batches."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import pii, quality, queries, toxicity
from tessera.llm.textarrays import Texts

WORDS = "alpha beta gamma delta omega kappa scum moron Zeta9 (x)".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    docs, labels = [], []
    for k in range(70):
        toxic, good = k % 5 == 0, k % 3 > 0
        w = [rnd.choice(WORDS[:6] + (WORDS[6:8] if toxic else [])) for _ in range(rnd.randrange(4, 9))] + ([] if good else ["Zeta9", "(x)"])
        docs.append((k, " ".join(w), "src"))
        if k % 4:
            labels.append((k, int(good), int(toxic)))
    docs += [(500, None, "src"), (501, "", "src"), (None, "scum alpha", None), (502, "scum " * 3000, "src"), (3, docs[3][1], "src")]
    at = str(tmp_path_factory.mktemp("plain"))
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, docs, labels


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 4


def one(text):
    return Texts.of(pa.array([text]))


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30, min(30, x))))


# --- quality ---------------------------------------------------------------------------------------------------------------


def quality_grams(text):
    """Hashed grams of a text, each computed from a text that holds only that gram, and the number of words."""
    words = (text or "").split()
    out = Counter()
    for n in (1, 2):
        for k in range(len(words) - n + 1):
            grams, _ = quality.streams(one(" ".join(words[k : k + n])))
            for (_, whole), size in zip(grams, (1, 2, 1, 2), strict=True):
                if size == n:
                    out[int(whole[0])] += 1
    return out, len(words)


def plain_ftrl(rows, y, epochs=4, alpha=0.1, beta=1.0, l1=0.02, l2=1.0):
    z, n, zb, nb = Counter(), Counter(), 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)).tolist():
            w = {i: weight(i) for i in rows[r]}
            b = -zb / ((beta + math.sqrt(nb)) / alpha)
            g0 = sigmoid(sum(w[i] * x for i, x in rows[r].items()) + b) - y[r]
            for i, x in rows[r].items():
                g = g0 * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
            zb += g0 - (math.sqrt(nb + g0 * g0) - math.sqrt(nb)) / alpha * b
            nb += g0 * g0
    return {i: weight(i) for i in z}, -zb / ((beta + math.sqrt(nb)) / alpha)


def test_op8_against_plain_loops(spark, folder):
    at, docs, labels = folder
    text = dict((i, t) for i, t, _ in docs)
    ids = [r.doc_id for r in spark.createDataFrame([(i,) for i, *_ in labels if held(i) != 2], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    good = {i: q for i, q, _ in labels}
    rows = []
    for i in ids:
        grams, n = quality_grams(text[i])
        rows.append({g: quality.SCALE * c / n for g, c in grams.items()})
    w, b = plain_ftrl(rows, [good[i] for i in ids])
    for r in queries.op8_quality(spark, at).join(spark.createDataFrame(docs, "doc_id long, text string, source string").distinct(), "doc_id").collect():
        grams, n = quality_grams(r.text)
        s = sigmoid(b + quality.SCALE * sum(w.get(g, 0.0) * c for g, c in grams.items()) / max(n, 1))
        assert r.score == pytest.approx(s, abs=1e-5) and r.held_out == (held(r.doc_id) == 2) and r.predicted == int(r.score >= 0.7)


# --- toxicity ----------------------------------------------------------------------------------------------------------------


def toxic_keys(text):
    """Hashed words and windows of a text; each text on its own."""
    return set(toxicity.feature_keys(one(text))[1].tolist())


def plain_nnpu(p, u, prior, keys, steps=500, rate=0.05, decay=1e-4):
    """The non-negative risk by sums over texts and their features, without matrices."""
    w, b = dict.fromkeys(keys, 0.0), math.log(prior / (1 - prior))
    m, v, mb, vb = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0.0), 0.0, 0.0
    for t in range(1, steps + 1):
        sp, su = ([sigmoid(b + sum(w[k] for k in x)) for x in rows] for rows in (p, u))
        corrected = sum(su) / len(u) - prior * sum(sp) / len(p) >= 0
        g, gb = {k: decay * w[k] for k in keys}, 0.0
        for rows, s, c in ((p, sp, (-2 if corrected else 1) * prior / len(p)), (u, su, (1 if corrected else -1) / len(u))):
            for x, y in zip(rows, s, strict=True):
                d = c * y * (1 - y)
                gb += d
                for k in x:
                    g[k] += d
        for k in keys:
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
            w[k] -= rate * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        b -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    f, low, high = [sum(w[k] for k in x) for x in u], -60.0, 60.0
    for _ in range(80):
        b = (low + high) / 2
        low, high = (low, b) if sum(sigmoid(x + b) for x in f) / len(f) > prior else (b, high)
    return w, b


def test_nnpu_against_plain_loops():
    rng = np.random.default_rng(4)
    for prior in (0.1, 0.6):
        p, u = rng.random((9, 6)) < 0.6, rng.random((25, 6)) < 0.3
        w, b = toxicity.fit_nnpu(p.astype(np.float32), u.astype(np.float32), prior, steps=60)
        rows = lambda x: [set(np.flatnonzero(r).tolist()) for r in x]
        want, bias = plain_nnpu(rows(p), rows(u), prior, range(6), steps=60)
        assert w == pytest.approx([want[k] for k in range(6)], abs=2e-3) and b == pytest.approx(bias, abs=2e-3)


def test_op5_against_plain_loops(spark, folder, monkeypatch):
    at, docs, labels = folder
    train, fit = toxicity.train_toxicity, toxicity.fit_nnpu
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda p, u, prior: fit(p, u, prior, steps=40))
    monkeypatch.setattr(toxicity, "train_toxicity", lambda d, y: train(d, y, words=60))
    known = {i: y for i, _, y in labels if held(i) != 2}
    prior = sum(known.values()) / len(known)
    text = {i: t for i, t, _ in docs if i is not None and t is not None and held(i) != 2}
    keys = {i: toxic_keys(t) for i, t in text.items()}
    p, u = [keys[i] for i, y in known.items() if y], list(keys.values())
    cp, cu = Counter(k for x in p for k in x), Counter(k for x in u for k in x)
    z = {}
    for k in cp | cu:
        mean = (cp[k] + cu[k]) / (len(p) + len(u))
        if cp[k] + cu[k] >= 3:
            z[k] = abs(cp[k] / len(p) - cu[k] / len(u)) / math.sqrt(max(mean * (1 - mean), 1e-9) * (1 / len(p) + 1 / len(u)))
    used = sorted((k for k in z if z[k] > 0), key=lambda k: (-z[k], k))[:60]
    w, b = plain_nnpu([x & set(used) for x in p], [x & set(used) for x in u], prior, used, steps=40)
    got = queries.op5_toxicity(spark, at).join(spark.createDataFrame(docs, "doc_id long, text string, source string").distinct(), "doc_id").collect()
    for r in got:
        s = sigmoid(b + sum(w[k] for k in toxic_keys(r.text or "") if k in w))
        assert r.score == pytest.approx(s, abs=5e-3) and r.held_out == (held(r.doc_id) == 2) and r.predicted == int(r.score >= 0.3)
    assert len(got) == len(docs) - 1  # the row without an id joins with nothing


# --- personal data -----------------------------------------------------------------------------------------------------------


def exact_marginals(g, model):
    """Sums over all labellings of the free nodes."""
    L, n = len(pii.LABELS), len(g.doc)
    u = np.array([sum((model.unary[f] for f in fs), np.zeros(L)) for fs in g.feats])
    free = [k for k in range(n) if g.seen[k] < 0]
    out, total = np.zeros((n, L)), 0.0
    for code in range(L ** len(free)):
        y = g.seen.copy()
        for k in free:
            y[k], code = code % L, code // L
        score = sum(u[k, y[k]] for k in free) + sum((model.skip if kind else model.chain)[y[a], y[b]] for a, b, kind in g.links.tolist())
        weight = math.exp(score)
        total += weight
        out[np.arange(n), y] += weight
    return out / total


def test_marginals_are_exact_where_links_form_a_tree():
    rng = np.random.default_rng(3)
    L = len(pii.LABELS)
    for n, links in ((1, []), (4, [(0, 1, 0), (1, 2, 0), (2, 3, 0)]), (5, [(0, 1, 0), (1, 3, 1), (1, 4, 1), (2, 4, 0)]), (5, [(0, 4, 1), (1, 2, 0)])):
        model = pii.SkipChainModel(rng.normal(size=(7, L)), rng.normal(size=(L, L)), np.eye(L) * 2)
        seen = np.where(rng.random(n) < 0.3, rng.integers(0, L, n), -1)
        g = pii.Graph(np.zeros(n, np.int64), np.arange(n), np.arange(n) + 1, [rng.integers(0, 7, 3).tolist() for _ in range(n)], seen, np.array(links, np.int64).reshape(-1, 3), [[]])
        assert model.marginals(g, settled=1e-9) == pytest.approx(exact_marginals(g, model), abs=1e-5)


def test_marginals_are_near_on_a_loop():
    """One loop with weak links: the loopy sums stay close to the exact ones."""
    rng = np.random.default_rng(9)
    L = len(pii.LABELS)
    links = np.array([(0, 1, 0), (1, 2, 0), (0, 2, 1)])
    model = pii.SkipChainModel(rng.normal(size=(5, L)), rng.normal(size=(L, L)) * 0.3, np.eye(L) * 0.5)
    g = pii.Graph(np.zeros(3, np.int64), np.arange(3), np.arange(3) + 1, [[0], [1], [2, 3]], np.full(3, -1), links, [[]])
    assert np.abs(model.marginals(g) - exact_marginals(g, model)).max() < 0.02
