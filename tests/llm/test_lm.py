import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import attention, lmscore, queries
from tessera.llm.tokens import vocabulary


def model(vocab=60, seed=0, n=6000):
    rng = np.random.default_rng(seed)
    ids = np.repeat(rng.integers(1, vocab - 1, n // 3), 3)[:n]  # each id three times: worth attending to
    return attention.train_attention(ids, np.full(n // 50, 50), vocab, vocab - 1, steps=60, batch=32), ids


def test_every_subword_is_scored_once_with_its_window():
    m, ids = model()
    counts = np.array([0, 1, 31, 32, 33, 100, 5])
    flat = ids[: counts.sum()]
    got = m.score(flat, counts)
    at = 0
    for n, s in zip(counts, got, strict=True):
        seq = [m.end, *flat[at : at + n], m.end]
        at += n
        total = 0.0
        for k in range(1, len(seq)):  # window of position k - 1: the first one, or the one whose fresh part holds it
            p = k - 1
            w = 0 if p < attention.WINDOW else 1 + (p - attention.WINDOW) // attention.STRIDE
            start = w * attention.STRIDE
            ctx = np.array(seq[start : k], np.int64)
            rows = np.concatenate([m.row[ctx], np.zeros(attention.WINDOW - len(ctx), np.int64)])[None]
            h = attention.forward(m.p, rows)[0][0, len(ctx) - 1]
            logits = h @ m.p["U"] + m.p["B"][m.klass[seq[k - 1]]]
            total += logits[m.klass[seq[k]]] - np.log(np.exp(logits).sum()) + m.emit.log(np.array([seq[k - 1]]), np.array([seq[k]]))[0]
        assert s == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-4)


def test_probabilities_sum_to_one():
    m, _ = model()
    v = np.arange(60)
    for before in (0, 5, 59):
        p = np.exp(m.emit.log(np.full(60, before), v))
        for c in range(attention.CLASSES):
            assert (m.klass == c).sum() == 0 or p[m.klass == c].sum() == pytest.approx(1, abs=1e-3)


def test_gradients():
    rng = np.random.default_rng(1)
    m, _ = model()
    p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rows, g_out = rng.integers(0, 60, (2, attention.WINDOW)), rng.standard_normal((2, attention.WINDOW, attention.WIDTH))
    h, kept = attention.forward(p, rows)
    g = attention.backward(p, rows, h, kept, g_out)
    for name in ("Q", "K", "V", "O", "W1", "W2", "P"):
        i = tuple(rng.integers(0, s) for s in p[name].shape)
        old, eps = p[name][i], 1e-5
        p[name][i] = old + eps
        up = (attention.forward(p, rows)[0] * g_out).sum()
        p[name][i] = old - eps
        down = (attention.forward(p, rows)[0] * g_out).sum()
        p[name][i] = old
        assert g[name][i] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-5)


def test_op10_against_brute_force(spark, tmp_path):
    rnd = random.Random(2)
    words = ["alpha", "Beta", "gamma", "DELTA", "éps", "zeta1"]
    rows = [(k, " ".join(rnd.choices(words, k=rnd.randrange(0, 60)))) for k in range(150)] + [(151, None), (None, "Alpha  beta\nnew"), (3, "alpha " * 3000), (3, "alpha")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in queries.op10_lm(spark, str(tmp_path)).collect())
    fold = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t in rows if not held(i) for w in [*fold(t), None])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t in rows:
        w = [*fold(t), None]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(base, 6)] += 1
    assert got == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lmscore.score_documents(empty, lmscore.train_lm(empty, vocabulary()), vocabulary()).count() == 0


def test_op10_scores_with_the_counts_of_all_training_documents(spark, monkeypatch):
    from tessera.llm.textarrays import Texts
    from tessera.llm.tokens import word_tokenizer

    rnd = random.Random(4)
    words = ["alpha", "Beta", "gamma", "DELTA", "épsilon", "internationalisation"]
    rows = [(k, " ".join(rnd.choices(words, k=rnd.randrange(0, 40)))) for k in range(200)] + [(201, None), (3, "zebra " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lmscore, "DOCS", 16)  # texts of a pass meet again from many chunks
    m = lmscore.train_lm(docs, vocabulary(), limit=20)  # far fewer than the training documents
    got = sorted((r.doc_id, round(r.score, 3)) for r in lmscore.score_documents(docs, m, vocabulary()).collect())
    tokenizer = word_tokenizer(vocabulary())
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    streams = []
    for _, t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        streams.append([m.end, *tokenizer.encode(Texts(raw, np.array([0, len(raw)])))[0].tolist(), m.end])
    pairs = collections.Counter(p for (i, _), s in zip(rows, streams, strict=True) if not held(i) for p in zip(s, s[1:]))
    freq = np.full(len(m.klass), 0.05)
    sums, kinds = collections.Counter(), collections.Counter()
    for (a, b), n in pairs.items():
        freq[b] += n
        sums[a, m.klass[b]] += n
        kinds[a, m.klass[b]] += 1
    alone = freq / np.bincount(m.klass, weights=freq)[m.klass]
    want = []
    for (i, _), s in zip(rows, streams, strict=True):
        n = np.array([len(s) - 2])
        given, target = m.steps(np.array(s[1:-1], np.int64), n)
        room = lambda a, b: kinds[a, m.klass[b]] + 0.5
        logs = np.array([math.log((pairs[a, b] + room(a, b) * alone[b]) / (sums[a, m.klass[b]] + room(a, b))) for a, b in zip(s, s[1:])])
        want.append((i, float(m.summed(given, target, n, logs)[0])))
    want.sort()
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-4, abs=2e-3)


def test_large_ranges_are_counted_in_parts(spark, monkeypatch):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["the", "of", f"w{rnd.randrange(50)}", f"rare{k}"]) for _ in range(60)) for k in range(300)] + [None, "", "the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    monkeypatch.setattr(lmscore, "DOCS", 16)
    m = lmscore.train_lm(docs, vocabulary(), limit=40)
    whole = sorted(map(tuple, lmscore.score_documents(docs, m, vocabulary()).collect()))
    parts = sorted(map(tuple, lmscore.score_documents(docs, m, vocabulary(), group_bytes=2000).collect()))
    assert [r[:5] for r in whole] == [r[:5] for r in parts]
    assert np.allclose([r[5:] for r in whole], [r[5:] for r in parts])


def test_gradients_of_single_precision_are_the_plain_ones():
    rng = np.random.default_rng(3)
    m, _ = model()
    rows = rng.integers(0, 60, (5, attention.WINDOW))
    before, goal = rng.integers(0, attention.CLASSES, (2, rows.size))
    on = (rng.random(rows.size) < 0.7).astype(np.float32)
    got = attention.gradients(m.p, rows, before, goal, on)
    p = {k: v.astype(np.float64) for k, v in m.p.items()}
    h, kept = attention.forward(p, rows)
    e = np.exp(h.reshape(-1, attention.WIDTH) @ p["U"] + p["B"][before])
    e /= e.sum(1, keepdims=True)
    e[np.arange(len(e)), goal] -= 1
    e *= (on / on.sum())[:, None]
    want = attention.backward(p, rows, h, kept, (e @ p["U"].T).reshape(h.shape))
    want["U"] = h.reshape(-1, attention.WIDTH).T @ e
    want["B"] = np.zeros_like(p["B"])
    np.add.at(want["B"], before, e)
    assert set(got) == set(m.p)
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-3, atol=1e-5), k


def test_classes_and_weights_see_all_training_documents(spark):
    from tessera.llm import samples
    from tessera.llm.textarrays import Texts
    from tessera.llm.tokens import word_tokenizer

    rnd = random.Random(6)
    ids = spark.range(2600).withColumnRenamed("id", "doc_id")
    first = {r[0] for r in samples.training_ids(ids, 2000, 10, 0).collect()}  # what the fit was once bounded to
    words = ["alpha", "beta", "gamma", "delta"]
    text = lambda i: " ".join([*rnd.choices(words, k=rnd.randrange(0, 6)), *([] if i in first else ["zebra"])])
    rows = [(i, text(i)) for i in range(2600)]
    m = lmscore.train_lm(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), vocabulary())
    tokenizer = word_tokenizer(vocabulary())

    def encoded(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return tokenizer.encode(Texts(raw, np.array([0, len(raw)])))[0].astype(np.int64).tolist()

    train = [encoded(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10 != 0]
    assert len(train) > 2200
    pairs = [p for x in train for p in zip([m.end, *x], [*x, m.end])]
    assert all(m.klass[k] > 0 for k in encoded("zebra"))  # none of the first 2000 holds it
    assert m.trained == len(pairs)
    freq = np.bincount([b for _, b in pairs], minlength=len(m.klass))
    top = attention.seen_often(freq)
    x = np.zeros(len(top) * 2 * (attention.CONTEXT + 1))
    for _, cell in attention.neighbours(*np.array(pairs).T, top, len(m.klass)):
        np.add.at(x, cell, 1)
    assert (m.klass == attention.grouped(top, freq, x, len(m.klass), np.random.default_rng(5))).all()


def test_texts_held_out_have_no_part_in_the_fit(spark):
    def fitted(other):
        rows = [(k, other if zlib.crc32(str(k).encode()) % 10 == 0 else f"alpha beta w{k % 9} " * (k % 7)) for k in range(120)]
        return lmscore.train_lm(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), vocabulary())

    one, two = fitted("gamma"), fitted("gamma")
    assert one.trained == two.trained and all((one.p[k] == two.p[k]).all() for k in one.p)  # reruns agree
    two = fitted("gamme delta " * 9)
    assert one.trained == two.trained and (one.klass == two.klass).all()
