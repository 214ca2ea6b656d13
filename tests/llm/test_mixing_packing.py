import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, queries
from tessera.llm.textarrays import Texts
from tessera.llm.tokens import WordTokenizer, vocabulary


def test_targets():
    t = mixing.targets({"b": 10, "a": 100, None: 50}, [3, 1, 2], 1.5, 2.0)
    assert t["b"] == 20.0 and t["a"] + t[None] == pytest.approx(220) and t[None] == pytest.approx(88) and t["a"] == pytest.approx(132)
    assert mixing.targets({}, [1], 1.5, 2.0) == {} and mixing.targets({"a": 0}, [1], 1.5, 2.0) == {"a": 0.0}


def test_mix(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(k, " ".join(["wOrd"] * rnd.choice([0, 1, 5, 30, 100])), rnd.choice(["s1", "s1", "s1", "s2", "s3", None])) for k in range(600)] + [(None, "a b", "s1"), (7, None, "s2"), (7, "x y z", "s2"), (7, "x y z", "s2")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_mixing(spark, str(tmp_path)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + size(t)
    want = mixing.targets(totals, [3.0, 1.0, 2.0], 1.5, 2.0)
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, size(t)) for i, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert {k: pytest.approx(v) for k, v in want.items()} == {s: next(t for (n, t) in by if n == totals[s] and t == pytest.approx(want[s])) for s in totals}
    assert all(abs(sum(v) - t) <= 100 for (_, t), v in by.items())
    again = queries.op2_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_prefers_quality(spark):
    rows = [(k, ("good text here " if k % 2 else "99 88 77 ") * 5, "a") for k in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), [1.0], share=0.3).collect()
    taken = [r.doc_id % 2 for r in got if r.copies]
    assert sum(taken) > 3 * (len(taken) - sum(taken))
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"), [1.0]).count() == 0


def test_mix_takes_what_a_plain_sort_takes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 4)  # so that an edge bucket holds a quarter of its source and more
    monkeypatch.setattr(mixing, "PARTS", 8)
    rows = [(k, "字 " * (k % 7 + 1) if k % 2 else "日本語 ABC " * (k % 5 + 1), f"s{k % 2}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.copies for r in mixing.mix(df, [3.0, 1.0], share=0.8, cap=1.5).collect()}
    keyed = df.select("doc_id", "source", mixing.words_in(F.col("text")).alias("n"), mixing.exponential_key(F.col("doc_id"), mixing.quality_weight(F.col("text")), "mix").alias("key")).collect()
    sizes = {s: sum(r.n for r in keyed if r.source == s) for s in ("s0", "s1")}
    for s, target in mixing.targets(sizes, [3.0, 1.0], 0.8, 1.5).items():
        epochs, at = int(target // sizes[s]), 0
        for r in sorted((r for r in keyed if r.source == s), key=lambda r: (r.key, r.doc_id)):
            at += r.n
            assert got[r.doc_id] == epochs + (at - r.n / 2 <= target - epochs * sizes[s])


def check(hist, size, runs):
    used, seqs = {}, 0
    for r in runs:
        assert r.first == seqs and sum(n * c for n, c in r.parts) <= size
        seqs += r.times
        for n, c in r.parts:
            used[n] = used.get(n, 0) + c * r.times
    assert used == {n: c for n, c in hist.items() if c}
    return seqs


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 400), max_size=20))
def test_plan(hist):
    got = packing.plan(hist, 64, rounds=32)
    left = {n: c for n, c in hist.items() if c and n < 64}
    plain = sum(packing.best_fit(left, 64).values()) + hist.get(64, 0)
    assert check(hist, 64, got.runs) == got.sequences <= plain and got.bound <= got.sequences + 1e-9
    # Piece by piece, longest first, to the fullest sequence that fits: as many sequences.
    spaces = []
    for n in sorted((n for n, c in left.items() for _ in range(c)), reverse=True):
        fits = [s for s in spaces if s >= n]
        if fits:
            spaces.remove(min(fits))
        spaces.append((min(fits) if fits else 64) - n)
    assert len(spaces) == plain - hist.get(64, 0)


def test_program_beats_best_fit_and_meets_the_bound():
    hist = {700: 5000, 650: 5000, 690: 3000, 1000: 4000, 1030: 2000, 24: 10}
    got = packing.plan(hist)
    assert check(hist, 2048, got.runs) == got.sequences and got.method == "program"
    assert got.sequences < sum(packing.best_fit(hist, 2048).values())
    rng = np.random.default_rng(0)
    lengths, counts = np.unique(np.clip(rng.lognormal(5.8, 0.9, 40_000).astype(int), 3, 2048), return_counts=True)
    hist = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    got = packing.plan(hist)
    assert check(hist, 2048, got.runs) <= 1.001 * got.bound


def test_price_is_the_best_knapsack():
    lengths, values, most = np.array([7, 5, 3]), np.array([7.0, 5.2, 2.9]), np.array([2, 1, 9])
    best = max(a * 7.0 + b * 5.2 + c * 2.9 for a in range(3) for b in range(2) for c in range(7) if 7 * a + 5 * b + 3 * c <= 18)
    assert packing.price(lengths, values, most, 18) @ values == pytest.approx(best)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aBé' ß1İΣ\n\x01\xa0<|endoft>x!日é", max_size=40), min_size=1, max_size=6))
def test_tokens(tokenizer, texts):
    texts = [*texts, "a <|endoftext|> b<|startoftext|>c", "\x01 x\x01y"]
    ids, n = WordTokenizer(vocabulary()).encode(Texts.of(pa.array(texts)))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_op9(spark, tmp_path, tokenizer):
    texts = ["Hello, wonderful world", None, "", "word " * 5000, "dup", "dup", "ümlaut 123"]
    spark.createDataFrame([(k if k != 5 else 4, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, length int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_packing(spark, str(tmp_path)).collect()
    want = []
    for k, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(k if k != 5 else 4, p, p * 2048, len(ids[p * 2048 : (p + 1) * 2048]), zlib.crc32(ids[p * 2048 : (p + 1) * 2048].tobytes())) for p in range(-(-len(ids) // 2048))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(packing.pieces(spark.createDataFrame([], "doc_id long, text string"), vocabulary())).count() == 0
    whole = packing.pieces(spark.createDataFrame([(1, "Hello world")], "doc_id long, text string"), vocabulary(), ids=True).first()
    assert whole.ids == [*tokenizer.encode("Hello world", add_special_tokens=False).ids, 0]


def optimum(hist, size):
    """Fewest sequences, by exhaustive search over what is left."""
    from functools import cache

    lengths = sorted(hist, reverse=True)

    @cache
    def fewest(left):
        if not any(left):
            return 0
        first = next(i for i, c in enumerate(left) if c)
        best = 10**9

        def fill(i, room, now):
            nonlocal best
            if i == len(lengths):
                best = min(best, 1 + fewest(tuple(now)))
                return
            for c in range(min(now[i], room // lengths[i]), -1 if i != first else 0, -1):
                now[i] -= c
                fill(i + 1, room - c * lengths[i], now)
                now[i] += c

        fill(first, size, list(left))
        return best

    return fewest(tuple(hist[n] for n in lengths))


def test_small_histograms_take_the_optimum():
    rnd = random.Random(11)
    for _ in range(120):
        size = rnd.choice([20, 100, 2048])
        hist = {rnd.randrange(max(1, size // 6), size): rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 6))}
        got = packing.plan(hist, size)
        check(hist, size, got.runs)
        assert got.sequences == optimum(hist, size) and got.bound <= got.sequences + 1e-6


@pytest.mark.parametrize("hist, most", [({683: 1000, 684: 500, 682: 800, 341: 333}, 852), ({n: 40 for n in range(600, 1200, 7)}, None), ({n: 3 for n in range(1, 2048)}, None), ({700: 10**6, 650: 10**6, 698: 3}, None)])
def test_sequences_are_near_the_bound(hist, most):
    got = packing.plan(hist, 2048)
    check(hist, 2048, got.runs)
    assert got.sequences <= (most or max(np.ceil(got.bound) + 1, 1.001 * got.bound))
