import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lexical
from tessera.llm.textarrays import U64

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """The k best documents of each item by the formula, over all documents."""
    own = [(i, Counter(t), len(t)) for i, x in docs if (t := terms(x))]
    n, length = len(own), sum(c for *_, c in own)
    df = Counter(t for _, tf, _ in own for t in tf)
    out = []
    for item, text in items:
        scored = []
        for i, tf, size in own:
            m = 50 + 50 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(terms(text)) if t in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, *_, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus(seed=3, docs=300):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Überß", "naïve", "X", "x", "x9"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(k * 7 - 50, " ".join(rnd.choices(words, weights, k=rnd.choice([1, 3, 12, 80]))) + rnd.choice(["", "!", "_w1-w2"])) for k in range(docs)]
    rows += [(rows[0][0], rows[0][1]), (None, "w1 w2 w3"), (None, None), (5000, ""), (5001, None), (5002, "... --"), (5003, "w3 " * 30_000), (6000, "w5 w6"), (6001, "w5 w6"), (5999, "W5, W6")]
    rnd.shuffle(rows)
    items = [(k, " ".join(rnd.choices(words, weights, k=6))) for k in range(25)] + [(98, ""), (99, None), (3, "nothing known here"), (None, "w5 w6"), (7, "w1 w1 W1"), (7, "w1")]
    return rows, items


@pytest.mark.parametrize("size, most, block, width, k", [(8 << 20, 8192, 1024, 96, 50), (500, 7, 4, 1, 3), (1, 1, 1024, 2, 10)])
def test_against_brute_force(spark, monkeypatch, size, most, block, width, k):
    for name, v in (("SHARD_BYTES", size), ("SHARD_DOCS", most), ("BLOCK_ITEMS", block), ("WIDTH", width)):
        monkeypatch.setattr(lexical, name, v)
    docs, items = corpus(docs=300 if most > 1 else 40)
    index = lexical.build_index(spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, score int, item_id string"))
    got = lexical.search(index, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int"), k).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items, k)


def test_empty_tables_and_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(lexical.build_index(none), items).count() == 0
    some = lexical.build_index(spark.createDataFrame([(1, "a b")], "doc_id int, text string"))
    assert lexical.search(some, items.limit(0)).count() == 0
    assert lexical.search(lexical.build_index(spark.createDataFrame([(1, "..")], "doc_id long, text string")), items).count() == 0
    with pytest.raises(TypeError):
        lexical.build_index(spark.createDataFrame([("1", "a")], "doc_id string, text string"))


def one_shard(rng, docs=500, lists=40):
    """Lists of random documents with random impacts, as one shard's columns."""
    parts = [(d := np.sort(rng.choice(docs, rng.integers(1, docs), replace=False)), np.full(len(d), t, U64), rng.integers(1, 1_000_000, len(d))) for t in range(1, lists + 1)]
    row = lexical.shard(pa.array(np.arange(docs) * 3), parts, docs, 1)
    return parts, row


def test_ranges_hold_each_half_by_falling_impact():
    rng = np.random.default_rng(5)
    parts, row = one_shard(rng)
    tree, starts = lexical.Shard(row["impacts"], row["bits"]), np.frombuffer(row["starts"], np.int32)
    for t in range(0, len(parts), 7):
        at = [(int(starts[t]), int(starts[t + 1]), 0)]
        for k in range(tree.levels):
            for lo, hi, _ in at:
                assert (np.diff(tree.impact[k, lo:hi]) <= 0).all()
            at = [(z, y, 2 * b + s) for lo, hi, b in at for s, z, y in ((0, lo - tree.ones[k, lo], hi - tree.ones[k, hi]), (1, tree.zeros[k] + tree.ones[k, lo], tree.zeros[k] + tree.ones[k, hi])) if z < y]
        want = dict(zip(parts[t][0].tolist(), parts[t][2].tolist(), strict=True))
        assert {b: int(tree.impact[-1, lo]) for lo, _, b in at} == want


def test_bounds_leave_nodes_closed():
    """A question of few matching documents opens a small part of the tree, and the k best stay exact."""
    rng = np.random.default_rng(6)
    docs, common = 8192, np.arange(8192)
    rare = np.sort(rng.choice(docs, 30, replace=False))
    parts = [(common, np.full(docs, 1, U64), rng.integers(1, 100, docs)), (rare, np.full(30, 2, U64), rng.integers(900_000, 1_000_000, 30))]
    row = lexical.shard(pa.array(common), parts, docs, 1)
    starts, best = np.frombuffer(row["starts"], np.int32).astype(np.int64), lexical.Best(1, 10)
    opened = lexical.search_shard(lexical.Shard(row["impacts"], row["bits"]), pa.array(common), np.zeros(2, np.int64), np.array([1, 1]), starts[:2], starts[1:3], best)
    total = parts[0][2].copy()
    total[rare] += parts[1][2]
    want = sorted(((-int(s), k) for k, s in enumerate(total)))[:10]
    assert list(zip((-best.score).tolist(), best.doc.tolist(), strict=True)) == want
    assert opened < docs / 8
