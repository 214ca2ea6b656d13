import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import jaccard
from tessera.llm.textarrays import Texts


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) if i is not None else frozenset() for i, t in rows]
    links = [[j for j, b in enumerate(sets) if j != k and a and b and len(a & b) / len(a | b) >= 0.8] for k, a in enumerate(sets)]
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((i, len(links[k]), c, i == c))
    return sorted(out, key=str)


def corpus(seed=2):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=4))
    base = [[word() for _ in range(rnd.choice([3, 7, 40, 120]))] for _ in range(25)]
    passage = [word() for _ in range(60)]
    rows = []
    for b in base:
        for _ in range(rnd.choice([1, 3, 8])):
            w = list(b)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                w[rnd.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [" ".join(base[3]).upper(), "", None, "  \n", "one two", "One  two"]
    rows += [" ".join([word() for _ in range(8)] + passage) for _ in range(40)]
    out = list(enumerate(rows))
    rnd.shuffle(out)
    return out + [out[0], (None, "one two")]


@pytest.mark.parametrize("block, exact, size, broadcast", [(1024, 2048, 8 << 20, 4 << 20), (8, 4, 8 << 20, 0), (2, 2048, 2000, 4 << 20)])
def test_against_brute_force(spark, monkeypatch, block, exact, size, broadcast):
    for name, v in (("BLOCK", block), ("EXACT_BLOCK", exact), ("EXACT_BYTES", size), ("BROADCAST_BYTES", broadcast)):
        monkeypatch.setattr(jaccard, name, v)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    got = jaccard.near_documents(df).select("doc_id", "n_links", "class_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty(spark):
    assert jaccard.near_documents(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_runs_reach_the_recall():
    rng = np.random.default_rng(0)
    n, met, runs = 200, 0, jaccard.runs_for(0.9)
    for _ in range(120):
        shared = rng.integers(0, 1 << 50, 178).astype(np.uint64)  # Jaccard 178 / 222 = 0.80
        a, b = (np.sort(np.concatenate([shared, rng.integers(0, 1 << 50, 22).astype(np.uint64)])) for _ in range(2))
        tokens, bounds = np.concatenate([a, b]), np.array([0, n, 2 * n])
        who, node = jaccard.paths(tokens, bounds, 0.8, runs)
        met += bool(set(node[who == 0].tolist()) & set(node[who == 1].tolist()))
    assert met / 120 >= 0.85


def test_very_long_text_and_sketch():
    t = " ".join(str(k) for k in range(60_000))
    tokens, bounds = jaccard.shingle_sets(Texts.of(pa.array([t, t + " end"])))
    assert bounds.tolist() == [0, 59_996, 119_993]
    s = jaccard.sketches(tokens, bounds)
    assert (s[0] == s[1]).mean() > 0.95


@pytest.mark.parametrize("own", [22, 60])
def test_shared_templates_are_not_compared_in_pairs(spark, monkeypatch, own):
    """Texts that share a template below the threshold: what is sent to the exact comparison does not grow with them."""
    rnd = random.Random(own)
    monkeypatch.setattr(jaccard, "EXACT_BLOCK", 32)
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    seen, verify = spark.sparkContext.accumulator(0), jaccard.verify

    def counted(threshold):
        run = verify(threshold)

        def watched(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return lambda batches: run(watched(batches))

    monkeypatch.setattr(jaccard, "verify", counted)
    template = " ".join(f"t{k}" for k in range(100))
    rows = [(k, template + " " + " ".join(f"x{rnd.randrange(10**9)}" for _ in range(own))) for k in range(420)]
    rows += [(2000 + k, rows[k][1] + " end") for k in range(0, 60, 3)] + [(3000 + k, template.replace("t", "u") + f" same same same {k} {k}") for k in range(40)]
    got = jaccard.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_links", "class_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert seen.value < 300  # the copies and, as pairs of blocks, the 40 rows that share nearly all
