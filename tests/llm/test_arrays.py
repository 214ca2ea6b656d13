import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.shared import connected_components
from tessera.llm.textarrays import LOWER, SOLID, Texts, ngrams, passes, ragged

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t .日\x0b\x1c", max_size=30)), max_size=12)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    t = Texts.of(pa.array(texts, pa.string()))
    s, e, owner = t.words(SOLID)
    want = [(k, w) for k, x in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", x or "")]
    assert [(int(o), t.buf[a:b].tobytes().decode()) for a, b, o in zip(s, e, owner, strict=True)] == want
    h = t.hashes(s, e, LOWER)
    fold = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for _, w in want]
    assert len(set(h.tolist())) == len(set(fold))
    g, o = ngrams(h, owner, 2)
    assert o.tolist() == [want[i][0] for i in range(len(want) - 1) if want[i][0] == want[i + 1][0]] and len(g) == len(o)


def test_passes_keep_whole_texts():
    batch = pa.record_batch({"id": pa.array(range(5)), "text": pa.array(["a" * 10, None, "b" * 50, "", "c"])})
    got = list(passes(iter([batch.slice(1, 4), batch]), size=20))
    assert [b.column(0).to_pylist() for b, _ in got] == [[1], [2], [3, 4], [0, 1], [2], [3, 4]]
    assert all(len(t) == b.num_rows for b, t in got) and b"".join(t.buf.tobytes() for _, t in got[3:]) == b"a" * 10 + b"b" * 50 + b"c"


def test_ragged():
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 80, (60, 2))] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2040)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
