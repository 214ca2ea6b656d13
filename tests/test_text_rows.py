import pytest

from tests.test_findings import against_sql
from tessera.operators import index, retrieve, scan

WORDS = ["renew", "licence", "payment", "visa", "transfer", "corner", "deposit", "permit"]


def test_search_against_sql_where_chunk_ids_meet(spark, tmp_path, monkeypatch):
    """Turn 100 of a conversation has the number of the next conversation's first turn: both share their terms. No postings are made."""

    def never(*args, **more):
        raise AssertionError("postings of all chunks")

    for module, f in ((index, "tfidf_postings"), (index, "bm25_postings"), (retrieve, "index_rows"), (retrieve, "sparse_scores")):
        monkeypatch.setattr(module, f, never)
    text = lambda c, t: " ".join(WORDS[(c * 3 + t * k) % 8] for k in range(2 + (c + t) % 5)) + f" x{c}"
    rows = [(c, t, "user", text(c, t)) for c in range(12) for t in range(4)] + [(3, 100, "user", "visa renew renew deposit"), (5, 101, "user", "permit")]
    tables = {"conversations": spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "benchmark": spark.createDataFrame([(k, text(k, k + 1)) for k in range(6)], "item_id long, text string")}
    for name in ("search_without_titles", "hybrid_blend"):
        assert against_sql(spark, tmp_path / name, name, **tables)


def test_counted_terms_and_whole_matrices(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [5, 3, 5]), (2, []), (3, None), (4, [7])], "k int, x array<long>")
    assert [tuple(r) for r in scan.counted(rows, "x").orderBy("k").collect()] == [(1, [3, 5], [1, 2]), (2, [], []), (3, [], []), (4, [7], [1])]
    import numpy as np

    rng = np.random.default_rng(3)
    row, term = np.nonzero(rng.random((40, 9)) < 0.7)
    w, weights, terms = rng.random(len(row)), rng.random((9, 4)), np.arange(9)
    monkeypatch.setattr(scan, "STEP", 50)
    whole = scan._product(row, term, w, 40, terms, weights)
    monkeypatch.setattr(scan, "DENSE", 0)
    assert whole == pytest.approx(scan._product(row, term, w, 40, terms, weights))
