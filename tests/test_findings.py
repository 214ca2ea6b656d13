"""Queries against their SQL on small tables that hold what the driver's smallest ones do not."""

import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import queries, queries_flow  # noqa: F401
from tessera.functions import fixed, text, vectors
from tessera.operators import retrieve, scan
from tessera.sources import pages as page_sources

duckdb = pytest.importorskip("duckdb")


def against_sql(spark, folder, name, **tables):
    """Rows of a query over ``tables``, compared with its SQL over the same rows."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(folder))
    cols = ", ".join(got.columns)
    rows = sorted(map(repr, map(tuple, got.collect())))
    assert rows == sorted(map(repr, con.execute(f"SELECT {cols} FROM ({queries.SQL[name]})").fetchall()))
    return rows


def test_page_headings_keep_references_that_sql_keeps(spark, tmp_path):
    heads = ['token = &quot;0b9', "cut short&amp", "A &amp; B &lt;c&gt;", "&amp;lt;", "&#65; &nbsp; &eacute;", "plain & bare"]
    pages = spark.createDataFrame([(k, "https://x.org", f"<html><body><h1>{h}</h1><p>text</p></body></html>") for k, h in enumerate(heads)], "page_id long, url string, html string")
    against_sql(spark, tmp_path, "page_headings", pages=pages)


def test_pages_are_parsed_once(spark, monkeypatch):
    """A page is parsed once for all of its fields, not once for each."""
    seen = []
    monkeypatch.setattr(page_sources, "parse_labelled_page", lambda m, t: seen.append(m) or {"title": m, "fees": t})
    out = page_sources.parser_udf("labelled").func(pd.Series(["a", None, "b"]), pd.Series(["x", "y", None]))
    assert seen == ["a", "b"]
    assert out["title"].tolist() == ["a", None, "b"] and out["fees"].tolist() == ["x", None, None]


def test_sections_of_a_page_cost_no_more_than_their_number():
    """With eight times the headings a page takes about eight times as long; it took the square before."""

    def took(n):
        page = "<html><body><h1>T</h1>" + "".join(f"<h3>Steps {k}</h3><p>Do {k}.</p>" for k in range(n))
        began = time.process_time()
        assert page_sources.parse_labelled_page(page)["steps"].endswith(f"Do {n - 1}.")
        return time.process_time() - began

    took(100)
    assert min(took(3200) for _ in range(2)) < 24 * min(took(400) for _ in range(3))


def test_counted_texts_are_what_native_functions_cut(spark):
    """N-grams and trigrams cut in Arrow batches have the counts of the native ones, in each row."""
    texts = [["renew the licence ñandú", "a b"], [""], [], ["x"], ["visa visa visas", ""], ["𝔘nder 東京 x"]]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t array<string>")
    got = {r.k: r for r in scan.counted(rows, texts="t").collect()}
    native = rows.select("k", F.flatten(F.transform("t", lambda t: text.char_ngrams(t))).alias("c"), F.flatten(F.transform("t", vectors.trigram_buckets)).alias("d")).collect()
    hashes = {}
    for r in native:
        own, buckets = Counter(r.c), Counter(r.d)
        assert sorted(own.values()) == sorted(got[r.k].char_n) and got[r.k].char_t == sorted(got[r.k].char_t)
        assert dict(sorted(buckets.items())) == dict(zip(got[r.k].dense_t, got[r.k].dense_n, strict=True))
        hashes[r.k] = set(got[r.k].char_t)
    for a in native:
        for b in native:
            assert len(set(a.c) & set(b.c)) == len(hashes[a.k] & hashes[b.k])
    assert {r.term: r.df for r in scan.gram_rows(rows, "t").collect()} == Counter(h for own in hashes.values() for h in own)


def test_evidence_is_sought_among_the_rows_of_the_hits(spark, monkeypatch):
    """Rows of services that are no hits are left before their vectors are made; sums over a row are made once."""
    words = ["renew", "licence", "payment", "visa", "transfer", "corner", "deposit", "permit"]
    rows = [(s * 10 + c, s, "en", "title" if c == 0 else "overview", "t", " ".join(words[(s * 3 + c * k) % 8] for k in range(5))) for s in range(30) for c in range(3)]
    chunks = spark.createDataFrame(rows, "chunk_id long, service_id long, lang string, section string, title string, text string")
    q = spark.createDataFrame([(1, "renew licence"), (2, "visa")], "query_id int, query string")
    seen, found, best = [], [], scan.best_chunks
    monkeypatch.setattr(scan, "best_chunks", lambda rows, *more: seen.append({r[0] for r in rows.select("service_id").collect()}) or best(rows, *more))
    for limit in (retrieve.LEXICON_ROWS, 0):  # the n-grams travel with the plan, or are joined
        monkeypatch.setattr(retrieve, "LEXICON_ROWS", limit)
        have = retrieve.text_rows(chunks) | {"query_trigrams": vectors.trigram_encoder(q, "query_id", "query")}
        hits = retrieve.search(q, have, fixed.CONFIGS["v3"] | {"expand": False}, k=2, digits=(6, 8, 8)).orderBy("query_id", "rank").collect()
        assert seen.pop() == {r.service_id for r in hits} and len(hits) == 4
        found.append([(r.query_id, r.service_id, r.score, [e.chunk_id for e in r.evidence]) for r in hits])
    assert found[0] == found[1]
