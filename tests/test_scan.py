import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.vectors import trigram_encoder
from tessera.operators import index, retrieve, scan


def test_nearest_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(900, base[5].tolist()), (-3, base[5].tolist()), (901, None), (902, [1.0] * 7), (903, [0.0] * 8), (904, [1.0] * 7 + [None])]
    queries = [(k, base[k].tolist()) for k in (0, 5, 7)] + [(50, [1.0] * 7), (51, None)]
    v = spark.createDataFrame(rows, "chunk_id long, vec array<double>").repartition(5)
    q = spark.createDataFrame(queries, "query_id int, qvec array<double>")
    for cosine in (True, False):
        monkeypatch.setattr(scan, "STEP", 64 if cosine else 1 << 21)
        got = {}
        for r in scan.nearest(q, v, 4, cosine=cosine, digits=6).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, r.score)
        for i, qv in queries[:3]:
            scored = []
            for k, x in rows:
                if x is not None and len(x) == 8 and None not in x and (any(x) or not cosine):
                    s = np.dot(qv, x) / (np.linalg.norm(qv) * np.linalg.norm(x)) if cosine else np.dot(qv, x)
                    scored.append((-round(float(s), 6), k))
            assert got[i] == {n + 1: (k, pytest.approx(-s, abs=2e-6)) for n, (s, k) in enumerate(sorted(scored)[:4])}
        assert set(got[50]) == {1} and got[50][1][0] == 902 and 51 not in got
    assert scan.nearest(q.limit(0), v, 4).count() == 0 and scan.nearest(q, v.limit(0), 4).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    words = [f"{a}{b}" for a in ("ren", "lic", "pay", "vis", "tra", "cor") for b in ("ew", "ense", "ment", "a", "de", "p")]
    chunks = []
    for s in range(60):
        title = " ".join(rnd.choices(words, k=3))
        for c in range(rnd.choice([1, 2, 5])):
            text = title if c == 0 else " ".join(rnd.choices(words, k=rnd.choice([4, 15])))
            chunks.append((f"s{s}-{c}", f"s{s}", "ar" if s % 3 == 0 and c % 2 else "en", "title" if c == 0 else "overview", title, text))
    df = spark.createDataFrame(chunks, "chunk_id string, service_id string, lang string, section string, title string, text string").repartition(6).cache()
    postings, idf = index.tfidf_model(df, "chunk_id", "text")
    questions = spark.createDataFrame([(k, " ".join(rnd.choices(words, k=4))) for k in range(8)] + [(90, "zzz"), (91, "")], "query_id int, query string")
    have = {"chunks": df, "tfidf": postings, "idf": idf, "bm25": index.bm25_postings(df, "chunk_id", "text"), "trigrams": trigram_encoder(df, "chunk_id", "text"), "query_trigrams": trigram_encoder(questions, "query_id", "query")}
    return questions, have


def by_joins(questions, have, w, k, where="true"):
    """The same search with all pairs: signals joined, pooled, ranked."""
    dense = retrieve.sparse_scores(have["query_trigrams"], have["trigrams"], on="bucket")
    scored = retrieve.signals(dense, retrieve.char_scores(questions, have["tfidf"], have["idf"]), retrieve.bm25_scores(questions, have["bm25"]))
    scored = scored.join(have["chunks"].where(where), "chunk_id").withColumn("combined", F.round(w["dense"] * F.round("dense", 6) + w["char"] * F.round("char", 6) + w["bm25"] * F.round("bm25", 6), 8))
    cover = retrieve.title_coverage(questions, have["chunks"].where("section = 'title'").select("service_id", "title"))
    hits = retrieve.rank_hits(retrieve.pool(scored), cover, w["w_tcov"], k)
    return hits, retrieve.evidence(scored, hits, 2)


@pytest.mark.parametrize("together, step", [(64, 1 << 21), (3, 40)])
def test_search_is_what_joins_give(spark, corpus, monkeypatch, together, step):
    monkeypatch.setattr(scan, "TOGETHER", together)
    monkeypatch.setattr(scan, "STEP", step)
    questions, have = corpus
    w = {"dense": 0.45, "char": 0.15, "bm25": 0.15, "w_tcov": 0.1}
    config = {"method": "v2", "w_dense": 0.45, "w_char": 0.15, "w_bm25": 0.15, "w_tcov": 0.1, "expand": False}
    cases = [("true", {}), ("lang = 'ar'", {"langs": ["ar"]}), ("section <> 'title'", {"titles": False})]
    have = have | {"rows": retrieve.index_rows(have).cache()}
    for where, more in cases if together == 64 else cases[:1]:
        hits, evidence = by_joins(questions, have, w, 5, where)
        got = retrieve.search(questions, have, config, k=5, n=2, digits=(6, 8, None), **more).collect()
        assert {(r.query_id, r["rank"], r.service_id): round(r.score, 7) for r in got} == {(r.query_id, r["rank"], r.service_id): round(r.score, 7) for r in hits.collect()}
        want = {(r.query_id, r.service_id): [e.chunk_id for e in r.evidence] for r in evidence.collect()}
        assert {(r.query_id, r.service_id): [e.chunk_id for e in r.evidence] for r in got} == want
        assert not {r.query_id for r in got} & {91}


def test_rows_that_leave_a_task_do_not_grow_with_the_chunks(spark, corpus):
    questions, have = corpus
    rows = retrieve.index_rows(have)
    for times in (1, 20):
        many = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("service_id", F.concat_ws("/", "service_id", "n")).coalesce(1)
        asked = scan._questions(questions, retrieve.query_signals(questions, have, ["char"]), 6.0, (None, None, None))
        assert scan.best_services(many, asked, [{"char": 1.0}], 3).count() <= 3 * questions.count()


def test_empty_sides(spark, corpus):
    questions, have = corpus
    assert retrieve.search(questions.limit(0), have, {"method": "lexical"}).count() == 0
    assert retrieve.search(questions, have | {"rows": retrieve.index_rows(have).limit(0)}, {"method": "lexical"}).count() == 0
