import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import queries, queries_flow  # noqa: F401
from tessera.operators import index, postings, retrieve, textscan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, f"g{k % 3}" if k % 11 else None, " ".join(rnd.choices(words, k=rnd.choice([1, 6, 30])))) for k in range(300)]
    rows += [(1000 + k, "g1", "w1 w2 w2 w3") for k in range(6)] + [(2000, "g2", None), (2001, "g2", ""), (2002, "alone", "w5")]  # ties by key, no terms
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5).cache()
    questions = spark.createDataFrame([(k, " ".join(rnd.choices(words, k=4))) for k in range(9)] + [(50, "w2 w2 w3"), (51, "zzz"), (52, "")], "query_id int, query string")
    return docs, questions


def by_joins(docs, questions):
    scored = retrieve.bm25_scores(questions, index.bm25_postings(docs, "doc_id", "text"), key="doc_id")
    return scored.withColumn("score", F.round("score", 6)).join(docs.select("doc_id", "source"), "doc_id")


@pytest.mark.parametrize("rows, held, together", [(4096, 200_000, 64), (16, 8, 5)])
def test_best_and_sums_are_what_joins_give(spark, texts, monkeypatch, rows, held, together):
    monkeypatch.setattr(textscan, "ROWS", rows)
    monkeypatch.setattr(textscan, "HELD", held)
    monkeypatch.setattr(textscan, "TOGETHER", together)
    docs, questions = texts
    have, pairs = textscan.token_rows(docs, "doc_id", "source"), by_joins(docs, questions).cache()
    order = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "doc_id")
    for k in (1, 3):
        want = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        cols = ["query_id", "source", "doc_id", "score", "rank"]
        got = textscan.best_in_groups(have, questions, k, "doc_id", "source", digits=6)
        assert set(map(tuple, got.select(*cols).collect())) == set(map(tuple, want.select(*cols).collect()))
    sums = {(r.query_id, r.source): r.total for r in textscan.sums_in_groups(have, questions, "source", digits=6).collect()}
    assert sums == {(r.query_id, r.source): pytest.approx(r.t) for r in pairs.groupBy("query_id", "source").agg(F.sum("score").alias("t")).collect()}


def test_empty_sides(spark, texts):
    docs, questions = texts
    have = textscan.token_rows(docs, "doc_id", "source")
    assert textscan.best_in_groups(have, questions.limit(0), 2, "doc_id", "source").count() == 0
    assert textscan.best_in_groups(have.limit(0), questions, 2, "doc_id", "source").count() == 0
    assert textscan.sums_in_groups(have.limit(0), questions, "source").count() == 0


NAMED = ["bm25_topk", "max_pool_source", "evidence_top3", "action_rerank", "related_links", "compose_v1", "multi_query_merge", "retrieval_metrics", "grouped_breakdown", "refusal_metrics", "threshold_fit_two", "split_counts", "fitting_splits", "config_sink", "answers_batch", "variant_merge", "changed_answers"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", NAMED)
def test_no_query_makes_postings_or_pairs_of_all_documents(spark, monkeypatch, name):
    """Postings of all terms and scores of all pairs of questions and documents grow far beyond the input."""

    def never(*args, **more):
        raise AssertionError("postings or pairs of all documents")

    for module, f in ((index, "bm25_postings"), (retrieve, "bm25_scores"), (postings, "top_k")):
        monkeypatch.setattr(module, f, never)
    assert queries.QUERIES[name](spark, SF) is not None
