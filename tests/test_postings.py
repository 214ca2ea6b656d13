import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import queries
from tessera.operators import index, postings, retrieve

SF = "/root/testdata/sf0.01"


def zipf(spark, docs=400, seed=3):
    rnd = random.Random(seed)
    words = [f"w{k}q" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    rows = [(k, " ".join(rnd.choices(words, weights, k=rnd.choice([3, 20, 60])))) for k in range(docs)]
    return spark.createDataFrame(rows, "chunk_id long, text string"), [(k, " ".join(rnd.choices(words, weights, k=6) + rnd.choices(words, k=2))) for k in range(12)] + [(50, "unknown"), (51, "")]


@pytest.mark.parametrize("levels, block", [(16, 4096), (3, 5)])
def test_top_k_is_what_all_scores_give(spark, monkeypatch, levels, block):
    monkeypatch.setattr(postings, "LEVELS", levels)
    monkeypatch.setattr(postings, "BLOCK", block)
    texts, asked = zipf(spark)
    table = index.bm25_postings(texts, "chunk_id", "text").cache()
    q = spark.createDataFrame(asked, "query_id int, query string")
    terms = retrieve.bm25_queries(q).withColumn("w", F.when(F.col("query_id") % 2 == 0, 1.0).otherwise(0.25))
    blocks = postings.impact_blocks(table).cache()
    assert blocks.agg(F.sum("n")).first()[0] == table.count()
    every = retrieve.sparse_scores(terms, table).withColumn("score", F.round("score", 6))
    for k in (7,):
        want = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= k)
        got = postings.top_k(terms, blocks, table, k, digits=6)
        assert sorted(map(tuple, got.select("query_id", "rank", "chunk_id", "score").collect())) == sorted(map(tuple, want.select("query_id", "rank", "chunk_id", "score").collect()))
    assert postings.top_k(terms.limit(0), blocks, table, 3).count() == 0
    assert postings.top_k(terms, blocks.limit(0), table.limit(0), 3).count() == 0


def share_read(q, table, blocks, k, key):
    """Postings of the questions' terms, and those that a search reads: first levels, needed blocks, candidates."""
    matched = table.join(q.select("query_id", "term"), "term").count()
    terms, need = postings.plan_reads(q, blocks, table, k, key)
    first = blocks.where("level = 0").join(q.select("query_id", "term"), "term").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return (first + need.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) / matched


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_most_postings_are_not_read(spark):
    """Over the driver's documents: questions, whole and short, read below half of their terms' postings."""
    table = queries.document_postings(spark, SF)
    q = queries.questions(spark, SF)
    short = q.withColumn("query", F.array_join(F.slice(F.split("query", " "), 1, 6), " "))
    blocks = postings.impact_blocks(table, "doc_id").cache()
    shares = {name: share_read(retrieve.bm25_queries(x), table, blocks, 5, "doc_id") for name, x in (("whole", q), ("short", short))}
    assert max(shares.values()) < 0.5, shares
