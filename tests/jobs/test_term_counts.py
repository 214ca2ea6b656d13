import random
from collections import Counter

from jobs import index_documents
from pyspark.sql import functions as F
from tessera.functions.text import has_terms, tokenize
from tessera.operators import index

PARTS = ["the ", "of ", "lamps ", "running ", "boxes", "نا", "الخدمات ", "في ", "والسجلات ", "هم ", "ـ", "٠١", "aB", "é", "​", " ", "-", "\n", "أحمد ", "K", "İ"]


def test_postings_of_a_row_are_its_tokens(spark, monkeypatch):
    """Terms counted in batches are what the native tokens are; whether a text has any is told without all of them."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.choice([1, 4, 60, 200]))) for _ in range(300)] + [None, "", "the of", "the " * 80, "the " * 80 + "lamp", "x" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    want = {r.k: Counter(r.t or []) for r in rows.select("k", tokenize(F.col("text")).alias("t")).collect()}
    for together, remembered in ((100_000, 500_000), (7, 3)):
        monkeypatch.setattr(index, "TOGETHER", together)
        monkeypatch.setattr(index, "REMEMBERED", remembered)
        got = {}
        for r in index.row_postings(rows, "k").collect():
            assert r.term not in got.setdefault(r.k, {})
            got[r.k][r.term] = r.tf
        assert got == {k: dict(c) for k, c in want.items() if c}
    assert {r.k: r.h for r in rows.select("k", has_terms(F.col("text")).alias("h")).collect()} == {k: bool(c) for k, c in want.items()}


def test_postings_are_not_shuffled(spark):
    """Nothing is exchanged above the step that makes postings; copies of a text are counted once."""
    rows = spark.createDataFrame([(1, "red lamp red", "a"), (1, "red lamp red", "b"), (2, "blue", "a"), (2, "green", "a"), (3, None, "a")], "doc_id long, text string, source string")
    new = rows.where("doc_id < 3 and text <> 'green'").groupBy("doc_id", F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"))
    found = index_documents.count_terms(rows, new)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]
    assert sorted(map(tuple, found.collect())) == [("blue", 2, 1), ("lamp", 1, 1), ("red", 1, 2)]
