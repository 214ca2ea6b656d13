import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, queries, samples, toxicity

BAD = "scum moron trash".split()


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=5))
    docs, labels = [], []
    for i in range(1200):
        toxic, good = rnd.random() < 0.15, rnd.random() < 0.8
        w = [word() for _ in range(rnd.randrange(20, 120))]
        if toxic:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(BAD)
        t = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        docs.append((i, t))
        if rnd.random() < 0.7:
            labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("label, module", [("toxic", toxicity), ("quality", quality)])
def test_held_out_accuracy(tables, label, module):
    docs, labels = tables
    if module is toxicity:
        out = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels))
    else:
        out = quality.score_quality(docs, quality.train_quality(docs, labels))
    held = out.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").select("score", label).collect()
    assert auc([(r.score, r[label]) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_cases(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "x y", "c"), (2, "scum " * 50_000, "d")], "doc_id long, text string, bias string")
    t, q = toxicity.train_toxicity(docs, labels), quality.train_quality(docs, labels)
    got = toxicity.score_toxicity(odd, t).orderBy("bias").collect()
    assert [r.bias for r in got] == ["a", "b", "c", "d"] and got[0].score == got[1].score and got[3].score >= 0.3
    got = quality.score_quality(odd, q).orderBy("bias").collect()
    assert got[0].score == got[1].score and len(got) == 4
    kept = toxicity.score_toxicity(odd, t, drop_from=0.3)
    assert kept.columns == odd.columns and {r.bias for r in kept.collect()} == {"a", "b", "c"}
    none = toxicity.train_toxicity(docs.limit(0), labels.limit(0))
    assert len({r.score for r in toxicity.score_toxicity(docs, none).collect()}) == 1
    assert {r.score for r in quality.score_quality(docs, quality.train_quality(docs, labels.limit(0))).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), t).count() == quality.score_quality(docs.limit(0), q).count() == 0


def test_queries_on_held_out_rows(spark, tables, tmp_path):
    """The queries themselves: rows, flags, the threshold, and accuracy on rows whose labels they may not read."""
    docs, labels = tables
    docs.withColumn("score", F.lit(7.0)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    known = {r.doc_id: r for r in labels.collect()}
    for query, label, least in ((queries.op5_toxicity, "toxic", 0.3), (queries.op8_quality, "quality", 0.7)):
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == docs.count() and rows[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= least) for r in rows)
        held = [(r, known[r.doc_id][label]) for r in rows if r.held_out and r.doc_id in known]
        assert sum(r.predicted == y for r, y in held) >= 0.95 * len(held)
        assert auc([(r.score, y) for r, y in held]) > 0.97


def test_score_replaces_a_column_of_its_name(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(1, "scum", 5.0)], "doc_id long, text string, score double")
    for out in (toxicity.score_toxicity(odd, toxicity.train_toxicity(docs, labels)), quality.score_quality(odd, quality.train_quality(docs, labels))):
        assert out.columns == ["doc_id", "text", "score"] and 0 <= out.first().score <= 1
    kept = toxicity.score_toxicity(odd, toxicity.train_toxicity(docs.limit(0), labels.limit(0)), drop_from=0.3)
    assert kept.first().score == 5.0


def test_samples_are_bounded_and_repeatable(spark):
    docs = spark.createDataFrame([(1, "b" * 40), (1, "a" * 30), (2, "c" * 500), (3, None), (4, "d" * 60), (5, "e" * 60)], "doc_id long, text string")
    ids = samples.training_ids(docs.select("doc_id").distinct(), 10, 1, -1)
    got = {r.doc_id: r.text for r in samples.sampled(docs, ids, 100).collect()}
    assert set(got) <= {1, 4, 5} and sum(map(len, got.values())) <= 100 and got.get(1, "a" * 30) == "a" * 30


def test_held_out_labels_are_not_read(spark, tables):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - toxic, toxic) as toxic")
    a, b = toxicity.train_toxicity(docs, labels), toxicity.train_toxicity(docs, flipped)
    assert a.bias == b.bias and (a.weights == b.weights).all()
