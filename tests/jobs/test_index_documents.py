import json
import math
import re
from collections import Counter

import pytest

from jobs import index_documents
from tessera.functions import fixed

DOCS = [
    [(1, "The red lamps and red lamp", "a"), (2, "blue lamp", "b"), (3, None, "a"), (None, "lamp", "a"), (4, "the of", "b"), (2, "blue lamp", "b"), (5, "one more", "c"), (5, "another one", "c")],
    [(2, "green lamp", "b"), (1, "The red lamps and red lamp", "z"), (6, "green green", None)],
    [(2, "blue lamp", "b"), (7, "lamp", "d")],
]


def tokens(text):
    out = []
    for t in re.findall("[a-z0-9]+", text.lower()):
        if t not in fixed.STOP_EN:
            for end, least in (("ing", 5), ("ed", 4), ("es", 4), ("s", 3)):
                if len(t) > least and t.endswith(end):
                    t = t[: -len(end)]
                    break
            out.append(t)
    return out


def expected(batches):
    """Term statistics of the newest version of each document."""
    now = {}
    for batch in batches:
        own = {}
        for i, text, _ in batch:
            if i is not None and text is not None and tokens(text):
                own.setdefault(i, []).append(text)
        import hashlib

        now |= {i: min(t, key=lambda x: hashlib.sha256(x.encode()).hexdigest()) for i, t in own.items()}
    tf = {i: Counter(tokens(t)) for i, t in now.items()}
    df, cf = Counter(w for c in tf.values() for w in c), sum(tf.values(), Counter())
    return sorted((w, df[w], cf[w], round(math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)), 9)) for w in df)


def terms(spark, at):
    return sorted((r.term, r.df, r.cf, round(r.idf, 9)) for r in spark.read.schema(index_documents.TERMS).parquet(f"{at}/terms").collect())


def add(spark, rows, at):
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(at)


@pytest.fixture
def places(tmp_path):
    return {"documents": f"file://{tmp_path}/in", "output": f"file://{tmp_path}/out", "checkpoint": f"file://{tmp_path}/cp"}


def test_growing_input(spark, places):
    for k, rows in enumerate(DOCS):
        add(spark, rows, places["documents"])
        done = index_documents.run(spark, **places)
        assert (done["batches"], done["read"]) == (1, len(rows))
        assert terms(spark, places["output"]) == expected(DOCS[: k + 1])
        again = index_documents.run(spark, **places)  # nothing new: nothing read, the same result
        assert again["batches"] == 0 and again["read"] == 0
        assert terms(spark, places["output"]) == expected(DOCS[: k + 1])
    documents = spark.read.parquet(f"{places['output']}/documents")
    assert sorted((r.batch, r.doc_id) for r in documents.collect()) == [(0, 1), (0, 2), (0, 5), (1, 2), (1, 6), (2, 2), (2, 7)]
    rejected = spark.read.parquet(f"{places['output']}/rejected")
    assert sorted((r.batch, r.reason, r.rows) for r in rejected.collect()) == [(0, "no id", 1), (0, "no terms", 1), (0, "no terms", 1)]


def test_repeated_batch_writes_the_same(spark, places):
    """A batch that is taken again after a failure leaves every table as it was."""
    add(spark, DOCS[0], places["documents"])
    index_documents.run(spark, **places)
    add(spark, DOCS[1], places["documents"])
    index_documents.run(spark, **places)

    def all_rows():
        return {n: sorted(map(str, spark.read.parquet(f"{places['output']}/{n}").collect())) for n in ("documents", "postings", "rejected", "changes")}

    before = all_rows()
    rows = spark.createDataFrame(DOCS[1], "doc_id long, text string, source string")
    index_documents.take_batch(rows, 1, places["output"], index_documents.DEFAULTS["buckets"])
    assert all_rows() == before


def test_many_batches_a_run_and_config(spark, places, tmp_path):
    for rows in DOCS:
        add(spark, rows, places["documents"])
    (tmp_path / "c.json").write_text(json.dumps({"buckets": 3, "files_a_batch": 1}))
    done = index_documents.run(spark, **places, config=f"file://{tmp_path}/c.json")
    assert done["batches"] == 3 and done["read"] == sum(map(len, DOCS))
    assert len(terms(spark, places["output"])) == done["terms"]
    (tmp_path / "d.json").write_text(json.dumps({"bucket": 3}))
    with pytest.raises(ValueError):
        index_documents.run(spark, **places, config=f"file://{tmp_path}/d.json")


def test_empty_input(spark, places):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(places["documents"])
    assert index_documents.run(spark, **places)["terms"] == 0
    assert terms(spark, places["output"]) == []
