import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_stages(spark):
    from tessera.llm import pipeline as cp
    from test_jaccard import brute

    from tessera.llm.shared import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    calm = written(cp.drop_toxic(spark, docs, SF), "t")
    assert calm.columns == columns
    kept = {r.doc_id for r in calm.collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in kept for i in clean) >= 0.7 * len(clean)
    twice = calm.unionByName(calm.limit(3))
    one = written(cp.drop_near_copies(spark, twice, SF), "n")
    want = {r[0] for r in brute([(r.doc_id, r.text) for r in calm.collect()]) if r[3]}
    got = [r.doc_id for r in one.collect()]
    assert one.columns == columns and sorted(got) == sorted(want)
    safe = written(cp.redact(spark, one, SF), "p")
    assert safe.columns == columns and safe.where("text rlike '[a-z0-9]@[a-z0-9-]+[.]'").count() == 0 and safe.count() == one.count()
    mixed = written(cp.mix_sources(spark, safe, SF), "m")
    per = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == columns and max(per.values()) <= 2 and set(per) <= set(got)
    packs = cp.pack(spark, mixed, SF)
    assert packs.select("doc_id").distinct().count() == len(per) and packs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_empty_and_extra_columns(spark, tmp_path):
    from tessera.llm import pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, `row` int"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], [(1, None, "en", None, None, 1, 0.5, 1), (None, "", "en", "a", 0, 1, 0.5, 1), (2, "a b c d e f", None, "a", 11, 2, 0.5, 2), (2, "a b c d e f", None, "a", 11, 2, 0.5, 2)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [c.strip("`") for c in "doc_id text lang source n_chars size score row".split()]
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_stages_of_two_pipelines_may_alternate(spark):
    from tessera.llm import pipeline as cp

    docs = spark.createDataFrame([(k, f"w{k} x y", "a", 5) for k in range(20)], "doc_id long, text string, source string, n_chars int")
    one = cp.mix_sources(spark, docs, "")
    cp.redact(spark, docs, "")
    assert one.select("doc_id").distinct().count() == 20


def test_very_long_texts(spark, tmp_path):
    """Texts beyond any batch go through every stage whole."""
    from tessera.llm import pipeline as cp

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = " ".join(f"w{k % 9973}q{k}" for k in range(60_000))
    docs = spark.createDataFrame([(1, long, "a"), (2, long + " end", "a"), (3, "short text of six words here", "b")], "doc_id long, text string, source string")
    for name, stage in cp.STAGES[1:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert {r.doc_id for r in docs.select("doc_id").collect()} == {1, 3}, name
    packed = cp.pack(spark, docs, "")
    assert packed.groupBy("doc_id").agg({"piece": "max"}).count() == 2 and packed.where("length > 2048").count() == 0


def test_rest_stands_without_this_part():
    """Imports of the library that reach this subpackage are only in the driver's entry."""
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[2] / "tessera"
    assert not [f for f in root.rglob("*.py") if "llm" not in f.parts and re.search(r"\bllm\b", f.read_text())]


def test_near_copies_keep_one_row_of_each_group_where_ids_repeat(spark):
    from tessera.llm import pipeline as cp

    a, b, c = (" ".join(f"{name}{k}" for k in range(60)) for name in ("ant", "bee", "cow"))
    # (7, a) leads its group, (7, b) is a near copy of document 3, (7, c) stands for itself, twice.
    rows = [(3, b), (7, a), (7, b + " more"), (9, a + " more"), (7, c), (7, c + " more"), (8, ""), (8, None), (8, a), (5, "five words that are alone"), (None, a), (None, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, f1 int")
    got = sorted((str(r.doc_id), (r.text or "")[:3]) for r in cp.drop_near_copies(spark, docs, "").select(*docs.columns).collect())
    assert got == sorted([("3", "bee"), ("7", "ant"), ("7", "cow"), ("8", ""), ("5", "fiv"), ("None", "ant"), ("None", "")])
