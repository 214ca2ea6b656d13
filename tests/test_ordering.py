import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import evaluate, ordering


def test_numbers_and_sums(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.randrange(40), rnd.randrange(5)) for k in range(500)] + [(None, None, 1)]
    df = spark.createDataFrame(rows, "k int, at int, n int")
    got = ordering.numbered(df, [F.asc_nulls_last("k")], "i", parts=7).collect()
    assert sorted((r.i, r.k is None, r.k or 0) for r in got) == [(i, i == 500, i if i < 500 else 0) for i in range(501)]
    got = ordering.running_sums(df.where("k is not null"), [F.desc("at")], {"upto": "n"}, parts=6).collect()
    assert all(r.upto == sum(n for _, a, n in rows[:500] if a >= r.at) for r in got) and len(got) == 500
    got = ordering.with_next(df.select("at").where("at is not null").distinct(), "at", "next", parts=9).collect()
    values = sorted({a for _, a, _ in rows if a is not None})
    assert sorted((r.at, r.next) for r in got if r.next is not None) == list(zip(values, values[1:])) and len(got) == len(values)
    assert ordering.numbered(df.limit(0), [F.col("k")], "i").count() == 0


@pytest.mark.parametrize("bins", [256, 2, 5])
def test_percentiles(spark, bins):
    rng = np.random.default_rng(bins)
    groups = {"a": rng.normal(size=700), "b": np.round(rng.exponential(size=300), 1), "c": np.array([5.0]), "d": np.repeat(2.0, 9), "e": np.append(rng.normal(size=50), [1e300, -1e300]), None: np.array([1.0, 2.0])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in ordering.percentiles(df, "v", ["g"], {"p50": 0.5, "p95": 0.95, "top": 1.0}, bins=bins).collect()}
    for g, v in groups.items():
        assert got[g].n == len(v) and all(getattr(got[g], c) == pytest.approx(np.quantile(v, p), rel=1e-12) for c, p in (("p50", 0.5), ("p95", 0.95), ("top", 1.0)))
    assert got["none"].n == 0 and got["none"].p50 is None
    one = ordering.percentiles(df, "v", [], {"p": 0.25}, bins=bins).collect()
    assert one[0].p == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.25))


def test_no_task_sees_all_scores(spark):
    rows = spark.range(1000).selectExpr("id AS query_id", "id % 97 / 97.0D AS top_score", "CAST(id % 2 AS INT) AS supported", "CAST(1 AS INT) AS rank")
    plan = evaluate.cumulative(rows)._jdf.queryExecution().executedPlan().toString()
    single = [line for line in plan.split("\n") if "SinglePartition" in line]
    assert len(single) <= 3  # totals of the ranges and of all rows: a row a range
    assert evaluate.fit_threshold(rows).count() == 1


def test_built_tables_follow_their_files(spark, tmp_path, monkeypatch):
    src, made = f"file://{tmp_path}/src", []

    def make():
        made.append(1)
        return spark.read.parquet(src).groupBy("x").count()

    spark.createDataFrame([(1,), (1,), (2,)], "x int").coalesce(1).write.parquet(src)
    table = lambda: {r.x: r["count"] for r in storage.built(spark, src, "counts", make).collect()}
    assert table() == {1: 2, 2: 1} == table() and len(made) == 1
    spark.createDataFrame([(3,)], "x int").coalesce(1).write.mode("overwrite").parquet(src)
    assert table() == {3: 1} and len(made) == 2
    # A named store serves other sessions: the table is found, not made.
    spark.conf.set(storage.STORE, f"file://{tmp_path}/store")
    try:
        assert table() == {3: 1} and len(made) == 3
        storage._built.clear()
        assert table() == {3: 1} and len(made) == 3
    finally:
        spark.conf.unset(storage.STORE)
