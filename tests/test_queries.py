import os

import pytest

from tessera import queries, queries_flow  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(pdf):
    return sorted(map(repr, pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(df.select(*cols).toPandas())
    if name in queries.SQL:
        assert got == rows(duck.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").df())


def test_dedup_query_against_loop(spark):
    from tessera.functions import text
    from pyspark.sql import functions as F

    keyed = queries.page_records(spark, SF).select("_order", "service_id", text.domain_of(F.col("official_url_en")).alias("a"), F.coalesce("title_en", "service_id").alias("b")).orderBy("_order").collect()
    a, b, want = {}, {}, {}
    for r in keyed:
        want[r.service_id] = a.get(r.a) or b.get(r.b)
        if not want[r.service_id]:
            a[r.a] = b[r.b] = r.service_id
    assert {r.service_id: r.kept_by for r in queries.QUERIES["dedup_first_wins"](spark, SF).collect()} == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and entry.entry(spark).count() > 0
