from test_kb import THREE, records

from tessera.streaming import incremental


def test_maintain_chunks(spark, tmp_path):
    rec = records(spark, *THREE)
    rec.write.parquet(f"{tmp_path}/in")
    for k in range(2):
        stream = spark.readStream.schema(rec.schema).parquet(f"{tmp_path}/in")
        incremental.maintain_chunks(stream, f"{tmp_path}/out", f"{tmp_path}/cp{k}").awaitTermination(60)
        n = spark.read.parquet(f"{tmp_path}/out")
        assert n.count() == n.select("chunk_id").distinct().count() > 0


def test_windowed_latency(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2026-01-01 00:01:00', 'a', 1.0D), (TIMESTAMP'2026-01-01 00:02:00', 'a', 3.0D), (TIMESTAMP'2026-01-01 00:07:00', 'a', 5.0D) t(ts, event_type, value)")
    assert sorted((r.n, r.mean) for r in incremental.windowed_latency(df).collect()) == [(1, 5.0), (2, 2.0)]
