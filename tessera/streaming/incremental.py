"""Extensions beyond batch: an index kept up to date from a stream of records, and windowed latency of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokenize
from ..operators.chunks import chunk_records


def maintain_chunks(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the chunks of each micro-batch to ``path``, but for chunks that are there with the same text.

    A batch that is replayed finds its chunks stored and adds nothing.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = chunk_records(batch).withColumn("text_hash", F.sha2("embed_text", 256))
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            new = new.join(spark.read.parquet(path).select("chunk_id", "text_hash"), ["chunk_id", "text_hash"], "left_anti")
        new.write.mode("append").parquet(path)

    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """Documents per term of a stream or table of chunks (complete mode on a stream)."""
    terms = chunks.select(F.explode(F.array_distinct(tokenize(F.col("embed_text")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def windowed_latency(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, mean and approximate 95th percentile of ``value`` by event type and tumbling window of ``ts``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile_approx("value", 0.95).alias("p95"))
