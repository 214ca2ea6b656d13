"""Keeps term statistics of a search index up to date as files of documents arrive.

    python -m jobs.index_documents --documents IN --output OUT --checkpoint CP [--config jobs/index_documents.json]

``IN`` holds Parquet files of documents (doc_id, text, source). Each run takes the files that have come since the last
one, as a file stream with a checkpoint that ends when nothing is left, and writes below ``OUT``:

- ``documents`` (doc_id, source, language, digest, tokens), partitioned by batch: what was accepted. A document that
  comes again with another text is a new version, which replaces the one before; with the same text it is passed over.
- ``postings`` (term, doc_id, tf), partitioned by batch and bucket of the term.
- ``rejected`` (doc_id, reason, rows), partitioned by batch.
- ``changes`` (term, df, cf), partitioned by batch: what a batch adds to a term's documents and occurrences, less what
  it takes away with the versions it replaces. The totals need only this, so a run costs what is new and the terms.
- ``terms`` (term, df, cf, idf), partitioned by bucket: the statistics that ranking takes, made anew by each run.

A batch writes partitions of its own number and reads those of smaller numbers, so a batch that is repeated after a
failure writes what it wrote before. Rows without an id or without search terms are rejected; of several texts of one id
in a batch, the one with the smallest digest counts, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, read_config, table
from tessera.functions.text import detect_language, has_terms
from tessera.operators.index import row_postings
from tessera.storage import small

DEFAULTS = {"buckets": 16, "files_a_batch": 1000}
DOCUMENTS = "doc_id long, source string, language string, digest string, tokens long"
POSTINGS = "term string, doc_id long, tf long"
REJECTED = "doc_id long, reason string, rows long"
CHANGES = "term string, df long, cf long"
TERMS = "term string, df long, cf long, idf double"


def bucket(term: str, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int").alias("bucket")


def put(df: DataFrame, path: str, *by: str) -> None:
    """Write the partitions that ``df`` has rows for, in place of what they held."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def current(documents: DataFrame) -> DataFrame:
    """The newest version of each document."""
    return documents.groupBy("doc_id").agg(F.max_by(F.struct(*(c for c in documents.columns if c != "doc_id")), "batch").alias("v")).select("doc_id", "v.*")


def read_rows(rows: DataFrame) -> DataFrame:
    """What a batch's rows are, without their texts; ``reason`` tells why a row is rejected."""
    reason = F.when(F.col("doc_id").isNull(), "no id").when(~has_terms(F.col("text")), "no terms")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.sha2("text", 256).alias("digest"), detect_language(F.col("text")).alias("language"), reason.alias("reason"))


def count_terms(rows: DataFrame, new: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of the texts that ``new`` (doc_id, digest, copies) names, one of each: texts may travel, postings never do."""
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("digest"), "text")
    named = texts.join(small(new.select("doc_id", "digest", "copies")), ["doc_id", "digest"])
    if not new.where("copies > 1").isEmpty():
        again = named.where("copies > 1").groupBy("doc_id", "digest").agg(F.first("text").alias("text"))
        named = named.where("copies = 1").select("doc_id", "text").unionByName(again.select("doc_id", "text"))
    return row_postings(named, "doc_id")


def take_batch(rows: DataFrame, number: int, output: str, buckets: int) -> dict[str, int]:
    """Write a batch's partitions of all tables; returns how many rows each got."""
    read = read_rows(rows).persist()
    try:
        return write_batch(rows, read, number, output, buckets)
    finally:
        read.unpersist()


def write_batch(rows: DataFrame, read: DataFrame, number: int, output: str, buckets: int) -> dict[str, int]:
    spark, batch = rows.sparkSession, F.lit(number).alias("batch")
    put(read.where("reason is not null").groupBy("doc_id", "reason").agg(F.count("*").alias("rows")).select("*", batch), f"{output}/rejected", "batch")

    # One version of each id, with the number of rows that repeat it; texts do not travel for this.
    light = read.where("reason is null").groupBy("doc_id", "digest").agg(F.min("source").alias("source"), F.first("language").alias("language"), F.count("*").alias("copies"))
    light = light.groupBy("doc_id").agg(F.min_by(F.struct(*(c for c in light.columns if c != "doc_id")), "digest").alias("v")).select("doc_id", "v.*")
    before = current(spark.read.schema(f"{DOCUMENTS}, batch long").parquet(f"{output}/documents").where(F.col("batch") < number))
    old = before.select("doc_id", F.col("digest").alias("was"), F.col("batch").alias("was_batch"))
    new = light.join(old, "doc_id", "left").where(~F.col("digest").eqNullSafe(F.col("was")))

    put(count_terms(rows, new).select("*", batch, bucket("term", buckets)), f"{output}/postings", "batch", "bucket")
    posted = spark.read.schema(f"{POSTINGS}, batch long, bucket int").parquet(f"{output}/postings").where(F.col("batch") == number)
    long = posted.groupBy("doc_id").agg(F.sum("tf").alias("tokens"))
    put(new.join(long, "doc_id").select("doc_id", "source", "language", "digest", "tokens", batch), f"{output}/documents", "batch")
    written = spark.read.schema(f"{DOCUMENTS}, batch long").parquet(f"{output}/documents").where(F.col("batch") == number)

    stored = spark.read.schema(f"{POSTINGS}, batch long, bucket int").parquet(f"{output}/postings")
    change = stored.where(F.col("batch") == number).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    gone = written.select("doc_id").join(before.select("doc_id", F.col("batch").alias("was_batch")), "doc_id")
    if not gone.isEmpty():
        left = stored.where(F.col("batch") < number).join(small(gone), (stored["doc_id"] == gone["doc_id"]) & (stored["batch"] == gone["was_batch"]), "left_semi")
        change = change.unionByName(left.groupBy("term").agg((-F.count("*")).alias("df"), (-F.sum("tf")).alias("cf"))).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    put(change.select("*", batch), f"{output}/changes", "batch")

    of = lambda name, schema: spark.read.schema(f"{schema}, batch long").parquet(f"{output}/{name}").where(F.col("batch") == number)
    out = {"accepted": of("documents", DOCUMENTS).count(), "postings": of("postings", POSTINGS).count(), "terms changed": of("changes", CHANGES).count()}
    return out | {"rejected": of("rejected", REJECTED).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]}


def refresh_terms(spark: SparkSession, output: str, buckets: int) -> int:
    """Totals of all changes, with idf over the current documents."""
    n = current(spark.read.schema(f"{DOCUMENTS}, batch long").parquet(f"{output}/documents")).count()
    changes = spark.read.schema(f"{CHANGES}, batch long").parquet(f"{output}/changes")
    terms = changes.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
    terms = terms.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    terms.select("*", bucket("term", buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{output}/terms")
    return spark.read.schema(f"{TERMS}, bucket int").parquet(f"{output}/terms").count()


def as_pattern(path: str) -> str:
    """The path as a pattern that only it matches: file streams take plain paths of folders alone, patterns of files too."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: str | None = None) -> dict:
    """Take what is new in ``documents``; returns what was read and written."""
    conf = read_config(spark, config, DEFAULTS)
    for name, schema, by in (("documents", DOCUMENTS, "batch long"), ("postings", POSTINGS, "batch long, bucket int"), ("rejected", REJECTED, "batch long"), ("changes", CHANGES, "batch long")):
        table(spark, f"{output}/{name}", schema, by)
    done: dict[str, int] = {"batches": 0, "read": 0}

    def step(rows: DataFrame, number: int) -> None:
        wrote = take_batch(rows, number, output, conf["buckets"]) | {"read": rows.count()}
        log.info("batch %d of %s: %s", number, documents, wrote)
        for k, v in wrote.items():
            done[k] = done.get(k, 0) + v
        done["batches"] += 1

    schema = spark.read.parquet(documents).select("doc_id", "text", "source").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", conf["files_a_batch"]).parquet(as_pattern(documents))
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done["terms"] = refresh_terms(spark, output, conf["buckets"])
    log.info("read %s, wrote %s: %s", documents, output, done)
    return done


if __name__ == "__main__":
    main(run, "Term statistics of arriving documents", {"documents": "folder of Parquet files of documents", "output": "folder of the tables", "checkpoint": "folder of the stream's checkpoint"})
