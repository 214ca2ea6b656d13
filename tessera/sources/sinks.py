"""Writers: JSON lines, CSV, index folders with their metadata, and reading an index back with a freshness check."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import chunk_stats, fingerprint


class StaleIndexError(RuntimeError):
    """The stored index was built from other chunks or with another encoder."""


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns become JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')


def write_quarantine(quarantined: DataFrame, path: str) -> None:
    write_jsonl(quarantined.withColumnsRenamed({"errors": "_errors", "warnings": "_warnings"}), path)


def write_index(index: dict[str, DataFrame], path: str, encoder: str) -> dict:
    """Each table as Parquet (postings clustered by term) and ``meta.json`` with fingerprint, encoder and counts."""
    for name, df in index.items():
        (df.sortWithinPartitions("term") if "term" in df.columns else df).write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(index.values())).sparkSession
    chunks = spark.read.parquet(f"{path}/chunks")
    totals = chunk_stats(chunks).where("lang is null and section is null").first()
    meta = {"fingerprint": fingerprint(chunks), "encoder": encoder, "chunks": totals["chunks"] if totals else 0, "services": totals["services"] if totals else 0}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return meta


def read_index(spark: SparkSession, path: str, names: list[str], encoder: str) -> dict[str, DataFrame]:
    """The tables of an index; raises ``StaleIndexError`` where chunks or encoder do not match the metadata."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    index = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    if meta["encoder"] != encoder:
        raise StaleIndexError(f"built with {meta['encoder']}")
    if meta["fingerprint"] != fingerprint(index["chunks"]):
        raise StaleIndexError("chunks do not match the stored fingerprint")
    return index


def write_json(value: dict, spark: SparkSession, path: str) -> None:
    """One JSON document, as a text folder that any file system of Spark can hold."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_document(spark: SparkSession, path: str) -> dict | None:
    """The JSON document at ``path`` (a file or a folder that ``write_json`` wrote), or None where there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small document


def read_config(spark: SparkSession, *paths: str) -> dict:
    """The first configuration that exists among ``paths``, newest first; uncalibrated dense search where none does."""
    found = (read_json_document(spark, p) for p in paths)
    return next((c for c in found if c is not None), {"method": "dense", "alpha": 1.0, "threshold": None, "calibrated": False})


def write_results(summary: dict, per_query: DataFrame, config: dict, path: str) -> dict:
    """Results, per-query rows and the calibrated configuration of an evaluation; returns the configuration."""
    spark = per_query.sparkSession
    write_json(summary, spark, f"{path}/results")
    write_csv(per_query, f"{path}/per_query")
    calibrated = config | {"calibrated": True, "threshold": round(config["threshold"], 4) if config.get("threshold") is not None else None}
    write_json(calibrated, spark, f"{path}/config")
    return calibrated


def write_report(report: DataFrame, path: str) -> None:
    """A build report (one row) as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_static(words: DataFrame, chunk_fingerprint: str, path: str) -> None:
    """A static word table (word, idf, vec) in single precision, with the fingerprint of the chunks it was made for."""
    words.select("word", F.round("idf", 5).alias("idf"), F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(f"{path}/words")
    write_json({"fingerprint": chunk_fingerprint}, words.sparkSession, f"{path}/meta")


def read_static(spark: SparkSession, path: str, chunk_fingerprint: str | None = None) -> DataFrame | None:
    """The static word table, or None where there is none or where it was made for other chunks."""
    meta = read_json_document(spark, f"{path}/meta")
    if meta is None or (chunk_fingerprint and meta.get("fingerprint") != chunk_fingerprint):
        return None
    return spark.read.parquet(f"{path}/words")
