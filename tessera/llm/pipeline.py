"""A training-data pipeline over ``documents`` of five stages, each an operator of this subpackage.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next
stage's documents; all but the last keep the columns of ``documents``. What a stage writes on its way is deleted by
``run`` once the stage's result is written, or when the application ends where stages are called on their own.

Cases common to all stages: very long texts are taken whole; columns with other names are kept as they are; of ties,
each operator's docstring says which row stands first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, mixing, packing, pii, tokens, toxicity
from .shared import bound_batches, erase, noting, release_driver, remove, written

TOXIC_FROM = 0.3
SIMILAR = 0.8
WEIGHTS = [3.0, 1.0, 2.0]


def _stage(stage):
    """A stage with Arrow batches of bounded size, which leaves the driver's memory as it found it."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        out = stage(spark, docs, sf_dir)
        release_driver()
        return out

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by the model that learns from the labels.

    Null and empty texts get the score of the model's bias; repeated rows are scored and kept alike; an empty table
    stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels), drop_from=TOXIC_FROM)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: one with the smallest id.

    Where an id repeats, its rows are told apart by their shingle sets: rows of one group are one, rows of other groups
    stay. Documents without words or without an id link with nothing and stay; without words, rows of one id are one. Of
    rows of one id and group any one stays; an empty table stays empty.
    """
    found = jaccard.near_documents(docs.select("doc_id", "text"), SIMILAR, sets=True)
    gone = written(found.where("not kept").select("doc_id").distinct(), "gone")
    twice = written(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return jaccard.join_ids(docs, gone, "doc_id", "left_anti")
    once = jaccard.join_ids(jaccard.join_ids(docs, twice, "doc_id", "left_anti"), gone, "doc_id", "left_anti")
    rows = jaccard.with_sets(jaccard.join_ids(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), twice, "doc_id", "left_semi"))
    kept = jaccard.join_ids(found.where("kept"), twice, "doc_id", "left_semi").select("doc_id", "f1", "f2", "n", "component").distinct()
    again = rows.join(kept, ["doc_id", "f1", "f2", "n"]).dropDuplicates(["doc_id", "component"]).select("row.*")
    return once.unionByName(again)


@_stage
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind.

    Null texts stay null; rows without personal data, repeated ones too, stay as they are; an empty table stays empty.
    """
    return pii.redact_pii(docs, pii.train_pii(docs))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is a source; null and empty texts have no words, cost nothing and stay with their source's epochs;
    repeated rows are taken alike but for a tie at the end of a target; an empty table stays empty.
    """
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))
    mixed = mixing.mix(rows, WEIGHTS, keep=["row"]).where("copies > 0")
    return mixed.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "row").select("row.*")


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset; a null or empty text is the end id alone.

    Repeated rows are packed each; an empty table gives no rows.
    """
    return packing.pack_documents(docs, tokens.vocabulary())


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("pii", redact), ("mixing", mix_sources), ("packing", pack)]

#: Classifiers, the chosen-path join and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage read and wrote on its way is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with noting([]) as paths:
            out = stage(spark, docs, sf_dir)
        docs = written(out, name)
        remove(spark, paths)
        if before is not None:
            erase(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
