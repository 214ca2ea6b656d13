"""End-to-end plans: knowledge-base build, index build and a batch of questions with answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.rules import service_actions
from ..functions.vectors import trigram_encoder
from ..operators import answer, chunks, index, kb, retrieve
from ..sources.records import load_all
from ..storage import cut


def build_kb(spark: SparkSession, inputs: list[tuple[str, str]], existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """accepted, quarantined, dropped and report of (loader, path) inputs; ``existing`` records come first and stay.

    Validation is one pass over the normalised records, which are cut once, so both branches and the report share it.
    """
    loaded = load_all(spark, inputs)
    validated = cut(kb.validate(kb.normalize_records(loaded)))
    ok, bad = kb.split_valid(validated)
    fresh = ok.drop("errors", "warnings")
    if existing is not None:
        first = existing.withColumn("_order", F.struct(F.lit(-1).alias("input"), F.monotonically_increasing_id().alias("row")))
        fresh = first.unionByName(fresh, allowMissingColumns=True)
    unique, dropped = kb.deduplicate(fresh)
    return {"accepted": unique, "quarantined": bad, "dropped": dropped, "report": kb.build_report(loaded, validated, unique, dropped)}


def build_index(records: DataFrame) -> dict[str, DataFrame]:
    """chunks, bm25, tfidf, idf and trigram vectors of records."""
    c = cut(chunks.assert_unique(chunks.chunk_records(records)))
    postings, idf = index.tfidf_model(c)
    vectors = trigram_encoder(c, "chunk_id", "embed_text")
    return {"chunks": c, "bm25": index.bm25_postings(c), "tfidf": postings, "idf": idf, "trigrams": vectors}


def ask(questions: DataFrame, built: dict[str, DataFrame], records: DataFrame, config: dict | None = None, k: int = 5, rerank: bool = False) -> DataFrame:
    """Answers to a batch of questions (query_id, query); with ``rerank``, hits follow the action they are asked for."""
    config = config or fixed.CONFIGS["v3"]
    index_ = built | {"query_trigrams": trigram_encoder(questions, "query_id", "query")}
    hits = retrieve.search(questions, index_, config, k=k).select("query_id", "service_id", "score", "rank")
    if rerank:
        services = records.select("service_id", service_actions(F.col("title_en"), F.col("title_ar")).alias("actions"))
        hits = retrieve.rerank(hits, services, questions).select("query_id", "service_id", "score", F.col("new_rank").alias("rank"))
    return answer.answers(questions, hits, records, config, index_["query_trigrams"], trigram_encoder)
