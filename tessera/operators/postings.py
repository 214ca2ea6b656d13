"""Top-k over postings that reads only what can reach the k-th score.

Postings are kept twice: as they are, by key, and as blocks of one term and one level of weight, each with the largest
weight in it. A question first reads the highest level of its terms; the rows with the best partial sums are scored in
full, and the k-th best of these scores is a floor for its k-th score. Terms are then taken from the largest bound down until the rest together stay below the floor: a row
must stand in one of those lists, so the long lists of common terms are not read at all, and of the others only blocks
that can still lift a row to the floor. What these rows may reach at most decides who is a candidate; candidates alone
are scored in full, by their keys. Weights of postings and questions must not be negative.

No list is sorted or held by one task: levels are cut by weight, and long ones are dealt into parts by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small, stored

LEVELS = 16
#: Postings that a block holds about at most.
BLOCK = 4096
#: Rows that are scored in full for the floor of a question, in multiples of k.
SEEDS = 8


def impact_blocks(postings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(term, level, part, top, n, rows array<struct<key, w>>) of postings (key, term, w); level 0 has the largest weights."""
    size = postings.groupBy("term").agg(F.max("w").alias("most"), F.count("*").alias("c"))
    level = F.least(F.floor((1 - F.col("w") / F.col("most")) * LEVELS), F.lit(LEVELS - 1)).cast("int")
    part = F.pmod(F.xxhash64(key), F.ceil(F.col("c") / (LEVELS * BLOCK)).cast("long")).cast("int")
    rows = postings.join(size.where("most > 0"), "term").select("term", level.alias("level"), part.alias("part"), F.struct(F.col(key).alias("key"), "w").alias("row"))
    return rows.groupBy("term", "level", "part").agg(F.max("row.w").alias("top"), F.count("*").alias("n"), F.collect_list("row").alias("rows"))


def _read(blocks: DataFrame, score: Column) -> DataFrame:
    """(query_id, key, s, seen): partial sums of blocks joined with questions' terms, and the bounds of the terms seen."""
    rows = blocks.select("query_id", "term", "qw", "bound", F.explode("rows").alias("r"))
    return rows.groupBy("query_id", F.col("r.key").alias("key")).agg(F.sum(score).alias("s"), F.sum("bound").alias("seen"))


def _full(candidates: DataFrame, postings: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score) of candidate rows (query_id, key), by their keys."""
    found = postings.join(small(candidates), key).join(small(terms.select("query_id", "term", "qw")), ["query_id", "term"])
    return found.groupBy("query_id", key).agg(F.sum(F.col("qw") * F.col("w")).alias("score"))


def plan_reads(queries: DataFrame, blocks: DataFrame, postings: DataFrame, k: int, key: str = "chunk_id", slack: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(terms with bounds and the floor of their question, blocks that have to be read) of (query_id, term, w)."""
    asked = queries.where("w > 0").select("query_id", "term", F.col("w").alias("qw"))
    tops = blocks.select("term", "top").groupBy("term").agg(F.max("top").alias("most"))
    terms = stored(tops.join(small(asked), "term").withColumn("bound", F.col("qw") * F.col("most")), "bounds")
    first = blocks.where("level = 0").join(small(terms.select("query_id", "term", "qw", "bound")), "term")
    place = lambda by: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), key))
    seeds = _read(first, F.col("qw") * F.col("r.w")).withColumnRenamed("key", key).withColumn("place", place("s")).where(F.col("place") <= SEEDS * k)
    seeds = stored(seeds.select("query_id", key), "seeds")
    kth = _full(seeds, postings, terms, key).withColumn("place", place("score")).where(F.col("place") == k).select("query_id", F.col("score").alias("floor"))
    upto = F.sum("bound").over(Window.partitionBy("query_id").orderBy("bound", "term"))
    whole = F.sum("bound").over(Window.partitionBy("query_id"))
    terms = terms.withColumns({"upto": upto, "whole": whole}).join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) * (1 - 1e-9) - slack)
    terms = stored(terms, "floors")
    essential = terms.where(F.col("upto") >= F.col("floor"))
    need = blocks.join(small(essential), "term").where(F.col("qw") * F.col("top") + F.col("whole") - F.col("bound") >= F.col("floor"))
    return terms, need


def top_k(queries: DataFrame, blocks: DataFrame, postings: DataFrame, k: int, key: str = "chunk_id", digits: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k best rows of every question (query_id, term, w), exactly; ties by key.

    ``blocks`` are ``impact_blocks`` of ``postings``. With ``digits``, scores are rounded before they are compared.
    """
    slack = 1e-6 if digits is None else 2 * 10.0**-digits
    terms, need = plan_reads(queries, blocks, postings, k, key, slack)
    limit = terms.select("query_id", "whole", "floor").distinct()
    reached = _read(need, F.col("qw") * F.col("r.w")).join(small(limit), "query_id").where(F.col("s") + F.col("whole") - F.col("seen") >= F.col("floor"))
    candidates = stored(reached.select("query_id", F.col("key").alias(key)), "candidates")
    scored = _full(candidates, postings, terms, key)
    scored = scored if digits is None else scored.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
