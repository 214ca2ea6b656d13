"""Search indexes as postings tables: BM25, character n-gram TF-IDF and dense vectors.

A posting is (chunk_id, term, w). Weights are materialised on build, so a question is one equi-join on its terms and a
sum. Terms are hash-partitioned; the totals that weights need (documents, mean length) are one row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed
from ..functions.text import RUN, char_ngrams, light_stem, lowered, tokenize, words
from ..functions.vectors import unit


def term_counts(texts: DataFrame, key: str, terms) -> DataFrame:
    """(key, term, tf) of an array-valued expression."""
    return texts.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


#: Runs whose terms a task remembers at most, and postings that it hands on together.
REMEMBERED = 500_000
TOGETHER = 100_000


class Terms(dict):
    """The term of each run of letters, as ``text.tokenize`` makes it, or None for a stop word; made once a task."""

    stops = frozenset((*fixed.STOP_EN, *fixed.STOP_AR))

    def __missing__(self, run: str) -> str | None:
        if len(self) >= REMEMBERED:
            self.clear()
        self[run] = None if run in self.stops else self.stem(run)
        return self[run]

    @staticmethod
    def stem(run: str) -> str:
        if run < "\u0600":
            return next((run[: -len(s)] for s in fixed.SUFFIXES_EN if len(run) > len(s) + 2 and run.endswith(s)), run)
        out = re.sub(fixed.PREFIX_AR, "", run)
        return re.sub(fixed.SUFFIX_AR, "", out) if len(out) > 4 else out


def row_postings(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, key, tf) of every row, counted within the row: nothing is shuffled. A null text has no terms."""
    kind = texts.schema[key].dataType
    key_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, of = re.compile(RUN).findall, Terms()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), keys.slice(first, len(sizes)).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))).cast(key_type), pa.array(tfs, pa.int64())], names=["term", key, "tf"])

        for batch in batches:
            keys, first, sizes, terms, tfs = batch.column(0), 0, [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own: dict[str, int] = {}
                for word, n in Counter(find(t or "")).items():
                    if (term := of[word]) is not None:
                        own[term] = own.get(term, 0) + n
                sizes.append(len(own))
                terms.extend(own)
                tfs.extend(own.values())
                if len(terms) >= TOGETHER:
                    yield made()
                    first, sizes, terms, tfs = i + 1, [], [], []
            yield made()

    return texts.select(key, lowered(F.col(text)).alias("text")).mapInArrow(run, f"term string, `{key}` {kind.simpleString()}, tf long")


def bm25_postings(texts: DataFrame, key: str = "chunk_id", text: str = "embed_text", k1: float = fixed.BM25["k1"], b: float = fixed.BM25["b"]) -> DataFrame:
    """(key, term, w): idf times saturated tf. The mean length is over all texts, empty ones included."""
    tokens = texts.select(key, tokenize(F.col(text)).alias("toks"))
    sized = tokens.withColumn("dl", F.size("toks"))
    total = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = sized.select(key, "dl", F.explode("toks").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(total)).select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    w = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(idf, "term").select(key, "term", (F.col("idf") * w).alias("w"))


def tfidf_model(texts: DataFrame, key: str = "chunk_id", text: str = "embed_text") -> tuple[DataFrame, DataFrame]:
    """(postings, idf): unit-length weights (1 + ln tf) * idf over character n-grams, idf = ln((1+N)/(1+df)) + 1."""
    tf = term_counts(texts, key, char_ngrams(F.col(text)))
    idf = tfidf_idf(tf, texts)
    return tfidf_postings(tf, idf, key), idf


def tfidf_idf(tf: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, idf) of the counts ``tf`` (key, term, tf) of ``texts``."""
    n = texts.agg(F.count("*").alias("n"))
    return tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_postings(tf: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    return unit_rows(tf.join(idf, "term").select(key, "term", ((1 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w")), key)


def tfidf_queries(queries: DataFrame, idf: DataFrame, key: str, text: str) -> DataFrame:
    """Unit-length query rows over the terms that the index knows."""
    tf = term_counts(queries, key, char_ngrams(F.col(text)))
    return unit_rows(tf.join(idf, "term").select(key, "term", ((1 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w")), key)


def unit_rows(rows: DataFrame, key: str) -> DataFrame:
    length = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return rows.join(length, key).select(key, "term", (F.col("w") / F.col("l")).alias("w"))


def vocabulary(texts: DataFrame, text: str = "embed_text") -> DataFrame:
    """Distinct words and light stems of two letters or more, with ln((N+1)/(df+1)) + 1 over the texts."""
    numbered = texts.select(F.monotonically_increasing_id().alias("i"), F.array_distinct(words(F.col(text))).alias("ws"))
    each = numbered.select("i", F.explode("ws").alias("w"))
    each = each.select("i", F.explode(F.array_distinct(F.array("w", light_stem(F.col("w"))))).alias("word")).where(F.length("word") >= 2).distinct()
    n = texts.agg(F.count("*").alias("n"))
    return each.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("word", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def static_encode(texts: DataFrame, table: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dim, v): unit-length idf-weighted sums of word vectors; a word without a vector takes its stem's.

    ``table`` is (word, idf, vec). Repeated words count each time; texts without known words are absent.
    """
    found = texts.select(key, F.posexplode(words(F.col(text))).alias("pos", "word")).withColumn("stem", light_stem(F.col("word")))
    own = table.select("word", F.struct("idf", "vec").alias("a"))
    stem = table.select(F.col("word").alias("stem"), F.struct("idf", "vec").alias("b"))
    hit = found.join(own, "word", "left").join(stem, "stem", "left").select(key, F.coalesce("a", "b").alias("e")).where("e is not null")
    dims = hit.select(key, F.col("e.idf").alias("idf"), F.posexplode("e.vec").alias("dim", "x")).groupBy(key, "dim").agg(F.sum(F.col("idf") * F.col("x")).alias("v"))
    length = dims.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l"))
    return dims.join(length, key).select(key, "dim", F.when(F.col("l") > 0, F.col("v") / F.col("l")).otherwise(0.0).alias("v"))


def remove_common(table: DataFrame, k: int = 1, sample: int = 20_000) -> DataFrame:
    """``table`` (word, vec) centred, without its ``k`` leading common directions, as unit vectors.

    Mean and directions are fitted on at most ``sample`` words in order; the projection is a native expression.
    """
    import numpy as np

    dims = table.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()  # one row per dimension
    mean = np.array([r.m for r in dims])
    v = np.array([r.vec for r in table.orderBy("word").limit(sample).select("vec").collect()]) - mean
    u = np.linalg.svd(v, full_matrices=False)[2][:k]
    lit = lambda row: F.array(*(F.lit(float(x)) for x in row))
    out = F.zip_with("vec", lit(mean), lambda a, b: a.cast("double") - b)
    rows = table.withColumn("vec", out)
    for row in u:
        d = F.aggregate(F.zip_with("vec", lit(row), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        rows = rows.withColumn("_d", d).withColumn("vec", F.zip_with("vec", F.transform(lit(row), lambda x: x * F.col("_d")), lambda a, b: a - b)).drop("_d")
    return rows.withColumn("vec", unit(F.col("vec")))


def lexicon_words(spark) -> DataFrame:
    """Distinct words of the expansion rules, to be united with a corpus vocabulary."""
    rows = [(t,) for phrases, official in (*fixed.EXPAND_EN, *fixed.EXPAND_AR) for t in (*phrases, official)]
    return spark.createDataFrame(rows, "t string").select(F.explode(words(F.col("t"))).alias("word")).distinct()


def encoded(questions: DataFrame, path: str, encode, text: str = "query") -> DataFrame:
    """``questions`` with ``qvec``: texts are encoded once and kept at ``path`` (digest, qvec) for later batches.

    ``encode`` makes (digest, qvec) from (digest, text) of the texts that are not there yet, each once. Several runs may
    add the same text; one of its vectors is taken. A null text has no vector.
    """
    spark = questions.sparkSession
    shape = "digest string, qvec array<double>"
    spark.createDataFrame([], shape).write.mode("ignore").parquet(path)
    asked = questions.withColumn("digest", F.sha2(text, 256))
    stored_ = spark.read.schema(shape).parquet(path)
    new = asked.where("digest is not null").select("digest", F.col(text).alias("text")).dropDuplicates(["digest"]).join(stored_.select("digest"), "digest", "left_anti")
    encode(new).select("digest", F.col("qvec").cast("array<double>").alias("qvec")).write.mode("append").parquet(path)
    every = spark.read.schema(shape).parquet(path).groupBy("digest").agg(F.any_value("qvec").alias("qvec"))
    return asked.join(every, "digest", "left").drop("digest")
