"""Vector functions on array columns, and a hashed character-trigram encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_for_matching


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; as it is where the length is 0."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def trigram_buckets(text: Column) -> Column:
    """Bucket (last byte of the md5) of each character trigram of the padded, normalised text."""
    padded = F.concat(F.lit(" "), normalize_for_matching(text), F.lit(" "))

    def bucket(t: Column, i: Column) -> Column:
        return F.conv(F.substring(F.md5(F.substring(t, i, F.lit(3)).cast("binary")), 31, 2), 16, 10).cast("int")

    # Bound as a lambda variable, the normalised text is evaluated once and not for every trigram.
    each = F.transform(F.array(padded), lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: bucket(t, i)))
    return F.flatten(each)


def trigram_encoder(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse unit vectors (key, bucket, w): counts of hashed trigrams over their length. Stays in the JVM."""
    counts = df.select(key, F.explode(trigram_buckets(F.col(text))).alias("bucket")).groupBy(key, "bucket").agg(F.count("*").cast("double").alias("c"))
    length = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("l"))
    return counts.join(length, key).select(key, "bucket", (F.col("c") / F.col("l")).alias("w"))
