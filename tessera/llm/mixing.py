"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word target: shares by weight of a budget, capped at a multiple of the source's size, the excess
reshared. A source takes its documents in complete epochs first; the rest of its target is filled by documents in the
order of exponential keys ``-ln(u) / quality`` whose prefix sums stay within the rest.

Prefix sums never put a whole source into one task: keys fall into buckets that keep their order, bucket sums are
summed first, and the one bucket of each source in which the target ends is cut again at the quantiles of its own keys;
only the one part in which the target ends is sorted.

Cases: a null text counts as empty (size 0); a null source is a source of its own, last in order; a null doc_id hashes
as empty text; repeated rows are rows of their own with equal keys and so in one part; very long texts count whole;
ties go by doc_id, then size; an empty table gives
no rows; a document counts as taken where the middle of its words lies within the target, so a target is met to half
a document; extra columns are kept by ``mix`` only when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .shared import written

BUCKETS = 1024
PARTS = 64
WORDS = r"[^\x20\x09-\x0D]+"
#: Above so many sources the limits are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1.1: the share of letters of any script in the text."""
    return F.lit(0.1) + F.coalesce(F.regexp_count(text, F.lit(r"\p{L}")) / F.greatest(F.char_length(text), F.lit(1)), F.lit(0.0))


def exponential_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """``-ln(u) / weight`` with ``u`` in (0, 1) from the md5 of seed and id."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((u + 0.5) / F.lit(float(1 << 52))) / weight


def targets(sizes: dict[str | None, int], weights: list[float], share: float, cap: float) -> dict[str | None, float]:
    """Target of each source: budget ``share`` of all sizes by repeating ``weights`` in code point order, null last.

    The rule in plain terms; ``goals`` computes it for any number of sources.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = {s for s in open_ if unit * w[s] > cap * sizes[s]}
        if not full:
            return out | {s: unit * w[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        left, open_ = max(left, 0.0), open_ - full
    return out


def goals(sources: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(key, source_size, target, epochs, rest) of each source (key, source, source_size), by the rule of ``targets``.

    Sources are numbered by ranges; what a unit of weight gets is found from sums alone, as it only grows while sources
    reach their limit.
    """
    order = [F.asc_nulls_last("source")]
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("i") % len(weights)).cast("int"))
    rows = written(numbered(sources, order, "i").select("key", "source_size", weight.alias("w")), "mixsources")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    unit, full = None, 0
    limit = F.lit(float(cap)) * F.col("source_size")
    while n:
        over = F.lit(False) if unit is None else F.lit(unit) * F.col("w") > limit
        count, used, left = rows.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if unit is not None and count == full or not left:
            break
        unit, full = max(share * total - used, 0.0) / left, count
    over = F.lit(unit or 0.0) * F.col("w") > limit
    target = F.when(over, limit).otherwise(F.lit(unit or 0.0) * F.col("w"))
    out = rows.select("key", "source_size", target.alias("target"))
    out = out.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))


def mix(documents: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every document, and the columns named in ``keep``.

    Targets, edges and cuts are tables with a row for each source; only sums come to the driver.
    """
    keep = keep or []
    key = exponential_key(F.col("doc_id"), quality_weight(F.col("text")), seed)
    # A source's key is never null: those of names begin with a sign.
    base = documents.select(F.col("doc_id").alias("__id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__source"), words_in(F.col("text")).alias("__size"), key.alias("__key"), *keep)
    base = base.withColumn("__bucket", F.least(F.floor(F.lit(float(BUCKETS)) * (1 - F.exp(F.col("__key") * -0.5))), F.lit(BUCKETS - 1)).cast("int"))
    base = written(base, "mix")
    sums = written(base.groupBy("__source", "__bucket").agg(F.sum("__size").alias("n")), "mixsums")
    sources = sums.groupBy("__source").agg(F.sum("n").alias("source_size"))
    sources = sources.select(F.col("__source").alias("key"), F.when(F.col("__source") != "", F.substring("__source", 2, 1 << 30)).alias("source"), "source_size")
    goal = written(goals(sources, weights, share, cap).withColumnRenamed("key", "__source"), "mixgoals")
    few = goal.count() <= BROADCAST_SOURCES

    def fit(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    def edges(sums: DataFrame, by: str, limits: DataFrame, edge: str, start: str) -> DataFrame:
        """(__source, edge, start): the group in which the prefix sum of words passes the rest, and the sum before it."""
        upto = F.col("base") + F.sum("n").over(Window.partitionBy("__source").orderBy(by))
        over = sums.join(fit(limits), "__source").withColumn("upto", upto).where("upto > rest")
        return over.groupBy("__source").agg(F.min_by(F.struct(by, (F.col("upto") - F.col("n")).alias("s")), by).alias("e")).select("__source", F.col(f"e.{by}").alias(edge), F.col("e.s").alias(start))

    edge = written(edges(sums, "__bucket", goal.select("__source", "rest", F.lit(0).cast("long").alias("base")), "b", "base"), "mixedges")
    # The edge bucket of a source may be large: quantiles of its keys cut it into parts of like size.
    inside = base.select("__source", "__bucket", "__key", "__size").join(fit(edge.select("__source", "b")), "__source").where("__bucket = b")
    cuts = written(inside.groupBy("__source").agg(F.percentile_approx("__key", [k / PARTS for k in range(1, PARTS)], 100 * PARTS).alias("cuts")), "mixcuts")
    part = F.size(F.filter("cuts", lambda c: c < F.col("__key"))).alias("part")
    parts = inside.join(fit(cuts), "__source").groupBy("__source", part).agg(F.sum("__size").alias("n"))
    last = edges(parts, "part", goal.join(edge, "__source").select("__source", "rest", "base"), "cut", "start")
    limit = goal.join(edge.select("__source", "b"), "__source", "left").join(cuts, "__source", "left").join(last, "__source", "left")
    none = F.array().cast("array<double>")
    limit = limit.withColumns({"b": F.coalesce("b", F.lit(BUCKETS)), "cuts": F.coalesce("cuts", none), "cut": F.coalesce("cut", F.lit(PARTS)), "start": F.coalesce("start", F.lit(0))})
    limit = written(limit.select("__source", "source_size", "target", "epochs", "rest", "b", "cuts", "cut", "start"), "mixlimits")
    # Names of the result stay clear of those of ``keep``.
    limit = limit.select("__source", *(F.col(c).alias(f"__{c}") for c in limit.columns[1:]))
    part = F.size(F.filter("__cuts", lambda c: c < F.col("__key")))
    rows = base.join(fit(limit), "__source").withColumn("__part", F.when(F.col("__bucket") == F.col("__b"), part))
    place = F.when(F.col("__bucket") != F.col("__b"), F.col("__bucket") < F.col("__b")).when(F.col("__part") != F.col("__cut"), F.col("__part") < F.col("__cut"))
    rows = rows.withColumn("__more", place.cast("long"))
    ranked = Window.partitionBy("__source").orderBy("__key", "__id", "__size").rowsBetween(Window.unboundedPreceding, 0)
    end = rows.where("__more is null").withColumn("__upto", F.sum("__size").over(ranked))
    end = end.withColumn("__more", (F.col("__start") + F.col("__upto") - F.col("__size") / 2 <= F.col("__rest")).cast("long")).drop("__upto")
    out = rows.where("__more is not null").unionByName(end)
    copies = F.col("__epochs") + F.col("__more")
    return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"), (copies * F.col("__size")).alias("taken"), *keep)
