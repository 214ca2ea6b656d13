"""Records to labelled section chunks, their fingerprint and what has to be embedded anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import missing

COLUMNS = ["chunk_id", "service_id", "lang", "section", "text", "embed_text", "title", "agency", "category", "official_url"]


def _given(name: str) -> Column:
    return F.when(~missing(F.col(name)), F.col(name))


def chunk_records(records: DataFrame, titles: bool = True) -> DataFrame:
    """One row per record, language with a title, and filled section (a title chunk first)."""
    per = []
    for lang in ("en", "ar"):
        label = fixed.LABELS[lang]
        title, agency, category = _given(f"title_{lang}"), F.coalesce(_given(f"agency_{lang}"), F.lit("")), F.coalesce(_given(f"category_{lang}"), F.lit(""))
        url = F.coalesce(_given(f"official_url_{lang}"), _given("official_url_en"), _given("official_url_ar"))
        head = F.concat(title, F.lit(". "), agency, F.lit(". "), category)

        def chunk(section, text, embed, lang=lang, title=title, agency=agency, category=category, url=url):
            return F.struct(F.lit(lang).alias("lang"), F.lit(section).alias("section"), text.alias("text"), embed.alias("embed_text"), title.alias("title"), agency.alias("agency"), category.alias("category"), url.alias("official_url"))

        if titles:
            per.append(F.when(title.isNotNull(), chunk("title", title, F.regexp_replace(head, r"^[. ]+|[. ]+$", ""))))
        for section, names in fixed.SECTIONS:
            parts = [F.concat(F.lit(label[n] + ": "), _given(f"{n}_{lang}")) if len(names) > 1 else _given(f"{n}_{lang}") for n in names]
            text = F.nullif(F.array_join(F.array_compact(F.array(*parts)), "\n"), F.lit(""))
            per.append(F.when(title.isNotNull() & text.isNotNull(), chunk(section, text, F.concat(head, F.lit(f". {label[section]}: "), text))))
    rows = records.select("service_id", F.explode(F.array_compact(F.array(*per))).alias("c")).select("service_id", "c.*")
    return rows.withColumn("chunk_id", F.concat_ws("::", "service_id", "lang", "section")).select(*COLUMNS)


def assert_unique(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Raises where a key occurs twice; one shuffle on the key."""
    twice = chunks.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate {key}: {twice[0][0]}")
    return chunks


def fingerprint(chunks: DataFrame) -> str:
    """Order-free hash of all (chunk_id, embed_text): a sum of row hashes, so it is combined map-side at any size."""
    row = F.sha2(F.concat(F.col("chunk_id"), F.lit("\x00"), F.col("embed_text"), F.lit("\x01")), 256)
    halves = [F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16)]
    a, b, n = chunks.agg(*halves, F.count("*")).first()
    return f"{int(a or 0):x}-{int(b or 0):x}-{n}"


def to_embed(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct texts without a stored vector (stored: text hash, vector)."""
    texts = chunks.select("embed_text").distinct().withColumn("text_hash", F.sha2("embed_text", 256))
    return texts.join(stored.select("text_hash"), "text_hash", "left_anti")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and services by language and section, with totals (grouping sets)."""
    return chunks.cube("lang", "section").agg(F.count("*").alias("chunks"), F.count_distinct("service_id").alias("services"))
