"""Catalogue views: lists with filters and pages, details, agency rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import missing, normalize_for_matching


def list_services(records: DataFrame, agency: str | None = None, search: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of services by id with ``total``; agency by code or name, search within normalised titles."""
    rows = records
    if agency:
        want = normalize_for_matching(F.lit(agency))
        rows = rows.where((F.lower(F.split_part("service_id", F.lit("-"), F.lit(1))) == F.lower(F.lit(agency))) | (normalize_for_matching(F.col("agency_en")) == want) | (normalize_for_matching(F.col("agency_ar")) == want))
    if search:
        hay = normalize_for_matching(F.concat_ws(" ", "title_en", "title_ar"))
        rows = rows.where(F.contains(hay, normalize_for_matching(F.lit(search))))
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy("service_id").offset(offset).limit(limit)
    short = lambda c: F.when(F.length(c) > 300, F.concat(F.left(c, F.lit(300)), F.lit("…"))).otherwise(F.col(c))
    return page.crossJoin(total).select("service_id", F.coalesce("title_en", "title_ar").alias("title"), F.coalesce("agency_en", "agency_ar").alias("agency"), F.coalesce(short("description_en"), short("description_ar")).alias("description"), "total")  # total is one row


def explore(records: DataFrame, keywords: str, agencies: list[str] | None = None) -> DataFrame:
    """Records whose titles and descriptions hold every keyword, in the chosen agencies."""
    hay = normalize_for_matching(F.concat_ws(" ", "title_en", "title_ar", "description_en", "description_ar"))
    words = F.filter(F.split(normalize_for_matching(F.lit(keywords)), " "), lambda w: w != "")
    rows = records.where(F.forall(words, lambda w: F.contains(hay, w)))
    return rows.where(F.coalesce("agency_en", "agency_ar").isin(*agencies)) if agencies else rows


def service_detail(records: DataFrame, service_id: str) -> DataFrame:
    """One service with a block of fields per language that has a title; ids of another form raise."""
    import re

    if not re.fullmatch(r"[a-z]{2,6}-[0-9a-z]{1,16}", service_id):
        raise ValueError("not a service id")
    block = lambda x: F.when(~missing(F.col(f"title_{x}")), F.struct(*(F.col(f"{f}_{x}").alias(f) for f in fixed.BILINGUAL))).alias(x)
    return records.where(F.col("service_id") == service_id).select("service_id", "source_domain", "service_channel", "contact_information", "date_collected", block("en"), block("ar"))


def agencies(records: DataFrame) -> DataFrame:
    """(code, name_en, name_ar, domain, services): most common names, smallest on ties; most services first."""
    code = F.split_part("service_id", F.lit("-"), F.lit(1))
    rows = records.withColumn("code", code)

    def common(name: str) -> DataFrame:
        return rows.where(F.col(name).isNotNull()).groupBy("code", name).agg(F.count("*").alias("n")).groupBy("code").agg(F.min_by(name, F.struct(-F.col("n"), F.col(name))).alias(name))

    base = rows.groupBy("code").agg(F.min_by("source_domain", "service_id").alias("domain"), F.count("*").alias("services"))
    out = base.join(common("agency_en"), "code", "left").join(common("agency_ar"), "code", "left")
    return out.select("code", F.col("agency_en").alias("name_en"), F.col("agency_ar").alias("name_ar"), "domain", "services").orderBy(F.desc("services"), "code")


def corpus_coverage(records: DataFrame) -> DataFrame:
    """(agency, records, with_arabic, with_english): by agency, and the total as the row without one."""
    agency = F.coalesce(*(F.when(~missing(F.col(c)), F.col(c)) for c in ("agency_en", "agency_ar")), F.lit(""))
    filled = lambda c: F.count_if(~missing(F.col(c)))
    rows = records.select(agency.alias("agency"), "title_ar", "title_en")
    return rows.rollup("agency").agg(F.count("*").alias("records"), filled("title_ar").alias("with_arabic"), filled("title_en").alias("with_english"))


def coverage_chart(coverage: DataFrame) -> DataFrame:
    """(field, n) as (field, lang, n): the language is the suffix of the name."""
    return coverage.select(F.regexp_replace("field", "_(en|ar)$", "").alias("field"), F.right("field", F.lit(2)).alias("lang"), "n")


def quarantine_view(quarantined: DataFrame) -> DataFrame:
    return quarantined.select(F.coalesce("title_en", "title_ar", F.lit("")).alias("title"), F.coalesce("official_url_en", "official_url_ar", F.lit("")).alias("url"), F.array_join("errors", "; ").alias("errors"))
