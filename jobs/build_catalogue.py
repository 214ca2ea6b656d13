"""Builds the catalogue of services from captured web pages: records, checks, duplicates, search chunks and a report.

    python -m jobs.build_catalogue --pages IN --output OUT [--config jobs/build_catalogue.json]

``IN`` is a Parquet table of captures (page_id, url, html). A page's title, first paragraph and address become a record;
``domains`` of the configuration names the official domain that a host's last two labels stand for (a mirror of it), other
hosts stand for themselves. Below ``OUT``:

- ``accepted`` (the record's filled fields), partitioned by source_domain: valid records, one for each service. Of records
  with one address, or with one agency and title, the first by page_id stays.
- ``duplicates`` (service_id, kept_by, source_domain), partitioned by source_domain: the others, and whom they repeat.
- ``quarantined`` (service_id, title, url, errors), partitioned by reason (the first error without its details).
- ``chunks`` (chunk_id, service_id, text, embed_text), partitioned by lang and section: what a search index takes.
- ``report`` (one row): counts and dates of the build.

Every run writes all of it anew from the same captures, so a run that is repeated, or that follows one that broke off,
leaves the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, read_config
from tessera.functions.text import domain_of
from tessera.operators import chunks, kb
from tessera.sources.records import FIELDS
from tessera.storage import stored

DEFAULTS = {"date_collected": "2026-09-30T00:00:00Z", "domains": {"example.com": "my.gov.sa", "example.org": "absher.sa", "example.net": "example.net"}}
#: The character references that plain text needs.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def plain(html: Column) -> Column:
    for name, char in ENTITIES:
        html = F.replace(html, F.lit(name), F.lit(char))
    return html


def page_records(pages: DataFrame, conf: dict) -> DataFrame:
    """A record for each page with an id; fields that a page does not give are null."""
    host = domain_of(F.col("url"))
    base = F.substring_index(F.split_part(host, F.lit(":"), F.lit(1)), ".", -2)
    known = F.create_map(*(F.lit(x) for pair in conf["domains"].items() for x in pair)) if conf["domains"] else F.create_map().cast("map<string,string>")
    first = lambda tag: plain(F.nullif(F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1), F.lit("")))
    have = {
        "service_id": F.concat(F.lit("web-"), F.col("page_id").cast("string")), "source_type": F.lit("official_web_page"), "verification_status": F.lit("verified_official_capture"), "official_url_en": F.col("url"),
        "source_domain": F.coalesce(F.try_element_at(known, base), host), "title_en": first("title"), "description_en": first("p"), "agency_en": base, "date_collected": F.lit(conf["date_collected"]), "source_sha256": F.sha2("html", 256),
    }
    return pages.where("page_id is not null").select(F.col("page_id").alias("_order"), F.lit("pages").alias("_loader"), *(have.get(f, F.lit(None).cast("string")).alias(f) for f in FIELDS))


def run(spark: SparkSession, pages: str, output: str, config: str | None = None) -> dict:
    """Build the catalogue of all captures in ``pages``; returns what was read and written."""
    conf = read_config(spark, config, DEFAULTS)
    captures = spark.read.parquet(pages).select("page_id", "url", "html")
    loaded = page_records(captures, conf).dropDuplicates(["_order"])
    validated = stored(kb.validate(kb.normalize_records(loaded)), "validated")  # read by both branches, the duplicates and the report
    ok, bad = kb.split_valid(validated)
    unique, dropped = kb.deduplicate(ok.drop("errors", "warnings"))
    unique, dropped = stored(unique, "unique"), stored(dropped.select("service_id", "kept_by", "source_domain"), "dropped")

    def put(df: DataFrame, name: str, *by: str) -> int:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{output}/{name}")
        log.info("wrote %s/%s", output, name)
        return df.count()

    filled = ["service_id", "title_en", "description_en", "agency_en", "official_url_en", "date_collected", "source_sha256", "source_domain"]
    reason = F.trim(F.regexp_replace(F.get("errors", F.lit(0)), "[:'(].*", ""))
    done = {"read": captures.count(), "accepted": put(unique.select(*filled), "accepted", "source_domain"), "duplicates": put(dropped, "duplicates", "source_domain")}
    done["quarantined"] = put(bad.select("service_id", F.col("title_en").alias("title"), F.col("official_url_en").alias("url"), F.col("errors"), reason.alias("reason")), "quarantined", "reason")
    done["chunks"] = put(chunks.chunk_records(unique).select("chunk_id", "service_id", "text", "embed_text", "lang", "section"), "chunks", "lang", "section")
    totals = unique.agg(F.count("*").alias("records"), F.count_distinct("agency_en").alias("agencies"), F.count_distinct("source_domain").alias("domains"), F.min("date_collected").alias("first_collected"), F.max("date_collected").alias("last_collected"))
    totals.select("*", *(F.lit(v).alias(k) for k, v in done.items() if k != "accepted")).coalesce(1).write.mode("overwrite").json(f"{output}/report")
    log.info("read %s, wrote %s: %s", pages, output, done)
    return done


if __name__ == "__main__":
    main(run, "Catalogue of services from captured pages", {"pages": "Parquet table of captures", "output": "folder of the tables"})
