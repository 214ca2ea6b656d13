"""The record schema and readers of record files: canonical CSV, seed CSV, JSON, JSON lines, open data, saved pages.

Every reader takes (spark, path) and returns records with the full schema and an ``_order`` for first-wins rules.
Column sets come from headers on the driver; rows are only read by executors.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.text import clean_text, domain_of
from .html import title_and_text
from .xlsx import read_sheet

FIELDS = [*fixed.PLAIN, *(f"{f}_{lang}" for f in fixed.BILINGUAL for lang in ("en", "ar"))]
SCHEMA = T.StructType([*(T.StructField(f, T.StringType()) for f in FIELDS), T.StructField("extra", T.StringType())])


def conform(df: DataFrame, loader: str) -> DataFrame:
    """Known columns in schema order as strings, unknown ones dropped, missing ones null; order of the input kept."""
    have = set(df.columns)
    order = F.col("_order") if "_order" in have else F.monotonically_increasing_id()
    return df.select(*((F.col(f).cast("string") if f in have else F.lit(None).cast("string")).alias(f) for f in [*FIELDS, "extra"]), F.lit(loader).alias("_loader"), order.alias("_order"))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; a byte-order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"', inferSchema=False)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def read_canonical_csv(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    unknown = [c for c in df.columns if c not in FIELDS and c != "extra"]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    return conform(df, "canonical_csv")


def read_seed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Hand-written seed rows; never indexable."""
    df = _csv(spark, path)
    arabic = F.lower(F.coalesce("language", F.lit("en"))).startswith("ar") if "language" in df.columns else F.lit(False)
    slot = {f"{f}_{x}": F.when(arabic if x == "ar" else ~arabic, F.col(c)) for f, c in (("title", "title"), ("agency", "agency"), ("category", "category"), ("description", "description"), ("official_url", "official_url")) if c in df.columns for x in ("en", "ar")}
    rows = df.select(F.concat(F.lit("seed-"), F.col("service_id")).alias("service_id"), F.lit("seed_manual_summary").alias("source_type"), F.lit("unverified").alias("verification_status"), domain_of(F.col("official_url")).alias("source_domain"), F.lit("Development seed: a manual summary that is not traceable to captured official text.").alias("provenance_notes"), *(v.alias(k) for k, v in slot.items()))
    return conform(rows, "seed_csv")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or one JSON document that is a list or ``{"records": [...]}``. ``extra`` stays JSON text."""
    if path.endswith(".jsonl"):
        rows = spark.read.text(path).select(F.col("value").alias("v")).where(F.trim("v") != "")
        rows = rows.withColumn("_order", F.monotonically_increasing_id())
    else:
        whole = spark.read.text(path, wholetext=True)
        inner = F.coalesce(F.get_json_object("value", "$.records"), F.col("value"))
        rows = whole.select(F.posexplode(F.from_json(inner, "array<string>")).alias("_order", "v"))
    got = rows.select("_order", *(F.get_json_object("v", f"$.{f}").alias(f) for f in [*FIELDS, "extra"]))
    return conform(got, "json")


def load_services(spark: SparkSession, path: str) -> DataFrame:
    """A built knowledge base: the last of repeated ids wins."""
    df = read_json(spark, path)
    rest = [c for c in df.columns if c != "service_id"]
    return df.groupBy("service_id").agg(F.max_by(F.struct(*rest), "_order").alias("r")).select("service_id", "r.*").select(*df.columns)


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def read_open_data(spark: SparkSession, path: str, mapping: str | dict | None = None) -> DataFrame:
    """An official CSV, JSON or XLSX download with a column map ``{columns, id_column, dataset_url, downloaded_at, license}``.

    The map is a dict or ``<stem>.map.json`` beside the file. A target that is no record field raises.
    """
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    spec = mapping if isinstance(mapping, dict) else json.loads(_text(spark, mapping or path.rsplit(".", 1)[0] + ".map.json"))
    unknown = [t for t in spec["columns"].values() if t not in FIELDS]
    if unknown:
        raise ValueError(f"unknown target fields: {unknown}")
    if path.endswith(".csv"):
        df = _csv(spark, path)
    elif path.endswith(".json"):
        df = spark.read.json(path, multiLine=True)
        df = df.select(F.explode("records").alias("r")).select("r.*") if df.columns == ["records"] else df
    else:
        cells = read_sheet(spark, path)
        df = cells.select(*(F.col("cells")[name].alias(name) for name in dict.fromkeys([spec["id_column"], *spec["columns"]])))
    digest = F.lit(None).cast("string")
    raw = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()
    if raw:
        digest = F.lit(raw[0])
    rows = df.select(
        F.concat(F.lit(f"od-{stem}-"), F.col(spec["id_column"]).cast("string")).alias("service_id"), F.lit("official_open_data").alias("source_type"),
        F.lit("verified_official_capture").alias("verification_status"), domain_of(F.lit(spec.get("dataset_url"))).alias("source_domain"), F.lit(spec.get("downloaded_at")).alias("date_collected"),
        F.col(spec["id_column"]).cast("string").alias("source_record_id"), digest.alias("source_sha256"), F.lit(f"Official open data, licence {spec.get('license')}.").alias("provenance_notes"),
        *(F.col(src).cast("string").alias(dst) for src, dst in spec["columns"].items() if dst not in ("service_id", "source_type", "verification_status", "source_domain", "date_collected", "source_record_id", "source_sha256", "provenance_notes")),
    )
    return conform(rows, "open_data")


def read_saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``<stem>.meta.json`` beside ``<stem>.html``, ``.htm`` or ``.txt``; pages of one service key become one record."""
    stem = lambda suffix: F.regexp_extract(F.col("path"), rf"([^/]+?){suffix}$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,html,htm,txt}").load(folder)
    meta = files.where(F.endswith("path", F.lit(".meta.json"))).select(stem(r"\.meta\.json").alias("stem"), F.col("content").cast("string").alias("m"))
    keys = ["lang", "official_url", "agency", "date_saved", "saved_by", "service_key", "title"]
    meta = meta.select("stem", *(F.get_json_object("m", f"$.{k}").alias(k) for k in keys))
    suffix = F.regexp_extract("path", r"\.(html|htm|txt)$", 1)
    pages = files.where(suffix != "").select(stem(r"\.(?:html|htm|txt)").alias("stem"), suffix.alias("kind"), "content")
    first = pages.withColumn("p", F.array_position(F.array(F.lit("html"), F.lit("htm"), F.lit("txt")), F.col("kind")))
    page = first.groupBy("stem").agg(F.min_by(F.struct("kind", "content"), "p").alias("f")).select("stem", "f.*")
    rows = meta.join(page, "stem").withColumn("html", F.col("content").cast("string"))
    rows = rows.withColumn("parsed", title_and_text(F.when(F.col("kind") != "txt", F.col("html"))))
    rows = rows.withColumn("page_title", F.coalesce("title", "parsed.title")).withColumn("body", F.when(F.col("kind") == "txt", clean_text(F.col("html"))).otherwise(F.col("parsed.text")))
    rows = rows.withColumn("key", F.coalesce("service_key", "stem")).withColumn("sha", F.concat("lang", F.lit(":"), F.sha2("content", 256)))
    at = lambda c, x: F.max_by(F.when(F.col("lang") == x, F.col(c)), F.when(F.col("lang") == x, F.col("stem")))
    sides = [at(c, x).alias(f"{f}_{x}") for f, c in (("title", "page_title"), ("agency", "agency"), ("description", "body"), ("official_url", "official_url")) for x in ("en", "ar")]
    out = rows.groupBy("key").agg(
        *sides, domain_of(F.min_by("official_url", "stem")).alias("source_domain"), F.min_by("date_saved", "stem").alias("date_collected"),
        F.concat(F.lit("Saved from an official page by "), F.coalesce(F.min_by("saved_by", "stem"), F.lit("a person")), F.lit(".")).alias("provenance_notes"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stem", "sha"))), lambda s: s["sha"]), ";").alias("source_sha256"), F.min("stem").alias("_stem"),
    )
    out = out.select("*", F.concat(F.lit("manual-"), F.col("key")).alias("service_id"), F.lit("manual_saved_page").alias("source_type"), F.lit("verified_official_capture").alias("verification_status"), F.xxhash64("_stem").alias("_order"))
    return conform(out, "saved_pages")


LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"canonical_csv": read_canonical_csv, "seed_csv": read_seed_csv, "json": read_json, "open_data": read_open_data, "saved_pages": read_saved_pages}


def register_loader(name: str, load: Callable[[SparkSession, str], DataFrame]) -> None:
    """Plug in a reader; it returns rows that ``conform`` accepts."""
    LOADERS[name] = load


def load_all(spark: SparkSession, inputs: list[tuple[str, str]]) -> DataFrame:
    """Union of (loader name, path) inputs; earlier inputs come first in ``_order``."""
    out = None
    for k, (name, path) in enumerate(inputs):
        df = LOADERS[name](spark, path)
        df = df.withColumn("_order", F.struct(F.lit(k).alias("input"), F.col("_order").cast("long").alias("row")))
        out = df if out is None else out.unionByName(df)
    return out


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark questions from CSV: all columns as text, blanks kept, ``supported`` and ``fresh`` as numbers."""
    df = _csv(spark, path)
    df = df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in df.columns))
    out = df.withColumn("supported", F.col("supported").cast("int"))
    return out.withColumn("fresh", F.coalesce(F.nullif("fresh", F.lit("")), F.lit("0")).cast("int")) if "fresh" in df.columns else out


#: Where a raw folder keeps what each loader reads, in loading order.
PLACES = [
    ("catalogue", "official/*/*_services_capture.json"), ("labelled_pages", "official/v2/*.json"), ("guide", "official/*/*_guide_capture.json"),
    ("saved_pages", "manual"), ("open_data", "open_data"), ("seed_csv", "seed/services_seed_v0.csv"),
]


def discover(spark: SparkSession, raw: str, places: list[tuple[str, str]] = PLACES) -> list[tuple[str, str]]:
    """(loader, path) of what lies below ``raw``. A file named like another one with ``_tag`` added supplements that one
    and is left to its loader."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for loader, place in places:
        pattern = jvm.org.apache.hadoop.fs.Path(f"{raw.rstrip('/')}/{place}")
        found = sorted(str(x.getPath().toString()) for x in pattern.getFileSystem(conf).globStatus(pattern) or [])
        stems = [path.removesuffix(".json") + "_" for path in found]
        out += [(loader, path) for path in found if not any(path.startswith(s) for s in stems if path != s[:-1] + ".json")]
    return out
