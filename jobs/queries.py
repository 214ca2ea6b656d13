"""The jobs as queries over the driver's tables: each runs twice into one new folder, and what stands there is returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import build_catalogue, index_documents
from tessera.queries import normed, tok
from tessera.storage import new_folder


def row(df: DataFrame, part: str, id_: str, detail, n, m=0, x=0.0) -> DataFrame:
    """Rows of different tables in one form."""
    as_column = lambda v: v if not isinstance(v, (int, float)) else F.lit(v)
    return df.select(F.lit(part).alias("part"), F.col(id_).cast("string").alias("id"), detail.alias("detail"), as_column(n).cast("long").alias("n"), as_column(m).cast("long").alias("m"), as_column(x).cast("double").alias("x"))


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, rejects and term statistics that the stream left; the second run finds nothing new."""
    at = new_folder(spark, "job1")
    for _ in range(2):
        index_documents.run(spark, f"{sf_dir}/documents.parquet", f"{at}/out", f"{at}/checkpoint")
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{at}/out/{name}")
    documents = row(read("documents", f"{index_documents.DOCUMENTS}, batch long"), "document", "doc_id", F.col("language"), F.col("tokens"), F.col("batch"))
    rejected = row(read("rejected", f"{index_documents.REJECTED}, batch long"), "rejected", "doc_id", F.col("reason"), F.col("rows"), F.col("batch"))
    terms = row(read("terms", f"{index_documents.TERMS}, bucket int"), "term", "term", F.lit(""), F.col("df"), F.col("cf"), F.round("idf", 6))
    return documents.unionByName(rejected).unionByName(terms)


def job2_build_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of all pages: accepted, duplicates, quarantined and chunks."""
    at = new_folder(spark, "job2")
    for _ in range(2):
        build_catalogue.run(spark, f"{sf_dir}/pages.parquet", at)
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{at}/{name}")
    accepted = row(read("accepted", "service_id string, title_en string, description_en string"), "accepted", "service_id", F.col("title_en"), F.coalesce(F.length("description_en"), F.lit(0)))
    duplicates = row(read("duplicates", "service_id string, kept_by string"), "duplicate", "service_id", F.col("kept_by"), 0)
    quarantined = row(read("quarantined", "service_id string, errors array<string>"), "quarantined", "service_id", F.array_join("errors", "; "), F.size("errors"))
    chunks = row(read("chunks", "chunk_id string, text string, embed_text string"), "chunk", "chunk_id", F.md5(F.col("embed_text").cast("binary")), F.length("text"))
    return accepted.unionByName(duplicates).unionByName(quarantined).unionByName(chunks)


_RATIO = r"""(SELECT CASE WHEN ar + la > 0 THEN ar / CAST(ar + la AS DOUBLE) ELSE 0.0 END FROM (SELECT length(regexp_replace(text, '[^\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]', '', 'g')) AS ar, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS la))"""
JOB1_SQL = f"""
WITH d AS (SELECT doc_id, text, {tok("text")} AS tk, sha256(text) AS digest, {_RATIO} AS r FROM documents),
f AS (SELECT *, CASE WHEN doc_id IS NULL THEN 'no id' WHEN coalesce(len(tk), 0) = 0 THEN 'no terms' END AS reason FROM d),
v AS (SELECT doc_id, min(digest) AS digest FROM f WHERE reason IS NULL GROUP BY doc_id),
u AS (SELECT v.doc_id, any_value(tk) AS tk, any_value(r) AS r FROM f JOIN v ON f.doc_id = v.doc_id AND f.digest = v.digest WHERE reason IS NULL GROUP BY v.doc_id),
t AS (SELECT doc_id, unnest(tk) AS term FROM u),
s AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term)
SELECT 'document' AS part, CAST(doc_id AS VARCHAR) AS id, CASE WHEN r >= 0.7 THEN 'ar' WHEN r <= 0.3 THEN 'en' ELSE 'mixed' END AS detail, CAST(len(tk) AS BIGINT) AS n, CAST(0 AS BIGINT) AS m, CAST(0 AS DOUBLE) AS x FROM u
UNION ALL SELECT 'rejected', CAST(doc_id AS VARCHAR), reason, count(*), CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM f WHERE reason IS NOT NULL GROUP BY doc_id, reason
UNION ALL SELECT 'term', term, '', df, cf, round(ln(1 + ((SELECT count(*) FROM u) - df + 0.5) / (df + 0.5)), 6) FROM s
"""


def _plain(x: str) -> str:
    for name, char in build_catalogue.ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _cleaned(x: str) -> str:
    """Lines trimmed, single spaces, no empty lines, composed; zero-width marks go and no-break spaces are spaces."""
    x = rf"replace(regexp_replace(nfc_normalize({x}), '[\x{{200B}}-\x{{200F}}\x{{FEFF}}]', '', 'g'), chr(160), ' ')"
    return rf"nullif(array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '\r\n|\r|\n'), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)), '')"


_DOMAINS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in build_catalogue.DEFAULTS["domains"].items())
JOB2_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, any_value(url) AS url, any_value(html) AS html FROM pages WHERE page_id IS NOT NULL GROUP BY page_id),
h AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS host FROM p),
b AS (SELECT *, regexp_extract(split_part(host, ':', 1), '([^.]*\.)?[^.]*$') AS base, 'web-' || page_id AS service_id,
  {_cleaned(_plain("nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '')"))} AS title, {_cleaned(_plain("nullif(regexp_extract(html, '<p>([^<]*)</p>', 1), '')"))} AS descr FROM h),
r AS (SELECT *, CASE base {_DOMAINS} ELSE host END AS domain, length(regexp_replace(coalesce(descr, ''), '[^\p{{L}}]', '', 'g')) >= 15 AS content FROM b),
v AS (SELECT *, list_filter([CASE WHEN title IS NULL THEN 'missing title (en and ar)' END, CASE WHEN NOT content THEN 'no official content (description/steps/requirements/documents)' END,
    CASE WHEN nullif(trim(url), '') IS NULL THEN 'missing official_url' END, CASE WHEN nullif(trim(url), '') IS NOT NULL AND NOT (scheme = 'https' AND host <> '') THEN 'invalid official_url_en: ''' || url || '''' END,
    CASE WHEN coalesce(domain, '') NOT IN ('my.gov.sa', 'absher.sa') AND NOT ends_with(coalesce(domain, ''), '.gov.sa') AND NOT ends_with(coalesce(domain, ''), '.edu.sa') THEN 'source_domain not an official Saudi domain: ' || coalesce('''' || domain || '''', 'None') END,
    CASE WHEN html IS NULL THEN 'verified record without source_sha256' END], lambda x: x IS NOT NULL) AS errors FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY page_id) AS i, replace(regexp_replace(lower(url), '/+$', ''), '://www.', '://') AS u, {normed("base || '|' || title")} AS t FROM v WHERE len(errors) = 0),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS us, CAST([] AS VARCHAR[]) AS ts, CAST([] AS VARCHAR[]) AS names, CAST(NULL AS VARCHAR) AS by_, CAST(NULL AS VARCHAR) AS id
  UNION ALL SELECT o.i, CASE WHEN k IS NULL THEN list_append(us, u) ELSE us END, CASE WHEN k IS NULL THEN list_append(ts, t) ELSE ts END, CASE WHEN k IS NULL THEN list_append(names, service_id) ELSE names END, k, service_id
  FROM (SELECT o.i, us, ts, names, u, t, service_id, coalesce(names[list_position(us, u)], names[list_position(ts, t)]) AS k FROM g JOIN o ON o.i = g.i + 1) AS o),
a AS (SELECT v.* FROM v JOIN g ON g.id = v.service_id WHERE by_ IS NULL),
w AS (SELECT *, title || '. ' || base || '. ' AS head FROM a),
c AS (SELECT service_id || '::en::title' AS chunk_id, title AS text, regexp_replace(head, '^[. ]+|[. ]+$', '', 'g') AS embed FROM w UNION ALL SELECT service_id || '::en::overview', descr, head || '. Overview: ' || descr FROM w WHERE descr IS NOT NULL)
SELECT 'accepted' AS part, service_id AS id, title AS detail, CAST(coalesce(length(descr), 0) AS BIGINT) AS n, CAST(0 AS BIGINT) AS m, CAST(0 AS DOUBLE) AS x FROM a
UNION ALL SELECT 'duplicate', id, by_, 0, 0, 0 FROM g WHERE by_ IS NOT NULL
UNION ALL SELECT 'quarantined', service_id, array_to_string(errors, '; '), len(errors), 0, 0 FROM v WHERE len(errors) > 0
UNION ALL SELECT 'chunk', chunk_id, md5(embed), length(text), 0, 0 FROM c
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_index_documents": job1_index_documents, "job2_build_catalogue": job2_build_catalogue}
SQL = {"job1_index_documents": JOB1_SQL, "job2_build_catalogue": JOB2_SQL}
