"""Queries of the library's operators over the driver's tables, each with SQL where SQL can express it.

Documents play the records (source is the service or agency), benchmark passages the questions, conversations the short
chunks and follow-ups, pages the captures. Every query reads its whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import fixed, rules, text
from .functions.vectors import trigram_encoder
from .operators import answer, catalog, chunks, claims, evaluate, index, kb, retrieve, scan, textscan
from .sources import pages as page_sources
from .sources.html import title_and_text
from .sources.records import FIELDS
from .storage import built, spread, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


#: Tables of texts: most of their queries' work is per row, so a single small file is dealt out first.
TEXTS = {"documents", "pages", "conversations"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name in TEXTS else df


# --- SQL blocks ------------------------------------------------------------------------------------------------------------


def tok(x: str) -> str:
    """Search tokens of Latin text."""
    stops = ", ".join(f"'{w}'" for w in fixed.STOP_EN)
    return f"""list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: NOT list_contains([{stops}], t)), lambda t:
      CASE WHEN length(t) > 5 AND ends_with(t, 'ing') THEN left(t, length(t) - 3) WHEN length(t) > 4 AND ends_with(t, 'ed') THEN left(t, length(t) - 2)
      WHEN length(t) > 4 AND ends_with(t, 'es') THEN left(t, length(t) - 2) WHEN length(t) > 3 AND ends_with(t, 's') THEN left(t, length(t) - 1) ELSE t END)"""


def normed(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


BM25 = f"""toks AS (SELECT doc_id, source, {tok("text")} AS tk FROM documents),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(tk)) AS avgdl FROM toks),
tf AS (SELECT doc_id, source, term, CAST(count(*) AS DOUBLE) AS tf, CAST(any_value(dl) AS DOUBLE) AS dl FROM (SELECT doc_id, source, len(tk) AS dl, unnest(tk) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
post AS (SELECT doc_id, source, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM tf JOIN dfs USING (term), tot),
q AS (SELECT item_id AS query_id, unnest(list_distinct({tok("text")})) AS term FROM benchmark),
bm AS (SELECT query_id, doc_id, source, round(sum(w), 6) AS score FROM q JOIN post USING (term) GROUP BY ALL)"""

EVAL = f"""{BM25},
best AS (SELECT query_id, source, max(score) AS b FROM bm GROUP BY ALL),
ranked AS (SELECT query_id, source, round(b / (b + 6.0), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, source) AS rank FROM best),
ev AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 1 END AS supported, item_id % 7 AS family, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS style,
  (SELECT score FROM ranked r WHERE r.query_id = item_id AND r.rank = 1) AS top_score, (SELECT source FROM ranked r WHERE r.query_id = item_id AND r.rank = 1) AS top1,
  CASE WHEN item_id % 3 <> 0 THEN (SELECT rank FROM ranked r WHERE r.query_id = item_id AND r.source = 'src' || (item_id % 20) AND r.rank <= 10) END AS rank FROM benchmark)"""

CHUNKS = "c AS (SELECT conv_id * 100 + turn AS chunk_id, conv_id AS service_id, turn, role, text FROM conversations)"


def grams(x: str) -> str:
    """Character n-grams (3 to 5) of padded words."""
    word = "' ' || w || ' '"
    each = " ".join(f"|| CASE WHEN {n} = 3 OR length({word}) >= {n} THEN list_transform(range(1, greatest(length({word}) - {n - 1}, 1) + 1), lambda i: substr({word}, CAST(i AS INTEGER), {n})) ELSE [] END" for n in (3, 4, 5))
    return f"flatten(list_transform(list_filter(string_split({normed(x)}, ' '), lambda w: w <> ''), lambda w: CAST([] AS VARCHAR[]) {each}))"


TFIDF = f"""{CHUNKS},
gtf AS (SELECT chunk_id, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT chunk_id, unnest({grams("text")}) AS term FROM c) GROUP BY ALL),
gidf AS (SELECT term, ln((1 + (SELECT count(*) FROM c)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM gtf GROUP BY term),
gw AS (SELECT chunk_id, term, (1 + ln(tf)) * idf AS w FROM gtf JOIN gidf USING (term)),
gp AS (SELECT chunk_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS w FROM gw),
qtf AS (SELECT query_id, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT item_id AS query_id, unnest({grams("text")}) AS term FROM benchmark) GROUP BY ALL),
qw AS (SELECT query_id, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN gidf USING (term)),
qp AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM qw),
chars AS (SELECT query_id, chunk_id, sum(qp.w * gp.w) AS score FROM qp JOIN gp USING (term) GROUP BY ALL)"""


def trigrams(table_: str, key: str) -> str:
    t = f"(' ' || {normed('text')} || ' ')"
    b = f"SELECT {key} AS k, unnest(list_transform(range(1, greatest(length({t}) - 2, 1) + 1), lambda i: CAST(('0x' || substr(md5(substr({t}, CAST(i AS INTEGER), 3)), 31, 2)) AS INTEGER))) AS bucket FROM {table_}"
    return f"SELECT k, bucket, count(*) / sqrt(sum(CAST(count(*) AS DOUBLE) * count(*)) OVER (PARTITION BY k)) AS w FROM ({b}) GROUP BY k, bucket"


SIGNALS = f"""{TFIDF},
ctok AS (SELECT chunk_id, {tok("text")} AS tk FROM c),
ctot AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(tk)) AS avgdl FROM ctok),
ctf AS (SELECT chunk_id, term, CAST(count(*) AS DOUBLE) AS tf, CAST(any_value(dl) AS DOUBLE) AS dl FROM (SELECT chunk_id, len(tk) AS dl, unnest(tk) AS term FROM ctok) GROUP BY ALL),
cdf AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM ctf GROUP BY term),
cpost AS (SELECT chunk_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM ctf JOIN cdf USING (term), ctot),
cq AS (SELECT item_id AS query_id, unnest(list_distinct({tok("text")})) AS term FROM benchmark),
cbm AS (SELECT query_id, chunk_id, sum(w) AS score FROM cq JOIN cpost USING (term) GROUP BY ALL),
td AS ({trigrams("c", "chunk_id")}),
tq AS ({trigrams("benchmark", "item_id")}),
dense AS (SELECT tq.k AS query_id, td.k AS chunk_id, sum(tq.w * td.w) AS score FROM tq JOIN td USING (bucket) GROUP BY ALL),
sig AS (SELECT query_id, chunk_id, round(sum(d), 6) AS dense, round(sum(h), 6) AS char, round(sum(b), 6) AS bm25 FROM (
  SELECT query_id, chunk_id, score AS d, 0.0 AS h, 0.0 AS b FROM dense UNION ALL SELECT query_id, chunk_id, 0.0, score, 0.0 FROM chars UNION ALL SELECT query_id, chunk_id, 0.0, 0.0, score / (score + 6.0) FROM cbm) GROUP BY ALL)"""

# --- frames ----------------------------------------------------------------------------------------------------------------


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def document_postings(spark: SparkSession, d: str) -> DataFrame:
    """BM25 postings of all documents, in the order of documents as they are read by key."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return built(spark, f"{d}/documents.parquet", "documents-bm25", lambda: index.bm25_postings(docs, "doc_id", "text").sortWithinPartitions("term"))


def document_terms(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, terms): token hashes of all documents, made once from their files."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return built(spark, f"{d}/documents.parquet", "documents-terms", lambda: textscan.token_rows(docs, "doc_id", "source"))


def best_documents(spark: SparkSession, d: str, k: int, last: bool = False) -> DataFrame:
    """(query_id, source, doc_id, score, rank): the k best documents of every source by BM25; with ``last``, ties go to larger ids."""
    rows = document_terms(spark, d)
    if not last:
        return textscan.best_in_groups(rows, questions(spark, d), k, "doc_id", "source", digits=6)
    best = textscan.best_in_groups(rows.withColumn("doc_id", -F.col("doc_id")), questions(spark, d), k, "doc_id", "source", digits=6)
    return best.withColumn("doc_id", -F.col("doc_id"))


def source_ranking(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, service_id, score, rank) of all sources by their best document; stored, since plans read it several times."""
    best = stored(best_documents(spark, d, 1).withColumnRenamed("score", "b"), "best")
    order = Window.partitionBy("query_id").orderBy(F.desc("b"), "source")
    return best.select("query_id", F.col("source").alias("service_id"), F.round(F.col("b") / (F.col("b") + 6), 6).alias("score"), F.row_number().over(order).alias("rank"))


def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    """Per-question results: the expected source of item i is src(i mod 20), every third item is unsupported."""
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, 0).otherwise(1).alias("supported"), (F.col("item_id") % 7).alias("family"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("style"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("expected_service_id"), F.lit("").alias("acceptable_service_ids"))
    hits = source_ranking(spark, d)
    rank = evaluate.first_relevant_rank(hits.where("rank <= 10"), evaluate.relevant_ids(bench.where("supported = 1")))
    top = hits.where("rank = 1").select("query_id", F.col("score").alias("top_score"), F.col("service_id").alias("top1_service_id"))
    return bench.join(top, "query_id", "left").join(rank, "query_id", "left")


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("service_id"), "turn", "role", "text")


def searchable(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The index of the chunks as searches take it: the first turn of a conversation is its title."""
    c = chunk_rows(spark, d).withColumn("lang", F.lit("en")).withColumn("section", F.when(F.col("turn") == 0, "title").otherwise("overview")).withColumn("title", F.col("text"))
    c = c.select("chunk_id", "service_id", "lang", "section", "title", "text")
    have = retrieve.text_rows(c, lambda name, make: built(spark, f"{d}/conversations.parquet", f"chunks-{name}", make))
    return have | {"query_trigrams": trigram_encoder(questions(spark, d), "query_id", "query")}


def chunk_signals(spark: SparkSession, d: str) -> DataFrame:
    q, have = questions(spark, d), searchable(spark, d)
    return scan.all_signals(have["rows"].where("first"), q, retrieve.query_signals(q, have, ["dense", "char", "bm25"]), digits=6)


def page_records(spark: SparkSession, d: str) -> DataFrame:
    """Pages as records: title and paragraph by pattern, provenance missing on every seventh page."""
    have = {
        "service_id": F.concat(F.lit("pg-"), F.col("page_id").cast("string")), "source_type": F.lit("official_web_page"), "verification_status": F.when(F.col("page_id") % 5 == 0, "unverified").otherwise("verified_official_capture"),
        "source_domain": F.when(F.col("page_id") % 2 == 0, "my.gov.sa").otherwise(text.domain_of(F.col("url"))), "official_url_en": F.col("url"), "title_en": F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("")),
        "description_en": F.nullif(F.trim(F.regexp_extract("html", "<p>([^<]*)</p>", 1)), F.lit("")), "date_collected": F.when(F.col("page_id") % 7 != 0, "2026-09-30T10:00:00Z"), "source_sha256": F.sha2("html", 256),
        "agency_en": F.concat(F.lit("agency "), (F.col("page_id") % 9).cast("string")),
    }
    return table(spark, d, "pages").select(F.col("page_id").alias("_order"), F.lit("pages").alias("_loader"), *((have[f] if f in have else F.lit(None).cast("string")).alias(f) for f in FIELDS))


PAGES = r"""pr AS (SELECT page_id, 'pg-' || page_id AS service_id, url, CASE WHEN page_id % 5 = 0 THEN 'unverified' ELSE 'verified_official_capture' END AS status,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS host,
  nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, nullif(trim(regexp_extract(html, '<p>([^<]*)</p>', 1)), '') AS descr, page_id % 7 <> 0 AS dated, 'agency ' || (page_id % 9) AS agency FROM pages),
pd AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'my.gov.sa' ELSE host END AS domain, length(regexp_replace(coalesce(descr, ''), '[^\p{L}]', '', 'g')) >= 15 AS content FROM pr),
pv AS (SELECT *, list_filter([CASE WHEN title IS NULL THEN 'missing title (en and ar)' END, CASE WHEN NOT content THEN 'no official content (description/steps/requirements/documents)' END,
    CASE WHEN NOT (scheme = 'https' AND host <> '') THEN 'invalid official_url_en: ''' || url || '''' END,
    CASE WHEN NOT (domain IN ('my.gov.sa', 'absher.sa') OR ends_with(domain, '.gov.sa') OR ends_with(domain, '.edu.sa')) THEN 'source_domain not an official Saudi domain: ''' || domain || '''' END,
    CASE WHEN status = 'unverified' THEN 'verification_status ''unverified'' is not indexable' END, CASE WHEN status = 'verified_official_capture' AND NOT dated THEN 'verified record without date_collected' END], lambda x: x IS NOT NULL) AS errors,
  list_filter([CASE WHEN content AND descr IS NULL THEN 'no description (other official fields present)' END, 'no official Arabic text', CASE WHEN title IS NULL THEN 'no official English text' END], lambda x: x IS NOT NULL) AS warnings FROM pd)"""


def doc_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records of agencies (sources)."""
    have = {
        "service_id": F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string")), "title_en": F.concat(F.lit("Document "), F.col("doc_id").cast("string")), "agency_en": F.col("source"), "category_en": F.when(F.col("lang") != "en", F.col("lang")),
        "description_en": F.col("text"), "fees_en": F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("n_chars").cast("string"), F.lit(" riyals"))), "target_audience_en": F.when(F.col("doc_id") % 4 == 0, F.col("lang")), "source_domain": F.concat(F.col("source"), F.lit(".gov.sa")),
        "official_url_en": F.concat(F.lit("https://"), F.col("source"), F.lit(".gov.sa/"), F.col("doc_id").cast("string")),
    }
    return table(spark, d, "documents").select(F.col("doc_id").alias("_order"), *((have[f] if f in have else F.lit(None).cast("string")).alias(f) for f in FIELDS))


DOCS = """r AS (SELECT doc_id, source || '-' || doc_id AS service_id, 'Document ' || doc_id AS title, source AS agency, CASE WHEN lang <> 'en' THEN lang ELSE '' END AS category, text AS descr,
  CASE WHEN doc_id % 3 = 0 THEN n_chars || ' riyals' END AS fees, CASE WHEN doc_id % 4 = 0 THEN lang END AS audience, 'https://' || source || '.gov.sa/' || doc_id AS url FROM documents),
head AS (SELECT *, title || '. ' || agency || '. ' || category AS h FROM r),
ch AS (SELECT service_id || '::en::title' AS chunk_id, service_id, 'title' AS section, title AS text, trim(h, '. ') AS embed_text FROM head
  UNION ALL SELECT service_id || '::en::overview', service_id, 'overview', descr, h || '. Overview: ' || descr FROM head WHERE nullif(trim(descr), '') IS NOT NULL
  UNION ALL SELECT service_id || '::en::service_facts', service_id, 'service_facts', f, h || '. Fees & service details: ' || f FROM (SELECT *, concat_ws(chr(10), 'Fees: ' || fees, 'Beneficiaries: ' || audience) AS f FROM head) WHERE f <> '')"""

# --- text ------------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tk)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {tok('text')} AS tk FROM documents)")
def token_counts(spark, d):
    t = text.tokenize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, md5(n) AS digest, CAST(length(n) AS BIGINT) AS chars FROM (SELECT doc_id, {normed('text')} AS n FROM documents)")
def normalize_text(spark, d):
    n = text.normalize_for_matching(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("n")).select("doc_id", F.md5(F.col("n").cast("binary")).alias("digest"), F.length("n").cast("long").alias("chars"))


@query(r"SELECT doc_id, md5(t) AS digest FROM (SELECT doc_id, nullif(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)), '') AS t FROM documents)")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_text(F.col("text")).cast("binary")).alias("digest"))


ARABIC_CASES = ["إصدار أمر آخر", "تِجَارَة", "٥٠٠ ريال", "اسماً تجارياً", "renew السجل التجاري online", "Trade-Name   Reservation!"]


@query("WITH t AS (SELECT text FROM conversations UNION ALL SELECT unnest([" + ", ".join(lit(x) for x in ARABIC_CASES) + r"""])),
r AS (SELECT text, length(regexp_replace(text, '[^\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]', '', 'g')) AS ar, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS la FROM t),
s AS (SELECT *, CASE WHEN ar + la > 0 THEN ar / CAST(ar + la AS DOUBLE) ELSE 0.0 END AS x FROM r)
SELECT md5(text) AS digest, CAST(round(x, 6) AS DOUBLE) AS ratio, CASE WHEN x >= 0.7 THEN 'ar' WHEN x <= 0.3 THEN 'en' ELSE 'mixed' END AS language, CASE WHEN x >= 0.5 THEN 'ar' ELSE 'en' END AS ui FROM s""")
def language_ratio(spark, d):
    extra = spark.createDataFrame([(x,) for x in ARABIC_CASES], "text string")
    t = table(spark, d, "conversations").select("text").unionByName(extra)
    c = F.col("text")
    return t.select(F.md5(c.cast("binary")).alias("digest"), F.round(text.arabic_ratio(c), 6).alias("ratio"), text.detect_language(c).alias("language"), text.query_language(c).alias("ui"))


INTENT_CASES = ["كم رسوم تجديد السجل؟", "What documents do I need for a visa?", "how long does it take", "شروط الاستقدام", "renew my CR", "delete the commercial record", "book a name", "the crane operator", "كيف اطلع سجل تجاري", "فقدت الاقامه وش اسوي"]
_INTENT = " ".join(f"WHEN regexp_matches(n, {lit(p)}) THEN '{k}'" for k, p in fixed.INTENTS)
_WITH_CASES = "t AS (SELECT text FROM conversations UNION ALL SELECT unnest([" + ", ".join(lit(x) for x in INTENT_CASES) + "]))"


def _with_cases(spark, d):
    return table(spark, d, "conversations").select("text").unionByName(spark.createDataFrame([(x,) for x in INTENT_CASES], "text string"))


# SQL has no Arabic folding here: the cases hold folded letters, but for question marks that normalising drops.
@query(f"WITH {_WITH_CASES}, m AS (SELECT text, {normed('text')} AS n FROM t) SELECT md5(text) AS digest, CASE {_INTENT} ELSE 'general' END AS intent FROM m")
def intent_detect(spark, d):
    return _with_cases(spark, d).select(F.md5(F.col("text").cast("binary")).alias("digest"), rules.detect_intent(F.col("text")).alias("intent"))


def _sql_actions(tbl: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(n, {lit(p)}) THEN '{a}' END" for a, p in tbl) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {_WITH_CASES}, m AS (SELECT text, ' ' || {normed('text')} || ' ' AS n FROM t), s AS (SELECT text, {_sql_actions(fixed.ACTIONS_STRONG)} AS st, {_sql_actions(fixed.ACTIONS_WEAK)} AS wk FROM m) SELECT md5(text) AS digest, array_to_string(CASE WHEN len(st) > 0 THEN st ELSE wk END, ',') AS actions, len(st) > 0 AS strong FROM s")
def action_detect(spark, d):
    a = rules.query_actions(F.col("text"))
    return _with_cases(spark, d).select(F.md5(F.col("text").cast("binary")).alias("digest"), a.alias("a")).select("digest", F.array_join("a.actions", ",").alias("actions"), F.col("a.strong").alias("strong"))


def _sql_first_action(tbl: list[tuple[str, str]]) -> str:
    return "list_min(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(n, {lit(p)}) THEN {{'at': length(string_split_regex(n, {lit(p)})[1]), 'k': {k}, 'a': '{a}'}} END" for k, (a, p) in enumerate(tbl)) + "], lambda x: x IS NOT NULL)).a"


@query(f"WITH {_WITH_CASES}, m AS (SELECT text, ' ' || {normed('text')} || ' ' AS n FROM t) SELECT md5(text) AS digest, coalesce({_sql_first_action(fixed.ACTIONS_STRONG)}, {_sql_first_action(fixed.ACTIONS_WEAK)}) AS action FROM m")
def title_action(spark, d):
    return _with_cases(spark, d).select(F.md5(F.col("text").cast("binary")).alias("digest"), rules.title_action(F.col("text")).alias("action"))


def _sql_expansions() -> str:
    edge = r"[^\p{L}\p{N}_\x{0600}-\x{06FF}]"
    parts = []
    for (p, add) in rules.expansion_rules():
        inner = p.split(")(?:", 1)[1].rsplit(")(?!", 1)[0]
        parts.append(f"CASE WHEN regexp_matches(q, {lit(f'(^|{edge})({inner})($|{edge})')}) THEN {lit(add)} END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {_WITH_CASES}, m AS (SELECT text, lower(text) AS q FROM t), e AS (SELECT text, {_sql_expansions()} AS adds FROM m) SELECT md5(text) AS digest, CASE WHEN len(adds) > 0 THEN md5(text || ' ' || array_to_string(adds, ' ')) ELSE md5(text) END AS expanded, CAST(len(adds) AS BIGINT) AS n FROM e")
def expand_query(spark, d):
    return _with_cases(spark, d).select(F.md5(F.col("text").cast("binary")).alias("digest"), F.md5(rules.expand_query(F.col("text")).cast("binary")).alias("expanded"), F.size(rules.expansions(F.col("text"))).cast("long").alias("n"))


@query(rf"WITH m AS (SELECT conv_id, turn, text, {normed('text')} AS n FROM conversations) SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) <= 9 AND (CASE {_INTENT} ELSE 'general' END <> 'general' OR regexp_matches(text, {lit(fixed.REFERENTIAL)})) AS followup FROM m")
def followup_detect(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", rules.looks_like_followup(F.col("text")).alias("followup"))


@query(r"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\d+(?:[.,]\d+)*'), lambda x: replace(x, ',', '')))), '|') AS numbers FROM conversations")
def text_numbers(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(text.numbers(F.col("text"))), "|").alias("numbers"))


@query()
def split_items(spark, d):
    """Sentences and list items of every document (SQL has no look-behind: tested against Python)."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.split_items(F.col("text"))).alias("pos", "item"))


@query()
def redact_identifiers(spark, d):
    """Documents with identifiers replaced (SQL has no look-around: tested against Python)."""
    return table(spark, d, "documents").select("doc_id", text.redact(F.col("text")).alias("r")).select("doc_id", F.md5(F.col("r.text").cast("binary")).alias("digest"), F.col("r.n").alias("n"))


_LABEL = " ".join(f"WHEN regexp_matches(t, {lit(p)}) THEN '{f}'" for f, p in page_sources.LABEL_RULES)


@query(rf"WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-3][^>]*>([^<]*)</h[1-3]>', 1)) AS label FROM pages), m AS (SELECT page_id, label, regexp_replace(lower(label), '^[ :：\-]+|[ :：\-]+$', '', 'g') AS t FROM l) SELECT page_id, label, CASE WHEN t = '' OR length(t) > 60 OR regexp_matches(t, {lit(page_sources.NO_LABEL)}) THEN NULL {_LABEL} END AS field FROM m")
def page_labels(spark, d):
    heads = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h[1-3][^>]*>([^<]*)</h[1-3]>"), F.lit(1))).alias("label"))
    return heads.select("page_id", "label", page_sources.label_field_column(F.col("label")).alias("field"))


@query()
def html_title_text(spark, d):
    """Title and text of every page by the tree parser (tested on fixtures)."""
    return table(spark, d, "pages").select("page_id", title_and_text(F.col("html")).alias("p")).select("page_id", "p.title", F.length("p.text").alias("chars"), F.md5(F.col("p.text").cast("binary")).alias("digest"))


@query()
def page_fields(spark, d):
    """Fields of every page by the labelled-page parser (tested on fixtures)."""
    p = page_sources.parser_udf("labelled")(F.col("html"), F.lit(None).cast("string"))
    return table(spark, d, "pages").select("page_id", p.alias("p")).select("page_id", *(F.md5(F.col(f"p.{f}").cast("binary")).alias(f) for f in page_sources.PAGE_FIELDS))


@query("SELECT page_id, 'pg-' || left(sha1(url), 10) AS service_id, sha256(html) AS source_sha256 FROM pages")
def sha_ids(spark, d):
    return table(spark, d, "pages").select("page_id", page_sources.hashed_id("pg", "url").alias("service_id"), F.sha2("html", 256).alias("source_sha256"))


@query(f"WITH {PAGES} SELECT page_id, host AS domain, scheme = 'https' AND host <> '' AS valid, (host IN ('my.gov.sa', 'absher.sa') OR ends_with(host, '.gov.sa') OR ends_with(host, '.edu.sa')) AS official FROM pr")
def url_checks(spark, d):
    host = text.domain_of(F.col("url"))
    return table(spark, d, "pages").select("page_id", host.alias("domain"), text.valid_url(F.col("url")).alias("valid"), text.official_domain(host).alias("official"))


# --- knowledge base ----------------------------------------------------------------------------------------------------------


@query(f"WITH {PAGES} SELECT service_id, array_to_string(errors, '; ') AS errors, array_to_string(warnings, '; ') AS warnings FROM pv")
def validate_errors(spark, d):
    return kb.validate(page_records(spark, d)).select("service_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query(f"WITH {PAGES} SELECT coalesce(title, '') AS title, coalesce(url, '') AS url, array_to_string(errors, '; ') AS errors FROM pv WHERE len(errors) > 0")
def quarantine_split(spark, d):
    return catalog.quarantine_view(kb.split_valid(kb.validate(page_records(spark, d)))[1])


@query(f"WITH {PAGES} SELECT w AS warning, count(*) AS n FROM (SELECT unnest(warnings) AS w FROM pv) GROUP BY w")
def warning_histogram(spark, d):
    return kb.warning_histogram(kb.validate(page_records(spark, d)))


@query("WITH " + DOCS + ", f AS (SELECT count(*) AS title, count(CASE WHEN category <> '' THEN 1 END) AS category, count(nullif(trim(descr), '')) AS description, count(fees) AS fees, count(audience) AS target_audience FROM r), u AS (UNPIVOT f ON COLUMNS(*) INTO NAME field VALUE n), names AS (SELECT unnest([" + ", ".join(f"'{f}'" for f in fixed.BILINGUAL if f not in ("official_url", "agency")) + "]) AS field), l AS (SELECT unnest(['en', 'ar']) AS lang) SELECT names.field, l.lang, CAST(coalesce(CASE WHEN l.lang = 'en' THEN u.n END, 0) AS BIGINT) AS n FROM names CROSS JOIN l LEFT JOIN u ON u.field = names.field")
def field_coverage(spark, d):
    return catalog.coverage_chart(kb.field_coverage(doc_records(spark, d)))


@query(f"""WITH RECURSIVE {PAGES}, o AS (SELECT row_number() OVER (ORDER BY page_id) AS i, service_id, host AS a, coalesce(title, service_id) AS b FROM pr),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS xs, CAST([] AS VARCHAR[]) AS ys, CAST([] AS VARCHAR[]) AS names, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS kept_by
  UNION ALL SELECT i, CASE WHEN k IS NULL THEN list_append(xs, a) ELSE xs END, CASE WHEN k IS NULL THEN list_append(ys, b) ELSE ys END, CASE WHEN k IS NULL THEN list_append(names, service_id) ELSE names END, service_id, k
  FROM (SELECT o.i, xs, ys, names, a, b, service_id, coalesce(names[list_position(xs, a)], names[list_position(ys, b)]) AS k FROM g JOIN o ON o.i = g.i + 1))
SELECT id AS service_id, kept_by FROM g WHERE i > 0""")
def dedup_first_wins(spark, d):
    """Greedy first-wins over pages by host and title."""
    keyed = page_records(spark, d).select("_order", "service_id", text.domain_of(F.col("official_url_en")).alias("a"), F.coalesce("title_en", "service_id").alias("b"))
    return kb.greedy_first_wins(keyed, "_order", "a", "b", "service_id").select("service_id", "kept_by")


@query(f"WITH {PAGES}, a AS (SELECT * FROM pv WHERE len(errors) = 0) SELECT (SELECT count(*) FROM a) AS records, (SELECT count(title) FROM a) AS with_english, CAST(0 AS BIGINT) AS with_arabic, (SELECT count(*) FROM pv WHERE len(errors) > 0) AS quarantined, (SELECT array_to_string(list_sort(list(DISTINCT agency)), '|') FROM a) AS agencies, (SELECT array_to_string(list_sort(list(DISTINCT domain)), '|') FROM a) AS domains, (SELECT count(*) FROM pv) AS loaded")
def build_report(spark, d):
    rec = page_records(spark, d)
    v = kb.validate(rec)
    ok, _ = kb.split_valid(v)
    r = kb.build_report(rec, v, ok, rec.limit(0))
    return r.select("records", "with_english", "with_arabic", "quarantined", F.array_join("agencies", "|").alias("agencies"), F.array_join("domains", "|").alias("domains"), F.col("sources")[0]["loaded"].alias("loaded"))


@query(f"WITH {DOCS} SELECT chunk_id, section, md5(text) AS text_digest, md5(embed_text) AS embed_digest FROM ch")
def chunk_unpivot(spark, d):
    c = chunks.assert_unique(chunks.chunk_records(doc_records(spark, d)))
    return c.select("chunk_id", "section", F.md5(F.col("text").cast("binary")).alias("text_digest"), F.md5(F.col("embed_text").cast("binary")).alias("embed_digest"))


@query(f"WITH {DOCS} SELECT l.lang, section, count(*) AS chunks, count(DISTINCT service_id) AS services FROM ch, (SELECT 'en' AS lang) l GROUP BY CUBE (l.lang, section)")
def chunk_counts(spark, d):
    return chunks.chunk_stats(chunks.chunk_records(doc_records(spark, d)))


@query(f"WITH {DOCS}, h AS (SELECT sha256(chunk_id || chr(0) || embed_text || chr(1)) AS x FROM ch) SELECT CAST(sum(CAST(('0x' || substr(x, 1, 15)) AS BIGINT)) AS VARCHAR) AS a, CAST(sum(CAST(('0x' || substr(x, 16, 15)) AS BIGINT)) AS VARCHAR) AS b, count(*) AS n FROM h")
def index_fingerprint(spark, d):
    a, b, n = chunks.fingerprint(chunks.chunk_records(doc_records(spark, d))).split("-")
    return spark.createDataFrame([(str(int(a, 16)), str(int(b, 16)), int(n))], "a string, b string, n long")


@query(f"WITH {DOCS}, e AS (SELECT DISTINCT embed_text FROM ch) SELECT sha256(embed_text) AS text_hash FROM e WHERE sha256(embed_text) NOT IN (SELECT sha256(embed_text) FROM ch WHERE section = 'title')")
def incremental_antijoin(spark, d):
    c = chunks.chunk_records(doc_records(spark, d))
    stored = c.where("section = 'title'").select(F.sha2("embed_text", 256).alias("text_hash")).distinct()
    return chunks.to_embed(c, stored).select("text_hash")


# --- catalogue ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {DOCS}, f AS (SELECT * FROM r WHERE agency = 'src0') SELECT service_id, title, agency, CASE WHEN length(descr) > 300 THEN left(descr, 300) || '…' ELSE descr END AS description, (SELECT count(*) FROM f) AS total FROM f ORDER BY service_id LIMIT 20 OFFSET 10")
def catalog_page(spark, d):
    return catalog.list_services(doc_records(spark, d), agency="src0", limit=20, offset=10)


@query("SELECT source AS code, source AS name_en, CAST(NULL AS VARCHAR) AS name_ar, source || '.gov.sa' AS domain, count(*) AS services FROM documents GROUP BY source")
def agency_rollup(spark, d):
    return catalog.agencies(doc_records(spark, d))


@query(f"WITH {DOCS} SELECT service_id FROM r WHERE contains({normed('concat_ws(chr(32), title, descr)')}, 'license')")
def explorer_filter(spark, d):
    return catalog.explore(doc_records(spark, d), "License").select("service_id")


# --- retrieval ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {BM25} SELECT term, CAST(df AS BIGINT) AS df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, tot")
def bm25_idf(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    n = docs.count()
    return docs.select("doc_id", F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).select("term", "df", F.round(F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 5")
def bm25_topk(spark, d):
    """Five best documents of every question, found in one scan of all documents."""
    rows = document_terms(spark, d).select("doc_id", F.lit(0).alias("all"), "terms")
    best = textscan.best_in_groups(rows, questions(spark, d), 5, "doc_id", "all", digits=6)
    return best.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {TFIDF} SELECT query_id, chunk_id, s AS score, rank FROM (SELECT query_id, chunk_id, round(score, 6) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM chars) WHERE rank <= 5")
def char_tfidf_topk(spark, d):
    """The best chunks by character n-grams, of which a question has hundreds: found in one scan of the chunks."""
    have, q = searchable(spark, d), questions(spark, d)
    best = scan.hits(have["rows"].withColumn("service_id", F.col("chunk_id")), q, retrieve.query_signals(q, have, ["char"]), [{"char": 1.0}], 5, digits=(6, 6, 6))
    return best.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score FROM v, v q WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id) SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5")
def dense_topk(spark, d):
    """Five nearest vectors of every hundredth one, against all."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
    near = scan.nearest(q, v, 6, key="vec_id", cosine=True, digits=6).where("query_id <> vec_id").drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 5")


@query(f"SELECT k AS item_id, CAST(bucket AS INTEGER) AS bucket, round(w, 6) AS w FROM ({trigrams('benchmark', 'item_id')})")
def trigram_embed(spark, d):
    return trigram_encoder(table(spark, d, "benchmark"), "item_id", "text").select("item_id", "bucket", F.round("w", 6).alias("w"))


@query(f"WITH {SIGNALS} SELECT * FROM sig")
def signals_bundle(spark, d):
    return chunk_signals(spark, d)


@query(f"WITH {SIGNALS}, x AS (SELECT query_id, chunk_id, round(CAST(0.4 AS DOUBLE) * dense + CAST(0.6 AS DOUBLE) * char, 7) AS score FROM sig) SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x) WHERE rank <= 5")
def hybrid_blend(spark, d):
    """Every chunk is a service of its own here."""
    have = searchable(spark, d)
    rows = have["rows"].withColumn("service_id", F.col("chunk_id"))
    asked = retrieve.query_signals(questions(spark, d), have, ["dense", "char"])
    best = scan.hits(rows, questions(spark, d), asked, [retrieve.weighting({"method": "hybrid", "alpha": 0.4})], 5, digits=(6, 7, 7))
    return best.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


COVER = f"""tt AS (SELECT conv_id AS service_id, list_distinct({tok("text")}) AS t FROM conversations WHERE turn = 0),
te AS (SELECT service_id, len(t) AS n, unnest(t) AS term FROM tt),
cov AS (SELECT query_id, service_id, max(s) AS cov FROM (SELECT query_id, service_id, count(*) / CAST(any_value(n) AS DOUBLE) AS s FROM (SELECT item_id AS query_id, unnest(list_distinct({tok("text")})) AS term FROM benchmark) JOIN te USING (term) GROUP BY ALL) GROUP BY ALL)"""


@query(f"WITH {COVER} SELECT query_id, service_id, round(cov, 6) AS cov FROM cov")
def title_coverage(spark, d):
    titles = chunk_rows(spark, d).where("turn = 0").select("service_id", F.col("text").alias("title"))
    return retrieve.title_coverage(questions(spark, d), titles).withColumn("cov", F.round("cov", 6))


@query(f"""WITH {SIGNALS}, {COVER},
x AS (SELECT query_id, service_id, chunk_id, round(CAST(0.45 AS DOUBLE) * dense + CAST(0.15 AS DOUBLE) * char + CAST(0.15 AS DOUBLE) * bm25, 8) AS combined FROM sig JOIN c USING (chunk_id)),
p AS (SELECT query_id, service_id, max(combined) AS best FROM x GROUP BY ALL),
h AS (SELECT query_id, service_id, round(best + CAST(0.1 AS DOUBLE) * coalesce(cov, 0.0), 8) AS score FROM p LEFT JOIN cov USING (query_id, service_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, service_id) AS rank FROM h),
e AS (SELECT query_id, service_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY r) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id, service_id ORDER BY combined DESC, chunk_id) AS r FROM x) WHERE r <= 3 GROUP BY ALL)
SELECT query_id, service_id, score, rank, evidence FROM k JOIN e USING (query_id, service_id) WHERE rank <= 5""")
def search_v3(spark, d):
    """Weighted signals, best chunk per service, title bonus, five hits with their three best chunks."""
    hits = retrieve.search(questions(spark, d), searchable(spark, d), fixed.CONFIGS["v3"] | {"expand": False}, digits=(6, 8, 8))
    return hits.select("query_id", "service_id", "score", F.col("rank").cast("long").alias("rank"), F.array_join(F.transform("evidence", lambda e: e["chunk_id"].cast("string")), ",").alias("evidence"))


@query(f"WITH {BM25} SELECT query_id, source AS service_id, max(score) AS best, arg_max(doc_id, {{'s': score, 'd': doc_id}}) AS best_doc FROM bm GROUP BY ALL")
def max_pool_source(spark, d):
    return best_documents(spark, d, 1, last=True).select("query_id", F.col("source").alias("service_id"), F.col("score").alias("best"), F.col("doc_id").alias("best_doc"))


@query(f"WITH {BM25} SELECT query_id, source, doc_id, score, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS r FROM bm) WHERE r <= 3")
def evidence_top3(spark, d):
    return best_documents(spark, d, 3).select("query_id", "source", "doc_id", "score", F.col("rank").cast("long").alias("r"))


@query(f"WITH {EVAL} SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS top_score, max(CASE WHEN rank = 2 THEN score END) AS second_score, round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 6) AS margin FROM ranked GROUP BY query_id")
def margin_second_score(spark, d):
    return retrieve.margins(source_ranking(spark, d)).withColumn("margin", F.round("margin", 6))


@query(f"""WITH {EVAL}, h AS (SELECT query_id, 0 AS variant, source AS service_id, score, rank FROM ranked WHERE rank <= 8 UNION ALL SELECT query_id, 1, 'src' || ((CAST(substr(source, 4) AS INTEGER) + 1) % 20), score, rank FROM ranked WHERE rank <= 8),
m AS (SELECT query_id, service_id, round(max(score - CASE WHEN variant > 0 THEN 0.03 ELSE 0.0 END), 6) AS score, min(variant * 1000 + rank) AS seen FROM h GROUP BY ALL)
SELECT query_id, service_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, service_id) AS rank FROM m) WHERE rank <= 10""")
def multi_query_merge(spark, d):
    """The ranking merged with a second wording's, which here is the ranking with every source moved by one."""
    top = source_ranking(spark, d).where("rank <= 8")
    other = top.withColumn("service_id", F.concat(F.lit("src"), ((F.substring("service_id", 4, 9).cast("int") + 1) % 20).cast("string")))
    both = top.withColumn("variant", F.lit(0)).unionByName(other.withColumn("variant", F.lit(1)))
    rounded = retrieve.merge_variants(both.withColumn("score", F.round("score", 6)))
    return rounded.select("query_id", "service_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _sql_adjust() -> str:
    return "CASE WHEN len(qa) = 0 OR sa IS NULL THEN 0.0 WHEN list_contains(qa, sa) THEN 0.02 WHEN strong THEN -0.03 ELSE 0.0 END"


@query(f"""WITH {EVAL}, qm AS (SELECT item_id AS query_id, ' ' || {normed("text || ' renew'")} || ' ' AS n FROM benchmark), qs AS (SELECT query_id, {_sql_actions(fixed.ACTIONS_STRONG)} AS qa FROM qm),
s AS (SELECT DISTINCT source, CASE CAST(substr(source, 4) AS INTEGER) % 3 WHEN 0 THEN 'renew' WHEN 1 THEN 'cancel' END AS sa FROM documents),
h AS (SELECT r.query_id, r.source AS service_id, r.score, r.rank, round(r.score + {_sql_adjust().replace("strong", "len(qa) > 0")}, 6) AS adjusted FROM ranked r JOIN qs USING (query_id) JOIN s USING (source) WHERE r.rank <= 10)
SELECT query_id, service_id, score, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, rank) AS new_rank FROM h""")
def action_rerank(spark, d):
    """Hits reranked for questions that ask to renew, where sources renew, cancel or neither by their number."""
    hits = source_ranking(spark, d).where("rank <= 10")
    n = F.substring("source", 4, 9).cast("int") % 3
    none = F.array().cast("array<string>")
    services = table(spark, d, "documents").select("source").distinct().select(F.col("source").alias("service_id"), F.when(n == 0, F.array(F.lit("renew"))).when(n == 1, F.array(F.lit("cancel"))).otherwise(none).alias("actions"))
    q = questions(spark, d).withColumn("query", F.concat("query", F.lit(" renew")))
    out = retrieve.rerank(hits, services, q)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("adjusted", 6)), "rank")
    return out.select("query_id", "service_id", "score", F.row_number().over(order).cast("long").alias("new_rank"))


@query("SELECT conv_id, string_agg(role || ': ' || left(text, 300), chr(10) ORDER BY turn) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4 GROUP BY conv_id")
def last_turns(spark, d):
    return retrieve.last_turns(table(spark, d, "conversations"))


@query(rf"WITH m AS (SELECT conv_id, turn, text, {normed('text')} AS n FROM conversations WHERE turn > 0), f AS (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM m), t AS (SELECT conv_id, text AS title FROM conversations WHERE turn = 0) SELECT f.conv_id * 100 + f.turn AS query_id, md5(CASE WHEN title IS NOT NULL AND (w <= 4 OR (w <= 9 AND (CASE {_INTENT} ELSE 'general' END <> 'general' OR regexp_matches(text, {lit(fixed.REFERENTIAL)})))) THEN text || ' ' || title ELSE text END) AS digest FROM f LEFT JOIN t USING (conv_id)")
def followup_context(spark, d):
    rows = chunk_rows(spark, d)
    q = rows.where("turn > 0").select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query"), F.col("service_id").alias("context_service_id"))
    titles = rows.where("turn = 0").select("service_id", F.col("text").alias("title"))
    return retrieve.with_context(q, titles, short_words=4).select("query_id", F.md5(F.col("query").cast("binary")).alias("digest"))


_WORDS = "regexp_extract_all({x}, '[a-z0-9]+')".replace("{x}", normed("text"))


def _sql_stem(t: str) -> str:
    return f"CASE WHEN length({t}) > 5 AND ends_with({t}, 'ing') THEN left({t}, length({t}) - 3) WHEN length({t}) > 4 AND ends_with({t}, 'ed') THEN left({t}, length({t}) - 2) WHEN length({t}) > 4 AND ends_with({t}, 'es') THEN left({t}, length({t}) - 2) WHEN length({t}) > 3 AND ends_with({t}, 's') THEN left({t}, length({t}) - 1) ELSE {t} END"


@query(f"WITH w AS (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark), e AS (SELECT DISTINCT item_id, unnest([w, {_sql_stem('w')}]) AS word FROM w) SELECT word, round(ln((1 + (SELECT count(*) FROM benchmark)) / CAST(1 + count(*) AS DOUBLE)) + 1, 6) AS idf FROM e WHERE length(word) >= 2 GROUP BY word")
def vocabulary(spark, d):
    return index.vocabulary(table(spark, d, "benchmark"), "text").select("word", F.round("idf", 6).alias("idf"))


_TABLE = f"""vw AS (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark), ve AS (SELECT DISTINCT item_id, unnest([w, {_sql_stem('w')}]) AS word FROM vw), voc AS (SELECT word, ln((1 + (SELECT count(*) FROM benchmark)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM ve WHERE length(word) >= 2 GROUP BY word),
wt AS (SELECT word, idf, CAST(embedding AS DOUBLE[]) AS vec FROM voc JOIN embeddings ON vec_id = CAST(('0x' || substr(md5(word), 1, 4)) AS BIGINT) % 500)"""


@query(f"""WITH {_TABLE}, f AS (SELECT conv_id * 100 + turn AS chunk_id, unnest({_WORDS}) AS word FROM conversations), fs AS (SELECT chunk_id, word, {_sql_stem('word')} AS stem FROM f),
hit AS (SELECT chunk_id, coalesce(a.idf, b.idf) AS idf, coalesce(a.vec, b.vec) AS vec FROM fs LEFT JOIN wt a ON fs.word = a.word LEFT JOIN wt b ON fs.stem = b.word),
dm AS (SELECT chunk_id, dim, sum(idf * x) AS v FROM (SELECT chunk_id, idf, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM hit WHERE vec IS NOT NULL) GROUP BY ALL)
SELECT chunk_id, CAST(dim AS INTEGER) AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY chunk_id)), 6) AS v FROM dm""")
def static_encoder_mean(spark, d):
    """Unit idf-weighted sums of word vectors; the words' vectors are rows of ``embeddings`` chosen by hash."""
    pick = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 4), 16, 10).cast("long") % 500
    emb = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    words = index.vocabulary(table(spark, d, "benchmark"), "text").withColumn("vec_id", pick).join(emb, "vec_id").select("word", "idf", "vec")
    return index.static_encode(chunk_rows(spark, d), words, "chunk_id", "text").select("chunk_id", "dim", F.round("v", 6).alias("v"))


# --- answers -----------------------------------------------------------------------------------------------------------------

_STATUS = "CASE WHEN top_score >= 0.85 THEN 'answered' WHEN top_score >= 0.7 THEN 'tentative' ELSE 'insufficient' END"
_CFG = {"t_answer": 0.85, "t_tentative": 0.7, "t_related": 0.5}


@query(f"WITH {EVAL} SELECT {_STATUS} AS status, count(*) AS n FROM ev GROUP BY 1")
def decision_buckets(spark, d):
    dec = answer.decisions(questions(spark, d), source_ranking(spark, d), _CFG)
    return dec.groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {EVAL}, s AS (SELECT query_id, {_STATUS} AS status, top_score FROM ev) SELECT r.query_id, r.source AS service_id, r.score, r.rank FROM ranked r JOIN s USING (query_id) WHERE status = 'insufficient' AND top_score >= 0.5 AND rank <= 3 AND score >= 0.5")
def related_links(spark, d):
    hits = source_ranking(spark, d)
    return answer.related_links(answer.decisions(questions(spark, d), hits, _CFG), hits, 0.5).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {EVAL}, s AS (SELECT query_id, {_STATUS} AS status, top_score FROM ev), u AS (SELECT r.query_id, r.source AS service_id, r.score, row_number() OVER (PARTITION BY r.query_id ORDER BY rank) AS n FROM ranked r JOIN s USING (query_id) WHERE status <> 'insufficient' AND (rank = 1 OR (score >= 0.7 AND round(top_score - score, 6) <= 0.06))) SELECT * FROM u WHERE n <= 3")
def support_selection(spark, d):
    hits = source_ranking(spark, d)
    used = answer.support(answer.decisions(questions(spark, d), hits, _CFG), hits, 0.7, margin=0.06 + 1e-9)
    return used.withColumn("n", F.col("n").cast("long"))


@query(f"WITH {EVAL}, t AS (SELECT query_id, max(score) AS top FROM ranked GROUP BY 1), k AS (SELECT r.* , top FROM ranked r JOIN t USING (query_id) WHERE rank = 1 OR (score >= 0.8 AND round(top - score, 6) <= 0.05 AND rank <= 3)) SELECT query_id, any_value(top) < 0.8 AS refused, CASE WHEN any_value(top) < 0.8 THEN 'none' WHEN any_value(top) >= 0.9 THEN 'strong' ELSE 'moderate' END AS confidence, CASE WHEN any_value(top) < 0.8 THEN '' ELSE string_agg(source, ',' ORDER BY rank) END AS services FROM k GROUP BY query_id")
def compose_v1(spark, d):
    out = answer.compose_v1(source_ranking(spark, d), 0.8, related_margin=0.05 + 1e-9, strong_margin=0.1 - 1e-12)
    return out.withColumn("services", F.array_join("services", ","))


@query(f"SELECT c_nationkey AS query_id, count(DISTINCT {normed('c_mktsegment')}) > 1 AND count(DISTINCT c_name) > 1 AS conflict FROM customer GROUP BY c_nationkey")
def fee_conflict(spark, d):
    cited = table(spark, d, "customer").select(F.col("c_nationkey").alias("query_id"), F.lit("en").alias("lang"), F.col("c_mktsegment").alias("fees_en"), F.lit(None).cast("string").alias("fees_ar"), F.col("c_name").alias("agency"))
    return answer.fee_conflicts(cited)


@query()
def answers_batch(spark, d):
    """Answers to all benchmark questions from the documents as records (tested on fixtures)."""
    rows = document_terms(spark, d).select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("service_id"), F.lit(0).alias("all"), "terms")
    hits = textscan.best_in_groups(rows, questions(spark, d), 5, "service_id", "all", digits=6).withColumn("score", F.col("score") / (F.col("score") + 6))
    out = answer.answers(questions(spark, d), hits.select("query_id", "service_id", "score", "rank"), doc_records(spark, d), _CFG)
    return out.select("query_id", "status", "intent", "lead", F.size("citations").alias("n_citations"), F.size("points").alias("n_points"), F.coalesce(F.size("related"), F.lit(0)).alias("n_related"))


@query(r"""WITH cl AS (SELECT conv_id * 100 + turn AS claim_id, conv_id, text FROM conversations WHERE role = 'assistant'), pk AS (SELECT conv_id, string_agg(text, ' ') AS t FROM conversations WHERE role <> 'assistant' GROUP BY conv_id),
n AS (SELECT claim_id, text, list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '(?i)^\s*(?:step\s*)?\d{1,2}\s*[.)\-:]\s+', ''), '\d+(?:[.,]\d+)*'), lambda x: replace(x, ',', ''))) AS own, list_transform(regexp_extract_all(pk.t, '\d+(?:[.,]\d+)*'), lambda x: replace(x, ',', '')) AS known, pk.t AS t FROM cl LEFT JOIN pk USING (conv_id))
SELECT claim_id, CASE WHEN trim(text) = '' OR length(text) > 1500 THEN 'empty_or_too_long' WHEN regexp_matches(text, '(?i)https?://|www\.|\b[\w-]+\.(?:gov|com|org|net|sa)\b') THEN 'url_in_text' WHEN t IS NULL THEN 'no_valid_evidence_id' WHEN len(list_filter(own, lambda x: NOT list_contains(known, x))) > 0 THEN 'number_not_in_evidence' END AS reason FROM n""")
def claim_validation(spark, d):
    """Assistant turns as claims that cite what the others said in the conversation."""
    rows = table(spark, d, "conversations")
    proposed = rows.where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("claim_id"), F.col("conv_id").alias("query_id"), "text", F.array(F.lit("[S1.description]")).alias("evidence"))
    package = rows.where("role <> 'assistant'").groupBy(F.col("conv_id").alias("query_id")).agg(F.array_join(F.collect_list("text"), " ").alias("text")).select("query_id", F.lit("S1").alias("sid"), F.lit("description").alias("field"), "text")
    return claims.validate_claims(proposed, package).select("claim_id", "reason")


# --- evaluation ---------------------------------------------------------------------------------------------------------------

_SUM = "count(*) AS n, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) AS top1, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END) AS top3, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS top5, avg(coalesce(1.0 / rank, 0.0)) AS mrr"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _sql_rounded(cols: str, body: str) -> str:
    return f"SELECT {cols} FROM ({body})"


@query(f"WITH {EVAL}, s AS (SELECT {_SUM} FROM ev WHERE supported = 1) SELECT n, round(top1, 9) AS top1, round(top3, 9) AS top3, round(top5, 9) AS top5, round(mrr, 9) AS mrr FROM s")
def retrieval_metrics(spark, d):
    return _rounded(eval_rows(spark, d).where("supported = 1").agg(*evaluate.summary_columns()))


@query(f"WITH {EVAL}, g AS (SELECT 'all' AS dim, 'all' AS value, * FROM ev UNION ALL SELECT 'style', style, * FROM ev UNION ALL SELECT 'family', CAST(family AS VARCHAR), * FROM ev UNION ALL SELECT 'supported', CAST(supported AS VARCHAR), * FROM ev), s AS (SELECT dim, value, {_SUM} FROM g GROUP BY dim, value) SELECT dim, value, n, round(top1, 9) AS top1, round(top3, 9) AS top3, round(top5, 9) AS top5, round(mrr, 9) AS mrr FROM s")
def grouped_breakdown(spark, d):
    return _rounded(evaluate.breakdowns(eval_rows(spark, d), "style", "family", "supported"))


_REFUSAL = """tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r"""


def _sql_refusal(t: str, frm: str, by: str = "") -> str:
    sums = f"""SELECT {by} CAST(sum(CASE WHEN refuse AND NOT sup THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN refuse AND sup THEN 1 ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN NOT refuse AND NOT sup THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
      avg(CASE WHEN NOT sup THEN CASE WHEN refuse THEN 1.0 ELSE 0.0 END END) AS unsupported_refused, avg(CASE WHEN sup THEN CASE WHEN NOT refuse THEN 1.0 ELSE 0.0 END END) AS supported_answered,
      avg(CASE WHEN sup THEN CASE WHEN NOT refuse AND good THEN 1.0 ELSE 0.0 END END) AS supported_answered_correct, avg(CASE WHEN (sup AND NOT refuse AND good) OR (NOT sup AND refuse) THEN 1.0 ELSE 0.0 END) AS end_to_end_accuracy
      FROM (SELECT *, coalesce(top_score, 0) < {t} AS refuse, supported = 1 AS sup, coalesce(rank = 1, false) AS good FROM {frm}) GROUP BY ALL"""
    return f"""SELECT {by} round(p, 9) AS refusal_precision, round(r, 9) AS refusal_recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9) AS refusal_f1, round(unsupported_refused, 9) AS unsupported_refused, round(supported_answered, 9) AS supported_answered,
      round(supported_answered_correct, 9) AS supported_answered_correct, round(end_to_end_accuracy, 9) AS end_to_end_accuracy, round(0.5 * (supported_answered_correct + unsupported_refused), 9) AS balanced_accuracy FROM (SELECT *, {_REFUSAL.replace("tp, fp, fn, ", "")} FROM ({sums}))"""


@query(f"WITH {EVAL} " + _sql_refusal("0.8", "ev"))
def refusal_metrics(spark, d):
    return _rounded(eval_rows(spark, d).agg(*evaluate.refusal_columns(F.col("top_score"), F.col("supported") == 1, F.coalesce(F.col("rank") == 1, F.lit(False)), F.lit(0.8))))


@query(f"WITH {EVAL}, st AS (SELECT ev.*, unnest(range(20, 80)) AS step FROM ev) SELECT CAST(step AS INTEGER) AS step, * EXCLUDE (step) FROM (" + _sql_refusal("step / 100.0", "st", "step,") + ")")
def threshold_curve(spark, d):
    return _rounded(evaluate.threshold_curve(eval_rows(spark, d)))


@query(f"""WITH {EVAL}, b AS (SELECT *, coalesce(top_score, 0) >= 0.85 AS sure, coalesce(top_score, 0) >= 0.7 AS shown, supported = 1 AS sup, coalesce(rank = 1, false) AS one, coalesce(rank <= 3, false) AS three FROM ev),
s AS (SELECT count(*) FILTER (sup) AS n_answerable, count(*) FILTER (NOT sup) AS n_unanswerable, avg(CASE WHEN shown AND one THEN 1.0 ELSE 0.0 END) FILTER (sup) AS success_top1, avg(CASE WHEN shown AND three THEN 1.0 ELSE 0.0 END) FILTER (sup) AS success_top3,
  avg(CASE WHEN shown THEN 0.0 ELSE 1.0 END) FILTER (sup) AS false_refusal_rate, avg(CASE WHEN sure THEN 1.0 ELSE 0.0 END) FILTER (sup) AS confident_rate, avg(CASE WHEN one THEN 1.0 ELSE 0.0 END) FILTER (sup AND sure) AS confident_precision,
  avg(CASE WHEN shown THEN 0.0 ELSE 1.0 END) FILTER (NOT sup) AS unsupported_refusal_rate, avg(CASE WHEN sure THEN 1.0 ELSE 0.0 END) FILTER (NOT sup) AS unsupported_confident_rate,
  CAST(count(*) FILTER (NOT shown AND NOT sup) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT shown AND sup) AS DOUBLE) AS fp, CAST(count(*) FILTER (shown AND NOT sup) AS DOUBLE) AS fn FROM b),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS c FROM s)
SELECT n_answerable, n_unanswerable, round(success_top1, 9) AS success_top1, round(success_top3, 9) AS success_top3, round(false_refusal_rate, 9) AS false_refusal_rate, round(confident_rate, 9) AS confident_rate, round(confident_precision, 9) AS confident_precision, round(unsupported_refusal_rate, 9) AS unsupported_refusal_rate,
  round(unsupported_confident_rate, 9) AS unsupported_confident_rate, round(p, 9) AS refusal_precision, round(c, 9) AS refusal_recall, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0.0 END, 9) AS refusal_f1 FROM r""")
def decision_metrics(spark, d):
    return _rounded(eval_rows(spark, d).agg(*evaluate.decision_columns(F.col("top_score"), F.col("supported") == 1, F.col("rank"), 0.85, 0.7)))


_CANDS = """ds AS (SELECT DISTINCT coalesce(top_score, 0) AS s FROM ev), cands AS (SELECT (s + nx) / 2 AS t, nx - s AS gap FROM (SELECT s, lead(s) OVER (ORDER BY s) AS nx FROM ds) WHERE nx IS NOT NULL UNION ALL SELECT min(s) - 0.001, 0.0 FROM ds UNION ALL SELECT max(s) + 0.001, 0.0 FROM ds),
cs AS (SELECT t, gap, avg(CASE WHEN coalesce(top_score, 0) < t THEN 1.0 ELSE 0.0 END) FILTER (supported = 0) AS refused, avg(CASE WHEN coalesce(top_score, 0) >= t AND coalesce(rank = 1, false) THEN 1.0 ELSE 0.0 END) FILTER (supported = 1) AS good, count(*) FILTER (coalesce(top_score, 0) >= t) AS conf, count(*) FILTER (coalesce(top_score, 0) >= t AND supported = 1 AND coalesce(rank = 1, false)) AS right_ FROM ev, cands GROUP BY t, gap)"""


@query(f"WITH {EVAL}, {_CANDS} SELECT round(t, 9) AS t, round(0.5 * (good + refused), 9) AS balanced_accuracy FROM cs ORDER BY round(0.5 * (good + refused), 9) DESC, round(gap, 9) DESC, t LIMIT 1")
def threshold_fit(spark, d):
    return _rounded(evaluate.fit_threshold(eval_rows(spark, d)))


@query(f"WITH {EVAL}, {_CANDS}, te AS (SELECT coalesce(min(t) FILTER (refused >= 0.5), max(t)) AS tt, max(t) AS last FROM cs) SELECT round(coalesce(min(t) FILTER (conf > 0 AND right_ / CAST(conf AS DOUBLE) >= 0.05 AND t >= tt), max(last)), 9) AS t_answer, round(max(tt), 9) AS t_tentative FROM cs, te")
def threshold_fit_two(spark, d):
    return _rounded(evaluate.fit_two_thresholds(eval_rows(spark, d), 0.5, 0.05))


@query(f"WITH {EVAL}, f AS (SELECT family, CASE WHEN bool_and(coalesce(rank = 1, false)) THEN 1.0 ELSE 0.0 END AS a1, CASE WHEN bool_and(coalesce(rank <= 3, false)) THEN 1.0 ELSE 0.0 END AS a3, avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END) AS m FROM ev GROUP BY family) SELECT count(*) AS families, round(avg(a1), 9) AS all_top1, round(avg(a3), 9) AS all_top3, round(avg(m), 9) AS mean_top1 FROM f")
def paraphrase_robustness(spark, d):
    return _rounded(evaluate.robustness(eval_rows(spark, d)))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    out = evaluate.latency(table(spark, d, "events"), "value", "event_type")
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95")))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


_GRID = "SELECT 'd' || a || '_c' || b || '_b' || c || '_t' || t AS config_id, a, b, c, t FROM (SELECT unnest(CAST([0.3, 0.6] AS DOUBLE[])) AS a), (SELECT unnest(CAST([0.0, 0.3] AS DOUBLE[])) AS b), (SELECT unnest(CAST([0.0, 0.45] AS DOUBLE[])) AS c), (SELECT unnest(CAST([0.0, 0.2] AS DOUBLE[])) AS t)"


@query(f"""WITH {SIGNALS}, {COVER}, g AS ({_GRID}),
p AS (SELECT config_id, query_id, service_id, round(max(CAST(a AS DOUBLE) * dense + CAST(b AS DOUBLE) * char + CAST(c.c AS DOUBLE) * bm25) + any_value(CAST(t AS DOUBLE) * coalesce(cov, 0.0)), 8) AS score FROM sig JOIN (SELECT chunk_id, service_id FROM c) cc USING (chunk_id) LEFT JOIN cov USING (query_id, service_id), g c GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY config_id, query_id ORDER BY score DESC, service_id) AS rank FROM p),
m AS (SELECT config_id, count(*) AS n, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END), 9) AS top1, round(avg(coalesce(1.0 / r, 0.0)), 9) AS mrr FROM (SELECT config_id, item_id, (SELECT min(rank) FROM k WHERE k.config_id = g.config_id AND k.query_id = item_id AND k.service_id % 10 = item_id % 10 AND rank <= 10) AS r FROM g, benchmark) GROUP BY config_id)
SELECT config_id, n, top1, mrr FROM m""")
def grid_cross_select(spark, d):
    """Sixteen weightings in one scan of the chunks; a conversation is relevant where its number ends like the item's."""
    grid, have, q = evaluate.config_grid(spark, (0.3, 0.6), (0.0, 0.3), (0.0, 0.45), (0.0, 0.2)), searchable(spark, d), questions(spark, d)
    weights = grid.orderBy("config_id").collect()
    hits = scan.hits(have["rows"], q, retrieve.query_signals(q, have, ["dense", "char", "bm25"]), [{"dense": r.w_dense, "char": r.w_char, "bm25": r.w_bm25, "w_tcov": r.w_tcov} for r in weights], 10, digits=(6, None, 8))
    hits = hits.withColumn("config_id", F.get(F.array(*(F.lit(r.config_id) for r in weights)), F.col("config")))
    found = hits.where("service_id % 10 = query_id % 10").groupBy("config_id", "query_id").agg(F.min("rank").alias("rank"))
    rows = grid.select("config_id").join(F.broadcast(q.select("query_id")), F.lit(True)).join(found, ["config_id", "query_id"], "left")
    return _rounded(rows.groupBy("config_id").agg(*evaluate.summary_columns((1,))))


@query("""WITH b AS (SELECT item_id, 'src' || (item_id % 20) AS s, 'document ' || item_id AS t FROM benchmark) SELECT item_id, (SELECT min(source || '-' || doc_id) FROM documents WHERE source = s AND 'document ' || doc_id = t) AS service_id FROM b""")
def label_resolution(spark, d):
    """Expected (source, title) labels to service ids; labels without a record stay unresolved here."""
    bench = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("expected_source"), F.concat(F.lit(" Document "), F.col("item_id").cast("string")).alias("expected_title"), F.lit(0).alias("supported"))
    return evaluate.resolve_labels(bench, doc_records(spark, d)).select("item_id", F.col("expected_service_id").alias("service_id"))


@query(f"WITH {EVAL}, b AS (SELECT query_id, arg_max(source, {{'s': total, 'x': source}}) AS after FROM (SELECT query_id, source, round(sum(score), 4) AS total FROM bm GROUP BY ALL) GROUP BY query_id) SELECT query_id, top1 AS before, after FROM ev JOIN b USING (query_id) WHERE top1 <> after")
def changed_answers(spark, d):
    """Questions whose first source differs between the best document and the sum over documents."""
    a = eval_rows(spark, d).select("query_id", "top1_service_id")
    total = textscan.sums_in_groups(document_terms(spark, d), questions(spark, d), "source", digits=6).withColumn("total", F.round("total", 4))
    b = total.groupBy("query_id").agg(F.max_by("source", F.struct("total", "source")).alias("top1_service_id"))
    return evaluate.changed_answers(a, b)
