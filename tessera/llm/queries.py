"""The queries ``opN_<name>`` of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import spread
from . import audio, egojoin, jaccard, lexical, licenses, lmscore, mixing, packing, pii, quality, tokens, toxicity, warc
from .samples import remainder
from .shared import bound_batches, scratch, written


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of ``embeddings``; vectors that cannot be compared stand alone, an empty table gives no rows."""
    return egojoin.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), 0.9)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of all documents: weights 3, 1, 2 by source, 150 % of all words, twice a source at most."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs, [3.0, 1.0, 2.0], 1.5, 2.0).select("doc_id", "size", "source_size", "target", "taken")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all documents by shingles of five words at 0.8; texts without words and rows without an id stand alone."""
    return jaccard.near_documents(table(spark, sf_dir, "documents", "doc_id", "text"), 0.8)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: counts and digest of the base spans, and all spans; a null text has none."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = pii.detect_pii(docs, pii.train_pii(docs))
    order = F.array(*(F.lit(k) for k in pii.KINDS))

    def joined(spans):
        ranked = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("n"))))
        return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["n"], s["s"].cast("string"), s["e"].cast("string"))), ",")

    def counted(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text by a model of the rows that are not held out; a null text scores as an empty one."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def base32_of_hex(digest):
    """Upper-case base32 of 40 hexadecimal digits: five of them make four digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are written as WARC records and read back; of equal payloads all rows with the smallest page_id are responses."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    pages = pages.withColumn("payload", F.coalesce("html", F.lit("")).cast("binary")).withColumn("sha1", F.sha1("payload"))
    # Who revisits whom is told by digests and ids alone; payloads meet only the few rows of that table.
    light = pages.select("page_id", "sha1").where("page_id is not null")
    first = light.groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("last > first").select("sha1", "first")
    again = written(light.join(first, "sha1").where("page_id > first").distinct(), "revisits")
    rows = jaccard.join_ids(pages, again, ["page_id", "sha1"], "left")
    revisit = F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    records = rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        base32_of_hex(F.col("sha1")).alias("payload_digest"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("http_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    warc.register(spark)
    at = scratch(spark, "warc")
    records.write.format("warc").mode("append").save(at)
    page_id = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast(kind)
    got = spark.read.format("warc").load(at).where("record_type = 'response'")
    got = got.select(page_id(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    again = spark.read.format("warc").option("payloads", "false").load(at).where("record_type = 'revisit'")
    again = again.select(page_id(F.col("record_id")).alias("page_id"), F.col("http_length").alias("payload_bytes"), "payload_digest", "record_type", page_id(F.col("refers_to")).alias("refers_to"))
    return got.unionByName(again)


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload, stored form and frame table of every whole text; a null text is an empty one, equal texts have equal values."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = audio.media_features(audio.encode_texts(docs))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_samples", "sample_rate", "seek_offsets")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text by a model of the labelled rows that are not held out; a null text scores as an empty one."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    out = quality.score_quality(docs, model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 ids; a null or empty text is the end alone."""
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokens.vocabulary())


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and score of the model for every whole text; a null or empty text is the end alone."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = lmscore.code_documents(docs, tokens.vocabulary())
    return lmscore.score_coded(coded, lmscore.fit_attention(coded))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item, from an index of all documents."""
    index = lexical.build_index(spread(table(spark, sf_dir, "documents", "doc_id", "text")))
    return lexical.search(index, table(spark, sf_dir, "benchmark", "item_id", "text"), 50)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and labels of every document; the score is the largest share of a template found, 1 where a phrase stands."""
    out = licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    starts, names = F.transform("base", lambda x: x["start"]), F.transform("base", lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    share = F.array_max(F.transform("found", lambda x: x["shared"] / x["n"]))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(names).alias("base_labels"), joined(F.concat(names, F.transform("found", lambda x: x["label"]))).alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
    )


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 4 that SQL can express: counts and digest of the base spans."""
    return op4_pii(spark, sf_dir).drop("spans")


def audio_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 7 that SQL can express: lengths and digest of the payload that was read back."""
    return op7_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 10 that SQL can express: counts and the unigram base."""
    out = op10_lm(spark, sf_dir).drop("score")
    return out.withColumn("base_score", F.round("base_score", 4))


def near_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over the benchmark passages, which SQL can join in full."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text").select(F.col("item_id").cast("long").alias("doc_id"), "text")
    return jaccard.near_documents(items, 0.8).select("doc_id", "n_links", "class_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if k.startswith("op")}
    return own | {f.__name__: f for f in (pii_base, audio_payload, lm_base, near_sets)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ego_join": EGO_SQL, "op2_mixing": MIXING_SQL, "op6_warc": WARC_SQL, "op11_lexical": LEXICAL_SQL, "op12_licenses": LICENSES_SQL, "pii_base": PII_SQL, "audio_payload": AUDIO_SQL, "lm_base": LM_SQL, "near_sets": SETS_SQL}


EGO_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT rid, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT rid AS a, rid AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(w.vec_id) AS component_id, v.vec_id IS NOT DISTINCT FROM min(w.vec_id) AS kept
FROM v JOIN reach ON reach.a = v.rid JOIN v w ON w.rid = reach.b LEFT JOIN n ON n.a = v.rid GROUP BY v.rid, v.vec_id
"""

# Matches of each pattern with their places: the gaps between them and they themselves, one after another.
PII_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT * FROM (VALUES (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  (3, 'card', '[0-9]([ -]?[0-9])+'), (4, 'phone', '\+[0-9][ ().0-9-]+[0-9]')) AS x(k, kind, pattern)),
m AS (SELECT rid, k, kind, regexp_extract_all(t, pattern, 0) AS hits, string_split_regex(t, pattern) AS gaps FROM d, p),
u AS (SELECT rid, k, kind, hits[i] AS hit,
    CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
g AS (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS digits FROM u),
ok AS (SELECT * FROM g WHERE CASE kind WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0
  WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
    CASE WHEN (length(digits) - i) % 2 = 1 THEN 2 * CAST(digits[i] AS INTEGER) - CASE WHEN CAST(digits[i] AS INTEGER) > 4 THEN 9 ELSE 0 END ELSE CAST(digits[i] AS INTEGER) END)) % 10 = 0
  ELSE length(digits) BETWEEN 8 AND 15 END)
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (coalesce(kind = 'email', false)) AS n_email, count(*) FILTER (coalesce(kind = 'ip', false)) AS n_ip, count(*) FILTER (coalesce(kind = 'card', false)) AS n_card, count(*) FILTER (coalesce(kind = 'phone', false)) AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || (start + length(hit)), ',' ORDER BY k, start), '')) AS base_sha256
FROM d LEFT JOIN ok USING (rid) GROUP BY rid
"""

AUDIO_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents)
SELECT doc_id, n AS n_bytes, n + pad AS payload_bytes, sha256(t || repeat(' ', pad)) AS payload_sha256
FROM (SELECT *, CAST(CASE WHEN n = 0 THEN 192 ELSE (192 - n % 192) % 192 END AS BIGINT) AS pad FROM d)
"""

# crc32 as SQL: a bit at a time over the id's digits.
LM_SQL = r"""
WITH ids AS (SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS s FROM documents),
crc AS (SELECT doc_id, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda h, c: list_reduce(list_prepend(xor(h, c), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)) AS h FROM ids),
held AS (SELECT doc_id, xor(h, CAST(4294967295 AS BIGINT)) % 10 = 0 AS held_out FROM crc),
d AS (SELECT row_number() OVER () AS rid, f.doc_id, held_out, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents f JOIN held ON f.doc_id IS NOT DISTINCT FROM held.doc_id),
w AS (SELECT rid, held_out, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+') || ['']) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM w WHERE NOT held_out GROUP BY word),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT any_value(d.doc_id) AS doc_id, any_value(d.held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(coalesce(n.n, 0)) AS train_tokens,
  round(sum(log10((coalesce(c.c, 0) + 0.1) / (coalesce(n.n, 0) + 0.1 * (n.v + 1)))), 4) AS base_score
FROM w JOIN d USING (rid) LEFT JOIN c USING (word), n GROUP BY w.rid
"""

SETS_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, CAST(item_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
s AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM d),
t AS (SELECT rid, len(s) AS n, unnest(s) AS g FROM s WHERE doc_id IS NOT NULL),
links AS (SELECT a.rid AS a, b.rid AS b FROM t a JOIN t b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8),
reach AS (SELECT rid AS a, rid AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT s.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(x.doc_id) AS class_id, s.doc_id IS NOT DISTINCT FROM min(x.doc_id) AS kept
FROM s JOIN reach ON reach.a = s.rid JOIN s x ON x.rid = reach.b LEFT JOIN n ON n.a = s.rid GROUP BY s.rid, s.doc_id
"""

WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST(('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5)) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f
"""

MIXING_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    0.1 + coalesce(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE), 0.0) AS w,
    (CAST(('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT source, source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
fill AS (
  SELECT 0 AS round, source, source_size, weight, false AS capped,
    1.5 * sum(source_size) OVER () * weight / sum(weight) OVER () AS share FROM o
  UNION ALL
  SELECT round + 1, source, source_size, weight, capped OR share > 2.0 * source_size,
    CASE WHEN capped OR share > 2.0 * source_size THEN 2.0 * source_size
      ELSE (1.5 * sum(source_size) OVER () - sum(CASE WHEN capped OR share > 2.0 * source_size THEN 2.0 * source_size ELSE 0 END) OVER ())
        * weight / nullif(sum(CASE WHEN capped OR share > 2.0 * source_size THEN 0 ELSE weight END) OVER (), 0) END
  FROM fill WHERE round < 60),
t AS (SELECT source, source_size, CAST(share AS DOUBLE) AS target FROM fill WHERE round = 60),
e AS (SELECT source, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.w, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto,
    e.target - e.epochs * e.source_size AS rest
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

LEXICAL_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
g AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
tf AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) GROUP BY rid, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT row_number() OVER () AS qid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
q AS (SELECT qid, item_id, unnest(list_distinct(w)) AS term FROM i),
s AS (SELECT qid, any_value(q.item_id) AS item_id, tf.rid, any_value(tf.doc_id) AS doc_id,
    CAST(sum(CAST(floor(1000 * ln((2 * g.n + 2) / CAST(2 * df.df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * tf.n * g.n) // g.l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), g GROUP BY qid, tf.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""


def _licenses_sql() -> str:
    """All blocks of all documents against all templates."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = " UNION ALL ".join(f"SELECT {quoted(licenses.template_words(p))} AS p, '{label}' AS label" for p, label in licenses.PHRASES)
    split = [(label, licenses.template_words(text)) for label, text in licenses.TEMPLATES]
    templates = " UNION ALL ".join(f"SELECT '{label}' AS label, {quoted(sorted(set(w)))} AS words, {licenses.needed(len(set(w)), 0.9)} AS need, {1 << (len(w) - 1).bit_length()} AS step" for label, w in split)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
ph AS ({phrases}), t AS ({templates}),
base AS (SELECT rid, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS start FROM d, ph),
b AS (SELECT rid, count(*) AS n, min(start) AS lo, max(start) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid),
blocks AS (SELECT rid, w, step, unnest(range(0, len(w), step)) AS start FROM d, (SELECT DISTINCT step FROM t)),
f AS (SELECT rid, label, len(words) AS n, len(list_intersect(words, list_distinct(w[start + 1 : start + 2 * t.step]))) AS shared, need FROM blocks JOIN t USING (step)),
m AS (SELECT rid, label, shared / CAST(n AS DOUBLE) AS share FROM f WHERE shared >= need),
a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM m) GROUP BY rid),
s AS (SELECT rid, max(share) AS share FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(s.share, 0.0) END AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid) LEFT JOIN s USING (rid)
"""


LICENSES_SQL = _licenses_sql()
