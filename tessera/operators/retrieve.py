"""Batch retrieval: three signals per chunk, a weighted sum, one hit per service, best evidence, reranking and merging.

Questions are a DataFrame, so a batch is one plan. ``search`` finds the k best services inside the scan of the chunks
(``scan``). The signals of all pairs of questions and chunks are equi-joins on terms that meet in one aggregation by
(query, chunk): a diagnostic, whose size is that of the pairs. Chunks without any signal score 0 and are absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.rules import action_adjustment, expand_query, looks_like_followup, query_actions
from ..functions.text import missing, normalize_for_matching, once, tokenize
from ..storage import small
from . import scan
from .index import tfidf_queries, unit_rows


#: Rows up to which the n-grams of a language travel with a plan: two numbers each.
LEXICON_ROWS = 1_000_000


def bm25_scores(queries: DataFrame, postings: DataFrame, text: str = "query", key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score): sums over the distinct query terms that the index knows."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col(text)))).alias("term"))
    return postings.join(small(terms), "term").groupBy("query_id", key).agg(F.sum("w").alias("score"))


def sparse_scores(query_rows: DataFrame, postings: DataFrame, on: str = "term", key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score): sparse dot products of (query_id, term, w) and (key, term, w)."""
    right = postings.withColumnRenamed("w", "pw")
    return right.join(small(query_rows), on).groupBy("query_id", key).agg(F.sum(F.col("w") * F.col("pw")).alias("score"))


def char_scores(queries: DataFrame, postings: DataFrame, idf: DataFrame, text: str = "query", key: str = "chunk_id") -> DataFrame:
    return sparse_scores(tfidf_queries(queries, idf, "query_id", text), postings, key=key)


def signals(dense: DataFrame | None, char: DataFrame | None, bm25: DataFrame | None, squash: float = fixed.BM25["squash"], key: str = "chunk_id") -> DataFrame:
    """(query_id, key, dense, char, bm25) from the scores at hand; bm25 is squashed to s / (s + squash)."""
    zero = F.lit(0.0)
    parts = []
    for name, df in (("dense", dense), ("char", char), ("bm25", bm25)):
        if df is not None:
            s = F.col("score") / (F.col("score") + squash) if name == "bm25" else F.col("score")
            parts.append(df.select("query_id", key, *((s if name == n else zero).alias(n) for n in ("dense", "char", "bm25"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", key).agg(*(F.sum(n).alias(n) for n in ("dense", "char", "bm25")))


def combine(method: str, alpha: float = 0.7, **weights: float) -> Column:
    """The score column of a method: dense, lexical, hybrid or v2."""
    d, c, b = F.col("dense"), F.col("char"), F.col("bm25")
    if method == "dense":
        return d
    if method == "lexical":
        return c
    if method == "hybrid":
        return alpha * d + (1 - alpha) * c
    w = fixed.V2_DEFAULT | weights
    return w["w_dense"] * d + w["w_char"] * c + w["w_bm25"] * b


def pool(scored: DataFrame, service: str = "service_id") -> DataFrame:
    """(query_id, service, best, dense, char): the best chunk of each service and its signals; ties by chunk id."""
    first = F.struct(F.col("combined"), F.col("chunk_id"))
    return scored.groupBy("query_id", service).agg(F.max("combined").alias("best"), F.max_by(F.struct("dense", "char"), first).alias("s")).select("query_id", service, "best", "s.dense", "s.char")


def title_coverage(queries: DataFrame, titles: DataFrame, text: str = "query", service: str = "service_id") -> DataFrame:
    """(query_id, service, cov): best share of a title's distinct tokens that the query holds, over title variants.

    ``titles`` is (service, title), one row per variant. An equi-join on tokens; services without overlap are absent.
    """
    toks = titles.select(service, F.array_sort(F.array_distinct(tokenize(F.col("title")))).alias("t")).where(F.size("t") > 0).distinct()
    toks = toks.withColumn("_v", F.array_join("t", " "))
    each = toks.select(service, "_v", F.size("t").alias("n"), F.explode("t").alias("term"))
    q = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col(text)))).alias("term"))
    share = q.join(each, "term").groupBy("query_id", service, "_v").agg((F.count("*") / F.first("n")).alias("share"))
    return share.groupBy("query_id", service).agg(F.max("share").alias("cov"))


def rank_hits(pooled: DataFrame, coverage: DataFrame | None = None, w_tcov: float = 0.0, k: int = 5, service: str = "service_id") -> DataFrame:
    """The k best services per query with ``score`` and ``rank``; ties by service id."""
    rows = pooled.withColumn("score", F.col("best"))
    if coverage is not None and w_tcov:
        rows = pooled.join(coverage, ["query_id", service], "left").withColumn("score", F.col("best") + w_tcov * F.coalesce("cov", F.lit(0.0))).drop("cov")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), service)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def evidence(scored: DataFrame, hits: DataFrame, n: int = 3, service: str = "service_id") -> DataFrame:
    """(query_id, service, evidence): the n best chunks of each hit, best first."""
    rows = scored.join(hits.select("query_id", service), ["query_id", service])
    order = Window.partitionBy("query_id", service).orderBy(F.desc("combined"), "chunk_id")
    best = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return best.groupBy("query_id", service).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "chunk_id", "section", "lang", "text", F.col("combined").alias("score")))), lambda e: e.dropFields("r")).alias("evidence"))


def bm25_queries(queries: DataFrame, text: str = "query") -> DataFrame:
    """(query_id, term, w) of the distinct terms of each question."""
    return queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col(text)))).alias("term"), F.lit(1.0).alias("w"))


def entries(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, term, w): the components of dense vectors by their place."""
    return vectors.select(key, F.posexplode(vec).alias("term", "w")).where("w is not null")


def index_rows(index: dict[str, DataFrame], signals: list[str] | None = None) -> DataFrame:
    """The chunks of an index with the vectors of its signals, as searches scan them; write it once where many follow."""
    have = {"char": "tfidf", "bm25": "bm25", "dense": "vectors" if "vectors" in index else "trigrams"}
    parts = {}
    for name in signals or have:
        if have[name] in index:
            df = index[have[name]]
            parts[name] = entries(df, "chunk_id", "vec") if have[name] == "vectors" else df.select("chunk_id", F.col("bucket" if have[name] == "trigrams" else "term").alias("term"), "w")
    named = index["chunks"].where("section = 'title'").select("service_id", "title")
    return scan.signal_rows(index["chunks"].select("chunk_id", "service_id", "lang", "section"), parts, named)


def _hashed(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.xxhash64(t.cast("string")))


def text_rows(chunks: DataFrame, keep=lambda name, make: make()) -> dict:
    """An index for ``search`` of ``chunks`` (chunk_id, service_id, lang, section, title, text), without postings.

    A row holds the counts of its own terms; what a term weighs in all chunks is put on the side of the questions
    (``folded``), and of each chunk only the length of its n-gram vector is joined to it. Terms are never shuffled one by
    one. ``keep(name, make)`` may store a table. Rows with one chunk id share their terms, as in postings; ``first`` marks
    one of them, and ``several`` holds the tokens of each of their texts. A null text has no terms.
    """
    same = chunks.groupBy("chunk_id").agg(F.collect_list("text").alias("texts"), F.collect_list(F.struct("service_id", "lang", "section")).alias("owners"))
    plain = F.transform("texts", normalize_for_matching).alias("plain")

    def known() -> DataFrame:
        n = chunks.agg(F.count("*").alias("n"))
        return scan.gram_rows(same.select(plain), "plain").crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row

    def count(idf: DataFrame | None = None) -> DataFrame:
        rows = same.select("chunk_id", "texts", F.size("owners").alias("shared"), F.posexplode("owners").alias("pos", "o"))
        rows = rows.select("chunk_id", "o.*", "texts", "shared", (F.col("pos") == 0).alias("first")).join(scan.title_tokens(chunks.where("section = 'title'").select("service_id", "title")), "service_id", "left")
        tokens = F.transform("texts", lambda t: _hashed(tokenize(t)))
        rows = rows.withColumns({"several": F.when(F.size("texts") > 1, tokens), "bm25": F.flatten(tokens), "plain": plain}).drop("texts")
        return scan.counted(rows, "bm25", texts="plain", idf=idf)

    idf = keep("gram-idf", known)

    def measured() -> DataFrame:
        if idf.count() <= LEXICON_ROWS:
            return count(idf)
        own = keep("counted", count)
        each = own.where("first").select("chunk_id", F.explode(F.arrays_zip("char_t", "char_n")).alias("e")).select("chunk_id", F.col("e.char_t").alias("term"), F.col("e.char_n").alias("tf"))
        w = (1 + F.log(F.col("tf").cast("double"))) * F.col("idf")
        return own.join(each.join(idf, "term").groupBy("chunk_id").agg(F.sqrt(F.sum(w * w)).alias("length")), "chunk_id", "left")

    rows = keep("measured", measured).withColumn("terms", F.aggregate("bm25_n", F.lit(0).cast("long"), lambda s, x: s + x))
    total = rows.agg(F.count("*").alias("n"), F.avg(F.col("terms") / F.col("shared")).alias("mean")).first()
    k1, b, mean = fixed.BM25["k1"], fixed.BM25["b"], total.mean or 1.0

    def length_at(t: Column, whole: Column) -> Column:
        return F.when(F.col("several").isNull(), whole).otherwise(F.size(F.get(F.filter("several", lambda a: F.array_contains(a, t)), F.lit(0))))

    # Sums over a row are bound once: the optimizer would put their expressions where they are used, which is for every term.
    norm = F.sqrt(F.aggregate("dense_n", F.lit(0.0), lambda s, x: s + x * x))
    weights = {
        "char_w": F.transform("char_n", lambda n: (1 + F.log(n.cast("double"))) / F.col("length")), "dense_w": once(norm, lambda whole: F.transform("dense_n", lambda n: n / whole)),
        "bm25_w": once(F.col("terms"), lambda whole: F.zip_with("bm25_t", "bm25_n", lambda t, n: n * (k1 + 1) / (n + k1 * (1 - b + b * length_at(t, whole) / mean)))),
    }
    return {"chunks": chunks, "rows": rows.withColumns(weights), "folded": {"idf": idf, "bm25": rows.where("first").select("bm25_t"), "n": total.n}}


def folded_signals(queries: DataFrame, index: dict, wanted: list[str], text: str = "query") -> dict[str, DataFrame]:
    """(query_id, t, w) by signal for the rows of ``text_rows``: a question's weight times what the term weighs in all chunks."""
    out, folded = {}, index["folded"]
    if "dense" in wanted and "query_trigrams" in index:
        out["dense"] = index["query_trigrams"].select("query_id", F.col("bucket").cast("long").alias("t"), "w")
    if "char" in wanted:
        own = scan.counted(queries.select("query_id", F.array(normalize_for_matching(F.col(text))).alias("plain")), texts="plain")
        tf = own.select("query_id", F.explode(F.arrays_zip("char_t", "char_n")).alias("e")).groupBy("query_id", F.col("e.char_t").alias("term")).agg(F.sum("e.char_n").alias("tf"))
        idf = folded["idf"].join(small(tf.select("term").distinct()), "term")
        own = unit_rows(tf.join(idf, "term").select("query_id", "term", ((1 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w")), "query_id")
        out["char"] = own.join(idf, "term").select("query_id", F.col("term").alias("t"), (F.col("w") * F.col("idf")).alias("w"))
    if "bm25" in wanted:
        asked = bm25_queries(queries, text).select("query_id", F.xxhash64("term").alias("t"))
        df = folded["bm25"].select(F.explode("bm25_t").alias("t")).join(small(asked.select("t").distinct()), "t").groupBy("t").agg(F.count("*").alias("df"))
        out["bm25"] = asked.join(df, "t").select("query_id", "t", F.log(1 + (folded["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("w"))
    return out


def query_signals(queries: DataFrame, index: dict[str, DataFrame], wanted: list[str], text: str = "query") -> dict[str, DataFrame]:
    """The questions' vectors (query_id, term, w) of each wanted signal that the index has."""
    if "folded" in index:
        return folded_signals(queries, index, wanted, text)
    out = {}
    if "dense" in wanted and "vectors" in index:
        out["dense"] = entries(queries, "query_id", "qvec")
    elif "dense" in wanted and "query_trigrams" in index:
        out["dense"] = index["query_trigrams"].select("query_id", F.col("bucket").alias("term"), "w")
    if "char" in wanted and "idf" in index:
        out["char"] = tfidf_queries(queries, index["idf"], "query_id", text)
    if "bm25" in wanted:
        out["bm25"] = bm25_queries(queries, text)
    return out


def weighting(config: dict) -> dict[str, float]:
    """Weights by signal, and ``w_tcov``, of a configuration's method."""
    method = config["method"]
    if method == "v2":
        w = fixed.V2_DEFAULT | config
        return {"dense": w["w_dense"], "char": w["w_char"], "bm25": w["w_bm25"], "w_tcov": w["w_tcov"]}
    alpha = {"dense": 1.0, "lexical": 0.0, "hybrid": config.get("alpha", 0.7)}[method]
    return {"dense": alpha, "char": 1 - alpha, "bm25": 0.0, "w_tcov": 0.0}


def search(queries: DataFrame, index: dict[str, DataFrame], config: dict, k: int = 5, langs: list[str] | None = None, titles: bool = True, n: int = 3, digits: tuple = (None, None, None)) -> DataFrame:
    """Hits (query_id, service_id, score, rank, dense, char, evidence) of a batch of questions (query_id, query[, qvec]).

    ``index`` holds chunks, bm25, tfidf, idf and optionally vectors (chunk_id, vec) or trigrams, and ``rows`` where they
    have been made. ``config`` names method and weights. Chunks are scanned once for the hits and once for their
    evidence (the n best chunks); tasks return k rows for each question, so what is shuffled does not grow with the
    chunks. Signals of weight 0 are left out. ``digits`` rounds signals, sums
    and scores before they are compared.
    """
    w = weighting(config)
    expand = config["method"] == "v2" and (fixed.V2_DEFAULT | config)["expand"]
    q = queries.withColumn("query", expand_query(F.col("query"))) if expand else queries
    wanted = [s for s in ("dense", "char", "bm25") if w[s]]
    asked = query_signals(q, index, wanted)
    use = index["rows"] if "rows" in index else index_rows(index, wanted)
    if langs:
        use = use.where(F.col("lang").isin(*langs))
    if not titles:
        use = use.where("section <> 'title'")
    found = scan.hits(use, q, asked, [w], k, n, digits=digits)
    for s in ("dense", "char"):
        found = found if s in found.columns else found.withColumn(s, F.lit(0.0))
    if not n:
        return found.select("query_id", "service_id", "score", "rank", "best", "dense", "char")
    named = found.select("query_id", "service_id", F.posexplode("evidence").alias("r", "e")).select("query_id", "service_id", "r", "e.*")
    texts = index["chunks"].select("chunk_id", "section", "lang", "text").join(F.broadcast(named), "chunk_id") if found.count() <= 10_000 else named.join(index["chunks"].select("chunk_id", "section", "lang", "text"), "chunk_id")
    rows = texts.groupBy("query_id", "service_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "chunk_id", "section", "lang", "text", F.col("combined").alias("score")))), lambda e: e.dropFields("r")).alias("evidence"))
    return found.drop("evidence").join(rows, ["query_id", "service_id"], "left").select("query_id", "service_id", "score", "rank", "best", "dense", "char", "evidence")


def margins(hits: DataFrame) -> DataFrame:
    """(query_id, top_score, second_score, margin)."""
    wide = hits.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score"))
    return wide.withColumn("margin", F.col("top_score") - F.col("second_score"))


def merge_variants(hits: DataFrame, discount: float = fixed.VARIANT_DISCOUNT, k: int = 10) -> DataFrame:
    """Hits of several wordings (query_id, variant from 0, service_id, score, rank) merged: rewordings pay a discount.

    The best discounted score of a service stays; ties go to the earlier wording, then the earlier rank.
    """
    s = F.col("score") - F.when(F.col("variant") > 0, discount).otherwise(0.0)
    best = hits.withColumn("s", s).groupBy("query_id", "service_id").agg(F.max("s").alias("score"), F.min(F.struct("variant", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "service_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("seen")


def rerank(hits: DataFrame, services: DataFrame, queries: DataFrame, bonus: float = fixed.ACTION_BONUS, penalty: float = fixed.ACTION_PENALTY) -> DataFrame:
    """Hits in the order of score plus action adjustment, earlier rank first on ties; scores stay as they were.

    ``services`` is (service_id, actions array).
    """
    q = queries.select("query_id", query_actions(F.col("query")).alias("qa"))
    rows = hits.join(services, "service_id").join(q, "query_id")
    rows = rows.withColumn("adjusted", F.col("score") + action_adjustment(F.col("qa.actions"), F.col("qa.strong"), F.col("actions"), bonus, penalty))
    order = Window.partitionBy("query_id").orderBy(F.desc("adjusted"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(order)).drop("qa")


def search_variants(variants: DataFrame, index: dict[str, DataFrame], config: dict, services: DataFrame | None = None, encode=None, per_variant: int = 8, k: int = 10) -> DataFrame:
    """Hits (query_id, service_id, score, rank) of questions asked in several wordings (query_id, variant from 0, query).

    Every wording is searched for ``per_variant`` services, all of them in one plan; the hits are merged, and reranked by
    the action of the first wording where ``services`` (service_id, actions) are given. ``encode`` makes the rows of
    ``query_trigrams`` from (query_id, query) where the index holds trigram vectors.
    """
    each = variants.select(F.struct("query_id", "variant").alias("query_id"), "query")
    have = index | ({"query_trigrams": encode(each)} if encode is not None else {})
    found = search(each, have, config, per_variant).select("query_id.query_id", "query_id.variant", "service_id", "score", "rank")
    merged = merge_variants(found, k=k)
    if services is None:
        return merged
    asked = variants.where("variant = 0").select("query_id", "query")
    return rerank(merged, services, asked).select("query_id", "service_id", "score", F.col("new_rank").alias("rank"))


def with_context(queries: DataFrame, titles: DataFrame, short_words: int | None = None) -> DataFrame:
    """Follow-ups get the title of the service in context appended.

    ``queries`` is (query_id, query, context_service_id); unknown services are ignored. ``short_words`` also takes
    questions of at most so many words as follow-ups.
    """
    rows = queries.join(titles.select(F.col("service_id").alias("context_service_id"), F.col("title").alias("_title")), "context_service_id", "left")
    follow = looks_like_followup(F.col("query"))
    if short_words is not None:
        follow = follow | (F.size(F.filter(F.split("query", r"\s+"), lambda x: x != "")) <= short_words)
    return rows.withColumn("query", F.when(~missing(F.col("_title")) & follow, F.concat_ws(" ", "query", "_title")).otherwise(F.col("query"))).drop("_title")


def last_turns(conversations: DataFrame, n: int = 4, chars: int = 300) -> DataFrame:
    """(conv_id, turns): the last n turns as ``role: text`` lines, texts cut to ``chars``."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = conversations.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    line = F.concat(F.col("role"), F.lit(": "), F.left("text", F.lit(chars)))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("turns"))
