"""Answers from hits: calibrated decision, supporting services, citations, verbatim sections and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.rules import detect_intent
from ..functions.text import missing, normalize_for_matching, query_language, split_items

SECTION_ORDER = ["direct", "need", "docs", "steps", "fees", "who", "notes"]


def decide(score: Column, t_answer: float, t_tentative: float | None = None) -> Column:
    """answered, tentative or insufficient; no score is insufficient."""
    low = t_answer if t_tentative is None else min(t_tentative, t_answer)
    return F.when(score >= t_answer, "answered").when(score >= low, "tentative").otherwise("insufficient")


def decisions(queries: DataFrame, hits: DataFrame, config: dict) -> DataFrame:
    """(query_id, query, ui_lang, intent, top_score, status); blank questions are ``empty``."""
    top = hits.where("rank = 1").select("query_id", F.col("score").alias("top_score"))
    rows = queries.select("query_id", "query").join(top, "query_id", "left")
    status = F.when(missing(F.col("query")), "empty").otherwise(decide(F.col("top_score"), config["t_answer"], config["t_tentative"]))
    return rows.select("query_id", "query", query_language(F.coalesce("query", F.lit(""))).alias("ui_lang"), detect_intent(F.col("query")).alias("intent"), "top_score", status.alias("status"))


def related_links(decided: DataFrame, hits: DataFrame, t_related: float | None) -> DataFrame:
    """Up to three links for declined questions whose top score reaches ``t_related``, up to the first below it."""
    if t_related is None:
        return hits.where("false").select("query_id", "service_id", "score", "rank")
    near = hits.join(decided.where((F.col("status") == "insufficient") & (F.col("top_score") >= t_related)).select("query_id"), "query_id", "left_semi").where("rank <= 3")
    below = F.max((F.col("score") < t_related).cast("int")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("_below", below).where("_below = 0").select("query_id", "service_id", "score", "rank")


def support(decided: DataFrame, hits: DataFrame, t_tentative: float, margin: float = fixed.SUPPORT_MARGIN, most: int = fixed.MAX_SUPPORT) -> DataFrame:
    """(query_id, service_id, score, n): the top hit and up to ``most`` close ones, numbered as citations."""
    rows = hits.join(decided.where(F.col("status").isin("answered", "tentative")).select("query_id", "top_score"), "query_id")
    near = rows.where((F.col("rank") == 1) | ((F.col("score") >= t_tentative) & (F.col("top_score") - F.col("score") <= margin)))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return near.withColumn("n", n).where(F.col("n") <= most + 1).select("query_id", "service_id", "score", "n")


def _pick(name: str) -> Column:
    return F.when(F.col("lang") == "ar", F.col(f"{name}_ar")).otherwise(F.col(f"{name}_en"))


def citations(used: DataFrame, records: DataFrame, decided: DataFrame) -> DataFrame:
    """Supporting services with their record, in the question's language where the record has it."""
    rows = used.join(records, "service_id").join(decided.select("query_id", "ui_lang", "intent", "status"), "query_id")
    has = F.when(F.col("ui_lang") == "ar", ~missing(F.col("title_ar"))).otherwise(~missing(F.col("title_en")))
    first = F.when(~missing(F.col("title_en")), "en").otherwise("ar")
    rows = rows.withColumn("lang", F.when(has, F.col("ui_lang")).otherwise(first))
    other = F.when(F.col("lang") == "ar", F.col("official_url_en")).otherwise(F.col("official_url_ar"))
    return rows.withColumns({"title": _pick("title"), "agency": _pick("agency"), "url": _pick("official_url"), "other_url": other, "modified": _pick("source_last_modified")})


def _ui(key: str) -> Column:
    return F.when(F.col("ui_lang") == "ar", fixed.UI["ar"][key]).otherwise(fixed.UI["en"][key])


def best_sentences(cited: DataFrame, query_vectors: DataFrame, encode, most: int = 2) -> DataFrame:
    """(query_id, best): of the first cited service, the ``most`` sentences nearest to the question, in their order.

    ``query_vectors`` are sparse unit vectors (query_id, bucket, w); ``encode(df, key, text)`` makes the same of the
    sentences. Sentences without any common bucket score 0; ties go to the earlier sentence.
    """
    rows = cited.where("n = 1").select("query_id", F.posexplode(split_items(_pick("description"))).alias("pos", "text"))
    rows = rows.withColumn("key", F.struct("query_id", "pos"))
    near = encode(rows, "key", "text").withColumnRenamed("w", "sw").withColumn("query_id", F.col("key.query_id"))
    score = near.join(query_vectors, ["query_id", "bucket"]).groupBy("key").agg(F.round(F.sum(F.col("w") * F.col("sw")), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "pos")
    kept = rows.join(score, "key", "left").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return kept.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("best"))


def points(cited: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """(query_id, section, section_rank, cite, pos, text, label): verbatim items of all sections, in display order.

    The direct answer is the ``best`` sentences (see ``best_sentences``), the first two where none are given. Steps come from the first service alone where several are cited and it has any; at most three audiences are shown.
    """
    many = F.max("n").over(Window.partitionBy("query_id"))

    def items(key: str, value: Column, label: Column | None = None, whole: bool = False) -> Column:
        arr = F.when(~missing(value), F.array(value)).otherwise(F.array().cast("array<string>")) if whole else split_items(value)
        return F.transform(arr, lambda x: F.struct(F.lit(key).alias("section"), x.alias("text"), (label if label is not None else F.lit(None).cast("string")).alias("label")))

    only_first = F.col("n") == 1
    lead = lambda x: F.struct(F.lit("direct").alias("section"), x.alias("text"), F.lit(None).cast("string").alias("label"))
    cited = cited.withColumn("best", F.lit(None).cast("array<string>")) if best is None else cited.join(best, "query_id", "left")
    nothing = F.array().cast("array<struct<section:string,text:string,label:string>>")
    all_items = F.concat(
        F.when(only_first, F.coalesce(F.transform("best", lead), F.slice(items("direct", _pick("description")), 1, 2))).otherwise(nothing),
        items("need", _pick("eligibility")), items("need", _pick("requirements")), items("docs", _pick("required_documents")), items("steps", _pick("steps")),
        items("fees", _pick("fees"), _ui("fees"), True), items("fees", _pick("processing_time"), _ui("time"), True), items("fees", _pick("service_languages"), _ui("langs"), True),
        items("who", _pick("target_audience"), None, True), items("notes", _pick("notes")),
        F.when(only_first, items("notes", F.col("contact_information"), _ui("contact"), True)).otherwise(nothing),
    )
    rows = cited.withColumn("many", many).select("query_id", "intent", "n", "many", F.posexplode(all_items).alias("pos", "p")).select("query_id", "intent", "many", F.col("n").alias("cite"), "pos", "p.*")
    # The contact line closes the notes of all services.
    rows = rows.withColumn("late", ((F.col("section") == "notes") & F.col("label").isNotNull()).cast("int"))
    first_steps = F.max(((F.col("section") == "steps") & (F.col("cite") == 1)).cast("int")).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("fs", first_steps).where((F.col("section") != "steps") | (F.col("cite") == 1) | (F.col("many") == 1) | (F.col("fs") == 0))
    nth = F.row_number().over(Window.partitionBy("query_id", "section").orderBy("late", "cite", "pos"))
    rows = rows.withColumn("nth", nth).where((F.col("section") != "who") | (F.col("nth") <= 3))
    want = F.element_at(F.create_map(*(F.lit(x) for kv in fixed.INTENT_SECTION.items() for x in kv)), F.col("intent"))
    place = F.array_position(F.array(*(F.lit(s) for s in SECTION_ORDER)), F.col("section"))
    moved = F.when(F.col("section") == "direct", 0).when(F.col("section") == F.coalesce(want, F.lit("")), 1).otherwise(place + 1)
    return rows.select("query_id", "section", moved.cast("int").alias("section_rank"), "cite", "nth", "text", "label")


def fee_conflicts(cited: DataFrame) -> DataFrame:
    """(query_id, conflict): different fees stated by different agencies among the cited services."""
    fee, agency = _pick("fees"), F.coalesce("agency", F.lit(""))
    return cited.groupBy("query_id").agg(((F.count_distinct(F.when(~missing(fee), normalize_for_matching(fee))) > 1) & (F.count_distinct(agency) > 1)).alias("conflict"))


def answers(queries: DataFrame, hits: DataFrame, records: DataFrame, config: dict, query_vectors: DataFrame | None = None, encode=None) -> DataFrame:
    """One row per question: status, lead, sections, citations, notes, related links.

    With ``query_vectors`` and ``encode`` the direct answer holds the sentences nearest to the question.
    """
    decided = decisions(queries, hits, config)
    used = support(decided, hits, min(config["t_tentative"], config["t_answer"]))
    cited = citations(used, records, decided)
    cite = F.struct("n", "service_id", "title", "agency", "url", "other_url", "lang", "date_collected", "modified", "score")
    lead = F.replace(F.replace(F.when(F.col("status") == "answered", _ui("lead")).otherwise(_ui("lead_tentative")), F.lit("{title}"), F.coalesce("title", F.lit(""))), F.lit("{agency}"), F.coalesce("agency", F.lit("")))
    name = F.when(F.col("lang") == "ar", _ui("name_ar")).otherwise(_ui("name_en"))
    note = F.when(F.col("lang") != F.col("ui_lang"), F.replace(F.replace(_ui("lang_note"), F.lit("{n}"), F.col("n").cast("string")), F.lit("{lang}"), name))
    head = cited.groupBy("query_id").agg(F.sort_array(F.collect_list(cite)).alias("citations"), F.max(F.when(F.col("n") == 1, lead)).alias("lead"), F.transform(F.sort_array(F.collect_list(F.when(note.isNotNull(), F.struct("n", note.alias("note"))))), lambda x: x["note"]).alias("lang_notes"))
    best = best_sentences(cited, query_vectors, encode) if encode is not None else None
    shown = points(cited, best).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("section_rank", "nth", "section", "text", "cite", "label"))), lambda p: p.dropFields("section_rank", "nth")).alias("points"))
    links = related_links(decided, hits, config.get("t_related")).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "service_id"))), lambda x: x["service_id"]).alias("related"))
    out = decided.join(head, "query_id", "left").join(shown, "query_id", "left").join(fee_conflicts(cited), "query_id", "left").join(links, "query_id", "left")
    conflict = F.when(F.coalesce("conflict", F.lit(False)), F.array(_ui("conflict"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("notes", F.concat(F.coalesce("lang_notes", F.array().cast("array<string>")), conflict)).drop("lang_notes", "conflict")


def ungrounded(shown: DataFrame, cited: DataFrame) -> DataFrame:
    """Points whose text is not verbatim in the cited record: must be empty."""
    fields = F.concat_ws("\n", *(F.coalesce(f"{f}_{x}", F.lit("")) for f in fixed.EVIDENCE_FIELDS + ["service_languages"] for x in ("en", "ar")), F.coalesce("contact_information", F.lit("")))
    source = cited.select("query_id", F.col("n").alias("cite"), fields.alias("source"))
    return shown.join(source, ["query_id", "cite"]).where(~F.contains("source", "text"))


def compose_v1(hits: DataFrame, threshold: float, related_margin: float = fixed.V1_RELATED_MARGIN, strong_margin: float = fixed.V1_STRONG_MARGIN, most: int = fixed.V1_MAX_RELATED) -> DataFrame:
    """(query_id, refused, confidence, services): one threshold; close services follow the first."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    rows = hits.withColumn("top", top).where((F.col("rank") == 1) | ((F.col("score") >= threshold) & (F.col("top") - F.col("score") <= related_margin) & (F.col("rank") <= most + 1)))
    kept = F.transform(F.sort_array(F.collect_list(F.struct("rank", "service_id"))), lambda x: x["service_id"])
    out = rows.groupBy("query_id").agg(F.max("top").alias("top"), kept.alias("services"))
    refused = F.col("top") < threshold
    return out.select("query_id", refused.alias("refused"), F.when(refused, "none").when(F.col("top") >= threshold + strong_margin, "strong").otherwise("moderate").alias("confidence"), F.when(refused, F.array().cast("array<string>")).otherwise(F.col("services")).alias("services"))
