"""Checks of proposed claims against an evidence package; the model that proposes them is a caller's function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import arabic_ratio, ascii_digits, missing, numbers


def evidence_package(used: DataFrame, chars: int = 900) -> DataFrame:
    """(query_id, sid, field, text) of cited services (query_id, n, lang and record columns): S1..Sn by citation."""
    pick = lambda f: F.when(F.col("lang") == "ar", F.col(f"{f}_ar")).otherwise(F.col(f"{f}_en"))
    named = [("title", pick("title")), ("agency", pick("agency")), ("service_channel", F.col("service_channel")), *((f, F.left(pick(f), F.lit(chars))) for f in fixed.EVIDENCE_FIELDS)]
    rows = F.array_compact(F.array(*(F.when(~missing(v) | F.lit(f in ("title", "agency")), F.struct(F.lit(f).alias("field"), v.alias("text"))) for f, v in named)))
    return used.select("query_id", F.concat(F.lit("S"), F.col("n").cast("string")).alias("sid"), F.explode(rows).alias("e")).select("query_id", "sid", "e.*")


def evidence_ids(ids: Column) -> Column:
    """array of struct(sid, field) from ids such as ``S1.fees``, ``[S1:docs]`` or a bare ``S1`` (field empty)."""
    alias = F.create_map(*(F.lit(x) for kv in fixed.FIELD_ALIASES.items() for x in kv))
    found = F.flatten(F.transform(ids, lambda e: F.regexp_extract_all(e, F.lit(fixed.EVIDENCE_ID), F.lit(0))))

    def one(m: Column) -> Column:
        field = F.lower(F.regexp_extract(m, fixed.EVIDENCE_ID, 2))
        return F.struct(F.concat(F.lit("S"), F.regexp_extract(m, fixed.EVIDENCE_ID, 1)).alias("sid"), F.coalesce(F.element_at(alias, field), field).alias("field"))

    return F.array_distinct(F.transform(found, one))


def validate_claims(claims: DataFrame, package: DataFrame) -> DataFrame:
    """``claims`` (claim_id, query_id, text, evidence array) with ``ids`` and ``reason``; reason null means accepted.

    Reasons in order: empty_or_too_long, url_in_text, no_valid_evidence_id, number_not_in_evidence.
    """
    ids = claims.select("claim_id", "query_id", F.explode(evidence_ids(F.col("evidence"))).alias("r")).select("claim_id", "query_id", "r.sid", "r.field")
    exact = ids.where("field <> ''").join(package, ["query_id", "sid", "field"])
    whole = ids.where("field = ''").select("claim_id", "query_id", "sid").join(package, ["query_id", "sid"])
    met = exact.select("claim_id", "sid", "field", "text").unionByName(whole.select("claim_id", "sid", "field", "text")).dropDuplicates(["claim_id", "sid", "field"])
    cited = met.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.concat_ws(".", "sid", "field"))).alias("ids"), F.array_distinct(F.flatten(F.collect_list(numbers(F.col("text"))))).alias("known"))
    rows = claims.join(cited, "claim_id", "left")
    text = F.col("text")
    stated = numbers(F.regexp_replace(ascii_digits(F.coalesce(text, F.lit(""))), fixed.LIST_NUMBER, ""))
    reason = (
        F.when(missing(text) | (F.length(text) > 1500), "empty_or_too_long")
        .when(F.rlike(text, F.lit(fixed.URL_IN_TEXT)), "url_in_text")
        .when(F.col("ids").isNull(), "no_valid_evidence_id")
        .when(F.size(F.array_except(stated, F.col("known"))) > 0, "number_not_in_evidence")
    )
    return rows.withColumn("reason", reason).drop("known")


def rejection_summary(checked: DataFrame) -> DataFrame:
    """(reason, n) of rejected claims."""
    return checked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def run_summary(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of totals of a run, and (reason, n) of its rejections.

    ``rows`` has a row for each question: kind, mode, text_origin, calls, tokens_in, tokens_out, seconds, proposed,
    rejected, language_ok, error and rejections (map of reason to number). Nulls count as nothing.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    one = rows.agg(
        F.count("*").alias("questions"), *(total(c) for c in ("calls", "tokens_in", "tokens_out", "proposed", "rejected")), F.count_if(F.col("text_origin") != "official_verbatim").alias("written_answers"),
        F.count_if(F.col("error").isNotNull()).alias("fallbacks"), F.count_if("language_ok").alias("language_ok"), F.count_if(F.col("mode") == "partial_answer").alias("partial_answers"),
        F.count_if((F.col("kind") == "unsupported") & F.col("mode").isin("grounded_answer", "partial_answer")).alias("unsupported_answered"), F.avg("seconds").alias("mean_seconds"),
    )
    reasons = rows.select(F.explode("rejections").alias("reason", "k")).groupBy("reason").agg(F.sum("k").alias("n"))
    return one, reasons


def unverified_note(intent: Column, verified: Column, lang: Column) -> Column:
    """The note that what a question asks for stands in no verified field; null where it does, or asks for none."""
    out = F.when(F.lit(False), "")
    for name, (field, en, ar) in fixed.INTENT_FIELDS.items():
        missing_ = (intent == name) & ~F.array_contains(F.coalesce(verified, F.array().cast("array<string>")), field)
        out = out.when(missing_, F.when(lang == "ar", fixed.NOT_VERIFIED["ar"] + ar).otherwise(fixed.NOT_VERIFIED["en"] + en))
    return out


def unverified_notes(notes: Column, note: Column) -> Column:
    """A reply's own notes with the intent's note before them, once."""
    notes = F.coalesce(notes, F.array().cast("array<string>"))
    return F.when(note.isNull() | F.array_contains(notes, note), notes).otherwise(F.concat(F.array(note), notes))


def response_mode(status: Column, related: Column, answerable: Column, in_scope: Column, notes: Column | None = None) -> Column:
    """Mode after downgrades.

    A question out of scope has no evidence. Where an answer or a possible match was proposed and the reply says that the
    evidence does not answer, its sources are shown as related services. A grounded answer, and only that, is partial
    where the reply says so or where ``notes`` (what is not verified) stand. Without a reply (null) nothing changes.
    """
    base = F.when(status == "answered", "grounded_answer").when(status == "tentative", "possible_match").when(related, "related_services").otherwise("insufficient_evidence")
    partial = F.coalesce(answerable == "partial", F.lit(False))
    if notes is not None:
        partial = partial | (answerable.isNotNull() & (F.coalesce(F.size(notes), F.lit(0)) > 0))
    out = F.when(~in_scope, "insufficient_evidence").when(base.isin("grounded_answer", "possible_match") & (answerable == "none"), "related_services")
    return out.when((base == "grounded_answer") & partial, "partial_answer").otherwise(base)


REPLY = "answerable string, direct_answer struct<text:string,evidence:array<string>>, sections array<struct<key:string,points:array<struct<text:string,evidence:array<string>>>>>, not_verified array<string>, follow_ups array<string>"


def parse_reply(raw: Column) -> Column:
    """The object in a model's reply, with or without a code fence or prose around it; null where there is none."""
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), F.from_json(body, REPLY))


def claims_of_replies(replies: DataFrame) -> DataFrame:
    """(query_id, claim_id, section, text, evidence) of replies (query_id, reply): direct answers and known sections' points."""
    r = replies.select("query_id", parse_reply(F.col("reply")).alias("r")).where("r is not null")
    direct = F.array(F.struct(F.lit("direct").alias("section"), F.col("r.direct_answer.text").alias("text"), F.col("r.direct_answer.evidence").alias("evidence")))
    known = F.filter(F.coalesce("r.sections", F.array().cast("array<struct<key:string,points:array<struct<text:string,evidence:array<string>>>>>")), lambda s: s["key"].isin(*fixed.CLAIM_SECTIONS))
    points = F.flatten(F.transform(known, lambda s: F.transform(s["points"], lambda p: F.struct(s["key"].alias("section"), p["text"].alias("text"), p["evidence"].alias("evidence")))))
    rows = r.select("query_id", F.posexplode(F.concat(F.when(F.col("r.direct_answer").isNotNull(), direct).otherwise(F.slice(direct, 1, 0)), points)).alias("pos", "c"))
    return rows.select("query_id", F.concat_ws("-", F.col("query_id").cast("string"), F.col("pos").cast("string")).alias("claim_id"), "c.*")


def check_replies(replies: DataFrame, package: DataFrame, languages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stands of replies (query_id, reply) to questions with ``languages`` (query_id, ui_lang).

    First the claims with ``ids`` and ``reason``, then one row for each reply: answerable (full, partial or none; null
    where nothing stands), proposed and rejected counts, reason, not_verified and follow_ups. A reply whose first
    standing claim is in the other language falls as a whole (``wrong_language``); one that says itself that the
    evidence does not answer is ``none``. Notes with numbers and texts with addresses are dropped.
    """
    claims = claims_of_replies(replies)
    checked = validate_claims(claims, package)
    pos = F.substring_index("claim_id", "-", -1).cast("int")
    first = checked.where("reason is null").groupBy("query_id").agg(F.min_by("text", pos).alias("sample"), F.count("*").alias("kept"))
    r = replies.select("query_id", parse_reply(F.col("reply")).alias("r")).join(languages.select("query_id", "ui_lang"), "query_id").join(first, "query_id", "left")
    points = lambda s: F.size(F.filter(F.coalesce(s["points"], F.array().cast("array<struct<text:string,evidence:array<string>>>")), lambda p: p.isNotNull()))
    proposed = F.lit(1) + F.aggregate(F.coalesce("r.sections", F.array().cast("array<struct<key:string,points:array<struct<text:string,evidence:array<string>>>>>")), F.lit(0), lambda n, s: n + points(s))
    none = F.col("r.answerable") == "none"
    wrong = (F.col("ui_lang") == "ar") != (arabic_ratio(F.col("sample")) >= 0.3)
    reason = F.when(F.col("r").isNull(), "no_reply").when(F.coalesce(none, F.lit(False)), None).when(F.col("sample").isNull(), "nothing_grounded").when(wrong, "wrong_language")
    stands = F.when(reason.isNull(), F.when(F.col("r.answerable").isin("full", "partial", "none"), F.col("r.answerable")).otherwise("partial"))

    def notes(c: Column, most: int, keep) -> Column:
        texts = F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "") & ~F.rlike(x, F.lit(fixed.URL_IN_TEXT)))
        return F.filter(F.slice(F.transform(texts, lambda x: F.left(F.trim(x), F.lit(200))), 1, most), keep)

    kept = F.coalesce("kept", F.lit(0)).cast("int")
    out = r.select(
        "query_id", stands.alias("answerable"), proposed.alias("proposed"), (proposed - kept).alias("rejected"), reason.alias("reason"),
        notes(F.col("r.not_verified"), 5, lambda x: F.size(numbers(x)) == 0).alias("not_verified"), notes(F.col("r.follow_ups"), 4, lambda x: F.lit(True)).alias("follow_ups"),
    )
    return checked, out


def cited_sources(checked: DataFrame, package: DataFrame, chars: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of standing claims: (query_id, sid, n) services in order of citation, (query_id, n, field, text) their evidence cut
    to ``chars``, and (query_id, verified_fields) what is backed by evidence, titles and agencies aside."""
    ids = checked.where("reason is null").select("query_id", F.substring_index("claim_id", "-", -1).cast("int").alias("claim"), F.posexplode("ids").alias("pos", "id"))
    ids = ids.select("query_id", "claim", "pos", F.substring_index("id", ".", 1).alias("sid"), F.substring_index("id", ".", -1).alias("field"))
    seen = ids.groupBy("query_id", "sid").agg(F.min(F.struct("claim", "pos")).alias("at"))
    sources = seen.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "sid"))).drop("at")
    shown = package.where(~F.col("field").isin("title", "agency")).join(sources, ["query_id", "sid"]).select("query_id", "n", "field", F.left("text", F.lit(chars)).alias("text"))
    fields = ids.where(~F.col("field").isin("title", "agency")).groupBy("query_id").agg(F.array_sort(F.collect_set("field")).alias("verified_fields"))
    return sources, shown, fields
