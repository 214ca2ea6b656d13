"""Model calls as functions of the caller: what a question means, and what an evidence package says.

``call(system, prompt)`` is any function from two texts to a reply text; it runs on executors, in Arrow batches, and is
tried once more where its reply is no JSON object. Without a function these plans are not run at all.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

Call = Callable[[str, str], str]


def asked(prompts: DataFrame, system: str, call: Call, tries: int = 2) -> DataFrame:
    """(query_id, reply, calls, error) of prompts (query_id, prompt): the first reply that holds a JSON object."""

    def one(prompt: str) -> tuple[str | None, int, str | None]:
        raw, error = None, None
        for n in range(1, tries + 1):
            try:
                raw = call(system, prompt)
            except Exception as e:  # the caller's function: what it raises is the error of that question alone
                return None, n, type(e).__name__
            body = raw[raw.find("{") : raw.rfind("}") + 1] if raw else ""
            try:
                if isinstance(json.loads(body), dict):
                    return raw, n, None
            except ValueError:
                error = "bad_json"
        return raw, tries, error

    def run(batches):
        for batch in batches:
            got = [one(p.as_py() or "") for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())], names=["query_id", "reply", "calls", "error"])

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "prompt").mapInArrow(run, f"query_id {kind}, reply string, calls int, error string")


def understood(replies: DataFrame, most: int = 5, chars: int = 120) -> DataFrame:
    """(query_id, in_scope, action, queries) of replies: known actions, short wordings without addresses, no repeats."""
    body = F.regexp_extract(F.coalesce("reply", F.lit("")), r"(?s)\{.*\}", 0)
    r = F.from_json(body, "in_scope boolean, action string, queries array<string>")
    texts = F.filter(F.coalesce(F.col("r.queries"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "") & (F.length(x) <= chars) & ~F.rlike(x, F.lit(fixed.URL_IN_TEXT)))
    known = sorted({a for a, _ in fixed.ACTIONS_STRONG} | {a for a, _ in fixed.ACTIONS_WEAK})
    rows = replies.select("query_id", r.alias("r"))
    return rows.select("query_id", F.coalesce("r.in_scope", F.lit(True)).alias("in_scope"), F.when(F.col("r.action").isin(*known), F.col("r.action")).alias("action"), F.slice(F.array_distinct(F.transform(texts, lambda x: F.trim(x))), 1, most).alias("queries"))


def wordings(queries: DataFrame, meant: DataFrame) -> DataFrame:
    """(query_id, variant, query): each question, then its other wordings."""
    rows = queries.select("query_id", "query").join(meant.select("query_id", "queries"), "query_id", "left")
    every = F.array_distinct(F.concat(F.array("query"), F.coalesce("queries", F.array().cast("array<string>"))))
    return rows.select("query_id", F.posexplode(every).alias("variant", "query"))


def valid_request(query, language=None, limit=None, offset=None):
    """Why a request is refused, or null: a question of 1 to 400 characters, a known language, a page within bounds."""
    n = F.length(F.trim(F.coalesce(query, F.lit(""))))
    out = F.when(n == 0, "empty_question").when(n > 400, "question_too_long")
    if language is not None:
        out = out.when(~F.coalesce(language, F.lit("auto")).isin("auto", "en", "ar"), "unknown_language")
    if limit is not None:
        out = out.when(~limit.between(1, 100), "limit_out_of_range")
    return out.when(offset < 0, "offset_out_of_range") if offset is not None else out
