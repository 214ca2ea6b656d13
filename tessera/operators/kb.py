"""Knowledge-base build: normalise, validate, quarantine, greedy first-wins de-duplication and report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import arabic_ratio, clean_text, domain_of, duplicate_keys, missing, nfc, official_domain, valid_url
from ..storage import stored
from .ordering import numbered

TEXT = [*fixed.PLAIN, *(f"{f}_{lang}" for f in fixed.BILINGUAL for lang in ("en", "ar"))]


def normalize_records(records: DataFrame, compose: bool = True) -> DataFrame:
    """Every text field cleaned (and composed), the domain taken from the URL where it is missing."""
    done = {c: clean_text(nfc(F.col(c)) if compose else F.col(c)) for c in TEXT}
    out = records.select(*(done[c].alias(c) for c in TEXT), *(c for c in records.columns if c not in TEXT))
    return out.withColumn("source_domain", F.coalesce("source_domain", domain_of(F.coalesce("official_url_en", "official_url_ar"))))


def _messages(rules: list[tuple[Column, Column | str]]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for c, m in rules)))


def substantive(c: Column) -> Column:
    """Fifteen letters or more."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\p{L}")) >= 15


def validate(records: DataFrame) -> DataFrame:
    """``records`` with arrays ``errors`` (blocking) and ``warnings``."""
    c = F.col
    no = lambda *cols: F.coalesce(*(F.when(missing(c(x)), None).otherwise(c(x)) for x in cols), F.lit("")) == ""
    content = F.lit(False)
    for f in ("description", "steps", "requirements", "required_documents", "eligibility"):
        for lang in ("en", "ar"):
            content = content | substantive(c(f"{f}_{lang}"))
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    none = lambda x: F.coalesce(quoted(x), F.lit("None"))
    status, kind = c("verification_status"), c("source_type")
    known = F.coalesce(status.isin(*fixed.STATUSES), F.lit(False))
    errors = [
        (no("service_id"), "missing service_id"),
        (no("title_en", "title_ar"), "missing title (en and ar)"),
        (~content, "no official content (description/steps/requirements/documents)"),
        (no("official_url_en", "official_url_ar"), "missing official_url"),
        *((~missing(c(f"official_url_{x}")) & ~valid_url(c(f"official_url_{x}")), F.concat(F.lit(f"invalid official_url_{x}: "), quoted(c(f"official_url_{x}")))) for x in ("en", "ar")),
        (~official_domain(c("source_domain")), F.concat(F.lit("source_domain not an official Saudi domain: "), none(c("source_domain")))),
        (~F.coalesce(kind.isin(*fixed.SOURCE_TYPES), F.lit(False)), F.concat(F.lit("unknown source_type "), none(kind))),
        (~known, F.concat(F.lit("unknown verification_status "), none(status))),
        (known & ~status.isin(*fixed.INDEXABLE), F.concat(F.lit("verification_status "), quoted(status), F.lit(" is not indexable"))),
        ((status == "verified_official_capture") & no("date_collected"), "verified record without date_collected"),
        ((status == "verified_official_capture") & no("source_sha256"), "verified record without source_sha256"),
    ]
    warnings = [(content & no("description_en", "description_ar"), "no description (other official fields present)")]
    for f in ("title", "description"):
        warnings += [(~missing(c(f"{f}_ar")) & (arabic_ratio(c(f"{f}_ar")) < 0.5), f"{f}_ar is mostly non-Arabic script"), (~missing(c(f"{f}_en")) & (arabic_ratio(c(f"{f}_en")) > 0.5), f"{f}_en is mostly Arabic script")]
    warnings += [(no("title_ar"), "no official Arabic text"), (no("title_en"), "no official English text")]
    return records.withColumn("errors", _messages(errors)).withColumn("warnings", _messages(warnings))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) branches."""
    return validated.where(F.size("errors") == 0), validated.where(F.size("errors") > 0)


#: Rounds in which rows that come first under both keys win at once, and rows of a component that one task decides.
PARALLEL_ROUNDS = 3
COMPONENT_ROWS = 1_000_000


def key_components(rows: DataFrame) -> DataFrame:
    """``rows`` (o, ka, kb) with ``comp``: a number shared by all rows that are linked through equal keys.

    Keys point at the smallest key of the rows around them and then at what that one points at, so a chain shrinks to
    half in every round; rounds grow with the logarithm of the longest chain. Hubs meet by shuffle.
    """
    point = stored(rows.select(F.explode(F.array("ka", "kb")).alias("k"), F.least("ka", "kb").alias("m")).groupBy("k").agg(F.min("m").alias("m")), "points")
    edges, seen = stored(rows.select("ka", "kb").distinct(), "edges"), None
    while True:
        # Both keys of a row, and what they point at, get the smaller of the two pointers.
        a, b = point.select(F.col("k").alias("ka"), F.col("m").alias("ma")), point.select(F.col("k").alias("kb"), F.col("m").alias("mb"))
        both = edges.join(a, "ka").join(b, "kb").withColumn("low", F.least("ma", "mb"))
        offers = both.select(F.explode(F.array("ka", "kb", "ma", "mb")).alias("k"), "low").groupBy("k").agg(F.min("low").alias("low"))
        moved = point.join(offers, "k", "left").select("k", F.least("m", "low").alias("m"))
        jump = moved.select(F.col("k").alias("m"), F.col("m").alias("mm"))
        point = stored(moved.join(jump, "m", "left").select("k", F.least("m", "mm").alias("m")), "points")
        now = point.agg(F.sum(F.xxhash64("k", "m").cast("decimal(38,0)"))).first()[0]
        if now == seen:
            return rows.join(point.select(F.col("k").alias("ka"), F.col("m").alias("comp")), "ka")
        seen = now


def _first_wins(batches):
    """Rows in order (comp, o) that win: no earlier winner of their component has one of their keys."""
    import pyarrow as pa

    comp, keys = None, set()
    for batch in batches:
        won = []
        for i, (c, a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
            if c != comp:
                comp, keys = c, set()
            if a not in keys and b not in keys:
                keys.update((a, b))
                won.append(i)
        yield batch.take(pa.array(won, pa.int64())).select([1, 2, 3])


def greedy_first_wins(rows: DataFrame, order: str, key_a: str, key_b: str, name: str) -> DataFrame:
    """``rows`` with ``kept_by``: null for kept rows, else the name of the kept row that shares a key (``key_a`` first).

    A dropped row registers no keys; keys are never null. A few rounds decide what is first under both its keys and what
    shares a key with it: that settles hot keys, in which one row wins. What is left depends on each other in chains; its
    rows are split into components of linked keys, and each is decided in one ordered pass. Of a component of more than
    ``COMPONENT_ROWS`` rows a first range of about as many is decided at a time, so no task holds more.
    """
    start = stored(numbered(rows.select(F.col(order).alias("_order"), F.col(key_a).alias("a"), F.col(key_b).alias("b"), F.col(name).cast("string").alias("n")), [F.col("_order")], "o").select("_order", "o", "n", "a", "b"), "rows")
    # Keys as numbers: those of either kind are told apart.
    todo = start.select("o", F.xxhash64(F.lit(0), "a").alias("ka"), F.xxhash64(F.lit(1), "b").alias("kb"))
    won, rounds = [], 0
    while not todo.isEmpty():
        if rounds < PARALLEL_ROUNDS:
            first_a, first_b = todo.groupBy("ka").agg(F.min("o").alias("fa")), todo.groupBy("kb").agg(F.min("o").alias("fb"))
            kept = todo.join(first_a, "ka").join(first_b, "kb").where((F.col("o") == F.col("fa")) & (F.col("o") == F.col("fb"))).select("o", "ka", "kb")
            decided = None
        else:
            linked = stored(key_components(todo), "linked")
            size = linked.groupBy("comp").agg(F.count("*").alias("c"), F.percentile_approx("o", F.lit([k / 64 for k in range(1, 64)]), 10_000).alias("cuts"))
            large = size.where(F.col("c") > COMPONENT_ROWS)
            # The largest of 63 quantiles below which a task's number of rows lies; the first one at least.
            upto = F.get("cuts", F.greatest(F.floor(F.lit(64.0) * COMPONENT_ROWS / F.col("c")).cast("int") - 1, F.lit(0)))
            now = linked.join(large.select("comp", upto.alias("upto")), "comp", "left").where(F.col("upto").isNull() | (F.col("o") <= F.col("upto")))
            now = stored(now.select("comp", "ka", "kb", "o"), "range")
            kept = now.select("comp", "ka", "kb", "o").repartition("comp").sortWithinPartitions("comp", "o").mapInArrow(_first_wins, "ka long, kb long, o long").select("o", "ka", "kb")
            decided = now.select("o")
        kept, rounds = stored(kept, "kept"), rounds + 1
        won.append(kept)
        todo = todo.join(kept.select("ka"), "ka", "left_anti").join(kept.select("kb"), "kb", "left_anti")
        todo = stored((todo if decided is None else todo.join(decided, "o", "left_anti")).select("o", "ka", "kb"), "todo")
    kept = start.limit(0).select("o") if not won else reduce(DataFrame.unionByName, (w.select("o") for w in won))
    kept = stored(kept, "won")
    # The row that dropped another one is named once all are decided: kept, earlier, and at most one for each key.
    keepers, rest = start.join(kept, "o"), start.join(kept, "o", "left_anti")
    earlier = lambda key: keepers.select(F.col(key).alias(f"k{key}"), F.col("o").alias(f"o{key}"), F.col("n").alias(f"n{key}"))
    named = rest.join(earlier("a"), (F.col("a") == F.col("ka")) & (F.col("oa") < F.col("o")), "left").join(earlier("b"), (F.col("b") == F.col("kb")) & (F.col("ob") < F.col("o")), "left")
    by = named.select("_order", F.coalesce("na", "nb").alias("kept_by")).unionByName(keepers.select("_order", F.lit(None).cast("string").alias("kept_by")))
    return rows.join(by.withColumnRenamed("_order", order), order)


def deduplicate(records: DataFrame, order: str = "_order") -> tuple[DataFrame, DataFrame]:
    """(unique, dropped with ``kept_by``) by canonical URL or by agency and title; the first in ``order`` wins."""
    url, title = duplicate_keys(F.coalesce("official_url_en", "official_url_ar"), F.coalesce("agency_en", "agency_ar"), F.coalesce("title_en", "title_ar"))
    keyed = records.withColumn("_url_key", url).withColumn("_title_key", title)
    done = greedy_first_wins(keyed, order, "_url_key", "_title_key", "service_id").drop("_url_key", "_title_key")
    return done.where("kept_by is null").drop("kept_by"), done.where("kept_by is not null")


def field_coverage(records: DataFrame) -> DataFrame:
    """(field, n): records in which each bilingual field (without URLs and agency) is filled."""
    names = [f"{f}_{lang}" for f in fixed.BILINGUAL if f not in ("official_url", "agency") for lang in ("en", "ar")]
    wide = records.agg(*(F.count_if(~missing(F.col(n))).alias(n) for n in names))
    return wide.unpivot([], names, "field", "n").select("field", "n")


def warning_histogram(validated: DataFrame, column: str = "warnings") -> DataFrame:
    return validated.select(F.explode(column).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


def build_report(loaded: DataFrame, validated: DataFrame, unique: DataFrame, dropped: DataFrame, previous_duplicates: int = 0) -> DataFrame:
    """One row: counters, date range, agencies, domains and per-source counts of a build."""
    by_source = loaded.groupBy("_loader").agg(F.count("*").alias("loaded"))
    ok = validated.where(F.size("errors") == 0).groupBy("_loader").agg(F.count("*").alias("accepted"))
    sources = by_source.join(ok, "_loader", "left").agg(F.sort_array(F.collect_list(F.struct("_loader", "loaded", F.coalesce("accepted", F.lit(0)).alias("accepted")))).alias("sources"))
    main = unique.agg(
        F.count("*").alias("records"),
        F.count_if(~missing(F.col("title_ar"))).alias("with_arabic"),
        F.count_if(~missing(F.col("title_en"))).alias("with_english"),
        F.sort_array(F.collect_set(F.coalesce("agency_en", "agency_ar"))).alias("agencies"),
        F.sort_array(F.collect_set("source_domain")).alias("domains"),
        F.min("date_collected").alias("first_collected"),
        F.max("date_collected").alias("last_collected"),
    )
    rest = validated.agg(F.count_if(F.size("errors") > 0).alias("quarantined"))
    gone = dropped.agg((F.count("*") + previous_duplicates).alias("duplicates_removed"))
    return main.crossJoin(rest).crossJoin(gone).crossJoin(sources)  # one row each


def tag_histogram(records: DataFrame, lang: str = "en") -> DataFrame:
    """(tag, n) of the page tags that ``extra`` keeps as JSON text ``{"page_tags": {lang: [...]}}``."""
    tags = F.from_json(F.get_json_object("extra", f"$.page_tags.{lang}"), "array<string>")
    return records.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def fallback_titles(chunks: DataFrame) -> DataFrame:
    """(service_id, lang, title): the title of the first chunk of each service and language."""
    return chunks.groupBy("service_id", "lang").agg(F.min_by("title", "chunk_id").alias("title"))
