"""Evaluation of rankings and decisions: ranks, summaries, breakdowns, thresholds, curves and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import percentiles, running_sums, with_next


def _rank() -> Column:
    return F.col("rank")


def _score(c: Column) -> Column:
    """A question without any hit scores 0: it is refused, not left out."""
    return F.coalesce(c.cast("double"), F.lit(0.0))


def relevant_ids(bench: DataFrame, separator: str = ";") -> DataFrame:
    """(query_id, service_id): the expected id and the acceptable ones, blanks dropped."""
    ids = F.array_union(F.array("expected_service_id"), F.split(F.coalesce("acceptable_service_ids", F.lit("")), separator))
    return bench.select("query_id", F.explode(F.filter(ids, lambda x: x.isNotNull() & (x != ""))).alias("service_id"))


def first_relevant_rank(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, rank): the first rank that holds a relevant service; queries without one are absent."""
    return hits.join(relevant, ["query_id", "service_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))


def resolve_labels(bench: DataFrame, records: DataFrame) -> DataFrame:
    """Expected (source, title) to service id, the first record wins; unknown titles raise."""
    key = F.lower(F.trim("title_en"))
    known = records.where("title_en is not null").select(F.split_part("service_id", F.lit("-"), F.lit(1)).alias("s"), key.alias("t"), "service_id", "_order").groupBy("s", "t").agg(F.min_by("service_id", "_order").alias("expected_service_id"))
    rows = bench.join(known, (F.col("expected_source") == F.col("s")) & (F.lower(F.trim("expected_title")) == F.col("t")), "left").drop("s", "t")
    lost = rows.where((F.col("supported") == 1) & F.col("expected_service_id").isNull()).select("expected_title").limit(1).collect()
    if lost:
        raise ValueError(f"benchmark title not in the knowledge base: {lost[0][0]}")
    return rows


def summary_columns(k: tuple[int, ...] = (1, 3, 5)) -> list[Column]:
    """n, top-k rates and mean reciprocal rank of a column ``rank`` whose nulls count as misses."""
    hits = [F.avg(F.coalesce((_rank() <= x).cast("double"), F.lit(0.0))).alias(f"top{x}") for x in k]
    return [F.count("*").alias("n"), *hits, F.avg(F.coalesce(1.0 / _rank(), F.lit(0.0))).alias("mrr")]


def breakdowns(rows: DataFrame, *dims: str) -> DataFrame:
    """Summary over all rows and by each dimension on its own, in one pass (grouping sets): (dim, value, ...)."""
    sets = F.array(F.struct(F.lit("all").alias("dim"), F.lit("all").alias("value")), *(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims))
    return rows.select("*", F.explode(sets).alias("g")).groupBy(F.col("g.dim").alias("dim"), F.col("g.value").alias("value")).agg(*summary_columns())


def refusal_columns(score: Column, supported: Column, correct: Column, t: Column) -> list[Column]:
    """Answer/refuse metrics at threshold ``t``; refusing is the positive class."""
    refuse = _score(score) < t
    n = lambda c: F.sum(c.cast("double"))
    tp, fp, fn = n(refuse & ~supported), n(refuse & supported), n(~refuse & ~supported)
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    good = supported & ~refuse & correct
    rate = lambda c, of: F.avg(F.when(of, c.cast("double")))
    return [
        p.alias("refusal_precision"), r.alias("refusal_recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("refusal_f1"),
        rate(refuse, ~supported).alias("unsupported_refused"), rate(~refuse, supported).alias("supported_answered"), rate(good, supported).alias("supported_answered_correct"),
        F.avg((good | (~supported & refuse)).cast("double")).alias("end_to_end_accuracy"), (0.5 * (rate(good, supported) + rate(refuse, ~supported))).alias("balanced_accuracy"),
    ]


def decision_columns(score: Column, supported: Column, rank: Column, t_answer: float, t_tentative: float) -> list[Column]:
    """Three-way decision metrics; null where a denominator is empty."""
    score = _score(score)
    shown, sure = score >= min(t_answer, t_tentative), score >= t_answer
    one, three = F.coalesce(rank == 1, F.lit(False)), F.coalesce(rank <= 3, F.lit(False))
    rate = lambda c, of: F.avg(F.when(of, c.cast("double")))
    n = lambda c: F.sum(c.cast("double"))
    tp, fp, fn = n(~shown & ~supported), n(~shown & supported), n(shown & ~supported)
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return [
        F.count_if(supported).alias("n_answerable"), F.count_if(~supported).alias("n_unanswerable"),
        rate(shown & one, supported).alias("success_top1"), rate(shown & three, supported).alias("success_top3"), rate(~shown, supported).alias("false_refusal_rate"),
        rate(sure, supported).alias("confident_rate"), rate(one, supported & sure).alias("confident_precision"), rate(~shown, ~supported).alias("unsupported_refusal_rate"), rate(sure, ~supported).alias("unsupported_confident_rate"),
        p.alias("refusal_precision"), r.alias("refusal_recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("refusal_f1"),
    ]


def candidate_thresholds(scores: DataFrame, score: str = "top_score") -> DataFrame:
    """(t, gap): midpoints between consecutive distinct scores, and one threshold beyond either end."""
    d = scores.select(_score(F.col(score)).alias("s")).distinct()
    mids = with_next(d, "s", "next").where("next is not null").select(((F.col("s") + F.col("next")) / 2).alias("t"), (F.col("next") - F.col("s")).alias("gap"))
    ends = d.agg(F.min("s").alias("lo"), F.max("s").alias("hi")).select(F.explode(F.array(F.col("lo") - 1e-3, F.col("hi") + 1e-3)).alias("t"), F.lit(0.0).alias("gap")).where("t is not null")
    return mids.unionByName(ends)


def cumulative(rows: DataFrame, score: str = "top_score") -> DataFrame:
    """Candidates (t, gap) with counts of scores at or above each: all, supported, supported and right, and totals.

    One deal into ranges with running sums instead of a pass for each candidate; no task sees all scores.
    """
    sup, good = F.col("supported") == 1, (F.col("supported") == 1) & F.coalesce(_rank() == 1, F.lit(False))
    facts = rows.groupBy(_score(F.col(score)).alias("at")).agg(F.count("*").alias("n"), F.count_if(sup).alias("sup"), F.count_if(good).alias("good"))
    cands = candidate_thresholds(rows, score)
    both = facts.select("at", "n", "sup", "good", F.lit(None).cast("double").alias("gap")).unionByName(cands.select(F.col("t").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("sup"), F.lit(0).cast("long").alias("good"), "gap"))
    whole = facts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"), F.coalesce(F.sum("sup"), F.lit(0)).alias("sup_all"))  # one row
    run = running_sums(both, [F.desc("at")], {f"{c}_above": c for c in ("n", "sup", "good")}).crossJoin(F.broadcast(whole))
    return run.where("gap is not null").select(F.col("at").alias("t"), "gap", "n_above", "sup_above", "good_above", "n_all", "sup_all")


def fit_threshold(rows: DataFrame, score: str = "top_score") -> DataFrame:
    """One row (t, balanced_accuracy): best balanced accuracy, then the widest gap, then the lowest threshold."""
    c = cumulative(rows, score)
    uns = F.col("n_all") - F.col("sup_all")
    acc = 0.5 * (F.col("good_above") / F.col("sup_all") + (uns - (F.col("n_above") - F.col("sup_above"))) / uns)
    return c.withColumn("balanced_accuracy", acc).orderBy(F.desc(F.round("balanced_accuracy", 9)), F.desc("gap"), "t").limit(1).select("t", "balanced_accuracy")


def fit_two_thresholds(rows: DataFrame, min_refusal: float = 0.80, min_precision: float = 0.90, score: str = "top_score") -> DataFrame:
    """One row (t_answer, t_tentative): lowest thresholds that refuse enough and answer precisely enough."""
    c = cumulative(rows, score)
    uns = F.col("n_all") - F.col("sup_all")
    refused = (uns - (F.col("n_above") - F.col("sup_above"))) / uns
    tent = c.agg(F.coalesce(F.min(F.when(refused >= min_refusal, F.col("t"))), F.max("t")).alias("t_tentative"), F.max("t").alias("last"))
    ok = (F.col("n_above") > 0) & (F.col("good_above") / F.col("n_above") >= min_precision) & (F.col("t") >= F.col("t_tentative"))
    return c.crossJoin(tent).agg(F.coalesce(F.min(F.when(ok, F.col("t"))), F.max("last")).alias("t_answer"), F.max("t_tentative").alias("t_tentative"))  # tent is one row


def fit_related(rows: DataFrame, t_tentative: float, margin: float = 0.005) -> DataFrame:
    """One row (t_related): just above the best out-of-domain score, never above ``t_tentative``."""
    return rows.agg(F.least(F.lit(t_tentative), F.max(F.when(F.col("style") == "out_of_domain", F.col("top_score"))) + margin).alias("t_related"))


def threshold_curve(rows: DataFrame, low: int = 20, high: int = 79) -> DataFrame:
    """Refusal metrics at each threshold of low..high hundredths."""
    steps = rows.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("step")).withColumn("t", F.col("step") / 100)
    return steps.groupBy("step").agg(*refusal_columns(F.col("top_score"), F.col("supported") == 1, F.coalesce(_rank() == 1, F.lit(False)), F.col("t")))


def robustness(rows: DataFrame) -> DataFrame:
    """One row over families: share with all wordings at rank 1, all within 3, and the mean share at rank 1."""
    one, three = F.coalesce(_rank() == 1, F.lit(False)), F.coalesce(_rank() <= 3, F.lit(False))
    fam = rows.groupBy("family").agg(F.bool_and(one).cast("double").alias("a1"), F.bool_and(three).cast("double").alias("a3"), F.avg(one.cast("double")).alias("m"))
    return fam.agg(F.count("*").alias("families"), F.avg("a1").alias("all_top1"), F.avg("a3").alias("all_top3"), F.avg("m").alias("mean_top1"))


def latency(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Number, mean, median and 95th percentile (linear interpolation); a group holds a few numbers, whatever its size."""
    return percentiles(rows, value, list(by), {"p50": 0.5, "p95": 0.95})


def config_grid(spark, dense=(0.3, 0.4, 0.5, 0.6), char=(0.0, 0.15, 0.3), bm25=(0.0, 0.15, 0.3, 0.45), tcov=(0.0, 0.1, 0.2)) -> DataFrame:
    """(config_id, w_dense, w_char, w_bm25, w_tcov): the product of weights."""
    rows = [(f"d{a}_c{b}_b{c}_t{d}", a, b, c, d) for a in dense for b in char for c in bm25 for d in tcov]
    return spark.createDataFrame(rows, "config_id string, w_dense double, w_char double, w_bm25 double, w_tcov double")


def select_config(summaries: DataFrame, *tie_break: Column) -> DataFrame:
    """The row with the best mean reciprocal rank, then the best top-1 rate, then ``tie_break``, then its name."""
    return summaries.orderBy(F.desc("mrr"), F.desc("top1"), *tie_break, "config_id").limit(1)


def changed_answers(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, before, after) where two runs put different services first."""
    return a.select("query_id", F.col("top1_service_id").alias("before")).join(b.select("query_id", F.col("top1_service_id").alias("after")), "query_id").where("before <> after")


def benchmark_rows(families: DataFrame, unsupported: DataFrame, cycle: tuple[str, ...] = ("dev", "val", "test", "test", "dev"), prefix: str = "v2q") -> DataFrame:
    """Flat benchmark of supported families and unsupported questions, numbered ``v2q001`` on in input order.

    ``families`` is (ord, family, split, expected_source, expected_title, acceptable, questions array of struct(language,
    style, query)); all wordings of a family share its split. ``unsupported`` is (ord, language, style, query); splits
    go round by ``cycle``.
    """
    sup = families.select("ord", "family", "split", "expected_source", "expected_title", "acceptable", F.posexplode("questions").alias("pos", "q")).select(F.lit(0).alias("part"), "ord", "pos", "family", "split", F.col("q.query").alias("query"), F.col("q.language").alias("language"), F.col("q.style").alias("style"), F.lit(1).alias("supported"), "expected_source", "expected_title", "acceptable")
    i = F.row_number().over(Window.orderBy("ord")) - 1  # a benchmark's questions: hundreds
    uns = unsupported.withColumn("i", i).select(F.lit(1).alias("part"), "ord", F.lit(0).alias("pos"), F.concat(F.lit("unsupported-"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("family"), F.element_at(F.array(*(F.lit(c) for c in cycle)), F.col("i") % len(cycle) + 1).alias("split"), "query", "language", "style", F.lit(0).alias("supported"), *(F.lit("").alias(c) for c in ("expected_source", "expected_title", "acceptable")))
    n = F.row_number().over(Window.orderBy("part", "ord", "pos"))
    return sup.unionByName(uns).withColumn("query_id", F.concat(F.lit(prefix), F.lpad(n.cast("string"), 3, "0"))).drop("part", "ord", "pos")


def in_splits(rows: DataFrame, *splits: str) -> DataFrame:
    return rows.where(F.col("split").isin(*splits))


def split_counts(bench: DataFrame) -> DataFrame:
    """(split, kind, n): answerable and unanswerable questions of each split."""
    kind = F.when(F.col("supported") == 1, "answerable").otherwise("unanswerable")
    return bench.groupBy("split", kind.alias("kind")).agg(F.count("*").alias("n"))


def unknown_services(bench: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, service_id): relevant services of a benchmark that the knowledge base does not hold."""
    return relevant_ids(bench).join(records.select("service_id"), "service_id", "left_anti").select("query_id", "service_id")


def related_block(rows: DataFrame, t_answer: float, t_tentative: float, t_related: float) -> DataFrame:
    """One row: what declined questions get to see when links are shown from ``t_related`` on."""
    score = _score(F.col("top_score"))
    declined, shown, asked = score < min(t_answer, t_tentative), score >= t_related, F.col("supported") == 1
    near = F.coalesce(_rank() <= 3, F.lit(False))
    return rows.where(declined).agg(
        F.count_if(asked).alias("declined_answerable"), F.count_if(asked & shown).alias("declined_answerable_shown"), F.count_if(asked & shown & near).alias("declined_answerable_right"),
        F.count_if(~asked).alias("declined_unanswerable"), F.count_if(~asked & shown).alias("declined_unanswerable_shown"), F.count_if((F.col("style") == "out_of_domain") & shown).alias("out_of_domain_shown"),
    )


def decision_view(rows: DataFrame, t_answer: float, t_tentative: float, style: str = "user_reported") -> DataFrame:
    """(query_id, query, top1_service_id, rank, top_score, decision) of the questions of one style."""
    score = _score(F.col("top_score"))
    decision = F.when(score >= t_answer, "confident").when(score >= min(t_answer, t_tentative), "tentative").otherwise("declined")
    return rows.where(F.col("style") == style).select("query_id", "query", "top1_service_id", "rank", "top_score", decision.alias("decision"))


def per_query_view(rows: DataFrame, split: str = "test") -> DataFrame:
    """The columns that a reader of one split's results looks at."""
    return in_splits(rows, split).select("query_id", "query", "language", "style", "supported", "expected_service_id", "top1_service_id", "rank", "top_score")


def best_per_variant(summaries: DataFrame, variant: str = "variant") -> DataFrame:
    """The configuration of each variant with the best reciprocal rank, then top-1 rate, then name."""
    order = Window.partitionBy(variant).orderBy(F.desc("mrr"), F.desc("top1"), "config_id")
    return summaries.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def selection_history(dev: DataFrame, val: DataFrame, baseline: str, most: int = 8) -> DataFrame:
    """(config_id, dev_mrr, val_mrr, role): the ``most`` best on the first split, and the baseline; the best on the second is chosen."""
    top = dev.orderBy(F.desc("mrr"), F.desc("top1"), "config_id").limit(most).select("config_id", F.col("mrr").alias("dev_mrr"))
    base = dev.where(F.col("config_id") == baseline).select("config_id", F.col("mrr").alias("dev_mrr"))
    rows = top.unionByName(base).distinct().join(val.select("config_id", F.col("mrr").alias("val_mrr")), "config_id")
    first = F.row_number().over(Window.orderBy(F.desc("val_mrr"), F.desc("dev_mrr"), "config_id"))  # at most nine rows
    rows = rows.withColumn("_r", first)
    return rows.select("config_id", "dev_mrr", "val_mrr", F.when(F.col("_r") == 1, "chosen").when(F.col("config_id") == baseline, "baseline").otherwise("candidate").alias("role"))
