import pytest
from pyspark.sql import functions as F
from test_kb import THREE, records

from tessera.functions import fixed
from tessera.operators import answer, claims, evaluate, retrieve
from tessera.operators.index import bm25_postings
from tessera.plans import engine


@pytest.fixture(scope="module")
def kb_rows(spark):
    return records(spark, *THREE, {"service_id": "zt-5", "title_en": "Name fees of the chamber", "agency_en": "Chamber", "fees_en": "2000 riyals", "description_en": "Reserving a trade name. It is needed. Third sentence.", "steps_en": "- Other step"}).cache()


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "trade name reservation service"), (1, "vat registration for businesses"), (2, "divorce notarization")], "chunk_id int, embed_text string")
    q = spark.createDataFrame([(1, "reserve a trade name")], "query_id int, query string")
    got = {r.chunk_id: r.score for r in retrieve.bm25_scores(q, bm25_postings(docs)).collect()}
    assert max(got, key=got.get) == 0 and 2 not in got


def test_title_coverage(spark):
    t = spark.createDataFrame([("a", "Trade Name Reservation"), ("b", "Extension of a trade name reservation")], "service_id string, title string")
    q = spark.createDataFrame([(1, "trade name reservation")], "query_id int, query string")
    got = {r.service_id: r.cov for r in retrieve.title_coverage(q, t).collect()}
    assert got["a"] == 1.0 and got["b"] == 0.75


def test_end_to_end(spark, kb_rows):
    built = engine.build_index(kb_rows)
    q = spark.createDataFrame([(1, "How much are the fees to reserve a trade name?"), (2, "zzz"), (3, "")], "query_id int, query string")
    cfg = fixed.CONFIGS["v3"] | {"t_answer": 0.2, "t_tentative": 0.1, "t_related": 0.05}
    got = {r.query_id: r for r in engine.ask(q, built, kb_rows, cfg, rerank=True).collect()}
    one = got[1]
    assert one.status == "answered" and one.intent == "fees" and one.citations[0].service_id in ("mc-1", "zt-5")
    assert [p.section for p in one.points].index("fees") < [p.section for p in one.points].index("steps")
    assert got[2].status == "insufficient" and got[3].status == "empty"


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id int, service_id string, score double, rank int")


def test_conflict_steps_and_grounding(spark, kb_rows):
    q = spark.createDataFrame([(1, "how much is a trade name")], "query_id int, query string")
    h = hits(spark, (1, "mc-1", 0.9, 1), (1, "zt-5", 0.88, 2), (1, "mc-99", 0.5, 3))
    cfg = {"t_answer": 0.8, "t_tentative": 0.4}
    a = answer.answers(q, h, kb_rows, cfg).first()
    assert [c.service_id for c in a.citations] == ["mc-1", "zt-5"] and len(a.notes) == 1
    steps = [p.text for p in a.points if p.section == "steps"]
    assert steps == ["Log in", "Choose the name", "Pay the fees"]
    assert [p.text for p in a.points if p.section == "direct"] == [THREE[0].get("description_en") or "An electronic service that allows reserving a trade name for a new business."]
    dec = answer.decisions(q, h, cfg)
    cited = answer.citations(answer.support(dec, h, 0.4), kb_rows, dec)
    assert answer.ungrounded(answer.points(cited), cited).count() == 0


def test_decision_and_related(spark):
    q = spark.createDataFrame([(k, "x") for k in range(4)], "query_id int, query string")
    h = hits(spark, (0, "a", 0.9, 1), (1, "a", 0.5, 1), (2, "a", 0.3, 1), (2, "b", 0.1, 2), (2, "c", 0.28, 3))
    dec = answer.decisions(q, h, {"t_answer": 0.8, "t_tentative": 0.4})
    assert {r.query_id: r.status for r in dec.collect()} == {0: "answered", 1: "tentative", 2: "insufficient", 3: "insufficient"}
    assert [r.service_id for r in answer.related_links(dec, h, 0.25).collect()] == ["a"]


def test_merge_and_rerank(spark):
    h = spark.createDataFrame([(1, 0, "a", 0.5, 1), (1, 1, "a", 0.9, 1), (1, 1, "b", 0.86, 2)], "query_id int, variant int, service_id string, score double, rank int")
    assert [(r.service_id, round(r.score, 2)) for r in retrieve.merge_variants(h).orderBy("rank").collect()] == [("a", 0.87), ("b", 0.83)]
    s = spark.createDataFrame([("a", ["cancel"]), ("b", ["renew"])], "service_id string, actions array<string>")
    q = spark.createDataFrame([(1, "renew my record")], "query_id int, query string")
    got = retrieve.rerank(hits(spark, (1, "a", 0.50, 1), (1, "b", 0.49, 2)), s, q).orderBy("new_rank").collect()
    assert [(r.service_id, r.score) for r in got] == [("b", 0.49), ("a", 0.5)]


def test_context_and_turns(spark):
    q = spark.createDataFrame([(1, "كم الرسوم؟", "a"), (2, "كم الرسوم؟", "nope"), (3, "pizza", "a"), (4, "any", None)], "query_id int, query string, context_service_id string")
    t = spark.createDataFrame([("a", "Title")], "service_id string, title string")
    assert [r.query for r in retrieve.with_context(q, t).orderBy("query_id").collect()] == ["كم الرسوم؟ Title", "كم الرسوم؟", "pizza", "any"]
    assert retrieve.with_context(q, t, short_words=4).where("query_id = 3").first().query == "pizza Title"
    c = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(6)], "conv_id int, turn int, role string, text string")
    assert retrieve.last_turns(c).first().turns == "user: t2\nuser: t3\nuser: t4\nuser: t5"


def test_claims(spark, kb_rows):
    pk = spark.createDataFrame([(1, "S1", "fees", "200 riyals"), (1, "S1", "required_documents", "Two photos, 3 forms")], "query_id int, sid string, field string, text string")
    rows = [(1, 1, "It costs 200 riyals", ["S1.fees"]), (2, 1, "It costs 300", ["[S1:fees]"]), (3, 1, "See www.x.com", ["S1"]), (4, 1, "ok", ["S9.fees"]), (5, 1, " ", ["S1"]), (6, 1, "1. Bring 3 forms", ["S1 - docs"]), (7, 1, "3 forms, 200 riyals", ["S1"])]
    got = {r.claim_id: (r.reason, r.ids) for r in claims.validate_claims(spark.createDataFrame(rows, "claim_id int, query_id int, text string, evidence array<string>"), pk).collect()}
    assert [got[k][0] for k in range(1, 8)] == [None, "number_not_in_evidence", "url_in_text", "no_valid_evidence_id", "empty_or_too_long", None, None]
    assert got[7][1] == ["S1.fees", "S1.required_documents"]
    used = kb_rows.where("service_id = 'mc-1'").withColumns({"query_id": F.lit(1), "n": F.lit(1), "lang": F.lit("en")})
    assert {r.field for r in claims.evidence_package(used).collect()} >= {"title", "agency", "fees", "steps", "description"}


def test_metrics(spark):
    r = spark.createDataFrame([(1,), (2,), (None,), (4,)], "rank int").agg(*evaluate.summary_columns()).first()
    assert (r.top1, r.top3) == (0.25, 0.5) and r.mrr == pytest.approx((1 + 0.5 + 0 + 0.25) / 4)
    d = spark.createDataFrame([(0.9, True, True), (0.8, True, False), (0.2, False, False), (0.6, False, False)], "s double, sup boolean, ok boolean")
    m = d.agg(*evaluate.refusal_columns(F.col("s"), F.col("sup"), F.col("ok"), F.lit(0.5))).first()
    assert (m.refusal_recall, m.refusal_precision, m.end_to_end_accuracy) == (0.5, 1.0, 0.5)


def test_thresholds(spark):
    rows = list(zip([0.9, 0.8, 0.7, 0.6, 0.35, 0.3, 0.25, 0.5], [1, 1, 1, 1, 0, 0, 0, 0], [1, 1, 2, 1, None, None, None, None], strict=True))
    df = spark.createDataFrame(rows, "top_score double, supported int, rank int")
    t = evaluate.fit_two_thresholds(df, 0.75, 0.9).first()
    uns = [s for s, sup, _ in rows if not sup]
    assert sum(s < t.t_tentative for s in uns) / 4 >= 0.75 and all(s >= t.t_tentative for s, sup, _ in rows if sup) and t.t_answer >= t.t_tentative
    assert evaluate.fit_threshold(df).first().t == pytest.approx(0.55)
    assert evaluate.threshold_curve(df).count() == 60


def test_modes_and_notes_after_a_reply(spark):
    from pyspark.sql import functions as F

    from tessera.operators import claims

    rows = [  # status, related, answerable, in scope, notes: mode
        ("answered", False, "full", True, [], "grounded_answer"), ("answered", False, "full", True, ["x"], "partial_answer"), ("answered", False, "partial", True, [], "partial_answer"),
        ("answered", False, None, True, ["x"], "grounded_answer"), ("answered", False, "none", True, [], "related_services"), ("tentative", False, "partial", True, ["x"], "possible_match"),
        ("tentative", False, "none", True, [], "related_services"), ("answered", True, "full", False, [], "insufficient_evidence"), ("insufficient", True, None, True, [], "related_services"), ("insufficient", False, None, True, [], "insufficient_evidence"),
    ]
    df = spark.createDataFrame(rows, "s string, r boolean, a string, i boolean, n array<string>, want string")
    got = df.select("want", claims.response_mode(F.col("s"), F.col("r"), F.col("a"), F.col("i"), F.col("n")).alias("mode")).collect()
    assert [r["mode"] for r in got] == [r.want for r in got]
    notes = spark.createDataFrame([("fees", ["fees"], "en"), ("fees", ["steps"], "en"), ("time", None, "ar"), ("general", [], "en"), (None, [], "en")], "intent string, verified array<string>, lang string")
    got = [r[0] for r in notes.select(claims.unverified_note(F.col("intent"), F.col("verified"), F.col("lang"))).collect()]
    assert got[0] is None and got[1].endswith("the current fee") and got[2].endswith("مدة التنفيذ") and got[3:] == [None, None]
    once = notes.limit(1).select(claims.unverified_notes(F.array(F.lit("a"), F.lit("b")), F.lit("b")), claims.unverified_notes(F.array(F.lit("a")), F.lit("b")), claims.unverified_notes(F.lit(None).cast("array<string>"), F.lit(None).cast("string"))).first()
    assert [list(x) for x in once] == [["a", "b"], ["b", "a"], []]


def test_run_summary_and_encoded_questions(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.operators import claims, index

    shape = "kind string, mode string, text_origin string, calls int, tokens_in int, tokens_out int, seconds double, proposed int, rejected int, language_ok boolean, error string, rejections map<string,int>"
    rows = [("gap", "partial_answer", "ai", 2, 10, None, 1.0, 3, 1, True, None, {"numbers": 1}), ("unsupported", "grounded_answer", "official_verbatim", None, 5, 1, 2.0, 0, 0, False, "timeout", None)]
    one, why = claims.run_summary(spark.createDataFrame(rows, shape))
    r = one.first()
    assert (r.questions, r.calls, r.tokens_in, r.tokens_out, r.written_answers, r.fallbacks, r.language_ok, r.partial_answers, r.unsupported_answered, r.mean_seconds) == (2, 2, 15, 1, 1, 1, 1, 1, 1, 1.5)
    assert [tuple(x) for x in why.collect()] == [("numbers", 1)]

    asked = []

    def encode(new):
        asked.append(new.count())
        return new.select("digest", F.array(F.length("text").cast("double")).alias("qvec"))

    q = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, "abc")], "query_id int, query string")
    for _ in range(2):
        got = {r.query_id: r.qvec for r in index.encoded(q, f"file://{tmp_path}/store", encode).collect()}
        assert got == {1: [2.0], 2: [2.0], 3: None, 4: [3.0]}
    assert asked == [2, 0]
