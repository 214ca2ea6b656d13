import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog, chunks, kb
from tessera.sources.records import FIELDS

GOOD = {"source_type": "official_web_page", "source_domain": "mc.gov.sa", "verification_status": "verified_official_capture", "date_collected": "2026-09-30T10:00:00Z", "source_sha256": "en:abc", "title_en": "Trade Name Reservation", "agency_en": "Ministry of Commerce", "description_en": "An electronic service that allows reserving a trade name for a new business."}


def records(spark, *rows):
    schema = ", ".join(f"{f} string" for f in FIELDS) + ", extra string, _loader string, _order long"
    data = []
    for k, r in enumerate(rows):
        r = GOOD | {"service_id": f"mc-{k}", "official_url_en": f"https://mc.gov.sa/{k}"} | r
        data.append(tuple(r.get(f) for f in FIELDS) + (None, "test", k))
    return spark.createDataFrame(data, schema)


THREE = [
    {"service_id": "mc-1", "title_ar": "حجز اسم تجاري", "description_ar": "خدمة إلكترونية تتيح حجز اسم تجاري", "fees_en": "200 riyals", "steps_en": "- Log in\n- Choose the name\n- Pay the fees"},
    {"service_id": "mc-99", "title_en": "Establish a limited liability company", "title_ar": "تأسيس شركة ذات مسؤولية محدودة", "description_en": "Establish a company with limited liability for its partners.", "description_ar": "تأسيس شركة ذات مسؤولية محدودة للشركاء"},
    {"service_id": "mc-30", "title_en": "Defective Products Inquiry", "description_en": "Ask whether a product has been recalled by its maker."},
]


def errors(spark, **change):
    return kb.validate(records(spark, change)).select("errors", "warnings").first()


def test_validation(spark):
    assert errors(spark).errors == []
    assert errors(spark, title_en=None).errors == ["missing title (en and ar)"]
    assert errors(spark, official_url_en=None).errors == ["missing official_url"]
    assert "invalid official_url_en" in errors(spark, official_url_en="http://mc.gov.sa/x").errors[0]
    assert len(errors(spark, source_domain="gov.sa.example.com").errors) == 1 and errors(spark, source_domain="my.gov.sa").errors == []
    assert any("not indexable" in e for e in errors(spark, verification_status="unverified", source_type="seed_manual_summary").errors)
    assert errors(spark, date_collected=None, source_sha256=None).errors == ["verified record without date_collected", "verified record without source_sha256"]
    assert "title_ar is mostly non-Arabic script" in errors(spark, title_ar="English").warnings
    assert errors(spark, description_en="- - short").errors == ["no official content (description/steps/requirements/documents)"]
    assert "unknown source_type 'x'" in errors(spark, source_type="x").errors


def test_deduplicate(spark):
    rows = [{"service_id": "a", "official_url_en": "https://www.mc.gov.sa/en/x"}, {"service_id": "b", "official_url_en": "https://mc.gov.sa/en/x/", "title_en": "Other"}, {"service_id": "c", "official_url_en": "https://mc.gov.sa/en/y"}, {"service_id": "d", "title_en": "New"}]
    unique, dropped = kb.deduplicate(records(spark, *rows))
    assert {r.service_id for r in unique.collect()} == {"a", "d"}
    assert {(r.service_id, r.kept_by) for r in dropped.collect()} == {("b", "a"), ("c", "a")}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_against_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [(k, f"a{rnd.randrange(25)}", f"b{rnd.randrange(25)}", f"n{k}") for k in range(120)]
    by_a, by_b, want = {}, {}, {}
    for _, a, b, n in rows:
        hit = by_a.get(a) or by_b.get(b)
        want[n] = hit
        if not hit:
            by_a[a] = by_b[b] = n
    got = kb.greedy_first_wins(spark.createDataFrame(rows, "o int, a string, b string, n string"), "o", "a", "b", "n")
    assert {r.n: r.kept_by for r in got.collect()} == want


def test_greedy_empty(spark):
    assert kb.greedy_first_wins(spark.createDataFrame([], "o int, a string, b string, n string"), "o", "a", "b", "n").count() == 0


def test_chunks(spark):
    rows = chunks.chunk_records(records(spark, *THREE)).collect()
    one = [(r.lang, r.section) for r in rows if r.service_id == "mc-1"]
    assert sorted(one) == sorted([("en", "title"), ("en", "overview"), ("en", "steps"), ("en", "service_facts"), ("ar", "title"), ("ar", "overview")])
    facts = next(r for r in rows if r.chunk_id == "mc-1::en::service_facts")
    assert facts.text == "Fees: 200 riyals" and facts.embed_text.endswith("Fees & service details: Fees: 200 riyals")
    title = next(r for r in rows if r.chunk_id == "mc-30::en::title")
    assert title.embed_text == "Defective Products Inquiry. Ministry of Commerce"


def test_fingerprint_and_unique(spark):
    c = chunks.chunk_records(records(spark, *THREE))
    assert chunks.fingerprint(c) == chunks.fingerprint(c.orderBy(F.desc("chunk_id")))
    assert chunks.fingerprint(c) != chunks.fingerprint(c.withColumn("embed_text", F.upper("embed_text")))
    with pytest.raises(ValueError):
        chunks.assert_unique(c.unionByName(c))


def test_report_and_catalog(spark):
    rec = records(spark, *THREE, {"service_id": "mc-7", "verification_status": "unverified"})
    v = kb.validate(rec)
    ok, bad = kb.split_valid(v)
    unique, dropped = kb.deduplicate(ok)
    r = kb.build_report(rec, v, unique, dropped).first()
    assert (r.records, r.with_arabic, r.quarantined, r.duplicates_removed) == (3, 2, 1, 0) and r.sources[0].loaded == 4
    cover = {(x.field, x.lang): x.n for x in catalog.coverage_chart(kb.field_coverage(rec)).collect()}
    assert cover["title", "ar"] == 2 and cover["fees", "en"] == 1
    assert "not indexable" in catalog.quarantine_view(bad).first().errors
    page = catalog.list_services(rec, search="defective").collect()
    assert [p.service_id for p in page] == ["mc-30"] and page[0].total == 1
    assert catalog.agencies(rec).first().services == 4
    assert catalog.service_detail(rec, "mc-1").first().ar.title == "حجز اسم تجاري"
    with pytest.raises(ValueError):
        catalog.service_detail(rec, "../x")
    assert [x.service_id for x in catalog.explore(rec, "recalled product").collect()] == ["mc-30"]


def loop_first_wins(rows):
    by_a, by_b, want = {}, {}, {}
    for _, a, b, n in rows:
        want[n] = by_a.get(a) or by_b.get(b)
        if not want[n]:
            by_a[a] = by_b[b] = n
    return want


@pytest.mark.parametrize("limit", [400])
def test_greedy_on_a_long_chain(spark, monkeypatch, limit):
    """Each row shares a key with the one before: a round for each link would be thousands of jobs."""
    monkeypatch.setattr(kb, "COMPONENT_ROWS", limit)
    rows = [(k, f"a{(k + 1) // 2}", f"b{k // 2}", f"n{k}") for k in range(1000)]
    spark.sparkContext.setJobGroup("chain", "chain")
    got = kb.greedy_first_wins(spark.createDataFrame(rows, "o long, a string, b string, n string"), "o", "a", "b", "n").collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.n: r.kept_by for r in got} == loop_first_wins(rows)
    assert jobs < 900  # three ranges; not one round for each of a thousand links


def test_greedy_with_a_hot_key_and_a_struct_order(spark):
    rows = [(k, "hot" if k % 3 else f"a{k}", f"b{k % 50}", f"n{k}") for k in range(600)]
    df = spark.createDataFrame(rows, "o long, a string, b string, n string").withColumn("o", F.struct(F.lit(0).alias("x"), F.col("o").alias("y")))
    assert {r.n: r.kept_by for r in kb.greedy_first_wins(df, "o", "a", "b", "n").collect()} == loop_first_wins(rows)
    assert kb.greedy_first_wins(df.limit(0), "o", "a", "b", "n").count() == 0
