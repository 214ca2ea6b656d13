import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import fixed, rules, text, vectors


def test_normalize_arabic(apply):
    got = apply(text.normalize_arabic, ["إصدار أمر آخر", "شركة", "مستشفى", "تِجَارَة", "تـــجارة", "٥٠٠ ريال", "اسماً تجارياً", "كتابا", "ماءً", None])
    assert got == ["اصدار امر اخر", "شركه", "مستشفي", "تجاره", "تجاره", "500 ريال", "اسم تجاري", "كتابا", "ماء", ""]


def test_normalize_for_matching(apply):
    assert apply(text.normalize_for_matching, ["Trade-Name   Reservation!", "حجز  الاسم، التجاري؟", ""]) == ["trade name reservation", "حجز الاسم التجاري", ""]


def test_languages(apply):
    assert apply(text.detect_language, ["كيف أجدد السجل", "renew my record", "renew my السجل", ""]) == ["ar", "en", "mixed", "en"]
    assert apply(text.query_language, ["كيف أجدد", "how", None]) == ["ar", "en", "en"]


def test_clean_text_and_nfc(apply):
    assert apply(text.clean_text, ["  Pay  the​ fees \n\n next ", " \n ", None]) == ["Pay the fees\nnext", None, None]
    assert apply(text.nfc, ["é", None]) == ["é", None]


def test_urls(apply):
    assert apply(text.domain_of, ["https://www.moe.gov.sa/en/a", "no url", None]) == ["moe.gov.sa", None, None]
    assert apply(text.valid_url, ["https://a.sa/x", "http://a.sa", "https://", None]) == [True, False, False, False]
    assert apply(text.official_domain, ["mc.gov.sa", "my.gov.sa", "example.com", "gov.sa.example.com", "mc.gov.sa:443", None]) == [True, True, False, False, True, False]


def test_tokenize(apply):
    got = apply(text.tokenize, ["Registering companies", "the fees of my visas", "السجل التجاري", "", None])
    assert got == [["register", "compani"], ["fee", "visa"], ["سجل", "تجاري"], [], []]


def test_light_stem(apply):
    assert apply(lambda c: F.transform(text.words(c), text.light_stem), ["Booking names"]) == [["book", "nam"]]


def test_char_ngrams(apply):
    got = apply(text.char_ngrams, ["a bcd", ""])
    assert got == [[" a ", " bc", "bcd", "cd ", " bcd", "bcd ", " bcd "], []]


def test_split_items(apply):
    got = apply(text.split_items, ["- one\n- two", "First. Second! third\nnext", None])
    assert got == [["one", "two"], ["First.", "Second!", "third", "next"], []]


def test_redact(apply):
    got = apply(text.redact, ["My iqama 2123456789, card 4111 1111 1111 1111, OTP 483920, passport A12345678", "nothing here"])
    assert got[0].n == 4 and "4111" not in got[0].text and "[ID_NUMBER]" in got[0].text
    assert (got[1].text, got[1].n) == ("nothing here", 0)


def _redacted(t):
    n = 0
    for label, p in fixed.REDACTIONS:
        t, k = re.subn(p.replace(r"[^\p{L}\p{N}_]", r"\W"), label, t, flags=re.ASCII if "OTP" not in label else 0)
        n += k
    return n


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="0123456789 -otpSAcode:x", max_size=40), min_size=1, max_size=20))
def test_redact_counts_as_python(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.n for r in df.select("k", text.redact(F.col("t")).alias("r")).orderBy("k").select("r.n").collect()]
    assert got == [_redacted(t) for t in texts]


def test_numbers(apply):
    assert apply(text.numbers, ["1,000 and 2.5, then 1000 and ٥", None]) == [["1000", "2.5", "5"], []]


def test_expansions(apply):
    got = apply(rules.expansions, ["the crane operator", "renew my CR", "كم رسوم التجديد", "l.l.c please"])
    assert got[0] == [] and "commercial registration" in got[1] and "renewal extension" in got[1] and "رسوم الخدمه" in got[2] and got[3] == ["limited liability company"]


def test_intents(apply):
    assert apply(rules.detect_intent, ["كم رسوم تجديد السجل؟", "What documents do I need for a visa?", "how long does it take", "شروط الاستقدام", "hello"]) == ["fees", "documents", "time", "requirements", "general"]


def test_actions(apply):
    got = apply(rules.query_actions, ["I want to delete my CR", "كيف أطلع سجل تجاري؟", "ابي احجز اسم تجاري", "فقدت الإقامة وش أسوي؟", "register", "x"])
    assert [set(g.actions) for g in got] == [{"cancel"}, {"issue"}, {"reserve"}, {"replace"}, {"issue"}, set()]
    assert [g.strong for g in got] == [True, True, True, True, False, False]
    assert apply(rules.title_action, ["Renewal then cancellation", "Registration", "none"]) == ["renew", "issue", None]


def test_followups(apply):
    assert apply(rules.looks_like_followup, ["كم الرسوم؟", "pizza", "I would like to know everything about opening a new company in Riyadh please"]) == [True, False, False]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(vectors.dot(F.col("a"), F.col("a")).alias("d"), vectors.unit(F.col("a")).alias("u"), vectors.unit(F.col("z")).alias("z")).first()
    assert (r.d, r.u, r.z) == (25.0, [0.6, 0.8], [0.0, 0.0])


def test_trigram_encoder(spark):
    rows = vectors.trigram_encoder(spark.createDataFrame([(1, "visa visa"), (2, "")], "k int, t string"), "k", "t").collect()
    assert sum(r.w**2 for r in rows if r.k == 1) == pytest.approx(1)


def test_expansions_are_those_of_the_patterns(spark):
    """Phrases looked up word by word give what the rules' patterns give."""
    import random

    import regex
    from pyspark.sql import functions as F

    from tessera.functions import rules
    from tessera.functions.text import normalize_arabic

    rnd = random.Random(5)
    table, _, _ = rules.phrase_table()
    phrases = sorted(table)
    bits = [*phrases, "x", "business", " name", "the", "_", "é", "ة", "-", "  ", "'", "9"]
    texts = ["", None, "Business Name?", "businessname", "shop  name", "a shop name9", "(booking)"] + ["".join(rnd.choice(bits) + rnd.choice([" ", " ", "", "-", "? ", "\n"]) for _ in range(rnd.choice([1, 3, 8]))) for _ in range(250)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: (r.n, r.e) for r in df.select("k", F.lower(normalize_arabic(F.col("t"))).alias("n"), rules.expansions(F.col("t")).alias("e")).collect()}
    for k in range(len(texts)):
        n, e = got[k]
        assert e == list(dict.fromkeys(add for p, add in rules.expansion_rules() if regex.search(p, n or ""))), texts[k]
