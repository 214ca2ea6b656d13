import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, templates, threshold):
    """(places of phrases, blocks) of a text: every block is intersected with every template."""
    w = words(text)
    places = sorted((label, i) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(words(p))] == words(p))
    blocks = []
    for label, t in templates:
        own, step = set(words(t)), 1
        while step < len(words(t)):
            step *= 2
        if own:
            blocks += [(label, a, n, len(own)) for a in range(0, len(w), step) if (n := len(own & set(w[a : a + 2 * step]))) >= max(1, threshold * len(own) - 1e-9)]
    return len(w), places, sorted(blocks)


def texts(seed=1):
    rnd = random.Random(seed)
    filler = ["of", "the", "this", "license", "software", "and", "to", "any", "x1", "Maße", "alpha", "gnu", "mit", "cc", "by"]
    out = [None, "", " . ", "MIT LICENSE", "mit-license Cc By cc by by", "gnu general public license version", "The KİT licenſe mıt license"]
    for label, t in licenses.TEMPLATES:
        for drop in (0, 0.05, 0.12, 0.3):
            w = [x for x in re.split(r"(\W+)", t) if rnd.random() >= drop or not x.isalnum()]
            before = " ".join(rnd.choices(filler, k=rnd.choice([0, 1, 5, 63, 64, 200])))
            out.append(f"{before}\n# {''.join(w)} {' '.join(rnd.choices(filler, k=rnd.choice([0, 3, 130])))}")
    out.append(" ".join(rnd.choices(filler, k=50_000)) + " " + licenses.TEMPLATES[7][1])
    return out


@pytest.mark.parametrize("threshold", [0.9, 0.6, 1.0])
def test_against_brute_force(spark, threshold):
    rows = [(k, t, k) for k, t in enumerate(texts())]
    rows += [rows[7], (7, "another text, MIT license", 0), (None, "cc by", 0), (None, "cc by", 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").withColumn("start", F.lit("s"))
    got = licenses.scan_licenses(df, threshold=threshold).collect()
    plain = [(r.doc_id, r.n_words, [tuple(x) for x in r.base], [tuple(x) for x in r.found]) for r in got]
    want = [(i, *brute(t, licenses.TEMPLATES, threshold)) for i, t, _ in rows]
    assert sorted(map(repr, plain)) == sorted(map(repr, want))


def test_order_and_bounds(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a a a b B c"), (2, None)], "doc_id long, text string")
    vocabulary, rows = licenses.order_templates(df, [("t", "a b c d, a"), ("empty", "...")], 0.5)
    assert vocabulary == ["d", "c", "b", "a"] and rows == [("t", ["d", "c", "b", "a"], 2, 8)]
    monkeypatch.setattr(licenses, "MAX_WORDS", 3)
    with pytest.raises(ValueError):
        licenses.order_templates(df, [("t", "a b c d")], 0.5)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan_licenses(none).count() == 0
    some = spark.createDataFrame([(1, "the MIT license")], "doc_id long, text string")
    r = licenses.scan_licenses(some, templates=[]).collect()
    assert [(x.n_words, [tuple(b) for b in x.base], x.found) for x in r] == [(3, [("mit", 1)], [])]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "the MIT license")], "doc_id long, text string").withColumn("text", F.concat("text", F.lit(" x")))
    plan = licenses.scan_licenses(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
