import json

import numpy as np
import pytest
from test_kb import GOOD

from tessera.operators import claims, evaluate, index


def test_replies_to_claims(spark):
    reply = {"answerable": "full", "direct_answer": {"text": "a", "evidence": ["S1.fees"]}, "sections": [{"key": "fees", "points": [{"text": "b", "evidence": ["S1"]}]}, {"key": "nope", "points": [{"text": "c", "evidence": []}]}]}
    df = spark.createDataFrame([(1, f"```json\n{json.dumps(reply)}\n```"), (2, "no object"), (3, '{"broken": '), (4, None)], "query_id int, reply string")
    got = claims.claims_of_replies(df).orderBy("claim_id").collect()
    assert [(r.claim_id, r.section, r.text, r.evidence) for r in got] == [("1-0", "direct", "a", ["S1.fees"]), ("1-1", "fees", "b", ["S1"])]


def test_remove_common(spark):
    rng = np.random.default_rng(0)
    common = rng.standard_normal(6)
    rows = [(f"w{k}", (rng.standard_normal() * 5 * common + rng.standard_normal(6)).tolist()) for k in range(200)]
    got = np.array([r.vec for r in index.remove_common(spark.createDataFrame(rows, "word string, vec array<double>"), 1).collect()])
    assert np.allclose(np.linalg.norm(got, axis=1), 1) and np.abs(got @ common / np.linalg.norm(common)).mean() < 0.2
    assert index.lexicon_words(spark).where("word = 'passport'").count() == 1


def test_benchmark_rows(spark):
    fam = spark.createDataFrame([(0, "f1", "dev", "mc", "T", "", [("en", "plain", "q1"), ("ar", "plain", "q2")])], "ord int, family string, split string, expected_source string, expected_title string, acceptable string, questions array<struct<language:string,style:string,query:string>>")
    uns = spark.createDataFrame([(k, "en", "out_of_domain", f"u{k}") for k in range(3)], "ord int, language string, style string, query string")
    got = evaluate.benchmark_rows(fam, uns).orderBy("query_id").collect()
    assert [(r.query_id, r.query, r.split, r.family) for r in got] == [("v2q001", "q1", "dev", "f1"), ("v2q002", "q2", "dev", "f1"), ("v2q003", "u0", "dev", "unsupported-00"), ("v2q004", "u1", "val", "unsupported-01"), ("v2q005", "u2", "test", "unsupported-02")]


def test_command_line(spark, tmp_path, capsys):
    from tessera.__main__ import main

    rec = GOOD | {"service_id": "mc-1", "fees_en": "200 riyals", "official_url_en": "https://mc.gov.sa/1"}
    (tmp_path / "r.jsonl").write_text(json.dumps(rec))
    assert main([f"{tmp_path}/r.jsonl", "reserve trade name fees", "--json"]) == 0 and json.loads(capsys.readouterr().out)["query_id"] == 1
    assert main([]) == 2


def test_labels_resolve_or_raise(spark):
    rec = spark.createDataFrame([("mc-1", "Title", 0), ("mc-2", " title ", 1)], "service_id string, title_en string, _order int")
    bench = lambda t: spark.createDataFrame([("mc", t, 1)], "expected_source string, expected_title string, supported int")
    assert evaluate.resolve_labels(bench("TITLE"), rec).first().expected_service_id == "mc-1"
    with pytest.raises(ValueError):
        evaluate.resolve_labels(bench("other"), rec)
