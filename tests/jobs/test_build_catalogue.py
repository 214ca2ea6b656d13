import json
import os
import subprocess
import sys

import pytest

from jobs import build_catalogue

LONG = "A service that renews the commercial registration of a company."
PAGES = [
    (3, "https://a.example.com/x", f"<title>Renew &amp; pay</title><p>{LONG}</p>"),
    (1, "https://b.example.com/y", f"<title>Renew   &amp;amp; pay </title>\n<p>{LONG}</p>"),
    (2, "https://www.a.example.com/x/", f"<title>Other</title><p>{LONG}</p>"),
    (4, "https://c.example.com/z", f"<title>renew - pay!</title><p>{LONG}</p>"),
    (5, "http://c.example.com/z", "<title>Short</title><p>x</p>"),
    (6, "https://q.example.net/z", f"<title>Elsewhere</title><p>{LONG}</p>"),
    (7, "https://mc.gov.sa/z", f"<p>no title</p><p>{LONG}</p>"),
    (8, None, None),
    (None, "https://c.example.com/z", f"<title>No id</title><p>{LONG}</p>"),
    (9, "https://d.example.org/", f"<title>Renew & pay</title><p>{LONG}</p>"),
]


def rows(spark, at, name, *columns):
    return sorted(tuple(r) for r in spark.read.parquet(f"{at}/{name}").select(*columns).collect())


def test_catalogue(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([(*p, "x") for p in [*PAGES, PAGES[0]]], "page_id long, url string, html string, title_en string").write.parquet(f"{at}/pages")
    done = build_catalogue.run(spark, f"{at}/pages", f"{at}/out")
    # 3 has the address of 2; 4 has the title of 3, which as a dropped record claims none; "&amp;amp;" is unescaped once.
    assert rows(spark, f"{at}/out", "accepted", "service_id", "title_en", "source_domain") == [("web-1", "Renew &amp; pay", "my.gov.sa"), ("web-2", "Other", "my.gov.sa"), ("web-4", "renew - pay!", "my.gov.sa"), ("web-9", "Renew & pay", "absher.sa")]
    assert rows(spark, f"{at}/out", "duplicates", "service_id", "kept_by") == [("web-3", "web-2")]
    reasons = {i: (r, n) for i, r, n in ((r.service_id, r.reason, len(r.errors)) for r in spark.read.parquet(f"{at}/out/quarantined").collect())}
    assert reasons == {"web-5": ("no official content", 2), "web-6": ("source_domain not an official Saudi domain", 1), "web-7": ("missing title", 2), "web-8": ("missing title", 5)}
    assert done == {"read": 11, "accepted": 4, "duplicates": 1, "quarantined": 4, "chunks": 8}
    assert json.loads(spark.read.text(f"{at}/out/report").first()[0])["records"] == 4
    before = {n: sorted(map(str, spark.read.parquet(f"{at}/out/{n}").collect())) for n in ("accepted", "duplicates", "quarantined", "chunks")}
    assert build_catalogue.run(spark, f"{at}/pages", f"{at}/out") == done
    assert before == {n: sorted(map(str, spark.read.parquet(f"{at}/out/{n}").collect())) for n in before}


def test_empty_and_config(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([], "page_id int, url string, html string").write.parquet(f"{at}/pages")
    (tmp_path / "c.json").write_text(json.dumps({"domains": {}}))
    assert build_catalogue.run(spark, f"{at}/pages", f"{at}/out", f"file://{tmp_path}/c.json")["accepted"] == 0
    (tmp_path / "c.json").write_text(json.dumps({"domain": {}}))
    with pytest.raises(ValueError):
        build_catalogue.run(spark, f"{at}/pages", f"{at}/out", f"file://{tmp_path}/c.json")


def test_command_line(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.run([sys.executable, "-m", "jobs.build_catalogue", "--pages", f"{tmp_path}/pages", "--output", f"{tmp_path}/out", "--config", f"{root}/jobs/build_catalogue.json"], cwd=root, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0 and "'read': 10" in run.stderr, run.stderr[-2000:]
    assert len(rows(spark, f"file://{tmp_path}/out", "accepted", "service_id")) == 4
