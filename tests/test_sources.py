import hashlib
import json

import pytest

from tessera.sources import pages, records, sinks
from tessera.sources.html import page_title_and_text

TABS = """<html><body><nav>menu</nav><main><h1>Renewal of a licence</h1><p>This service lets establishments renew a licence before it ends.</p>
<ul class="nav-tabs"><li><a role="tab" href="#t1">Service Steps</a></li><li><a role="tab" href="#t2">Required Documents</a></li></ul>
<div id="t1"><ol><li>Log in</li><li>Pay</li></ol></div><div id="t2"><p>Identity card</p></div>
<h3>Service Fees</h3><p>500 riyals</p><p><strong>Duration:</strong> 3 days</p><p class="fw-bold">Beneficiaries</p><p>Companies</p><h3>Conditions</h3><p>None</p>
<h2>Related services</h2><div class="card"><h3>Fees</h3><p>999 riyals</p></div></main></body></html>"""


def test_title_and_text():
    assert page_title_and_text("<title>T</title><h2>Head</h2><script>x</script><main><p>a</p><p>b</p></main>") == ("Head", "a\nb")
    assert page_title_and_text("") == (None, None)


def test_labelled_page():
    p = pages.parse_labelled_page(TABS)
    assert p["title"] == "Renewal of a licence" and p["steps"] == "- Log in\n- Pay" and p["required_documents"] == "Identity card"
    assert p["fees"] == "500 riyals" and p["processing_time"] == "3 days" and p["target_audience"] == "Companies" and "requirements" not in p
    assert p["description"].startswith("This service lets")


@pytest.mark.parametrize("tab", ['<a role="tab" href="#p">{}</a>', '<button data-toggle="pill" data-target="#p">{}</button>', '<a data-bs-toggle="tab" data-bs-target="#p">{}</a>', '<div role="tab" aria-controls="p">{}</div>', '<a href="#p">{}</a>'])
def test_tabs(tab):
    page = f"<main><h1>Permit</h1>{tab.format('Service Steps')}<div id='p'><h4>Service Steps</h4><ul><li>One</li><li>Two</li></ul></div><div role='tabpanel'><h3>Fees</h3><p>9</p></div></main>"
    p = pages.parse_labelled_page(page)
    assert p["steps"] == "- One\n- Two" and "fees" not in p


def test_fixed_tabs_escaped_text_and_forms():
    page = "<form><h1>Permit</h1><div id='steps'>&lt;ol&gt;&lt;li&gt;Go&lt;/li&gt;&lt;li&gt;Pay&lt;/li&gt;&lt;/ol&gt;</div><div id='terms'>None</div><dl><dt>Duration</dt><dd>2 | 4</dd><dt>Fees</dt><dd>Free</dd><dd>for all</dd></dl></form>"
    p = pages.parse_labelled_page(page)
    assert p["steps"] == "- Go\n- Pay" and p["fees"] == "Free\nfor all" and not {"requirements", "processing_time"} & set(p)


def test_description_of_another_service_is_not_taken():
    long = "This is a text about the service of more than thirty letters."
    card = f"<div class='card'><div class='service-description'>{long} Other.</div></div>"
    assert pages.parse_labelled_page(f"<main><h1>A</h1>{card}<div class='service-description'>{long}</div></main>")["description"] == long
    assert pages.parse_labelled_page(f"<main><h1>A</h1>{card}<p>{long} Own.</p></main>")["description"] == long + " Own."
    assert pages.parse_labelled_page(f"<main><h1>A</h1><a><p>{long}</p></a><p>Short</p><div>{long} Leaf.</div></main>")["description"] == long + " Leaf."


def test_hidden_and_foreign_parts_are_left_out():
    page = "<main><div class='breadcrumb'>Home</div><h1>T</h1><h3>Fees</h3><p>5 riyals<span style='display: none'>hidden</span></p><div class='share-box'>Share</div><div class='rating'>Stars</div><script>x</script><p>Similar Services</p><h3>Conditions</h3><p>Of another one</p></main>"
    p = pages.parse_labelled_page(page)
    assert p["fees"] == "5 riyals" and "requirements" not in p
    assert pages.parse_labelled_page("", "Renewal - Ministry")["title"] == "Renewal" and pages.parse_labelled_page(None)["title"] is None


def test_bold_leads_and_repeated_headings():
    page = "<main><h1>T</h1><p><b>Fees:</b> 10 riyals</p><p>each</p><p><b>Duration</b></p><p>1 day</p><h3>Required Documents</h3><p>Required Documents</p><p>Card</p><h4>Attachments</h4><p>Photo</p><p>x <b>Notes</b> none of these</p></main>"
    p = pages.parse_labelled_page(page)
    assert p["fees"] == "10 riyals\neach" and p["processing_time"] == "1 day" and p["required_documents"] == "Card\nPhoto\nx Notes none of these" and "notes" not in p


def test_label_field_column(apply):
    labels = ["Service Steps", "Required documents:", "Fees", "FAQ", "المستندات المطلوبة", "x" * 70, ""]
    assert apply(pages.label_field_column, labels) == [pages.label_field(x) for x in labels] == ["steps", "required_documents", "fees", None, "required_documents", None, None]


CATALOGUE = """<div><div>Name reservation</div><div>Name reservation</div><span>Merchant</span><span>Start</span><span>Merchant</span><span>Business sector</span>
<p>An electronic service by which a trade name is reserved for a shop or a company.</p><a>Service level agreement</a>
<ul id="steps"><li>Log in</li><li>Choose</li></ul><p>Service Fees</p><p>200 riyals</p><p>Duration of service</p><p>1 day</p><p>You can call the unified number</p><p>1900</p><p>info@mc.gov.sa</p><p>Last Modified 1 May 2026</p></div>"""


def test_catalogue_page():
    p = pages.parse_catalogue_page(CATALOGUE, "Site | Other")
    assert p["title"] == "Name reservation" and p["category"] == "Merchant · Business sector" and p["steps"] == "- Log in\n- Choose"
    assert p["fees"] == "200 riyals" and p["processing_time"] == "1 day" and p["contact"] == "1900, info@mc.gov.sa" and p["source_last_modified"] == "1 May 2026"


def test_guide():
    got = pages.guide_fields(pages.parse_guide_script('{"title": {"en": `Passport<br>issue`}, "about": {"en": `For <b>citizens</b> &amp; more`}, "payment": {"en": `300`}}'))
    assert got["title"] == "Passport\nissue" and got["description"] == "For citizens & more" and got["fees"] == "300"


def test_capture_with_supplement(spark, tmp_path):
    page = lambda i, lang, status, body: {"id": i, "lang": lang, "url": f"https://hrsd.gov.sa/{i}/{lang}", "http_status": status, "fetched_at": f"2026-0{status % 9 + 1}-01T00:00:00Z", "page_title": None, "main_html": body}
    (tmp_path / "c.json").write_text(json.dumps({"source": "hrsd", "records": [page("A", "en", 200, TABS), page("B", "en", 500, ""), page("C", "en", 200, "<h1>404 not found</h1>"), page("D", "ar", 200, TABS)]}))
    (tmp_path / "s.json").write_text(json.dumps({"records": [page("b", "en", 200, TABS.replace("licence", "permit")), page("a", "en", 200, "<h1>never</h1>")]}))
    got = pages.read_labelled_capture(spark, f"{tmp_path}/c.json", "hrsd", {"en": "HR", "ar": "م"}, "hrsd.gov.sa", "Online", f"{tmp_path}/s.json").orderBy("title_en").collect()
    assert [r.title_en for r in got] == ["Renewal of a licence", "Renewal of a permit"] and got[0].service_id == "hrsd-" + hashlib.sha1(b"a").hexdigest()[:10] and got[0].agency_en == "HR"


def test_readers(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"service_id": "a-1", "title_en": "x", "nope": 1}\n{"service_id": "a-1", "title_en": "y"}\n')
    assert [r.title_en for r in records.load_services(spark, f"{tmp_path}/r.jsonl").collect()] == ["y"]
    (tmp_path / "r.json").write_text('{"records": [{"service_id": "b", "extra": {"k": 1}}]}')
    assert records.read_json(spark, f"{tmp_path}/r.json").first().extra == '{"k":1}'
    (tmp_path / "c.csv").write_text("﻿service_id,title_en\nq,\"a, b\"\n", encoding="utf-8")
    assert records.read_canonical_csv(spark, f"{tmp_path}/c.csv").first().title_en == "a, b"
    (tmp_path / "bad.csv").write_text("service_id,what\nq,1\n")
    with pytest.raises(ValueError):
        records.read_canonical_csv(spark, f"{tmp_path}/bad.csv")
    (tmp_path / "seed.csv").write_text("service_id,title,agency,category,description,official_url,source,language\n7,T,A,C,D,https://www.x.gov.sa,s,ar\n")
    s = records.read_seed_csv(spark, f"{tmp_path}/seed.csv").first()
    assert (s.service_id, s.title_ar, s.title_en, s.source_domain, s.verification_status) == ("seed-7", "T", None, "x.gov.sa", "unverified")
    (tmp_path / "od.csv").write_text("nr,name\n5,Open\n")
    (tmp_path / "od.map.json").write_text(json.dumps({"columns": {"name": "title_en"}, "id_column": "nr", "dataset_url": "https://data.gov.sa/d", "downloaded_at": "2026-01-01", "license": "open"}))
    o = records.read_open_data(spark, f"{tmp_path}/od.csv").first()
    assert (o.service_id, o.title_en, len(o.source_sha256)) == ("od-od-5", "Open", 64)
    with pytest.raises(ValueError):
        records.read_open_data(spark, f"{tmp_path}/od.csv", {"columns": {"name": "nope"}, "id_column": "nr"})


def test_saved_pages(spark, tmp_path):
    for lang, title in (("en", "Hello"), ("ar", "مرحبا")):
        (tmp_path / f"p_{lang}.html").write_text(f"<h1>{title}</h1><main>body</main>", encoding="utf-8")
        (tmp_path / f"p_{lang}.meta.json").write_text(json.dumps({"service_key": "k", "lang": lang, "official_url": "https://www.a.gov.sa/x", "agency": "A", "date_saved": "2026-01-01", "saved_by": "me"}))
    r = records.read_saved_pages(spark, str(tmp_path)).first()
    assert (r.service_id, r.title_en, r.title_ar, r.source_domain) == ("manual-k", "Hello", "مرحبا", "a.gov.sa") and r.source_sha256.count(";") == 1


def test_index_sink(spark, tmp_path):
    c = spark.createDataFrame([("a::en::title", "a", "en", "title", "t", "t", "t", "", "", None)], "chunk_id string, service_id string, lang string, section string, text string, embed_text string, title string, agency string, category string, official_url string")
    sinks.write_index({"chunks": c}, f"{tmp_path}/i", "trigram")
    assert sinks.read_index(spark, f"{tmp_path}/i", ["chunks"], "trigram")["chunks"].count() == 1
    with pytest.raises(sinks.StaleIndexError):
        sinks.read_index(spark, f"{tmp_path}/i", ["chunks"], "other")
    sinks.write_csv(c.selectExpr("service_id", "array(text) as a"), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True, escape="\"").first().a == '["t"]'


def test_frames_are_told_by_exact_case():
    """SharePoint's own classes hold "Share" and wrap whole pages; only lower-case parts mark a frame."""
    page = "<div class='SharePointZone Related'><main><h1>T</h1><h2>Fees</h2><p>20 riyals</p><div class='social-share'><h2>Steps</h2><p>Click</p></div><div id='Related1'><h2>Duration</h2><p>3 days</p></div><div id='unrelated'><h2>Notes</h2><p>Other</p></div></main></div>"
    assert pages.parse_labelled_page(page) == {"title": "T", "fees": "20 riyals", "processing_time": "3 days"}
    whole = "<main class='SharePointZone'><div class='SharePointZone'><h1>T</h1><h2>Fees</h2><p>20 riyals</p></div></main>"
    assert pages.parse_labelled_page(whole)["fees"] == "20 riyals"


ARTICLE = """Home
Trade Name Reservation
Trade Name Reservation
Start
Commerce
Permits
This service lets the owner of a business reserve a name for it before it is registered with the ministry.
More about it.
Service level agreement
Steps
Service Fees
first value that a later label replaces
Beneficiary Group
Companies
Individuals
Service Fees
200 riyals
Steps
a year
Pay Methods
Card
Duration of service
To contact us call the unified number
199099 or 8001
info@mc.gov.sa
Last Modified 12/01/2026
The service is provided in
Arabic
Related Services
Service Fees
not ours"""


def test_catalogue_lines_as_windows(spark):
    """The plan over lines gives what the page parser gives, for every article of a table at once."""
    variants = [ARTICLE, ARTICLE.replace("Trade Name Reservation\n", "", 1), ARTICLE.replace("Service level agreement\n", "").replace("Steps\n", ""), ARTICLE.replace("Start\n", ""), "one line", "Service Fees\nFree\nDownload\nService Fees\nLast Modified x\nLast Modified y", "Related Services\nService Fees\nFree"]
    rows = [(k, None if k % 2 else "Page | Site name", i, x) for k, v in enumerate(variants) for i, x in enumerate(v.split("\n"))]
    df = spark.createDataFrame(rows, "id int, own string, pos long, line string").repartition(3)
    got = {r.id: r.asDict() for r in pages.catalogue_fields(df, "id", title="own").collect()}
    for k, v in enumerate(variants):
        want = pages.parse_catalogue_page("".join(f"<p>{x}</p>" for x in v.split("\n")), None if k % 2 else "Page | Site name")
        assert {f: got[k][f] for f in got[k] if f not in ("id",)} == {f: want.get(f) for f in got[k] if f != "id"}, k
    assert pages.catalogue_fields(df.limit(0), "id").count() == 0


def test_still_to_capture(spark):
    wanted = spark.createDataFrame([("a", "en"), ("a", "ar"), ("b", "en"), ("b", "en")], "id string, lang string")
    captured = spark.createDataFrame([("a", "en", 200), ("a", "ar", 404), (None, "en", 200)], "id string, lang string, http_status int")
    assert sorted(map(tuple, pages.still_to_capture(wanted, captured, "id", "lang").collect())) == [("a", "ar"), ("b", "en")]


def workbook(path, rows, shared=True, sheet="xl/worksheets/sheet1.xml"):
    """A workbook of one sheet; texts as shared or inline strings, numbers as they are."""
    import zipfile
    from xml.sax.saxutils import escape

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    strings, body = [], []
    for i, row in enumerate(rows, 1):
        cells = []
        for ref, v in row.items():
            if isinstance(v, str) and shared:
                cells.append(f'<c r="{ref}{i}" t="s"><v>{len(strings)}</v></c>')
                strings.append(f"<si><r><t>{escape(v[:1])}</t></r><r><t>{escape(v[1:])}</t></r><rPh><t>no</t></rPh></si>" if len(v) % 2 else f"<si><t>{escape(v)}</t></si>")
            elif isinstance(v, str):
                cells.append(f'<c r="{ref}{i}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
            else:
                cells.append(f'<c r="{ref}{i}"><f>1+1</f><v>{v}</v></c>')
        body.append(f'<row r="{i}">{"".join(cells)}</row>')
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Data" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="{sheet.removeprefix("xl/")}"/></Relationships>')
        z.writestr(sheet, f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(strings)}</sst>')


@pytest.mark.parametrize("shared", [True, False])
def test_workbooks(spark, tmp_path, shared):
    from tessera.sources import xlsx

    rows = [{"A": "nr", "B": "name", "AA": "name", "AB": "fee"}, {"A": 5, "B": "Open & free", "AB": 12.5}, {}, {"A": 6, "AA": "second", "AC": "beyond"}, {"B": ""}, {"A": 7, "B": "خدمة"}]
    workbook(f"{tmp_path}/od.xlsx", rows, shared)
    got = xlsx.read_sheet(spark, f"file://{tmp_path}/od.xlsx", "Data").orderBy("row").collect()
    assert [r.cells for r in got] == [{"nr": "5", "name": "Open & free", "fee": "12.5"}, {"nr": "6", "name_2": "second"}, {"nr": "7", "name": "خدمة"}]
    (tmp_path / "od.map.json").write_text(json.dumps({"columns": {"name": "title_en"}, "id_column": "nr", "dataset_url": "https://data.gov.sa/d", "downloaded_at": "2026-01-01", "license": "open"}))
    o = {r.service_id: r for r in records.read_open_data(spark, f"{tmp_path}/od.xlsx").collect()}
    assert {k: r.title_en for k, r in o.items()} == {"od-od-5": "Open & free", "od-od-6": None, "od-od-7": "خدمة"} and len(o["od-od-5"].source_sha256) == 64
    workbook(f"{tmp_path}/none.xlsx", [], shared)
    assert xlsx.read_sheet(spark, f"file://{tmp_path}/none.xlsx").count() == 0
    with pytest.raises(Exception, match="no sheet"):
        xlsx.read_sheet(spark, f"file://{tmp_path}/od.xlsx", "Other").collect()


def test_large_workbook(spark, tmp_path):
    from tessera.sources import xlsx

    workbook(f"{tmp_path}/large.xlsx", [{"A": "id", "B": "text"}] + [{"A": k, "B": f"row {k} " + "x" * 40} for k in range(30_000)])
    got = xlsx.read_sheet(spark, f"file://{tmp_path}/large.xlsx").selectExpr("count(*) AS n", "sum(CAST(cells['id'] AS long)) AS s", "max(row) AS last").first()
    assert (got.n, got.s, got.last) == (30_000, 30_000 * 29_999 // 2, 29_999)
