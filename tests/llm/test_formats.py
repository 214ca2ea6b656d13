import gzip
import hashlib
import random
import zlib

import pytest

from tessera.llm import audio, queries, warc


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    warc.register(spark)
    rows = [("response", f"urn:{k}", f"http://x/{k}", "2024-01-01T00:00:00Z", warc.base32_sha1(b), None, len(b), b) for k, b in enumerate([b"", b"\r\n\r\nWARC/1.1", random.Random(1).randbytes(300_000), "é".encode()])]
    rows += [("revisit", "urn:9", "http://x/" + "long" * 2000, None, rows[1][4], "urn:1", len(rows[1][7]), None)]
    df = spark.createDataFrame(rows, "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, http_length long, payload binary")
    at = f"file://{tmp_path}/w"
    df.write.format("warc").option("max_bytes", "1000").mode("append").save(at)
    files = list((tmp_path / "w").glob("*.warc.gz"))
    assert len(files) >= 2 and not list((tmp_path / "w").glob("*.tmp"))
    assert all(gzip.open(f).read().startswith(b"WARC/1.1\r\nWARC-Type: re") for f in files)
    got = {r.record_id: r for r in spark.read.format("warc").load(at).collect()}
    assert {k: bytes(r.payload) for k, r in got.items() if r.payload is not None} == {r[1]: r[7] for r in rows[:4]}
    assert got["urn:9"].payload is None and got["urn:9"].http_length == len(rows[1][7]) and got["urn:9"].refers_to == "urn:1"
    light = spark.read.format("warc").option("payloads", "false").load(at)
    assert [r.record_id for r in light.where("record_type = 'revisit'").collect()] == ["urn:9"]
    assert light.where("target_uri in ('http://x/1', 'http://x/3')").count() == 2 and light.where("refers_to is not null").count() == 1
    assert all(r.payload is None for r in light.collect())


def test_predicates_reach_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    r = warc.WarcReader({"path": "/x"})
    left = list(r.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("http_length",), 3)]))
    assert [type(f) for f in left] == [GreaterThan] and r.where == [("record_type", ("response",))]


def raw_records():
    """Records of another writer: a warcinfo, a response, one without an HTTP length, a folded header, and odd payloads."""
    def rec(kind, k, block, extra=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{k}>\r\nWARC-Target-URI: http://x/{k}\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
    big = random.Random(2).randbytes(400_000)
    return [
        rec("warcinfo", 0, b"software: x\r\n", "X-Long: one\r\n two\r\n"), rec("response", 1, http + b"Content-Length: 5\r\n\r\nhello"), rec("response", 2, http + b"\r\n" + big), rec("request", 3, b"GET / HTTP/1.1\r\n\r\n"),
        rec("response", 4, http + b"\r\nWARC/1.0\r\n\r\n\r\n\r\nWARC/1.1"), rec("response", 5, http + b"\r\n"),
    ], big


@pytest.mark.parametrize("form", ["plain", "members", "one", "mixed"])
def test_warc_files_of_other_writers(spark, tmp_path, form):
    warc.register(spark)
    records, big = raw_records()
    if form == "plain":
        (tmp_path / "a.warc").write_bytes(b"".join(records))
    elif form == "members":
        (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    elif form == "one":
        (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    else:
        (tmp_path / "a.warc.gz").write_bytes(warc.member(records[0]) + gzip.compress(records[1]) + gzip.compress(records[2] + records[3]) + warc.member(records[4]) + gzip.compress(records[5]))
    read = spark.read.format("warc").load(f"file://{tmp_path}")
    got = {r.record_id: r for r in read.collect()}
    assert [got[f"urn:{k}"].record_type for k in range(6)] == ["warcinfo", "response", "response", "request", "response", "response"]
    assert [bytes(got[f"urn:{k}"].payload) for k in (0, 1, 2, 4, 5)] == [b"software: x\r\n", b"hello", big, b"WARC/1.0\r\n\r\n\r\n\r\nWARC/1.1", b""]
    assert [got[f"urn:{k}"].http_length for k in (1, 2, 5)] == [5, len(big), 0]
    assert {r.record_id for r in read.where("record_type = 'response' and target_uri <> 'http://x/4'").collect()} == {"urn:1", "urn:2", "urn:5"}
    light = spark.read.format("warc").option("payloads", "false").load(f"file://{tmp_path}").where("record_type = 'response'").collect()
    assert len(light) == 4 and all(r.payload is None for r in light)


def test_warc_bad_files(spark, tmp_path):
    warc.register(spark)
    (tmp_path / "none").mkdir()
    assert spark.read.format("warc").load(f"file://{tmp_path}/none").count() == 0
    records, _ = raw_records()
    m = warc.member(records[1])
    broken = bytearray(m)
    broken[-6] ^= 1
    zipped = bytearray(gzip.compress(records[1]))
    zipped[-6] ^= 1
    for k, (raw, said) in enumerate([(m[:-3], "truncated"), (bytes(broken), "checksum"), (bytes(zipped), "damaged"), (gzip.compress(records[2])[:-9], "truncated"), (gzip.compress(b"no record\r\n\r\n"), "no record"), (b"".join(records)[:-300], "truncated")]):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / ("x.warc" if k == 5 else "x.warc.gz")).write_bytes(raw)
        with pytest.raises(Exception, match=said):
            spark.read.format("warc").load(f"file://{tmp_path}/{k}").collect()


def test_op6_against_brute_force(spark, tmp_path):
    rows = [(5, "u", "aa"), (3, "u", "aa"), (7, None, ""), (9, "u\n", None), (4, "u", "b" * 500_000), (3, "u", "aa"), (8, "u", "aa")]
    spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string").write.parquet(f"{tmp_path}/pages.parquet")
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    want = [(i, len(h or ""), warc.base32_sha1((h or "").encode()), "revisit" if i > first[h or ""] else "response", first[h or ""] if i > first[h or ""] else None) for i, _, h in rows]
    assert sorted(map(str, map(tuple, queries.op6_warc(spark, str(tmp_path)).collect()))) == sorted(map(str, want))
    empty = tmp_path / "empty"
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{empty}/pages.parquet")
    assert queries.op6_warc(spark, str(empty)).count() == 0


def payload(t):
    raw = (t or "").encode()
    return raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))


def test_audio_query(spark, tmp_path):
    texts = ["", None, "a" * 192, "a" * 193, "é" * 70_000, "same", "same", "ID3 Xing Info TAG"]
    spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_audio(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        p = payload(t)
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert f"good={len(p) // 192}/{len(p) // 192}" in got[k].feature and "skipped=0" in got[k].feature
    assert got[5][1:] == got[6][1:] and got[0][1:] == got[1][1:]


def test_audio_resynchronises():
    p = payload("hello " * 100)
    raw = audio.encode(p, 600)
    whole = audio.parse(raw)
    assert whole.tags == {"bytes": "600"} and whole.table["frames"] == len(whole.offsets) == 4 and len(whole.table["toc"]) == 100
    assert whole.samples == 4 * 1152 and whole.rate == 48000 and whole.good == whole.checked == 4
    cut = int(whole.offsets[2])
    dirty = raw[:cut] + b"junk\xff\xfbjunk" + raw[cut:] + b"TAG" + b"title".ljust(125, b"\0")
    got = audio.parse(dirty)
    assert len(got.offsets) == 4 and got.skipped == 10 and got.tags["title"] == "title" and audio.decode(dirty, got) == p
    bad = bytearray(raw)
    bad[int(whole.offsets[1]) + 8] ^= 1
    assert audio.parse(bytes(bad)).good == 3
    assert audio.parse(b"").samples == 0 and audio.parse(b"no audio here").skipped == 13


@pytest.mark.parametrize("word", [b"TAG", b"ID3", b"Info", b"VBRI", b"Xing", b"\xff\xfa\x64\xc0", b"\xff\xfb\x92\x04"])
def test_audio_payload_may_hold_marks_at_any_place(word):
    for at in range(0, 192, 3 if word != b"TAG" else 1):
        for n in (192, 384):
            p = (b"x" * (n - 192) + b" " * at + word).ljust(n)[:n]
            raw = audio.encode(p, n)
            got = audio.parse(raw)
            assert audio.decode(raw, got) == p and got.skipped == 0 and got.tags == {"bytes": str(n)}
            tagged = raw + b"TAG" + b"name".ljust(125, b"\0")
            got = audio.parse(tagged)
            assert audio.decode(tagged, got) == p and got.skipped == 0 and got.tags["title"] == "name"


def test_audio_other_streams_have_no_payload(spark):
    small = bytes([0xFF, 0xFB, 0x10, 0xC0]).ljust(audio.header(bytes([0xFF, 0xFB, 0x10, 0xC0])).size, b"\0")
    got = audio.parse(small * 5)
    assert len(got.offsets) == 5 and audio.decode(small * 5, got) == b""
    df = spark.createDataFrame([(1, 0, bytearray(small * 5)), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    rows = {r.doc_id: r for r in audio.media_features(df).collect()}
    assert (rows[1].payload_bytes, rows[1].n_frames, rows[2].n_frames) == (0, 5, 0)
    vbri = bytearray(audio.encode(b" " * 192, 1))
    first = audio.header(audio.HEAD)
    start = vbri.index(audio.HEAD)
    vbri[start + 23 : start + first.size] = bytes(first.size - 23)
    vbri[start + 36 : start + 36 + 30] = b"VBRI" + bytes(6) + (999).to_bytes(4, "big") + (7).to_bytes(4, "big") + (2).to_bytes(2, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + (5).to_bytes(2, "big") + (6).to_bytes(2, "big")
    assert audio.parse(bytes(vbri)).table == {"kind": "VBRI", "bytes": 999, "frames": 7, "frames_an_entry": 1, "toc": [15, 18]}


def test_audio_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id int, text string, media string")
    assert audio.media_features(audio.encode_texts(docs)).count() == 0


def test_audio_headers():
    h = audio.header(bytes([0xFF, 0xFB, 0x92, 0x04]))  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz, padded, joint stereo
    assert (h.version, h.layer, h.kbits, h.rate, h.size, h.samples, h.side, h.checked) == (1, 3, 128, 44100, 418, 1152, 32, False)
    assert audio.header(bytes([0xFF, 0xF3, 0x40, 0xC0])).samples == 576 and audio.header(b"\xff\xff\xff\xff") is None and audio.header(b"\x00" * 4) is None


def test_vbr_stream():
    small = bytes([0xFF, 0xFB, 0x14, 0xC0]) + b"\0" * 92  # 32 kbit/s at 48 kHz: 96 bytes
    large = bytes([0xFF, 0xFB, 0x54, 0xC0]) + b"\0" * 188  # 64 kbit/s: 192 bytes
    got = audio.parse(small * 3 + large * 2 + small)
    assert got.sizes.tolist() == [96, 96, 96, 192, 192, 96] and got.offsets.tolist() == [0, 96, 192, 288, 480, 672] and got.samples == 6 * 1152
