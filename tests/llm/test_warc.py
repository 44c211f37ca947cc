import gzip
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from signalmill.llm import warc as W


def header(version, url, date, block, code="200"):
    more = f"{code} abc - 0 - " if version == 2 else ""
    return f"{url} 10.0.0.1 {date} text/html {more}{len(block)}\n".encode() + block + b"\n"


def first(version):
    return W.arc_first(version) + b"\n"


HTTP = b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\n"


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_parse_by_declared_length(version, packed):
    blocks = [HTTP % 1 + b"line\nhttp://looks.like/ 1.2.3.4 20240101000000 text/html 5\nno", b"", bytes(range(256)) * 50]
    parts = [first(version)] + [header(version, f"http://a/{i}", f"2001020304050{i}", b) for i, b in enumerate(blocks)]
    data = b"".join(map(gzip.compress, parts)) if packed else b"".join(parts)
    got = list(W.parse_arc(W.unpack(data, step=7)))
    assert [r["block"] for r in got] == blocks and [r["version"] for r in got] == [version] * 3
    assert [r.get("result_code") for r in got] == [200 if version == 2 else None] * 3
    at = [len(parts[0])]
    for p in parts[1:-1]:
        at.append(at[-1] + len(p))
    assert [r["offset"] for r in got] == at


def test_damage_gives_one_row_and_reading_goes_on():
    data = first(1) + header(1, "http://a/", "20240101000000", b"x") + b"rubbish\nmore rubbish here\n" + header(1, "http://b/", "20240101000000", b"yy")
    data += b"http://c/ 10.0.0.1 20240101000000 text/html 99\nshort"
    got = list(W.parse_arc(iter([data])))
    assert [r.get("problem") for r in got] == [None, "no header line", None, "shorter than declared"]
    assert [r.get("url") for r in got] == ["http://a/", None, "http://b/", None]


def put(tmp_path, pages):
    """An ARC file of each version from (url, date, block)."""
    for version in (1, 2):
        (tmp_path / f"v{version}.arc.gz").write_bytes(gzip.compress(first(version) + b"".join(header(version, *p) for p in pages[version - 1])))


def test_convert(spark, tmp_path):
    arc, warc = tmp_path / "arc", str(tmp_path / "warc")
    arc.mkdir()
    body = b"<html>" + b"same " * 40
    put(arc, [[("http://a/1", "20010203040506", HTTP % 9 + body), ("dns:a", "20010203040507", b"a record"), ("http://a/raw", "20010203040508", bytes(range(256)))],
              [("http://a/2", "20020203040506", HTTP % 3 + body), ("http://a/s", "20020203040507", HTTP % 4 + b"tiny"), ("http://a/t", "20020203040507", HTTP % 5 + b"tiny")]])
    by = W.http_field(F.col("head"), "X-Page-Id").try_cast("long")
    for name in ("warc", "again"):
        W.convert(spark, str(arc), str(tmp_path / name), first_by=by)
    got = {r.target_uri: r for r in W.read_warc(spark, warc).where("record_type != 'warcinfo'").collect()}
    assert {u: r.record_type for u, r in got.items()} == {
        "http://a/1": "revisit", "http://a/2": "response", "dns:a": "resource", "http://a/raw": "response", "http://a/s": "response", "http://a/t": "response",
    }
    assert got["http://a/1"].refers_to_id == got["http://a/2"].record_id
    assert got["http://a/1"].payload_digest == got["http://a/2"].payload_digest == "sha256:" + hashlib.sha256(body).hexdigest()
    assert bytes(got["http://a/raw"].block) == bytes(range(256)) and bytes(got["http://a/2"].block) == HTTP % 3 + body
    assert bytes(got["http://a/1"].block) == HTTP % 9 and got["http://a/1"].date == "2001-02-03T04:05:06Z"
    again = {r.target_uri: r.record_id for r in W.read_warc(spark, str(tmp_path / "again")).where("record_type != 'warcinfo'").collect()}
    assert again == {u: r.record_id for u, r in got.items()}


def pages(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, by int")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    return W.op1_warc(spark, str(tmp_path)).collect()


CASES = [(i, f"http://h/{i}", ("copy " * 30) if i % 3 == 0 else f"page {i} " * 40) for i in range(40)]
ODD = [(100, None, None), (101, "", ""), (102, "a b\nc\td", "x" * 99), (103, "u", "x" * 99), (104, "é", "日本😀\r\n\r\nHTTP/1.1 " * 20), (105, "u", "日本😀\r\n\r\nHTTP/1.1 " * 20),
       (106, "u", "long " * 200_000), (107, "u", "\n" * 150), (108, "u", "WARC/1.1\r\n\r\n" * 20), (0, "http://h/0", "copy " * 30)]


@pytest.mark.parametrize("sent", [20_000, 0])
def test_query_against_sql(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(W, "SENT_REVISITS", sent)
    got = pages(spark, tmp_path, [(*r, "clash", 1) for r in CASES + ODD])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT page_id, url, html FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = {tuple(r) for r in con.execute(W.OP1_SQL).fetchall()}
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.page_id != 0]
    assert sorted(map(str, rows)) == sorted(str(r) for r in want if r[0] != 0) and len(got) == len(CASES + ODD)
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id == 0) == [("response", None), ("revisit", 0)]  # a repeated row


def test_null_ids_and_empty_tables(spark, tmp_path):
    (tmp_path / "a").mkdir()
    got = pages(spark, tmp_path / "a", [(None, "u", "z" * 200, None, None), (None, "v", "z" * 200, None, None)])
    assert sorted((r.record_type, r.refers_to, r.payload_bytes) for r in got) == [("response", None, 200), ("revisit", None, 200)]
    (tmp_path / "b").mkdir()
    assert pages(spark, tmp_path / "b", []) == []
