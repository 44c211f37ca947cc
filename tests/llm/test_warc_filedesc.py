from signalmill.llm import warc as W

from .test_warc import HTTP, first, header


def test_a_later_filedesc_url_is_a_record():
    page = HTTP % 7 + b"a page of that name"
    data = first(2) + header(2, "http://a/", "20240101000000", b"x") + header(2, "filedesc://page", "20240101000000", page)
    data += b"rubbish\n" + header(2, "filedesc:x", "20240101000000", b"1 y") + header(2, "http://b/", "20240101000000", b"yy")
    got = list(W.parse_arc(iter([data])))
    assert [r.get("url") for r in got] == ["http://a/", "filedesc://page", None, "filedesc:x", "http://b/"]
    assert got[1]["block"] == page and got[2]["problem"] == "no header line" and got[2]["version"] == 2


def test_joined_files_keep_their_headers_apart():
    data = b"\n" + first(2) + header(2, "http://a/", "20240101000000", b"x") + first(1) + header(1, "http://b/", "20240101000000", b"yy")
    got = list(W.parse_arc(iter([data])))
    assert [(r["url"], r["version"]) for r in got] == [("http://a/", 2), ("http://b/", 1)]
