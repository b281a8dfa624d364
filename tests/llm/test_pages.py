"""Operators 4 and 7 on small cases."""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import json
import time
import zlib
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
import zstandard
from pyspark.sql import functions as F

from evidencelake.llm import url_filters as U, warc_derivatives as W


def day(n):
    return dt.date(2024, 1, n)


def judged(spark, captures, entries):
    c = spark.createDataFrame([(*x, "extra") for x in captures], "page_id long, url string, fetched_at date, target string")
    e = spark.createDataFrame(entries, "target string, action string, listed_at date")
    rows = U.judge(c, e).collect()
    assert sorted(((r.page_id, r.url, r.fetched_at) for r in rows), key=str) == sorted(set(captures), key=str)
    return {r.page_id: (r.action, r.target, r.since) for r in rows}


ENTRIES = [("example.org", "block", day(5)), ("example.org", "remove", day(10)), ("example.org", "block", day(20)), ("a.example.org", "allow", day(7)), ("a.example.org/x/y", "block", day(8)), ("a.example.org/x/y", "allow", day(8)), (None, "block", day(1)), ("example.com", "odd", day(1)), ("org", "allow", None)]
CAPTURES = [
    (1, "https://example.org/", day(4)), (2, "https://example.org/", day(5)), (3, "https://www.EXAMPLE.org:80/a?b", day(9)), (4, "http://example.org", day(10)), (5, "http://example.org", day(25)), (6, "https://u@a.example.org/", day(9)),
    (7, "https://a.example.org/x/y/z?q#f", day(9)), (8, "https://a.example.org/x/yy", day(9)), (9, None, day(9)), (10, "no url", day(9)), (11, "https://example.org/", None), (12, "https://notexample.org/", day(9)), (12, "https://notexample.org/", day(9)),
]


def test_as_of_join(spark):
    got = judged(spark, CAPTURES, ENTRIES)
    none = ("none", None, None)
    block = ("block", "example.org", day(5))
    assert got == {
        1: none, 2: block, 3: block, 4: none, 5: ("block", "example.org", day(20)), 6: ("allow", "a.example.org", day(7)), 7: ("block", "a.example.org/x/y", day(8)),
        8: ("allow", "a.example.org", day(7)), 9: none, 10: none, 11: none, 12: none,
    }


def test_both_ways_of_the_list_join(spark, monkeypatch):
    few = judged(spark, CAPTURES, ENTRIES)
    monkeypatch.setattr(U, "MAX_BROADCAST_INTERVALS", 0)
    assert judged(spark, CAPTURES, ENTRIES) == few
    assert judged(spark, [], ENTRIES) == {} and set(judged(spark, CAPTURES, []).values()) == {("none", None, None)}


def test_every_capture_of_a_page_is_judged(spark, monkeypatch):
    url, rows = "https://example.org/a", [(1, "https://example.org/a", day(n)) for n in (4, 5, 25)] + [(1, "https://a.example.org/", day(25)), (None, "https://example.org/", day(6)), (None, "https://other.org/", day(6))]
    c = spark.createDataFrame(rows, "page_id long, url string, fetched_at date")
    e = spark.createDataFrame(ENTRIES + [("example.org", "block", dt.date(2020, 1, 1) + dt.timedelta(9 * i)) for i in range(120)], "target string, action string, listed_at date")
    for most in (U.MAX_BROADCAST_INTERVALS, 0):
        monkeypatch.setattr(U, "MAX_BROADCAST_INTERVALS", most)
        got = {(r.page_id, r.url, r.fetched_at): (r.action, r.target, r.since) for r in U.judge(c, e).collect()}
        assert set(got) == set(rows)
        assert got[1, url, day(4)] == ("block", "example.org", dt.date(2022, 12, 7)) and got[1, url, day(5)][2] == day(5) and got[1, url, day(25)][2] == day(20)
        assert got[1, "https://a.example.org/", day(25)][0] == "allow" and got[None, "https://other.org/", day(6)][0] == "none"


def test_old_entries_are_rows_of_the_captures_time_only(spark):
    old = [(f"h{i}.org", "block", dt.date(2000, 1, 1) + dt.timedelta(i)) for i in range(300)] + [("gone.org", "block", dt.date(2001, 1, 1)), ("gone.org", "remove", dt.date(2002, 1, 1))]
    c = spark.createDataFrame([(i, f"http://h{i}.org/", day(9)) for i in range(300)] + [(999, "http://gone.org/", day(9))], "page_id long, url string, fetched_at date")
    e = spark.createDataFrame(old, "target string, action string, listed_at date")
    assert U.spans_of(c, e).count() == 300  # and none of gone.org, removed long before
    got = {r.page_id: r.action for r in U.judge(c, e).collect()}
    assert got == {**{i: "block" for i in range(300)}, 999: "none"}


PAGE = '<html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- no --><p>One <b>two</b>&nbsp;three<p>Four<a class=x href="/up?a=1&amp;b=2">link</a><img src=\'i.png\'><a href="javascript:x()">no</a></body></html>'


def test_text_and_links():
    assert W.page_text(PAGE) == "A & B\nOne two three\nFourlinkno"
    assert W.page_links(PAGE, "http://h.org/d/e") == [{"path": "A@/href", "url": "http://h.org/up?a=1&b=2"}, {"path": "IMG@/src", "url": "http://h.org/d/i.png"}]
    assert W.page_text("<script>never closed") == "" and W.page_text("") == ""


class Plain(HTMLParser):
    """Text, links and title by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.title, self.inside, self.skip = [], [], "", [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template", "svg"):
            self.skip += 1
        self.inside.append(tag)
        wanted = [v for k, v in attrs if k in ("href", "src", "action") and v]
        if tag in W.LINKED and wanted:
            self.links.append(wanted[0])
        self.text.append("\n" if tag in W.BREAKS or tag == "title" else "")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template", "svg"):
            self.skip -= 1
            self.text.append(" ")
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass
        self.text.append("\n" if tag in W.BREAKS or tag == "title" else "")

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
        if "title" in self.inside:
            self.title += data


def test_whole_table_equals_a_parser(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    records = W.build_derivatives(pages.select("page_id", W.response_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record")), id_col="page_id").collect()
    digests = {(r.page_id, r.warc_type): (r.block_digest, r.content_length, r.n_links) for r in W.op4_warc_derivatives(spark, sf).collect()}
    bodies = {(r.page_id, r.warc_type): W.split_block(bytes(r.record))[1][: r.content_length] for r in records}
    assert len(digests) == len(bodies) == 2 * pages.count() > 50
    for row in pages.collect():
        plain = Plain()
        plain.feed(row.html)
        words = lambda s: [x for x in (" ".join(line.split()) for line in s.split("\n")) if x]
        text = bodies[row.page_id, "conversion"]
        assert words(text.decode()) == words("".join(plain.text)), row.page_id
        told = json.loads(bodies[row.page_id, "metadata"])
        assert told["html"]["title"] == " ".join(plain.title.split()) or not plain.title
        assert [x["url"] for x in told["html"]["links"]] == [urljoin(row.url, x) for x in plain.links if not x.startswith(("#", "javascript:", "data:", "mailto:"))]
        assert digests[row.page_id, "conversion"] == (W.digest(text), len(text), 0) and digests[row.page_id, "metadata"][2] == len(told["html"]["links"])


def test_tags_with_quotes_and_long_pages():
    assert W.read_page('<p title="a>b">x</p><p title=it\'s>y</p><a href="u>v" class=c>z</a> 1 < 2 <TITLE>T &lt;</title >', "http://h/") == ("x\ny\nz 1 < 2\nT <", [{"path": "A@/href", "url": "http://h/u>v"}], "T <")
    text, links, _ = W.read_page('<p>word <a href="/x">y</a>' * 100_000 + '<a href="open>t' * 1000, "http://h/")
    assert len(links) >= 100_000 and text.count("word y") == 100_000


def response(headers, payload, status="HTTP/1.1 200 OK"):
    http = (status + "".join(f"\r\n{k}: {v}" for k, v in headers) + "\r\n\r\n").encode() + payload
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Target-URI: http://a.org/d/e\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"


def outcome(headers, payload, status="HTTP/1.1 200 OK"):
    """The conversion's text, and why there is none."""
    rows = {r[0]: r for r in W.derive(response(headers, payload, status))}
    told = json.loads(W.split_block(rows["metadata"][-1])[1].rstrip())
    assert (told["conversion"] is None) == ("conversion" not in rows) == ("not_converted" in told)
    if "conversion" in rows:
        assert told["conversion"] == rows["conversion"][1]
        return W.split_block(rows["conversion"][-1])[1][: rows["conversion"][7]].decode(), None
    return None, told["not_converted"]


def test_only_text_is_converted():
    page, html_type = b"<p>hello <b>you</b>", [("Content-Type", "text/html")]
    assert outcome(html_type, page) == ("hello you", None)
    assert outcome([("Content-Type", "Application/XHTML+XML; charset=utf-8")], page) == ("hello you", None)
    assert outcome([("Content-Type", "text/plain")], b" a <b> &amp; c\n") == ("a <b> &amp; c", None)
    assert outcome([], page) == ("hello you", None) and outcome([], b"") == ("", None)
    assert outcome([], b"\x89PNG\x00") == (None, "media type unknown")
    assert outcome([("Content-Type", "image/png")], b"\x89PNG\x00<p>") == (None, "media type image/png")
    assert outcome([("Content-Type", "application/pdf")], b"%PDF-1.4") == (None, "media type application/pdf")
    assert outcome([*html_type, ("Content-Encoding", "br")], b"\x8b\x0f\x80") == (None, "coding br")
    assert outcome([*html_type, ("Content-Encoding", "identity")], page) == ("hello you", None)
    assert outcome(html_type, page, "HTTP/1.1 404 Not Found") == (None, "status 404")
    assert outcome(html_type, page, "HTTP/1.1") == ("hello you", None)
    for coding, packed in (("gzip", gzip.compress(page)), ("deflate", zlib.compress(page)), ("zstd", zstandard.compress(page)), ("gzip, zstd", zstandard.compress(gzip.compress(page)))):
        assert outcome([*html_type, ("Content-Encoding", coding)], packed) == ("hello you", None)
        assert outcome([("Content-Type", "image/png"), ("Content-Encoding", coding)], packed)[1] == "media type image/png"


def test_content_that_unpacks_without_end(monkeypatch):
    monkeypatch.setattr(W, "MAX_CONTENT", 1 << 20)
    for coding, packed in (("gzip", gzip.compress(bytes(1 << 22))), ("zstd", zstandard.compress(bytes(1 << 22)))):
        assert outcome([("Content-Type", "text/html"), ("Content-Encoding", coding)], packed) == (None, f"content over {1 << 20} bytes")


def test_base_and_srcset():
    page = '<a href="before"><base target=x><base href="http://b.org/x/"><base href="http://c.org/"><a href="y"><img src=i.png srcset="a.png 1x, /b.png 2x,c.png">'
    assert [x["url"] for x in W.page_links(page, "http://a.org/d/")] == [f"http://b.org/{u}" for u in ("x/before", "x/y", "x/i.png", "x/a.png", "b.png", "x/c.png")]
    assert [x["url"] for x in W.page_links('<base href="../z/"><a href=y>', "http://a.org/d/e")] == ["http://a.org/z/y"]
    assert W.page_links('<base href="http://[bad"><a href=y>', "http://a.org/") == [{"path": "A@/href", "url": "y"}]


@pytest.mark.parametrize("piece", ["<a b=", "<a ", "<", "<!--", "<!", "</", '<a b="', "<a b='x\">", '<a ="x>y"', "<title>", "<script>", "&amp", "<a href=x" + " " * 50, "<!-- -->", "</script", "<svg>", "<a b = "])
def test_hostile_pages_take_no_time(piece):
    began = time.monotonic()
    for tail in ("", ">", '="z>', "'>"):
        W.read_page(piece * (1_000_000 // len(piece)) + tail, "http://h.org/")
    assert time.monotonic() - began < 20, "four pages of a megabyte"


def test_long_tags_end_where_they_should():
    assert W.read_page(f'<img src="data:{"A" * 100_000}">x<p title="{"y" * 100}>z">w', "")[0] == "x\nw"
    assert W.read_page("a <b", "")[0] == "a <b" and W.read_page("x <!-- > never closed <p>y", "")[0] == "x"


def test_derivatives_refer_to_their_source(spark):
    df = spark.createDataFrame([(1, "http://h.org/d/e", PAGE), (2, None, None), (3, "http://h.org/", "")], "page_id long, url string, html string")
    source = df.select("page_id", W.response_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"), F.lit("x").alias("warc_type"))
    sources = {r.page_id: bytes(r.record) for r in source.collect()}
    out = W.build_derivatives(source, id_col="page_id").collect()
    assert len(out) == 6
    for r in out:
        head, body = W.split_block(bytes(r.record))
        _, fields = W.headers(head)
        _, own = W.headers(W.split_block(sources[r.page_id])[0])
        body = body[: int(fields["content-length"])]
        assert fields["warc-refers-to"] == own["warc-record-id"] == r.refers_to
        assert fields["warc-type"] == r.warc_type and fields.get("warc-target-uri", "") == own.get("warc-target-uri", "")
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.payload_digest == own["warc-payload-digest"]
        if r.warc_type == "metadata":
            told = json.loads(body)
            assert told["source"] == own and told["http"]["headers"]["content-type"] == "text/html; charset=utf-8"
            assert told["payload_digest"]["computed"] == told["payload_digest"]["stated"] == own["warc-payload-digest"]
            assert told["conversion"] == next(x.record_id for x in out if x.page_id == r.page_id and x.warc_type == "conversion")
    assert next(bytes(r.record) for r in out if r.page_id == 1 and r.warc_type == "conversion").endswith(b"A & B\nOne two three\nFourlinkno\r\n\r\n")


def captured(body, *http):
    block = "".join(f"{x}\r\n" for x in ("HTTP/1.1 200 OK", *http)).encode() + b"\r\n" + body
    metadata, conversion = W.derive(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n")
    told, text = (W.split_block(r[-1])[1][:-4] for r in (metadata, conversion))
    return json.loads(told), text.decode()


def test_repeated_headers_stay():
    told, _ = captured(b"<p>x", "Set-Cookie: a=1", "Via: one", "Set-Cookie: b=2", "Via: two", "Content-Type: text/html")
    assert told["http"]["headers"] == {"set-cookie": ["a=1", "b=2"], "via": ["one", "two"], "content-type": "text/html"}
    assert told["source"]["warc-concurrent-to"] == ["<a>", "<b>"]


def test_links_of_hidden_elements():
    page = '<script src="s.js">var a = "<a href=no>";</script><noscript><img src="n.png"></noscript><template><a href="t">t</a></template><!-- <script> <a href="c"> --><a href="z">z</a><script async src=last.js>'
    assert [x["url"].removeprefix("http://h.org/") for x in W.page_links(page, "http://h.org/")] == ["s.js", "n.png", "t", "z", "last.js"]
    assert W.page_text(page) == "z"


def test_chunked_and_compressed_payloads():
    page = "<p>café one two".encode()
    packed = gzip.compress(page[:6]) + gzip.compress(page[6:])
    chunked = lambda b: b"".join(b"%x;ext=1\r\n%s\r\n" % (len(b[i : i + 5]), b[i : i + 5]) for i in range(0, len(b), 5)) + b"0\r\nTrailer: x\r\n\r\n"
    te, gz = "Transfer-Encoding: chunked", "Content-Encoding: gzip"
    for body, fields in ((chunked(page), [te]), (packed, [gz]), (chunked(packed), [te, gz]), (zlib.compress(page), ["Content-Encoding: deflate"]), (zlib.compress(page)[2:-4], ["Content-Encoding: deflate"]), (page, [te, gz])):
        told, text = captured(body, *fields)
        assert text == "café one two", fields
        assert told["payload_digest"] == {"stated": None, "computed": W.digest(body), "length": len(body)}
    assert "café" in captured(gzip.compress(page + bytes(range(256)) * 9)[:-20], gz)[1]


def test_other_records_give_nothing(spark):
    rows = [(None,), (b"",), (b"WARC/1.0\r\nWARC-Type: request\r\n\r\nGET /",), (b"junk",), (b"WARC/1.0\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nonsense\r\n\r\n<p>caf\xc3\xa9 \xff",)]
    out = W.build_derivatives(spark.createDataFrame(rows, "record binary")).collect()
    assert [r.warc_type for r in out] == ["metadata", "conversion"]
    assert out[1].content_length == len("café �".encode())
    assert W.build_derivatives(spark.createDataFrame([], "record binary")).count() == 0
