import gzip
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import warc as w

BIG = "<html>" + "x" * 200
PAGES = [
    (1, "http://a.example/x y", BIG),
    (2, None, BIG),
    (3, "http://b.example/", None),
    (4, "http://b.example/", ""),
    (5, "http://c.example/", "short"),
    (6, "http://c.example/\n", "short"),
    (7, "http://d.example/é", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é𝒳\r\n\r\nhttp://x 0.0.0.0 20080430204825 text/html 10\n" * 5),
    (8, "u", "line\r\n\r\n" * 40),
    (8, "u", "line\r\n\r\n" * 40),
    (None, "u", BIG),
]


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        first = min(same) if len(data) >= 100 and same else i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=repr)


def told(df):
    cols = [F.expr("try_cast(source_id AS long)"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to AS long)")]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_round_trip(spark, small):
    odd = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("key", F.lit(1))
    pages = spark.read.parquet(f"{small}/pages.parquet")
    for version in (1, 2):
        assert told(w.convert(odd, version=version)) == brute(PAGES)
    assert told(w.convert(pages)) == brute([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert w.convert(odd.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=80), max_size=6), st.sampled_from([1, 2]))
def test_arc_and_warc_bytes(bodies, version):
    contents = [w._http_response(b) for b in bodies]
    arc = w.arc_header(version, "f.arc", "20080430204825") + b"".join(w.arc_record(version, f"http://h/{i}", "20080430204825", c) for i, c in enumerate(contents))
    records = list(w.parse_arc(arc))
    assert [r["content"] for r in records] == contents and [w.http_payload(r["content"]) for r in records] == bodies
    digests = [hashlib.sha256(b).hexdigest() for b in bodies]
    warc = [w.warc_record(r, str(i), d, None) + b"\r\n\r\n" for i, (r, d) in enumerate(zip(records, digests))]
    for data in (b"".join(warc), gzip.compress(b"".join(warc)), b"".join(map(gzip.compress, warc))):
        parsed = list(w.parse_warc(data))
        assert [b for _, b in parsed] == contents
        assert all(f["WARC-Date"] == "2008-04-30T20:48:25Z" for f, _ in parsed)
    assert len({f["WARC-Record-ID"] for f, _ in parsed}) == len(bodies)
    assert [r["content"] for r in w.parse_arc(gzip.compress(arc))] == contents


def test_revisits_name_the_response(spark):
    rows = spark.createDataFrame([(2, "u", BIG), (1, "v", BIG), (3, "u", "other")], "page_id long, url string, html string")
    told = {f["X-Source-Id"]: f for r in w.arc_to_warc(rows).collect() for f, _ in w.parse_warc(bytes(r.record) + b"\r\n\r\n")}
    assert told["2"]["WARC-Refers-To"] == told["1"]["WARC-Record-ID"] and told["2"]["WARC-Type"] == "revisit"
    assert "WARC-Refers-To" not in told["1"] and len({f["WARC-Record-ID"] for f in told.values()}) == 3


def test_reading_goes_on_after_broken_lines():
    """A broken header, a length beyond the end, and blank lines cost no other record."""
    date = "20080430204825"
    good = [w.arc_record(1, f"http://h/{i}", date, b"body %d" % i) for i in range(3)]
    arc = w.arc_header(1, "f.arc", date) + good[0] + b"no header at all 12\n\n" + good[1] + b"http://h/x 0.0.0.0 20080430204825 text/html 99999\n" + good[2]
    assert [r["content"] for r in w.parse_arc(arc)] == [b"body 0", b"body 1", b"body 2"]


def test_archives_on_disk_and_large_payloads(spark, tmp_path):
    date, big = "20080430204825", b"x" * 3_000_000
    for name, wrap in (("a.arc", bytes), ("b.arc.gz", gzip.compress)):
        (tmp_path / name).write_bytes(wrap(w.arc_header(2, name, date) + w.arc_record(2, "http://h/", date, w._http_response(big)) + w.arc_record(2, "http://i/", date, w._http_response(b""))))
    got = sorted((r.key, r.url, len(r.payload)) for r in w.read_arc(spark, str(tmp_path)).collect())
    assert got == [("a.arc:0", "http://h/", 3_000_000), ("a.arc:1", "http://i/", 0), ("b.arc.gz:0", "http://h/", 3_000_000), ("b.arc.gz:1", "http://i/", 0)]
    pages = spark.createDataFrame([(i, "u", "y" * (3_000_000 + i % 2)) for i in range(6)], "page_id long, url string, html string")
    assert sorted((r.source_id, r.payload_bytes, r.refers_to) for r in w.convert(pages).collect()) == [(str(i), 3_000_000 + i % 2, None if i < 2 else str(i % 2)) for i in range(6)]


def test_legacy_forms():
    arc = b"filedesc://x 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n\n" + b"http://a/b c 1.2.3.4 199609231421 text/html 5\nhello\nbroken line\n"
    got = list(w.parse_arc(arc))
    assert len(got) == 1 and got[0]["URL"] == "http://a/b c" and got[0]["content"] == b"hello"
    assert w.iso_date("199609231421") == "1996-09-23T14:21:00Z" and w.iso_date("1996") == "1996-01-01T00:00:00Z"
