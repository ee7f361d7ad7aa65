import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.llm import licenses as li
from quarry.llm import queries, shared, url_filter


def test_forms(spark, odd):
    mit = li.KNOWN[0][1]
    texts = [
        (1, mit), (2, "Copyright (c) 2001 Someone\n© 2002 Else, Inc.\n\n" + mit.upper().replace("SOFTWARE", "Software") + "\n"), (3, "Text.\nReleased under the  MIT Licence!\nmore"), (4, mit + " extra"), (5, None), (6, ""),
        (6, ""), (7, "RELEASED UNDER THE MIT LICENSE.\nLicensed under CC BY-NC 4.0.\nreleased under the mit license"), (None, "Licensed under the Apache License, Version 2.0"), (8, "copyright law is a topic"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("license", F.lit("x")).withColumn("digest", F.lit("x"))
    got = [(r.doc_id, r.text_license, r.n_notices, r.licenses) for r in li.license_scan(docs, li.known_licenses(spark)).collect()]
    plain = [(i, None, 0, "") for i in (4, 5, 6, 6, 8)]
    want = [(1, "MIT", 0, "MIT"), (2, "MIT", 0, "MIT"), (3, None, 1, "MIT"), (7, None, 3, "CC-BY-NC-4.0,MIT"), (None, "Apache-2.0", 1, "Apache-2.0")]
    assert sorted(got, key=repr) == sorted(plain + want, key=repr)
    assert li.license_scan(docs.limit(0), li.known_licenses(spark)).count() == 0
    assert li.license_scan(odd, li.known_licenses(spark, [("X", "x")])).filter("text_license = 'X'").count() == 1


def test_one_digest_of_two_licences(spark):
    """Of two identifiers with one canonical text the least stands for both."""
    docs = spark.createDataFrame([(1, "The  TERMS."), (2, "other\nthe terms")], "doc_id long, text string")
    known = li.known_licenses(spark, [("B", "The terms."), ("A", "the terms"), ("C", "None of them.")])
    assert known.count() == 2
    assert sorted((r.doc_id, r.text_license, r.n_notices, r.licenses) for r in li.license_scan(docs, known).collect()) == [(1, "A", 1, "A"), (2, None, 1, "A")]


ENTRIES = [
    ("domain", "Bad.example", "add", 10, "spam"), ("domain", "bad.example", "remove", 20, "spam"), ("domain", "bad.example", "add", 30, "spam"), ("prefix", "ok.example/a", "add", 0, "adult"), ("domain", "twice.example", "add", 5, "x"),
    ("domain", "twice.example", "remove", 5, "x"), (None, "bad.example", "add", 0, "x"), ("domain", "null.example", "add", None, "x"),
]
CAPTURES = [
    (1, "http://bad.example/", 9, False), (2, "http://bad.example/", 10, True), (3, "https://u:p@WWW.bad.example.:80/x?y#z", 19, True), (4, "http://bad.example/", 20, False), (5, "http://bad.example", 99, True),
    (6, "http://notbad.example/", 50, False), (7, "http://ok.example/a", 1, True), (8, "http://ok.example/a/b?c", 1, True), (9, "http://ok.example/ab", 1, False), (10, "http://sub.ok.example/a", 1, False), (11, None, 50, False),
    (12, "garbage", 50, False), (13, "http://bad.example/", None, False), (14, "http://twice.example/", 9, False), (2, "http://bad.example/", 10, True), (15, "http://null.example/", 9, False),
]


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_intervals(spark, monkeypatch, broadcast):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    entries = spark.createDataFrame(ENTRIES, "kind string, pattern string, action string, at long, category string")
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_at long, wanted boolean").withColumn("n", F.lit(1)).withColumn("kind", F.lit("x"))
    got = url_filter.filter_urls(captures, entries).collect()
    assert sorted((r.page_id, r.blocked) for r in got) == sorted((c[0], c[3]) for c in CAPTURES)
    assert not any(r.blocked for r in url_filter.filter_urls(captures, entries.limit(0)).collect())
    assert url_filter.filter_urls(captures.limit(0), entries).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, small).toPandas()
    plain = lambda d: sorted(repr(tuple(None if pd.isna(v) else str(v).removesuffix(".0") for v in r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_whole_texts_of_the_longer_licences(spark):
    from pathlib import Path

    held = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(li.__file__).parent / "license_texts").glob("*.txt"))]
    assert [n for n, _ in held] == ["Apache-2.0", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "MPL-2.0"]
    held += [(n, t.partition("END OF TERMS AND CONDITIONS")[0]) for n, t in held]
    held += [("BSD-3-Clause", "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + li._BSD_HEAD + li._BSD_NAMES + li._BSD_TAIL), ("BSD-2-Clause", "Copyright (c) 2020, Someone\n\n" + li._BSD_HEAD + li._BSD_TAIL)]
    docs = spark.createDataFrame([(i, "  " + t.replace("\n", "\r\n")) for i, (_, t) in enumerate(held)], "doc_id long, text string")
    got = {r.doc_id: r.text_license for r in li.license_scan(docs, li.known_licenses(spark)).collect()}
    assert got == {i: n for i, (n, _) in enumerate(held)}
