import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, line_dedup, shared

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[SPACE.sub(" ", text or "")].append(i)
    out = []
    for i, text in rows:
        body = SPACE.sub(" ", text or "")
        ids = [x for x in groups[body] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[body]), keep == i, hashlib.sha256(body.encode()).hexdigest()))
    return out


def brute_lines(rows, min_docs):
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate({c: c + 32 for c in range(65, 91)})
    count = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if count[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_exact_dedup(odd, documents, monkeypatch, broadcast):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", broadcast)
    for docs in (odd, documents):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert order(exact_dedup.exact_dedup(docs).collect()) == order(brute_exact(rows))


def test_exact_keeps_columns_and_one_of_each(odd):
    clash = odd.withColumn("sha", F.lit(1)).withColumn("len", F.lit(2))
    kept = exact_dedup.drop_duplicates(clash)
    assert kept.columns == clash.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, None, 5, 6, 7, 8, 9], key=repr)


def test_empty_tables(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.drop_duplicates(no_docs).count() == 0
    assert line_dedup.line_dedup(no_docs).count() == 0


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_line_dedup(odd, documents, monkeypatch, broadcast):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    for docs, least in ((odd, 2), (documents, 10)):
        docs = docs.withColumn("h1", F.lit(1)).withColumn("lost", F.lit(1))
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert order(line_dedup.line_dedup(docs, min_docs=least).collect()) == order(brute_lines(rows, least))


def test_repeated_rows_are_one_document_to_op4(spark, tmp_path):
    """A document listed ten times is one; a line that ten documents hold still goes."""
    import duckdb

    from quarry.llm import queries

    rows = [(1, "listed often\nshared")] * 10 + [(i, f"shared\nown {i}") for i in range(2, 11)] + [(11, "listed often\nshared\nother"), (None, "other")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in con.execute(queries.OP4_SQL).fetchall() if r[0] not in (1, None)}  # the SQL gathers repeated rows
    got = {r[0]: tuple(r)[1:] for r in queries.op4_line_dedup(spark, str(tmp_path)).collect() if r[0] not in (1, None)}
    assert got == want and got[11][1] == 1
