import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate as d
from quarry.llm import shared

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, window=10):
    held = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            held.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(k) for k in held}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in held:
                    hit |= set(range(i, i + n))
                    found |= held[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [
    (1, "quick brown fox jumps over the lazy dog near the river"),
    (2, "Fox JUMPS"),
    (3, None),
    (4, ""),
    (5, "... !"),
    (6, "absent words never found in any document at all here"),
    (7, "fox jumps"),
    (10, "the the"),
    (10, "long tail"),
    (11, "long long long long long long long long long long long"),
]


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_against_brute_force(spark, odd, documents, small, monkeypatch, broadcast):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    odd = odd.withColumn("row", F.lit(1)).withColumn("cands", F.lit(1))
    for docs, items in ((odd, bench), (documents, spark.read.parquet(f"{small}/benchmark.parquet"))):
        got = sorted((tuple(r) for r in d.decontaminate(docs, items).collect()), key=repr)
        want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
        assert got == want
        assert any(r[4] for r in want)
        left = d.drop_contaminated(docs, items)
        assert left.columns == docs.columns
        assert left.count() == sum(not r[4] for r in want)


@pytest.mark.parametrize("most", [1 << 28, 1 << 15])
def test_key_filter_knows_every_key(spark, monkeypatch, most):
    """Also once it is full, when it rules little out; null keys and an empty list do no harm."""
    monkeypatch.setattr(shared, "FILTER_BITS", most)
    rows = spark.range(60_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), "id")
    keys = rows.filter("id % 3 = 0").select("key").cache()
    marked = shared.may_hold(rows, "key", shared.key_filter(keys))
    told = {r.hit: (r.n, r.may) for r in marked.groupBy((F.col("id") % 3 == 0).alias("hit")).agg(F.count("*").alias("n"), F.sum(F.col("__q_may").cast("int")).alias("may")).collect()}
    assert told[True] == (20_000, 20_000) and told[False][0] == 40_000 and told[False][1] < (8_000 if most > 1 << 15 else 40_000)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    assert shared.without_keys(rows, "key", keys).count() == 40_000
    assert shared.without_keys(rows, "key", keys.limit(0)).count() == 60_000


def test_empty(spark, odd, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.decontaminate(no_docs, bench).count() == 0
    assert not any(r.contaminated for r in d.decontaminate(odd, bench.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 80 + "beta gamma"), (3, "gamma beta alpha alpha"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    met = d.proximity_matches(docs, items, span=50)
    keys = docs.select("doc_id", d.row_key("doc_id", "text").alias("row"))
    assert sorted(r.doc_id for r in met.join(keys, "row").select("doc_id").distinct().collect()) == [1, 3]
