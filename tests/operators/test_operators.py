import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import dedup, labels, sampling, service
from quarry.sources import raw


def test_allocation():
    assert sampling.allocate({"peq": 60, "gde": 100_000}, 10_000, 500) == {"peq": 60, "gde": 9_940}
    parts = sampling.allocate({"a": 3, "b": 40, "c": 100, "d": 500, "e": 2000, "f": 7000}, 1000, 50)
    assert sum(parts.values()) == 1000 and (parts["a"], parts["b"]) == (3, 40)
    assert sampling.largest_remainder({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3}
    assert sampling.largest_remainder({"c": 1, "a": 1}, 3, declared=True) == {"c": 2, "a": 1}
    assert sampling.allocate_quotas({"x": 5, "y": 5}, {"x": 2, "y": 50}, 20) == {"x": 2, "y": 18}
    with pytest.raises(ValueError):
        sampling.allocate({"a": 1}, 2)


def test_systematic_and_ranks(spark):
    rows = spark.range(1000).withColumn("k", F.pmod(F.col("id") * 37, F.lit(101)))
    placed = sampling.ranked(rows, [F.col("k"), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in placed] == list(range(1000)) and [(r.k, r.id) for r in placed] == sorted((r.k, r.id) for r in placed)
    assert sorted(r["rank"] for r in sampling.systematic(rows, [F.col("id")], 7).collect()) == [i * 1000 // 7 for i in range(7)]


def test_split_keeps_singletons(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(10)] + [(99, "b"), (100, "c"), (101, "c")], "id long, label string")
    got = sampling.split(rows, "label", "id", 0.2).groupBy("label").agg(F.count_if("is_test").alias("n")).collect()
    assert {r.label: r.n for r in got} == {"a": 2, "b": 0, "c": 0}


def test_batches(spark):
    got = sampling.batches(spark.range(200).withColumnRenamed("id", "k"), "k", 80, spark.range(1000, 1010).withColumnRenamed("id", "k")).collect()
    assert len({r.k for r in got if not r.is_gold}) == 200
    assert all(sum(r.is_gold for r in got if r.batch == b) == 3 for b in {r.batch for r in got})


def test_exact_dedup(spark):
    rows = spark.createDataFrame([("1", "a", "ola mundo", 3, "w"), ("2", "b", "ola mundo", 0, "x"), ("3", "c", "ola mundo", 2, "y"), ("4", "d", "outra", 0, "x"), ("5", "e", "", 0, "x"), ("6", "f", "", 0, "x")], "sid string, uid string, key string, rank int, source string")
    got = {r.uid: r for r in dedup.exact_dedup(rows, "key", dedup.canonical_order(F.col("rank"), F.lit(0), F.col("sid"), F.col("uid"))).collect()}
    assert [u for u in sorted(got) if got[u].kept] == ["b", "d", "e", "f"]
    assert got["b"].n_exact_dups == 2 and got["a"].canonical_uid == "b" and sorted(got["b"].dup_sources) == ["w", "y"]


def test_pair_measures(spark):
    rows = spark.createDataFrame([(100, 50), (0, 0), (10, 0)], "a int, b int")
    assert [r.x for r in rows.select(dedup.length_ratio(F.col("a"), F.col("b")).alias("x")).collect()] == [2.0, 1.0, math.inf]
    sets = spark.createDataFrame([([], []), ([], ["a"]), (["a", "b"], ["b"])], "a array<string>, b array<string>")
    assert [r.x for r in sets.select(dedup.jaccard(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, 0.5]


def test_near_chain(spark):
    at = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d)), 0.0]
    rows = spark.createDataFrame([(1, at(0), 0), (2, at(6), 0), (3, at(12), 0), (4, [0.0, 0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    pairs = dedup.cosine_pairs(rows, 0.985, blocks=3)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(1, 2), (2, 3)]
    order, vectors = rows.select(F.col("vec_id").alias("node"), F.col("vec_id").alias("order")), rows.select(F.col("vec_id").alias("node"), F.col("embedding").alias("v"))
    assert [r.node for r in dedup.near_dedup(pairs, order, vectors, 0.985).filter("removed").collect()] == [2]
    assert sorted(r.node for r in dedup.near_dedup(pairs, order, vectors, 0.985, pairwise=False).filter("removed").collect()) == [2, 3]
    assert {r.node: r.n_near_dups for r in dedup.near_dedup(pairs, order, vectors, 0.985, pairwise=False).collect()} == {1: 2, 2: 0, 3: 0}
    # Texts must confirm a pair: 1 and 2 share their words, 3 is more than twice as long as 2.
    texts = spark.createDataFrame([(1, ["a", "b"], 10), (2, ["a", "b"], 10), (3, ["a", "b"], 21)], "node long, tokens array<string>, n_chars int")
    sure = dedup.confirm_pairs(pairs, texts)
    assert [(r.a, r.b) for r in sure.collect()] == [(1, 2)]
    assert sorted((r.node, r.removed, r.n_near_dups) for r in dedup.near_dedup(sure, order, vectors.join(texts, "node"), 0.985).collect()) == [(1, False, 1), (2, True, 0)]


def cosine_rows(spark, n=300, seed=5):
    """Vectors in three groups and a lone partition, with copies, a zero vector, NaN, nulls and repeated ids."""
    import numpy as np

    made = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.float32(made.normal(size=6))], int(i % 3)) for i in range(n)]
    rows += [(n + i, rows[7][1], 1) for i in range(40)] + [(n + 40, [0.0] * 6, 1), (n + 41, None, 1), (n + 42, rows[0][1], None), (None, rows[0][1], 0), (n + 43, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (n + 44, [1.0, 2.0], 0), (7, rows[7][1], 1), (n + 45, [float("nan")] * 6, 9), (n + 46, [1.0] * 6, 9)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def brute_pairs(rows, at_least):
    import numpy as np

    held = [(i, np.array(v, float), p) for i, v, p in rows if i is not None and v is not None and p is not None and None not in v]
    unit = [v / max(np.sqrt((v * v).sum()), 1e-12) for _, v, _ in held]
    return {(a[0], b[0]) for x, a in enumerate(held) for y, b in enumerate(held) if a[2] == b[2] and a[0] < b[0] and len(a[1]) == len(b[1]) and not unit[x] @ unit[y] < at_least}


def least_reachable(pairs):
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_cosine_pairs_and_links_against_all_pairs(spark):
    """No elementwise products in the plan; links have the pairs' components in linear number."""
    frame, rows = cosine_rows(spark)
    for at_least, blocks in ((0.8, 1), (0.8, 3), (0.9, 2), (0.95, None)):
        want = brute_pairs(rows, at_least)
        pairs = dedup.cosine_pairs(frame, at_least, blocks=blocks)
        assert "zip_with" not in pairs._jdf.queryExecution().toString()
        assert {(r.a, r.b) for r in pairs.collect()} == want
        links = dedup.cosine_links(frame, at_least, blocks=blocks)
        assert {r.node: r.root for r in dedup.components(links).collect()} == least_reachable(want)
    assert dedup.cosine_links(frame, 0.8, blocks=1).count() < frame.count() < len(brute_pairs(rows, 0.8))
    assert dedup.cosine_pairs(frame.limit(0), 0.8).count() == dedup.cosine_links(frame.limit(0), 0.8).count() == 0


def test_cosine_links_that_texts_confirm(spark):
    frame, rows = cosine_rows(spark)
    told = [(i, sorted({"abcdefghij"[(i * k) % 10] for k in range(i % 5)}), i % 7) for i in range(350)]
    texts = spark.createDataFrame([*told, (0, None, 3)][1:], "vec_id long, tokens array<string>, n_chars int")
    like = {"least_jaccard": 0.4, "most_ratio": 2.0}
    sure = dedup.confirm_pairs(dedup.cosine_pairs(frame, 0.5), texts.withColumnRenamed("vec_id", "node"), **like)
    want = least_reachable({(r.a, r.b) for r in sure.collect()})
    for blocks in (1, 3):
        got = dedup.components(dedup.cosine_links(frame.join(texts, "vec_id"), 0.5, blocks=blocks, **like))
        assert {r.node: r.root for r in got.collect()} == want and len(want) > 100


def test_components_compute_their_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long").mapInArrow(count, "a long, b long")
    assert {r.root for r in dedup.components(edges).collect()} == {0}
    assert seen.value == 30


def agreement(spark, pairs, weights):
    rows = spark.createDataFrame([("f", a, b) for a, b in pairs], "f string, a long, b long")
    return labels.weighted_agreement(rows, ["f"], 5, weights).first()


def test_agreement(spark):
    got = agreement(spark, [(3, 4)] * 6 + [(4, 3)] * 6, "quadratic")
    assert (got.observed, got.expected, got.kappa) == (0.9375, 0.9688, -1.0)
    assert agreement(spark, [(2, 2)] * 12, "nominal").reason == "sem_variancia"
    assert agreement(spark, [(2, 3)] * 3, "linear").reason == "poucos_pares"


def test_bands(spark):
    rows = spark.createDataFrame([(0.5,), (0.35,), (0.34,), (None,)], "c double")
    accepted, review = labels.bands(F.col("c"))
    assert [(r.a, r.r) for r in rows.select(accepted.alias("a"), review.alias("r")).collect()] == [(True, False), (True, True), (False, True), (None, True)]


def test_filters_and_search(spark):
    rows = spark.createDataFrame([(1, None, "pt"), (2, False, "pt"), (3, True, "en")], "id long, nsfw boolean, lang string")
    assert [r.id for r in service.apply_filters(rows, service.Filters()).collect()] == [1, 2]
    assert [r.id for r in service.apply_filters(rows, service.Filters(nsfw="only")).collect()] == [3]
    with pytest.raises(ValueError):
        service.Filters(nsfw="maybe")
    with pytest.raises(ValueError):
        service.Filters(n_chars_min=5, n_chars_max=1)
    assert service.parse_query('"Olá mundo" *! prefi* x') == [(["ola", "mundo"], False), (["prefi"], True), (["x"], False)]
    docs = spark.createDataFrame([(1, "Olá, mundo bom"), (2, "mundo olá"), (3, "prefixo olá mundo")], "id long, text string")
    assert [r.id for r in service.search(docs, '"ola mundo"').collect()] == [1, 3]
    assert [r.id for r in service.search(docs, "prefi* ola").collect()] == [3]
    assert service.search(docs, "!!!").count() == 0
    assert docs.filter("id = 1").select(service.snippet(F.col("text"), ["mundo"]).alias("x")).first().x == "Olá, <mark>mundo</mark> bom"


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "q"\nb', None, True), (2, "", "x", False)], "i long, s string, n string, b boolean")
    raw.write_jsonl(rows, f"{tmp_path}/j")
    good, bad = raw.read_jsonl(spark, f"{tmp_path}/j", "i long, s string, n string, b boolean")
    assert sorted(good.collect()) == sorted(rows.collect()) and bad.count() == 0
    raw.write_csv(rows, f"{tmp_path}/c")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/c")
    assert sorted((r.i, r.s, r.b) for r in back.collect()) == [("1", 'a "q"\nb', "true"), ("2", None, "false")]
    raw.write_parquet(rows, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    with open(f"{tmp_path}/t.jsonl", "w") as f:
        f.write('﻿{"i": 1}\n```json\nsome prose\n{"i": 2}\n\n')
    good, bad = raw.read_jsonl(spark, f"{tmp_path}/t.jsonl", "i long")
    assert [r.i for r in good.collect()] == [1, 2] and [r.line for r in bad.collect()] == ["some prose"]


def test_sources(spark):
    assert raw.resolve_sources(["a-b"], ["a_b", "c"]) == ["a_b"]
    for names in (["zz"], ["lmsys-chat-1m"]):
        with pytest.raises(ValueError):
            raw.resolve_sources(names, ["a_b"])
    with pytest.raises(ValueError):
        raw.require_columns(spark.range(1), ["text"], "s")


def test_windowed_counts(spark):
    from quarry.streaming.ingest import windowed_counts

    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.event_type, r.n, r.total) for r in windowed_counts(rows).collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_components_of_string_ids_and_their_limit(spark):
    import pytest

    from quarry.operators.dedup import components

    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("z1", "z2")], "a string, b string")
    assert {r.root for r in components(chain).collect()} == {"n000", "z1"}
    with pytest.raises(RuntimeError):
        components(chain, rounds=2)


def test_shared_fragments_against_sets(spark):
    """Nulls, blanks, short texts, repeated ids, repeated fragments, odd spaces; no shuffle carries what can't be shared."""
    import random

    from quarry.operators import fragments

    made = random.Random(1)
    word = lambda: made.choice(["a", "b", "é", "日本", "Aa"])
    text = lambda n: made.choice([" ", "\n", " \t"]).join(word() for _ in range(n))
    shown = [(made.randrange(60), text(made.randrange(40))) for _ in range(200)] + [(61, None), (62, ""), (None, "x1 x2 x3"), (None, " x1 x2\x0bx3 x4")]
    known = [text(12) for _ in range(40)] + [None, "", "x1 x2 x3 x4 x5"]

    def grams(t, n=4):
        w = (t or "").encode().split()
        return {b" ".join(w[i : i + n]).decode() for i in range(len(w) - n + 1)}

    held = set().union(*map(grams, known))
    want = {(k, g) for k, t in shown for g in grams(t) & held}
    frames = spark.createDataFrame(shown, "doc_id long, text string"), spark.createDataFrame([(t,) for t in known], "text string")
    got = [(r.doc_id, r.gram) for r in fragments.shared_fragments(*frames, "doc_id", 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50 and (None, "x1 x2 x3 x4") in want
    assert fragments.shared_fragments(frames[0], frames[1].limit(0), "doc_id", 4).count() == 0
    rare = spark.createDataFrame([(i, " ".join(f"{i}-{k}" for k in range(50))) for i in range(100)], "doc_id long, text string")
    bitmap = fragments._bitmap(fragments._hashes(frames[1], 4), 300)
    assert fragments._left(rare, "doc_id", 4, bitmap).count() < 470  # of 4,700 fragments


def test_shared_fragments_when_the_bitmap_is_full(spark, monkeypatch):
    """A bitmap far too small for the protected table: what it lets pass is not written as text."""
    from quarry.operators import fragments

    written, write = [], fragments.kept
    monkeypatch.setattr(fragments, "kept", lambda df: written.append(write(df)) or written[-1])
    monkeypatch.setattr(fragments, "MOST_BITS", 1 << 15)
    table = lambda mark, rows: spark.createDataFrame([(i, " ".join(f"{mark}{i}-{k}" for k in range(1000))) for i in range(rows)], "doc_id long, text string")
    shown = table("s", 20).union(spark.createDataFrame([(99, "p3-4 p3-5\np3-6  p3-7 p3-8")], "doc_id long, text string"))
    assert {tuple(r) for r in fragments.shared_fragments(shown, table("p", 200), "doc_id", 4).collect()} == {(99, "p3-4 p3-5 p3-6 p3-7"), (99, "p3-5 p3-6 p3-7 p3-8")}
    assert sum(w.count() for w in written) < 200  # of 19,942 fragments


def test_shared_counts_on_every_path(spark, monkeypatch):
    """Many ranges, small blocks; codes sent or as a bitmap, texts broadcast or shuffled; long words, repeated and null keys."""
    import random

    from quarry.operators import fragments

    made = random.Random(2)
    text = lambda n: made.choice([" ", "\x0b", "\r\n "]).join(made.choice(["a", "b", "é", "日本", "z" * 70_000]) for _ in range(n))
    shown = [(made.choice([None, *range(30)]), text(made.randrange(25))) for _ in range(120)] + [(31, None), (32, "a\x1fb c")]
    known = [text(9) for _ in range(30)] + [None, ""]
    grams = lambda t: {b" ".join(w[i : i + 3]) for w in [(t or "").encode().split()] for i in range(len(w) - 2)}
    held, want = set().union(*map(grams, known)), {}
    for k, t in shown:
        want.setdefault(k, set()).update(grams(t) & held)
    want = {k: len(g) for k, g in want.items() if g}
    frames = spark.createDataFrame(shown, "doc_id long, text string"), spark.createDataFrame([(t,) for t in known], "text string")
    assert len(want) > 20
    for codes, sent, rows in ((1 << 21, 1 << 22, 200_000), (1000, 0, 0), (50, 1 << 22, 0)):
        monkeypatch.setattr(fragments, "CODES", codes)
        monkeypatch.setattr(fragments, "SENT", sent)
        monkeypatch.setattr(fragments, "BROADCAST_ROWS", rows)
        got = [tuple(r) for r in fragments.shared_counts(*frames, "doc_id", 3).collect()]
        assert len(got) == len(want) and dict(got) == want
