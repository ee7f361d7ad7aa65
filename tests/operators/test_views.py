"""Reviews, preference pairs, allocation by band, raw scans, filters and the blockwise search."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarry.operators import labels, review, sampling, service
from quarry.sources import raw
from quarry.sources.corpus import _variant


def test_bands_keep_the_rare_one():
    assert sampling.allocate_bands(20, {"curto": 900, "longo": 1, "medio": 99}, 0.1) == {"curto": 16, "longo": 1, "medio": 3}  # floors 2, 1, 2; then 15 by 898 to 97
    assert sampling.allocate_bands(20, {"curto": 3, "medio": 4}, 0.1) == {"curto": 3, "medio": 4}
    assert sampling.allocate_bands(0, {"curto": 3}, 0.1) == {"curto": 0}
    given = sampling.allocate_bands(50, {"a": 7, "b": 40, "c": 1000}, 0.1)
    assert sum(given.values()) == 50 and given["a"] >= 5 and given["b"] >= 5


def test_review_refuses_what_is_not_submitted(spark):
    rows = spark.createDataFrame([(1, "submetida"), (2, "submetida"), (3, "aprovada"), (4, "submetida")], "id long, status string")
    verdicts = spark.createDataFrame([(1, True), (2, True), (2, False), (3, False), (9, True)], "id long, approve boolean")
    got = {x.id: (x.status, x.promised_uid is not None, x.refused) for x in review.review_creations(rows, verdicts).collect()}
    assert got == {1: ("aprovada", True, False), 2: ("rejeitada", False, False), 3: ("aprovada", False, True), 4: ("submetida", False, False)}


def test_preference_pairs(spark):
    rounds = spark.createDataFrame([(1, 0, "x", "y", "A"), (1, 2, "x", "y", "B"), (1, 4, "x", "y", "tie"), (2, 1, "x", None, "A"), (3, 1, "x", "y", None)], "conv_id long, round long, answer_a string, answer_b string, winner string")
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", "late")], "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, review.preference_pairs(rounds, turns).collect()))
    assert got == [(1, 0, "x", "y", "A", ""), (1, 2, "y", "x", "B", "user: hi\nassistant: ")]


def test_report_has_no_row_for_a_scale_without_pairs(spark):
    pairs = spark.createDataFrame([(1, 1)] * 12, "a int, b int")
    got = {x.field: x.reason for x in labels.agreement_report({"s": (pairs, 4, "quadratic"), "t": (pairs.limit(0), 2, "nominal")}).collect()}
    assert got == {"s": "sem_variancia"}


def test_raw_scan_leaves_pools_out(spark, tmp_path):
    for name in ("b", "a", "a_pool"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    files = spark.read.parquet(str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")).count()
    got = {x.source_file: x.n for name in ("a", "b", "a_pool") for x in raw.scan_raw(spark, str(tmp_path / f"{name}.parquet")).groupBy("source_file").agg(F.count("*").alias("n")).collect()}
    assert files == 6 and got == {"a": 3, "b": 3}


def test_raw_scan_of_files_and_folders(spark, tmp_path):
    """A table may be a file or a folder of part files, beside others, in a folder whose name looks like a pattern."""
    top = tmp_path / "in [a]"
    for name in ("docs", "docs_b", "docs_pool", "other"):
        spark.range(6).repartition(2).write.parquet(str(top / f"{name}.parquet"))
    spark.range(6).withColumn("k", F.col("id") % 2).write.partitionBy("k").parquet(str(top / "keyed.parquet"))
    next((top / "docs_b.parquet").glob("part-*")).rename(top / "docs_d.parquet")
    got = {x.source_file: x.n for p in ("docs*.parquet", "keyed.parquet") for x in raw.scan_raw(spark, str(top), p).groupBy("source_file").agg(F.count("*").alias("n")).collect()}
    assert got == {"docs": 6, "docs_b": 3, "docs_d": 3, "keyed": 6}


def test_stamps(spark):
    rows = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 3, 4, 5), {"a": "é", "b": None}), (datetime.datetime(2024, 1, 2, 3, 4, 5, 60), {}), (None, None)], "ts timestamp, meta map<string,string>")
    got = [tuple(x) for x in rows.select(raw.iso_text(F.col("ts")), raw.compact_meta(F.col("meta"))).collect()]
    assert got == [("2024-01-02T03:04:05", '{"a":"é","b":null}'), ("2024-01-02T03:04:05.000060", "{}"), ("", "{}")]


def test_filters_refuse_unknown_words():
    for bad in ({"task_type": ["poem"]}, {"domain": ["x"]}, {"license": ["x"]}, {"quality": [True]}, {"quality": [4]}):
        with pytest.raises(ValueError):
            service.Filters(**bad)


def test_search_is_a_filter(spark):
    rows = spark.createDataFrame([(1, "Olá mundo", None, 9), (2, "mundo", None, 5), (3, None, None, 0)], "id long, text string, nsfw boolean, n_chars int")
    f = service.Filters(q='"ola mundo"')
    assert [x.id for x in service.apply_filters(rows, f).collect()] == [1]
    hits = service.with_hits(rows, f)
    assert [x.id for x in service.apply_filters(rows.drop("text"), hits).collect()] == [1]
    assert service.with_hits(rows, service.Filters(q="*!")).hits is None
    assert service.apply_filters(rows, service.Filters(q="*!")).count() == 3


def test_blocks_rank_as_the_plain_search(spark):
    rows = spark.range(300).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") % 50 + i).cast("float")).alias("embedding"))
    rows = rows.union(spark.createDataFrame([(999, None)], "vec_id long, embedding array<float>"))
    q = [0.5, -1.0, 0.25, 2.0, 0.0, 1.0, -0.5, 0.75]
    want = [x.id for x in service.top_similar(rows.filter("embedding IS NOT NULL"), q, 12).collect()]
    assert [x.id for x in service.top_similar_blocks(rows, q, 12).collect()] == want


def test_variant_of_portuguese_texts(spark):
    rows = spark.createDataFrame([("Você pegou o ônibus? O time está jogando e meu celular sumiu.", "Brazil"), ("Tens o telemóvel? O autocarro está a chegar e o comboio não.", "Portugal"), ("nada", None)], "t string, c string")
    assert [x[0] for x in rows.select(_variant(F.col("t"), F.col("c"))).collect()] == ["pt-BR", "pt-PT", "pt-indef"]


def test_guards_change_no_count(spark):
    """Texts made of the cues' own letters, so that guards pass and fail around real matches."""
    import random

    from quarry.functions import language

    patterns = [p for br, pt, *_ in language.DIALECT for p in br + pt]
    assert language.required_literal(r"\busuári[oa]s?\b") == "usuári" and language.required_literal(r"\bvocês?\b") == "você" and language.required_literal(r"a|b") == ""
    words = sorted({w for p in patterns for w in "".join(c if c.isalpha() or c == "-" else " " for c in p.replace("\\b", " ").replace("\\w", " ").replace("\\s", " ")).split()})
    rng = random.Random(3)
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "s", "a", "ando", ", pá!", " a ver", "-me"]) for _ in range(40)) for _ in range(150)] + ["", "a gente está a fazer, pá!"]
    rows = spark.createDataFrame([(x.lower(),) for x in texts], "t string")
    met = 0
    for i in range(0, len(patterns), 20):  # few enough regexes a plan
        got = rows.select(*[F.struct(language._guarded_count(F.col("t"), p), F.regexp_count("t", F.lit("(?U)" + p))) for p in patterns[i : i + 20]]).collect()
        for row in got:
            for guarded, plain in row:
                assert guarded == plain
                met += plain > 0
    assert met > 500
