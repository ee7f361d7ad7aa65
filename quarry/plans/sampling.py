"""Queries of samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import sampling as a
from quarry.plans.registry import query
from quarry.sources.corpus import CORPUS_SQL, corpus, table

C = "WITH " + CORPUS_SQL


@query("sample_hash_gate", C + f"SELECT id FROM c WHERE CAST('0x' || substr(sha256(uid), 1, 8) AS BIGINT) < {int(0.11 * (1 << 32))}")
def hash_gate(spark, sf):
    return corpus(spark, sf).filter(a.hash_gate(F.col("uid"), 0.11)).select("id")


@query("sample_smallest_hashes", C + "SELECT id, sha256(uid) AS h FROM c ORDER BY h, id LIMIT 50")
def smallest_hashes(spark, sf):
    """O-S11, O-A20."""
    return corpus(spark, sf).select("id", F.sha2("uid", 256).alias("h")).orderBy("h", "id").limit(50)


@query("sample_first_per_source", C + "SELECT source, id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS p FROM c) WHERE p <= 10")
def first_per_source(spark, sf):
    """O-S3, O-S27: a cap for each source."""
    from pyspark.sql.window import Window as W

    return corpus(spark, sf).select("source", "id").withColumn("p", F.row_number().over(W.partitionBy("source").orderBy("id"))).filter("p <= 10").drop("p")


_RANK = "row_number() OVER (PARTITION BY lang ORDER BY sha256('0:' || id), id)"


@query(
    "sample_stratified",
    C
    + f""", n AS (SELECT lang, count(*) AS n FROM c GROUP BY lang), t AS (SELECT sum(n) AS s FROM n), e AS (SELECT lang, 100 * n / CAST(s AS DOUBLE) AS x FROM n, t),
    r AS (SELECT lang, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, lang) <= 100 - (SELECT sum(floor(x)) FROM e) THEN 1 ELSE 0 END AS share FROM e),
    p AS (SELECT id, lang, {_RANK} AS place FROM c) SELECT id, lang FROM p JOIN r USING (lang) WHERE place <= share""",
)
def stratified(spark, sf):
    rows = corpus(spark, sf).select("id", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each stratum
    return a.stratified_sample(rows, "lang", "id", a.largest_remainder(counts, 100))


@query("sample_allocated")
def allocated(spark, sf):
    """O-A8, O-A9: floors, then in proportion to what is left."""
    from quarry.functions.text import strata_key

    rows = corpus(spark, sf).select("id", strata_key(F.col("model"), F.col("n_chars"), F.col("created_ts")).alias("stratum"))
    counts = {r["stratum"]: r["n"] for r in rows.groupBy("stratum").agg(F.count("*").alias("n")).collect()}  # 63 strata at most for known models
    return a.stratified_sample(rows, "stratum", "id", a.allocate(counts, sum(counts.values()) // 4, 5))


@query("sample_systematic", "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, r AS rank FROM o WHERE r IN (SELECT unnest(range(37)) * n // 37)")
def systematic(spark, sf):
    return a.systematic(table(spark, sf, "documents").select("doc_id", "n_chars"), [F.col("n_chars"), F.col("doc_id")], 37).select("doc_id", "rank")


@query("sample_two_slices", "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, (row_number() OVER (ORDER BY r) - 1) % 2 AS slice FROM o WHERE r IN (SELECT unnest(range(40)) * n // 40)")
def two_slices(spark, sf):
    """O-A14."""
    picked = a.systematic(table(spark, sf, "documents").select("doc_id", "n_chars"), [F.col("n_chars"), F.col("doc_id")], 40)
    return a.ranked(picked.drop("rank"), [F.col("n_chars"), F.col("doc_id")]).select("doc_id", F.pmod("rank", F.lit(2)).alias("slice"))


@query("sample_interleaved", "WITH o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE lang IN ('en', 'fr')) SELECT doc_id, r, lang FROM o ORDER BY r, lang LIMIT 60")
def interleaved(spark, sf):
    """O-A15: one of each language in turn."""
    from pyspark.sql.window import Window as W

    rows = table(spark, sf, "documents").filter("lang IN ('en', 'fr')").select("doc_id", "lang")
    return rows.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))).orderBy("r", "lang").limit(60)


@query("sample_train_test", "WITH o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('0:' || vec_id), vec_id) AS p, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, label, p <= CASE WHEN n < 2 THEN 0 ELSE least(round(n * 0.2), n - 1) END AS is_test FROM o")
def train_test(spark, sf):
    return a.split(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.2)


@query("sample_batches")
def batches(spark, sf):
    gold = table(spark, sf, "labels").select("doc_id").orderBy("doc_id").limit(20)
    rows = table(spark, sf, "documents").select("doc_id").join(F.broadcast(gold), "doc_id", "left_anti")
    return a.batches(rows, "doc_id", 80, gold)
