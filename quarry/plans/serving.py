"""Queries of the serving table and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import serving as v
from quarry.operators.dedup import dot
from quarry.plans.registry import query
from quarry.sources.corpus import CORPUS_SQL, corpus, table

C = "WITH " + CORPUS_SQL


@query("serving_build_id", C + "SELECT substr(sha256(count(*) || ':' || coalesce(sum(CAST('0x' || substr(sha256(uid), 1, 12) AS BIGINT)), 0)), 1, 16) AS build_id FROM c")
def serving_build_id(spark, sf):
    return v.build_id(corpus(spark, sf))


@query("dataset_card", C + "SELECT 'lang' AS section, lang AS name, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'license', license, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*) FROM c WHERE quality IS NOT NULL GROUP BY ALL")
def dataset_card(spark, sf):
    return v.dataset_card(corpus(spark, sf))


@query("embed_hashed")
def embed_hashed(spark, sf):
    """Unit vectors of benchmark items, with their squared length."""
    rows = table(spark, sf, "benchmark").select("item_id", v.hashed_embedding(F.col("text")).alias("embedding"))
    return rows.select("item_id", "embedding", F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("square"))
