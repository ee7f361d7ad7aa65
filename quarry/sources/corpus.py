"""The curated corpus: the canonical columns that every query of the service reads.

``documents`` and ``labels`` supply text, language, source, quality and the unsafe
flag. Provenance that the tables lack follows from the id by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.functions.language import dialect, dialect_scores
from quarry.functions.vocabulary import DOMAINS, LICENSES, TASK_TYPES

COUNTRIES = ["Brazil", "Portugal", "Angola"]
MODELS = ["gpt-4.1-mini-2025-04-14", "gpt-4.1-2025", "gpt-4o-2024-05-13", "gpt-3.5-turbo-0301", "o1-preview", "other-model"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], at) -> Column:
    """The value at a place counted from 0; null beyond the last."""
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def _variant(text: Column, country: Column) -> Column:
    """The dialect of a text. As variables of lambdas the scores are made once, outside of generated code, which they would outgrow."""
    scored = F.transform(F.array(F.struct(text.alias("t"), country.alias("c"))), lambda x: F.struct(*[s.alias(n) for n, s in zip(("br", "pt"), dialect_scores(x["t"], x["c"]))]))
    return F.get(F.transform(scored, lambda x: dialect(x["br"], x["pt"])[0]), 0)


def license_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LICENSES, "license string, commercial_ok boolean, redistributable boolean, license_rank int")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document; labels and the licence policy are joined, not looked up by row."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
    i = F.col("doc_id")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        i.alias("id"),
        t.stable_id(F.col("source"), i.cast("string"), body).alias("uid"),
        body.alias("text"),
        "lang",
        "source",
        _pick([x[0] for x in LICENSES], F.pmod(i, F.lit(9))).alias("license"),
        _pick(TASK_TYPES, F.pmod(i, F.lit(17))).alias("task_type"),
        _pick(DOMAINS, F.pmod(i * 7, F.lit(17))).alias("domain"),
        _pick(COUNTRIES, F.pmod(i, F.lit(4))).alias("country"),
        _pick(MODELS, F.pmod(i, F.lit(6))).alias("model"),
        F.when(F.pmod(i, F.lit(7)) != 0, F.concat(F.lit("202"), F.pmod(i, F.lit(4)), F.lit("-01-0"), F.pmod(i, F.lit(9)) + 1, F.lit("T00:00:00Z"))).alias("created_ts"),
        (F.pmod(i, F.lit(11)) == 0).alias("edited"),
        (F.contains(body, F.lit("@")) & body.rlike(r"[A-Za-z0-9_.+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]")).alias("pii_found"),
        F.length(body).cast("long").alias("n_chars"),
        F.when(F.length(body) < 120, "curto").when(F.length(body) < 600, "medio").otherwise("longo").alias("n_chars_bucket"),
        F.when(F.col("lang") == "pt", _variant(body, _pick(COUNTRIES, F.pmod(i, F.lit(4))))).alias("lang_variant"),
        t.n_words(body).alias("n_words"),
    )
    rows = rows.join(F.broadcast(license_policy(spark)), "license", "left").join(labels.withColumnRenamed("doc_id", "id"), "id", "left")
    return rows.select(
        *[c for c in rows.columns if c not in ("q", "x")],
        (F.col("q") + 1 + F.pmod("id", F.lit(2))).cast("int").alias("quality"),
        (F.col("x") == 1).alias("nsfw"),
        F.when(F.col("q").isNotNull(), "manual").when(F.col("task_type").isNotNull(), "native").alias("label_method"),
        (F.col("task_type").isNull() | F.col("domain").isNull()).alias("needs_review"),
    )


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The same rows in DuckDB SQL, as the common table expression ``c``.
CORPUS_SQL = f"""c AS (
  SELECT d.doc_id AS id, substr(sha256(source || ':' || d.doc_id), 1, 16) AS uid, coalesce(d.text, '') AS text, lang, source, p.license,
    {_listed(TASK_TYPES)}[d.doc_id % 17 + 1] AS task_type, {_listed(DOMAINS)}[d.doc_id * 7 % 17 + 1] AS domain,
    {_listed(COUNTRIES)}[d.doc_id % 4 + 1] AS country, {_listed(MODELS)}[d.doc_id % 6 + 1] AS model,
    CASE WHEN d.doc_id % 7 <> 0 THEN '202' || (d.doc_id % 4) || '-01-0' || (d.doc_id % 9 + 1) || 'T00:00:00Z' END AS created_ts,
    d.doc_id % 11 = 0 AS edited, regexp_matches(coalesce(d.text, ''), '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9-]') AS pii_found,
    length(coalesce(d.text, '')) AS n_chars, CASE WHEN length(coalesce(d.text, '')) < 120 THEN 'curto' WHEN length(coalesce(d.text, '')) < 600 THEN 'medio' ELSE 'longo' END AS n_chars_bucket,
    CASE WHEN lang = 'pt' THEN CAST(error('the dialect of Portuguese rows has no SQL') AS VARCHAR) END AS lang_variant,
    CASE WHEN l.q IS NOT NULL THEN 'manual' WHEN d.doc_id % 17 <> 16 THEN 'native' END AS label_method,
    len(list_filter(regexp_split_to_array(coalesce(d.text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS n_words,
    p.commercial_ok, p.redistributable, p.license_rank, CAST(l.q + 1 + d.doc_id % 2 AS INTEGER) AS quality, l.x = 1 AS nsfw,
    (d.doc_id % 17 = 16 OR d.doc_id * 7 % 17 = 16) AS needs_review
  FROM documents d
  JOIN (VALUES {", ".join(f"({k}, '{x[0]}', {x[1]}, {x[2]}, {x[3]})" for k, x in enumerate(LICENSES))}) AS p(k, license, commercial_ok, redistributable, license_rank) ON p.k = d.doc_id % 9
  LEFT JOIN (SELECT doc_id, min(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
)"""
