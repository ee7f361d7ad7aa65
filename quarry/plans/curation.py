"""Queries of language, dialect and personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import language as lang
from quarry.functions import pii
from quarry.functions import text as t
from quarry.plans.registry import query
from quarry.sources.corpus import corpus, table

KEPT = ["en", "fr", "de", "es"]


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _detect_sql(scores: dict[str, str], out: str, source: str) -> str:
    """``out``_lang and ``out``_score from one SQL score for each language."""
    names = list(scores)
    return f"""(SELECT *, CASE WHEN list_sum(v) > 0 THEN {_list(names)}[list_position(v, list_max(v))] ELSE 'und' END AS {out}_lang,
      CASE WHEN list_sum(v) > 0 THEN list_max(v) / list_sum(v) ELSE 0.0 END AS {out}_score FROM (SELECT *, [{", ".join(scores.values())}] AS v FROM {source}))"""


_WORDS = {k: f"len(list_filter(w, lambda x: list_contains({_list(v)}, x)))" for k, v in lang.STOP_WORDS.items()}
_LETTERS = {k: f"len(regexp_extract_all(h, '{v}'))" for k, v in lang.LETTERS.items()}
_HEADS = "(SELECT doc_id, lang, length(coalesce(text, '')) AS n, lower(substr(coalesce(text, ''), 1, 1000)) AS h, regexp_split_to_array(lower(substr(coalesce(text, ''), 1, 1000)), '[^\\p{L}]+') AS w FROM documents)"
_FIRST = _detect_sql(_WORDS, "first", _HEADS)
_BOTH = _detect_sql(_LETTERS, "second", f"(SELECT * EXCLUDE (v) FROM {_FIRST})")
_DOUBT = "(first_score < 0.65 OR n < 25 OR (lang IN ('en', 'fr', 'de', 'es') AND first_lang <> lang))"
_FINAL = f"CASE WHEN first_lang IN ('en', 'fr', 'de', 'es') AND (NOT {_DOUBT} OR first_lang = second_lang) THEN first_lang END"


def decided(spark, sf):
    first, score = lang.detect_words(F.col("text"))
    second, _ = lang.detect_letters(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).alias("n"), first.alias("first_lang"), score.alias("first_score"), second.alias("second_lang"))
    return rows.withColumn("final", lang.decide(F.col("first_lang"), F.col("first_score"), F.col("second_lang"), F.col("n"), F.col("lang"), KEPT))


@query("language_detect", f"SELECT doc_id, first_lang, round(first_score, 6) AS first_score FROM {_FIRST}")
def language_detect(spark, sf):
    return decided(spark, sf).select("doc_id", "first_lang", F.round("first_score", 6).alias("first_score"))


@query("language_second_opinion", f"SELECT doc_id, second_lang FROM {_BOTH}")
def language_second_opinion(spark, sf):
    return decided(spark, sf).select("doc_id", "second_lang")


@query("language_decide", f"SELECT doc_id, {_FINAL} AS final FROM {_BOTH}")
def language_decide(spark, sf):
    return decided(spark, sf).select("doc_id", "final")


@query(
    "language_funnel",
    f"SELECT count(*) AS n, count(*) FILTER (WHERE {_DOUBT}) AS n_arbitrated, count(final) AS n_kept, count(*) FILTER (WHERE final <> lang) AS n_moved, count(*) FILTER (WHERE final IS NULL AND first_lang IN ('en', 'fr', 'de', 'es')) AS n_disagreed, count(*) FILTER (WHERE first_lang NOT IN ('en', 'fr', 'de', 'es')) AS n_other FROM (SELECT *, {_FINAL} AS final FROM {_BOTH})",
)
def language_funnel(spark, sf):
    """O-L4."""
    own, first = F.col("lang").isin(KEPT), F.col("first_lang")
    doubt = (F.col("first_score") < 0.65) | (F.col("n") < 25) | (own & (first != F.col("lang")))
    return decided(spark, sf).agg(
        F.count("*").alias("n"), F.count_if(doubt).alias("n_arbitrated"), F.count("final").alias("n_kept"), F.count_if(F.col("final") != F.col("lang")).alias("n_moved"),
        F.count_if(F.col("final").isNull() & first.isin(KEPT)).alias("n_disagreed"), F.count_if(~first.isin(KEPT)).alias("n_other"),
    )


@query("language_recheck", f"SELECT doc_id FROM {_BOTH.replace('1, 1000', '1, 250')} WHERE n > 250 AND first_lang <> lang AND first_lang = second_lang AND second_score >= 0.5")
def language_recheck(spark, sf):
    """O-L8: long texts whose head both layers call the same other language."""
    head = F.substring("text", 1, 250)
    (first, _), (second, score) = lang.detect_words(head), lang.detect_letters(head)
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("n"), first.alias("a"), second.alias("b"), score.alias("s"))
    return rows.filter("n > 250 AND a <> lang AND a = b AND s >= 0.5").select("doc_id")


@query("dialect_scoreboard")
def dialect_scoreboard(spark, sf):
    br, pt = lang.dialect_scores(F.col("text"), F.col("country"))
    rows = corpus(spark, sf).select("id", br.alias("br"), pt.alias("pt"))
    variant, margin = lang.dialect(F.col("br"), F.col("pt"))
    return rows.select("id", "br", "pt", variant.alias("lang_variant"), margin.alias("variant_confidence"))


@query("pii_scrub")
def pii_scrub(spark, sf):
    """O-P1, O-P5: what changes is hashed and measured anew."""
    rows = table(spark, sf, "documents").select("doc_id", "text", pii.scrub("text").alias("s"))
    changed = F.col("s.text") != F.col("text")
    return rows.select("doc_id", changed.alias("pii_found"), F.col("s.text").alias("clean"), *[F.col(f"s.{k}").alias(f"n_{k}") for k in pii.KINDS], t.n_words(F.col("s.text")).alias("n_words"))


@query("pii_report")
def pii_report(spark, sf):
    """O-P6."""
    rows = pii_scrub(spark, sf)
    one = rows.agg(*[F.sum(f"n_{k}").alias(k) for k in pii.KINDS], F.count_if("pii_found").alias("rows_altered"))
    return one.unpivot([], [*pii.KINDS, "rows_altered"], "kind", "n")


@query("pii_email_count", "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:[.][A-Za-z0-9_-]+)+')) AS n_email FROM documents")
def pii_email_count(spark, sf):
    """The e-mail step of O-P1 alone, within the engine."""
    return table(spark, sf, "documents").select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:[.][A-Za-z0-9_-]+)+")).cast("long").alias("n_email"))
