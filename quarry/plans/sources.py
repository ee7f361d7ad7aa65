"""Queries of raw sources, sinks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.registry import query
from quarry.sources import raw as r
from quarry.sources.corpus import CORPUS_SQL, corpus, table
from quarry.sources.scratch import scratch_dir

C = "WITH " + CORPUS_SQL


@query("source_raw_rows", "SELECT 'docs' AS source, CAST(doc_id AS VARCHAR) AS source_id, text AS text_raw, lang AS lang_source, 'apache-2.0' AS license, false AS nsfw_hint FROM documents WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def raw_rows(spark, sf):
    rows = r.require_columns(table(spark, sf, "documents"), ["doc_id", "text", "lang"], "docs")
    return r.raw_rows(rows, "docs", "apache-2.0", source_id=F.col("doc_id").cast("string"), text_raw=F.col("text"), lang_source=F.col("lang")).select("source", "source_id", "text_raw", "lang_source", "license", "nsfw_hint")


@query("source_language_filter", "SELECT 'split-' || lpad(CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR), 6, '0') AS source_id, doc_id FROM documents QUALIFY lang = 'es'")
def language_filter(spark, sf):
    """O-S8: positions are counted before the filter."""
    from quarry.operators.sampling import ranked

    rows = ranked(table(spark, sf, "documents").select("doc_id", "lang"), [F.col("doc_id")])
    return rows.filter("lang = 'es'").select(F.concat(F.lit("split-"), F.lpad(F.col("rank").cast("string"), 6, "0")).alias("source_id"), "doc_id")


@query("source_first_user_turn", "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role = 'user') WHERE p = 1 AND text <> ''")
def first_user_turn(spark, sf):
    return r.first_turn(table(spark, sf, "conversations"))


@query("source_first_human_turn", "SELECT conv_id, trim(text) AS human FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role = 'user') WHERE p = 1")
def first_human_turn(spark, sf):
    return r.transcript(table(spark, sf, "conversations")).select("conv_id", r.first_human_turn(F.col("body")).alias("human")).filter("human IS NOT NULL")


@query("source_with_context", "SELECT b.item_id, CASE WHEN trim(coalesce(b.text, '')) <> '' AND b.item_id % 2 = 0 THEN 'Answer.' || chr(10) || chr(10) || b.text ELSE 'Answer.' END AS text_raw FROM benchmark b")
def with_context(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", r.with_context(F.lit("Answer."), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise("  ")).alias("text_raw"))


@query("source_union_first_wins", "SELECT user_id, event_id, part FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY part, event_id) AS p FROM (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 END AS part FROM events WHERE event_type IN ('purchase', 'click'))) WHERE p = 1")
def union_first_wins(spark, sf):
    events = table(spark, sf, "events")
    parts = [events.filter(F.col("event_type") == t).select("user_id", "event_id", F.lit(i).alias("part")) for i, t in enumerate(("purchase", "click"))]
    return r.union_first_wins(parts, "user_id", "event_id")


@query("source_content_parts", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations WHERE text IS NOT NULL AND role <> 'system' GROUP BY conv_id")
def content_parts(spark, sf):
    kind = F.when(F.col("role") != "system", "text").otherwise("other")
    part = F.struct(F.col("turn"), kind.alias("type"), F.col("text"))
    held = table(spark, sf, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return held.select("conv_id", r.content_text(F.col("parts")).alias("body")).filter("body <> ''")


@query("report_raw", C + "SELECT source, count(*) AS n, count(DISTINCT md5(text)) AS n_distinct, round(100.0 * count(*) FILTER (WHERE length(trim(text)) < 10) / count(*), 4) AS pct_short, CAST(floor(median(n_chars)) AS BIGINT) AS median_chars, CASE WHEN count(*) BETWEEN 10 AND 100000 THEN 'PASS' ELSE 'WARN' END AS status FROM c GROUP BY source")
def report_raw(spark, sf):
    """O-G9."""
    return corpus(spark, sf).groupBy("source").agg(
        F.count("*").alias("n"), F.countDistinct(F.md5("text")).alias("n_distinct"), F.round(100.0 * F.count_if(F.length(F.trim("text")) < 10) / F.count("*"), 4).alias("pct_short"),
        F.floor(F.percentile("n_chars", 0.5)).alias("median_chars"), F.when(F.count("*").between(10, 100_000), "PASS").otherwise("WARN").alias("status"),
    )


@query("report_universe", C + "SELECT coalesce(CAST(quality AS VARCHAR), '(nulo)') AS value, count(*) AS n, sum(n_chars) AS chars, round(quantile_cont(n_chars, 0.5), 4) AS median, round(quantile_cont(n_chars, 0.9), 4) AS p90, max(n_chars) AS longest FROM c GROUP BY 1")
def report_universe(spark, sf):
    """O-G10."""
    return corpus(spark, sf).groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("(nulo)")).alias("value")).agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.percentile("n_chars", 0.5), 4).alias("median"), F.round(F.percentile("n_chars", 0.9), 4).alias("p90"), F.max("n_chars").alias("longest")
    )


@query("report_integrity", C + "SELECT count(*) AS n, count(DISTINCT uid) AS n_uids, count(*) FILTER (WHERE uid IS NULL OR source IS NULL) AS n_null, count(*) FILTER (WHERE quality NOT BETWEEN 1 AND 3) AS n_bad_quality FROM c")
def report_integrity(spark, sf):
    """O-G13."""
    return corpus(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("uid").alias("n_uids"), F.count_if(F.col("uid").isNull() | F.col("source").isNull()).alias("n_null"), F.count_if(~F.col("quality").between(1, 3)).alias("n_bad_quality"))


@query(
    "report_funnel",
    C
    + "SELECT 'raw' AS stage, count(*) AS n FROM c UNION ALL SELECT 'language', count(*) FROM c WHERE lang IN ('en', 'fr') UNION ALL SELECT 'size', count(*) FROM c WHERE lang IN ('en', 'fr') AND n_words >= 5 UNION ALL SELECT 'licence', count(*) FROM c WHERE lang IN ('en', 'fr') AND n_words >= 5 AND redistributable",
)
def report_funnel(spark, sf):
    """O-G11: every stage counted in one scan."""
    lang = F.col("lang").isin("en", "fr")
    size, open_ = lang & (F.col("n_words") >= 5), lang & (F.col("n_words") >= 5) & F.col("redistributable")
    one = corpus(spark, sf).agg(F.count("*").alias("raw"), F.count_if(lang).alias("language"), F.count_if(size).alias("size"), F.count_if(open_).alias("licence"))
    return one.unpivot([], ["raw", "language", "size", "licence"], "stage", "n")


@query("stream_first_turns", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND turn <= 1 AND text <> ''")
def stream_first_turns(spark, sf):
    import uuid

    from quarry.streaming import ingest

    base = f"{scratch_dir(spark)}/quarry-stream-{uuid.uuid4().hex}"
    turns = table(spark, sf, "conversations")
    turns.write.parquet(f"{base}/in")
    ingest.run_once(ingest.first_user_turns(spark, f"{base}/in", turns.schema), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("conv_id", "turn", "text")
