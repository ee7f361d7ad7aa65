"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.functions.vocabulary import FAMILIES
from quarry.plans.registry import query
from quarry.sources.corpus import CORPUS_SQL, corpus, table

C = "WITH " + CORPUS_SQL
#: The comparison key in DuckDB: the database's own accent folding.
KEY = "rtrim(regexp_replace(trim(regexp_replace(replace(strip_accents(lower({0})), 'ß', 'ss'), '[\\x20\\x09-\\x0D]+', ' ', 'g')), '[.!?…]+$', ''))"


@query("text_stable_id", C + " SELECT id, uid FROM c")
def stable_id(spark, sf):
    return corpus(spark, sf).select("id", "uid")


@query(
    "text_norm_display",
    """SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'),
       '[\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}]', '', 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}]', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS display_sha256 FROM documents""",
)
def norm_display(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(t.norm_display(F.coalesce("text", F.lit(""))), 256).alias("display_sha256"))


@query("text_hash_norm", f"SELECT doc_id, sha256({KEY.format('coalesce(text, chr(32))')}) AS hash_norm FROM documents")
def hash_norm(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.hash_norm(t.comparison_key_latin(F.coalesce("text", F.lit(" ")))).alias("hash_norm"))


@query("text_comparison_key_unicode")
def comparison_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.comparison_key("text").alias("comparison_key"))


@query("text_stats", C + " SELECT id, n_chars, n_words FROM c")
def stats(spark, sf):
    return corpus(spark, sf).select("id", "n_chars", "n_words")


@query(
    "text_token_set",
    f"SELECT doc_id, CASE WHEN k = '' THEN 0 ELSE len(list_distinct(string_split(k, ' '))) END AS n_tokens FROM (SELECT doc_id, {KEY.format('coalesce(text, chr(32))')} AS k FROM documents)",
)
def token_set(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(t.token_set(t.comparison_key_latin(F.coalesce("text", F.lit(" "))))).cast("long").alias("n_tokens"))


@query(
    "text_truncate_preview",
    C
    + """ SELECT id, CASE WHEN n_chars > 200 THEN substr(text, 1, 200) || ' …[TRUNCADO]' ELSE text END AS truncated, substr(text, 1, 160) AS preview, n_chars > 160 AS text_truncated,
    contains(lower(substr(text, 1, 20000)), 'user:') OR contains(lower(substr(text, 1, 20000)), 'assistant:') AS chat_markers FROM c""",
)
def truncate_preview(spark, sf):
    text = F.col("text")
    cut, was_cut = t.preview(text, 160)
    return corpus(spark, sf).select("id", t.truncate_marked(text, 200).alias("truncated"), cut.alias("preview"), was_cut.alias("text_truncated"), t.has_chat_markers(text).alias("chat_markers"))


@query(
    "text_safe_filename",
    "SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 80) AS filename, nullif(regexp_extract(url, '[?](.*)', 1), '') AS query_or_null FROM pages",
)
def safe_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.safe_filename(F.col("url")).alias("filename"), t.null_if_empty(F.regexp_extract("url", "[?](.*)", 1)).alias("query_or_null"))


_FAMILY = "CASE " + " ".join(f"WHEN starts_with(model, '{p}') THEN '{f}'" for p, f in FAMILIES) + " ELSE model END"
_STRATA = f"({_FAMILY}) || '|' || CASE WHEN n_chars < 120 THEN '1_lt120' WHEN n_chars <= 600 THEN '2_120a600' ELSE '3_gt600' END || '|' || CASE WHEN regexp_matches(substr(created_ts, 1, 4), '^[0-9]{{4}}$') THEN substr(created_ts, 1, 4) ELSE '????' END"


@query(
    "text_strata",
    C
    + f""" SELECT id, {_FAMILY} AS family, {_STRATA} AS strata_key, upper(coalesce(country, '')) AS country_key,
    CASE WHEN n_chars < 120 THEN 'lt120' WHEN n_chars < 600 THEN '120a600' WHEN n_chars < 2000 THEN '600a2000' ELSE 'ge2000' END AS size_band FROM c""",
)
def strata(spark, sf):
    return corpus(spark, sf).select(
        "id",
        t.model_family(F.col("model")).alias("family"),
        t.strata_key(F.col("model"), F.col("n_chars"), F.col("created_ts")).alias("strata_key"),
        t.country_key(F.col("country")).alias("country_key"),
        t.size_band(F.col("n_chars"), [120, 600, 2000]).alias("size_band"),
    )


@query(
    "text_meta_fold",
    """SELECT event_id, user_id % 2 = 0 AS hint, json_extract_string(props, '$.' || (json_keys(props))[1]) AS first_value, len(json_keys(props)) + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS n_keys FROM events""",
)
def meta_fold(spark, sf):
    events = table(spark, sf, "events")
    folded = F.from_json(t.meta_fold(F.col("props"), F.pmod("user_id", F.lit(2)) == 0), "map<string,string>")
    return events.select("event_id", (F.pmod("user_id", F.lit(2)) == 0).alias("hint"), F.get(F.map_values(F.from_json("props", "map<string,string>")), 0).alias("first_value"), F.size(folded).cast("long").alias("n_keys"))


@query(
    "text_dirty_warnings",
    "SELECT doc_id, len(list_filter(["
    + ", ".join(f"contains(t, '{m}')" for m in t.DIRTY_MARKERS)
    + ", 1000.0 * len(regexp_extract_all(t, '[a-zà-ÿ]-\\n[a-zà-ÿ]')) / nullif(length(t), 0) >= 6], lambda x: x)) AS n_warnings FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
)
def dirty_warnings(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(t.dirty_warnings(F.coalesce("text", F.lit("")))).cast("long").alias("n_warnings"))


@query(
    "text_md_cell_key",
    f"""SELECT doc_id, sha256(trim(regexp_replace(replace(replace(t, chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS cell_sha256,
    sha256(source || '#' || CASE WHEN k = '' THEN t ELSE k END) AS natural_key FROM (SELECT doc_id, source, coalesce(text, ' ') AS t, {KEY.format("coalesce(text, ' ')")} AS k FROM documents)""",
)
def md_cell_key(spark, sf):
    text = F.coalesce("text", F.lit(" "))
    key = t.comparison_key_latin(text)
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2(t.md_cell(text), 256).alias("cell_sha256"), F.sha2(F.concat("source", F.lit("#"), F.when(key == "", text).otherwise(key)), 256).alias("natural_key")
    )


@query("text_windows", "SELECT doc_id, w AS start, substr(text, w, 2000) AS piece FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1, 1800)) AS w FROM documents WHERE text IS NOT NULL AND text <> '')")
def windows(spark, sf):
    """O-S26: overlapping character windows of 2,000, each 1,800 after the last."""
    docs = table(spark, sf, "documents").filter("text IS NOT NULL AND text <> ''")
    cut = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.length("text"), F.lit(1800))).alias("start"))
    return cut.select("doc_id", F.col("start").cast("long").alias("start"), F.substring(F.col("text"), F.col("start"), F.lit(2000)).alias("piece"))


@query("text_longest_common_run")
def common_run(spark, sf):
    """O-T22 between consecutive turns of a conversation."""
    turns = table(spark, sf, "conversations").filter("text IS NOT NULL")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", t.longest_common_run("text", "reply").alias("common_run"))
