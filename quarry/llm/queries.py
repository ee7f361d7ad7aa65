"""The query and, where SQL can express it, the DuckDB SQL of each corpus operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quarry.llm import bpe, licenses, quality, secrets, url_filter, warc
from quarry.llm.decontaminate import decontaminate
from quarry.llm.exact_dedup import exact_dedup
from quarry.llm.line_dedup import line_dedup
from quarry.llm.simhash import near_duplicates


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark, sf_dir: str):
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_warc(spark, sf_dir: str):
    out = warc.convert(table(spark, sf_dir, "pages"))
    return out.select(
        F.expr("try_cast(source_id AS long)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to AS long)").alias("refers_to")
    )


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def op3_simhash(spark, sf_dir: str):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir: str):
    out = line_dedup(table(spark, sf_dir, "documents"), by_id=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE key IN (SELECT key FROM frequent)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM frequent)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""


def op5_decontaminate(spark, sf_dir: str):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


OP5_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM windows)
  WHERE i + n - 1 <= len(w)
), hits AS (
  SELECT doc_id, i, n, item FROM grams JOIN windows USING (n, phrase)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op6_licenses(spark, sf_dir: str):
    return licenses.license_scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def _op6_sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def prepared(s: str) -> str:
        s = f"translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        for found, one in licenses.SPELLINGS:
            s = f"replace({s}, {quoted(found)}, {quoted(one)})"
        return s

    def form(s: str) -> str:
        cut = f"regexp_replace({s}, {quoted(licenses.COPYRIGHT_LINE)}, chr(10), 'g')"
        return f"trim(regexp_replace({cut}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"

    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in licenses.KNOWN)
    return f"""
WITH known AS (
  SELECT digest, min(license) AS license FROM (SELECT license, sha256({form(prepared("body"))}) AS digest FROM (VALUES {values}) AS k(license, body)) GROUP BY digest
), lines AS (
  SELECT doc_id, {form("line")} AS line FROM (SELECT doc_id, unnest(string_split({prepared("coalesce(text, '')")}, chr(10))) AS line FROM documents)
), hits AS (
  SELECT doc_id, license FROM lines JOIN known ON sha256(line) = digest WHERE line <> ''
), whole AS (
  SELECT doc_id, w.digest AS text_digest, license AS text_license
  FROM (SELECT doc_id, sha256({form(prepared("coalesce(text, '')"))}) AS digest FROM documents) w LEFT JOIN known ON w.digest = known.digest
), names AS (
  SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses
  FROM (SELECT doc_id, license FROM hits UNION SELECT doc_id, text_license FROM whole WHERE text_license IS NOT NULL) GROUP BY doc_id
), counts AS (
  SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id
)
SELECT doc_id, text_digest, text_license, coalesce(n, 0) AS n_notices, coalesce(licenses, '') AS licenses
FROM whole LEFT JOIN names USING (doc_id) LEFT JOIN counts USING (doc_id)
"""


def op7_bpe(spark, sf_dir: str):
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary, digests=True)


def op8_exact_dedup(spark, sf_dir: str):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM n WINDOW same AS (PARTITION BY text_sha256)
"""

_DAY = 86_400
_LISTED_FROM = 1_704_067_200  # 2024-01-01 in epoch seconds
# The dated list: kind, pattern, action, day of 2024 (from 0), category.
LIST_ENTRIES = [
    ("domain", "cheap-pills.example.com", "add", 30, "spam"),
    ("domain", "cheap-pills.example.com", "remove", 120, "spam"),
    ("domain", "cheap-pills.example.com", "add", 200, "spam"),
    ("domain", "spam-farm.example.org", "add", 10, "spam"),
    ("domain", "tionsh.example.net", "add", 90, "mirror"),
    ("domain", "tionsh.example.net", "remove", 150, "mirror"),
    ("prefix", "blog.tionsh.example.net/de", "add", 60, "adult"),
    ("prefix", "blog.tionsh.example.net/de", "remove", 300, "adult"),
    ("prefix", "thther.example.org/en", "add", 0, "mirror"),
    ("domain", "m.ththth.example.net", "add", 180, "malware"),
]


def op9_url_filter(spark, sf_dir: str):
    """``pages`` has no fetch time: page n counts as fetched in hour n of 2024, modulo its 8784 hours."""
    entries = spark.createDataFrame([(k, p, a, _LISTED_FROM + d * _DAY, c) for k, p, a, d, c in LIST_ENTRIES], "kind string, pattern string, action string, at long, category string")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", (F.lit(_LISTED_FROM) + F.pmod("page_id", F.lit(8784)) * 3600).alias("fetched_at"))
    return url_filter.filter_urls(captures, entries).select("page_id", "host", "fetched_at", "blocked", "n_entries", "categories")


OP9_SQL = f"""
WITH events AS (
  SELECT * FROM (VALUES {", ".join(str((k, p, a, _LISTED_FROM + d * _DAY, c)) for k, p, a, d, c in LIST_ENTRIES)}) AS e(kind, pattern, action, listed, category)
), captures AS (
  SELECT page_id, {_LISTED_FROM} + (page_id % 8784) * 3600 AS fetched_at,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '[.]$', '') AS host,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1)) AS path
  FROM pages
), matched AS (
  SELECT page_id, c.fetched_at, kind, pattern, arg_max(action, e.listed) AS action, arg_max(category, e.listed) AS category
  FROM captures c JOIN events e ON e.listed <= c.fetched_at AND (
    (kind = 'domain' AND (host = pattern OR ends_with(host, '.' || pattern)))
    OR (kind = 'prefix' AND (host || '/' || path = pattern OR starts_with(host || '/' || path, pattern || '/'))))
  GROUP BY ALL
), blocked AS (
  SELECT page_id, fetched_at, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM matched WHERE action = 'add' GROUP BY ALL
)
SELECT page_id, host, fetched_at, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_entries, coalesce(categories, '') AS categories
FROM captures LEFT JOIN blocked USING (page_id, fetched_at)
"""


def op10_secrets(spark, sf_dir: str):
    out = secrets.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_licenses": op6_licenses,
    "op7_bpe": op7_bpe,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_secrets": op10_secrets,
}
ORACLES = {
    "op2_warc": OP2_SQL,
    "op6_licenses": _op6_sql(),
    "op9_url_filter": OP9_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_decontaminate": OP5_SQL,
    "op8_exact_dedup": OP8_SQL,
}
