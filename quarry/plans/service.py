"""Queries of the curation service."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.vocabulary import TASK_TYPES
from quarry.operators import service as s
from quarry.plans.registry import query
from quarry.sources.corpus import CORPUS_SQL, corpus, table

C = "WITH " + CORPUS_SQL
FACETS = ["lang", "lang_variant", "source", "license", "task_type", "domain", "label_method", "quality", "nsfw", "needs_review", "edited", "pii_found", "n_chars_bucket"]


def _by(columns, where="true"):
    return " UNION ALL ".join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM c WHERE {where if isinstance(where, str) else where(c)} GROUP BY ALL" for c in columns)


@query("facets_joint", C + _by(FACETS))
def facets_joint(spark, sf):
    return s.facets_joint(corpus(spark, sf), FACETS)


F1 = s.Filters(lang=["en", "fr"], quality_min=2, nsfw="exclude", commercial_only=True, n_chars_min=50)
_TESTS = {"lang": "lang IN ('en', 'fr')", "quality": "quality >= 2", "nsfw": "nsfw IS DISTINCT FROM true", "n_chars_bucket": "n_chars >= 50", "": "commercial_ok"}


@query("facets_self_removed", C + _by(FACETS, lambda c: " AND ".join(v for k, v in _TESTS.items() if k != c)))
def facets_self_removed(spark, sf):
    return s.facets_unfiltered(corpus(spark, sf), F1, FACETS)


@query("filter_ids", C + "SELECT id FROM c WHERE " + " AND ".join(_TESTS.values()))
def filter_ids(spark, sf):
    return s.apply_filters(corpus(spark, sf), F1).select("id")


@query("filter_nsfw_only", C + "SELECT id FROM c WHERE nsfw")
def filter_nsfw_only(spark, sf):
    return s.apply_filters(corpus(spark, sf), s.Filters(nsfw="only")).select("id")


@query("filter_pii_review", C + "SELECT id FROM c WHERE pii_found AND needs_review AND NOT edited AND redistributable AND n_chars <= 5000")
def filter_pii_review(spark, sf):
    f = s.Filters(nsfw="include", pii="only", needs_review=True, edited=False, redistributable_only=True, n_chars_max=5000)
    return s.apply_filters(corpus(spark, sf), f).select("id")


@query("filter_members", C + "SELECT id FROM c WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1) AND task_type IN ('resumo', 'codigo')")
def filter_members(spark, sf):
    members = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return s.apply_filters(corpus(spark, sf), s.Filters(nsfw="include", task_type=["resumo", "codigo"], members=members)).select("id")


@query("facet_task_with_zeros", C + ", v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(TASK_TYPES)) + ") AS v(place, value)) SELECT coalesce(place, 1000001) AS place, value, coalesce(n, 0) AS n FROM v FULL JOIN (SELECT task_type AS value, count(*) AS n FROM c WHERE quality = 3 GROUP BY 1) USING (value)")
def facet_task_with_zeros(spark, sf):
    return s.facet_with_zeros(corpus(spark, sf).filter("quality = 3"), "task_type", TASK_TYPES)


@query("facet_size_bands", C + "SELECT CASE WHEN n_chars < 120 THEN 'curto' WHEN n_chars < 600 THEN 'medio' ELSE 'longo' END AS band, count(*) AS n FROM c GROUP BY 1")
def facet_size_bands(spark, sf):
    band = F.when(F.col("n_chars") < 120, "curto").when(F.col("n_chars") < 600, "medio").otherwise("longo")
    return corpus(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query(
    "counts_global",
    C + "SELECT count(*) AS n, count(*) FILTER (WHERE pii_found) AS n_pii, count(*) FILTER (WHERE edited) AS n_edited, count(*) FILTER (WHERE needs_review) AS n_review, count(*) FILTER (WHERE nsfw) AS nsfw_yes, count(*) FILTER (WHERE NOT nsfw) AS nsfw_no, count(*) FILTER (WHERE nsfw IS NULL) AS nsfw_null, count(task_type) AS n_labelled, count(task_type) > 0 AS any_labelled FROM c",
)
def counts_global(spark, sf):
    """O-G6, O-G8."""
    return corpus(spark, sf).agg(
        F.count("*").alias("n"), F.count_if("pii_found").alias("n_pii"), F.count_if("edited").alias("n_edited"), F.count_if("needs_review").alias("n_review"), F.count_if("nsfw").alias("nsfw_yes"),
        F.count_if(~F.col("nsfw")).alias("nsfw_no"), F.count_if(F.col("nsfw").isNull()).alias("nsfw_null"), F.count("task_type").alias("n_labelled"), F.bool_or(F.col("task_type").isNotNull()).alias("any_labelled"),
    )


for _name, _order in {"newest": "created_ts DESC NULLS LAST, id DESC", "oldest": "created_ts ASC NULLS FIRST, id", "shortest": "n_chars, id", "longest": "n_chars DESC, id", "random": "(id * 2654435761 + 283521) % 4294967291 * 279470273 % 1000003, id"}.items():

    @query(f"page_{_name}", C + f"SELECT id FROM c ORDER BY {_order} LIMIT 25 OFFSET 50")
    def _page(spark, sf, sort=_name):
        return s.page(corpus(spark, sf), sort, 3, 25, seed=7).select("id")


@query("page_with_total", C + "SELECT id, uid, n_chars, count(*) OVER () AS total FROM c WHERE lang = 'en' ORDER BY n_chars, id LIMIT 20")
def page_with_total(spark, sf):
    """O-Q10; the total is one aggregated row, not a window over one partition."""
    rows = corpus(spark, sf).filter("lang = 'en'").select("id", "uid", "n_chars")
    return rows.orderBy("n_chars", "id").limit(20).crossJoin(rows.agg(F.count("*").alias("total")))


@query("hydrate_list", C + "SELECT place, id, uid, license FROM c JOIN (VALUES (0, 30), (1, 5), (2, 17), (3, 120)) AS w(place, wid) ON id = wid")
def hydrate_list(spark, sf):
    return s.hydrate(corpus(spark, sf), [30, 5, 17, 120]).select("place", "id", "uid", "license")


_TERMS = "list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_PADDED = f"' ' || array_to_string({_TERMS}, ' ') || ' '"


@query("search_terms", f"SELECT id FROM (SELECT doc_id AS id, {_PADDED} AS p FROM documents) WHERE contains(p, ' the ') AND contains(p, ' and ') AND contains(p, ' thth')")
def search_terms(spark, sf):
    return s.search(table(spark, sf, "documents"), "the AND! thth*", "doc_id")


@query("search_phrase", f"SELECT id FROM (SELECT doc_id AS id, {_PADDED} AS p FROM documents) WHERE contains(p, ' of the ') AND contains(p, ' that ')")
def search_phrase(spark, sf):
    return s.search(table(spark, sf, "documents"), '"of the" That', "doc_id")


@query("search_index", f"SELECT term, count(*) AS df, sum(tf) AS cf FROM (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def search_index(spark, sf):
    return s.inverted_index(table(spark, sf, "documents"), "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(
    "search_bm25",
    f"""WITH t AS (SELECT doc_id AS id, {_TERMS} AS w FROM documents), n AS (SELECT id, len(w) AS len, len(list_filter(w, lambda x: x = 'with')) AS a, len(list_filter(w, lambda x: x = 'worthless')) AS b FROM t),
    g AS (SELECT count(*) AS docs, avg(len) AS avg_len, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM n)
    SELECT id, round(-(greatest(ln((docs - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / avg_len)) + greatest(ln((docs - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM n, g WHERE a > 0 AND b > 0""",
)
def search_bm25(spark, sf):
    return s.bm25(table(spark, sf, "documents"), "with worthless", "doc_id").select("id", F.round("score", 6).alias("score"))


@query("search_snippets")
def search_snippets(spark, sf):
    docs = table(spark, sf, "documents")
    hits = s.bm25(docs, "with worthless", "doc_id").orderBy("score", "id").limit(20)
    return docs.join(F.broadcast(hits), docs.doc_id == hits.id).select("id", s.snippet(F.col("text"), ["with", "worthless"]).alias("snippet"))


_Q = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_SIM = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), [" + ", ".join(f"CAST({x} AS DOUBLE)" for x in _Q) + "])"


@query("semantic_top_k", f"SELECT vec_id AS id, round({_SIM}, 6) AS similarity FROM embeddings ORDER BY {_SIM} DESC, vec_id LIMIT 20")
def semantic_top_k(spark, sf):
    return s.top_similar(table(spark, sf, "embeddings"), _Q, 20).select("id", F.round("similarity", 6).alias("similarity"))


@query("semantic_filtered", C + f"SELECT vec_id AS id, round({_SIM}, 6) AS similarity FROM embeddings WHERE vec_id IN (SELECT id FROM c WHERE lang = 'en' AND nsfw IS DISTINCT FROM true) ORDER BY {_SIM} DESC, vec_id LIMIT 10")
def semantic_filtered(spark, sf):
    """O-V3: the filter is exact: it decides which rows are scored, not which of the best are shown."""
    allowed = s.apply_filters(corpus(spark, sf), s.Filters(lang=["en"])).select(F.col("id").alias("vec_id"))
    return s.top_similar(table(spark, sf, "embeddings").join(allowed, "vec_id", "left_semi"), _Q, 10).select("id", F.round("similarity", 6).alias("similarity"))


@query("semantic_coverage", "WITH a AS (SELECT DISTINCT doc_id AS k FROM documents), b AS (SELECT DISTINCT vec_id AS k FROM embeddings), n AS (SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a JOIN b USING (k)) AS n_both) SELECT *, n_both / n_left AS left_covered, n_both / n_right AS right_covered FROM n")
def semantic_coverage(spark, sf):
    return s.coverage(table(spark, sf, "documents").select(F.col("doc_id").alias("k")), table(spark, sf, "embeddings").select(F.col("vec_id").alias("k")), "k")


def _collection(spark, sf):
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return ids.filter("id % 3 = 0"), ids.filter("id % 2 = 0").union(spark.range(-5, 0))


@query("collection_add", "SELECT DISTINCT doc_id AS id FROM labels WHERE doc_id % 3 = 0 OR (doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM documents))")
def collection_add(spark, sf):
    held, ids = _collection(spark, sf)
    return s.add_members(held, ids, corpus(spark, sf).select("id"))[0]


@query("collection_add_counts", "SELECT count(*) FILTER (WHERE id % 3 <> 0 AND id IN (SELECT doc_id FROM documents)) AS added, count(*) FILTER (WHERE id % 3 = 0 AND id >= 0) AS already, count(*) FILTER (WHERE id NOT IN (SELECT doc_id FROM documents)) AS not_found FROM (SELECT DISTINCT doc_id AS id FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT unnest(range(-5, 0)))")
def collection_add_counts(spark, sf):
    held, ids = _collection(spark, sf)
    return s.add_members(held, ids, corpus(spark, sf).select("id"))[1]


@query("collection_remove", "SELECT DISTINCT doc_id AS id FROM labels WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0")
def collection_remove(spark, sf):
    held, ids = _collection(spark, sf)
    return s.remove_members(held, ids).distinct()


@query("edit_overlay", C + ", e AS (SELECT user_id % 200 AS id, arg_max(CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'edit-' || event_id END, event_id) AS v, max(event_id) AS m FROM events GROUP BY 1) SELECT id, coalesce(CASE WHEN m % 5 <> 0 THEN 'edit-' || m END, task_type) AS task_type, task_type AS task_type_original, coalesce(m % 5 <> 0, false) AS is_edited FROM c LEFT JOIN e USING (id)")
def edit_overlay(spark, sf):
    edits = table(spark, sf, "events").select(F.pmod("user_id", F.lit(200)).alias("id"), F.when(F.pmod("event_id", F.lit(5)) != 0, F.concat(F.lit("edit-"), "event_id")).alias("value"), F.col("event_id").alias("at"))
    return s.overlay(corpus(spark, sf).select("id", "task_type"), edits, "task_type")


@query("export_license_class", C + "SELECT id, CASE WHEN NOT redistributable THEN 'bloqueada' WHEN NOT commercial_ok THEN 'nao-comercial' WHEN contains(license, '-sa-') THEN 'viral' ELSE 'livre' END AS license_class FROM c")
def export_license_class(spark, sf):
    return corpus(spark, sf).select("id", s.license_class(F.col("commercial_ok"), F.col("redistributable"), F.col("license")).alias("license_class"))


@query("export_rows", C + "SELECT id, uid, lang, source, license, quality, n_chars FROM c WHERE redistributable")
def export_rows(spark, sf):
    return s.export_rows(corpus(spark, sf)).select("id", "uid", "lang", "source", "license", "quality", "n_chars")


@query(
    "export_manifest",
    C
    + """, k AS (SELECT * FROM c WHERE redistributable) SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT commercial_ok) AS n_non_commercial, count(*) FILTER (WHERE nsfw) AS n_nsfw, count(*) FILTER (WHERE pii_found) AS n_pii,
    count(*) FILTER (WHERE edited) AS n_edited, max(n_chars) AS max_chars, (SELECT count(*) FROM c WHERE NOT redistributable) AS n_blocked,
    (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT lang || '=' || count(*) AS x FROM k GROUP BY lang)) AS by_lang, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT license || '=' || count(*) AS x FROM k GROUP BY license)) AS by_license FROM k""",
)
def export_manifest(spark, sf):
    return s.manifest(corpus(spark, sf))
