"""Queries of single items, overviews, searches under filters, exports, reports and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.operators import labels as lb
from quarry.operators import review as r
from quarry.operators import sampling as a
from quarry.operators import service as s
from quarry.plans.dedup import EXACT_SQL, deduped
from quarry.plans.labels import EVENTS_SQL, events
from quarry.plans.ledger import LEDGER_SQL, ledger
from quarry.plans.registry import query
from quarry.plans.service import _PADDED, _Q, _SIM, _TERMS, FACETS
from quarry.sources import raw
from quarry.sources.corpus import CORPUS_SQL, corpus, table

C = "WITH " + CORPUS_SQL
_HIT = f"contains({_PADDED}, ' that ') AND contains({_PADDED}, ' of ')"
_UNDER = {"lang": "lang = 'en'", "pii_found": "NOT pii_found", "nsfw": "nsfw IS DISTINCT FROM true", "": _HIT}


@query("search_facets", C + " UNION ALL ".join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM c WHERE " + " AND ".join(v for k, v in _UNDER.items() if k != c) + " GROUP BY ALL" for c in FACETS))
def search_facets(spark, sf):
    """O-F10, O-X6, O-G1: facets of a search; the hits are found once."""
    rows = corpus(spark, sf)
    f = s.Filters(lang=["en"], pii="none", q="that OF")
    return s.facets_unfiltered(rows, s.with_hits(rows, f), FACETS)


@query("search_filtered", C + f"SELECT id FROM c WHERE lang IN ('en', 'de') AND nsfw IS DISTINCT FROM true AND {_HIT}")
def search_filtered(spark, sf):
    """O-F10: a query among the other filters, in the same scan."""
    return s.apply_filters(corpus(spark, sf), s.Filters(lang=["en", "de"], q="that OF")).select("id")


@query(
    "page_relevance",
    f"""WITH t AS (SELECT doc_id AS id, lang, {_TERMS} AS w FROM documents), n AS (SELECT id, lang, len(w) AS len, len(list_filter(w, lambda x: x = 'that')) AS a FROM t),
    g AS (SELECT count(*) AS docs, avg(len) AS avg_len, count(*) FILTER (WHERE a > 0) AS da FROM n)
    SELECT id, round(-(greatest(ln((docs - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / avg_len))), 12) AS score FROM n, g WHERE a > 0 AND lang = 'en' ORDER BY score, id LIMIT 20""",
)
def page_relevance(spark, sf):
    """O-Q3, O-J6: the best of a search under a filter, hits joined to rows by id."""
    rows = corpus(spark, sf).filter("lang = 'en'").select("id")
    hits = s.bm25(table(spark, sf, "documents"), "that", "doc_id").withColumn("score", F.round("score", 12))
    return s.page(rows.join(hits, "id"), "relevance", 1, 20).select("id", "score")


@query("item_detail", C + "SELECT id, uid, text, text AS text_original, edited, n_chars, n_words, lang, lang_variant, source, license, commercial_ok, redistributable, task_type, domain, quality, nsfw, pii_found, label_method, needs_review, country, created_ts, contains(lower(text), 'user:') OR contains(lower(text), 'assistant:') AS has_chat_markers FROM c WHERE uid = (SELECT min(uid) FROM c)")
def item_detail(spark, sf):
    """O-Q2: one item whole, its original beside it. The markers count anywhere in the text."""
    rows = corpus(spark, sf).withColumn("text_original", F.lit(None).cast("string"))
    first = rows.agg(F.min("uid").alias("uid"))
    low = F.lower("text")
    return rows.join(F.broadcast(first), "uid").select(  # first is one row
        "id", "uid", "text", F.coalesce("text_original", "text").alias("text_original"), "edited", "n_chars", "n_words", "lang", "lang_variant", "source", "license", "commercial_ok", "redistributable", "task_type",
        "domain", "quality", "nsfw", "pii_found", "label_method", "needs_review", "country", "created_ts", (F.contains(low, F.lit("user:")) | F.contains(low, F.lit("assistant:"))).alias("has_chat_markers"),
    )


@query("item_collections", "WITH i AS (SELECT doc_id AS id, 'quality ' || quality AS name FROM labels UNION SELECT doc_id, 'unsafe' FROM labels WHERE toxic = 1) SELECT id, string_agg(name, '|' ORDER BY name) AS names FROM i GROUP BY id")
def item_collections(spark, sf):
    """O-Q12."""
    rows = table(spark, sf, "labels")
    items = rows.select(F.col("doc_id").alias("id"), F.col("quality").alias("collection")).filter("collection IS NOT NULL").unionByName(rows.filter("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(-1).alias("collection")))
    names = items.select("collection").distinct().withColumn("name", F.when(F.col("collection") == -1, "unsafe").otherwise(F.concat(F.lit("quality "), "collection")))
    return s.memberships(items, names).select("id", F.array_join("names", "|").alias("names"))


_OVERVIEW = ["lang", "lang_variant", "source", "license", "task_type", "domain", "quality", "label_method"]


@query("overview", C + " UNION ALL ".join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM c GROUP BY ALL" for c in _OVERVIEW) + " UNION ALL SELECT 'chat_markers', 'true', count(*) FILTER (WHERE contains(lower(substr(text, 1, 20000)), 'user:') OR contains(lower(substr(text, 1, 20000)), 'assistant:')) FROM c UNION ALL SELECT 'all', NULL, count(*) FROM c")
def overview(spark, sf):
    """O-G7: eight counts in one scan; markers and the total in another, the only one that reads texts."""
    rows = corpus(spark, sf)
    sums = rows.agg(F.count_if(t.has_chat_markers(F.col("text"))).alias("m"), F.count("*").alias("n"))
    stacked = sums.select(F.inline(F.array(F.struct(F.lit("chat_markers").alias("facet"), F.lit("true").alias("value"), F.col("m").alias("n")), F.struct(F.lit("all").alias("facet"), F.lit(None).cast("string").alias("value"), F.col("n").alias("n")))))
    return s.facets_joint(rows, _OVERVIEW).unionByName(stacked)


@query("top_dups_preview", EXACT_SQL + "SELECT e.uid, n_exact_dups, c.source, c.lang, substr(c.text, 1, 160) AS preview FROM e JOIN c USING (id) WHERE kept AND n_exact_dups > 0 ORDER BY n_exact_dups DESC, id LIMIT 10")
def top_dups_preview(spark, sf):
    """O-Q11: ten rows are chosen first, then their texts are read."""
    top = deduped(spark, sf).filter("kept AND n_exact_dups > 0").select("id", "uid", "n_exact_dups").orderBy(F.desc("n_exact_dups"), "id").limit(10)
    return corpus(spark, sf).drop("uid").join(F.broadcast(top), "id").select("uid", "n_exact_dups", "source", "lang", F.substring("text", 1, 160).alias("preview"))


_FLAT_SQL = {
    "source_id": "CAST(id AS VARCHAR)", "attribution": "'Data from ' || c.source", "label_confidence": "CASE WHEN label_method = 'native' THEN 0.5 WHEN label_method = 'manual' THEN 1.0 END", "n_exact_dups": "e.n_exact_dups",
    "n_near_dups": "0", "model_family": "f.family", "native_category": "NULL", "taxonomy_version": "'v1'", "uid": "c.uid", "source": "c.source",
}


@query(
    "export_flat",
    EXACT_SQL
    + ", f AS (SELECT * FROM (VALUES ('gpt-4.1-mini-2025-04-14', 'gpt-4.1-mini'), ('gpt-4.1-2025', 'gpt-4.1'), ('gpt-4o-2024-05-13', 'gpt-4o'), ('gpt-3.5-turbo-0301', 'gpt-3.5-turbo'), ('o1-preview', 'o1-preview'), ('other-model', 'other-model')) AS f(model, family)) SELECT "
    + ", ".join(f"{_FLAT_SQL.get(c, c)} AS {c}" for c in s.FLAT)
    + ", c.text AS text_original FROM c JOIN e USING (id) JOIN f ON f.model = c.model WHERE e.kept AND redistributable",
)
def export_flat(spark, sf):
    """O-E6, O-E7: the flat record of every row that may be redistributed, exact copies left out; no near pass runs here, so n_near_dups is 0."""
    copies = deduped(spark, sf).filter("kept").select("id", "n_exact_dups")
    method = F.col("label_method")
    rows = s.export_rows(corpus(spark, sf)).join(copies, "id").withColumns({
        "source_id": F.col("id").cast("string"), "label_confidence": F.when(method == "native", 0.5).when(method == "manual", 1.0), "n_near_dups": F.lit(0), "model_family": t.model_family(F.col("model")),
        "native_category": F.lit(None).cast("string"), "text_original": F.lit(None).cast("string"),
    })
    attribution = rows.select("source").distinct().withColumn("attribution", F.concat(F.lit("Data from "), "source"))
    return s.flat_records(rows, attribution, "v1", include_original=True)


@query("semantic_envelope", C + f", k AS (SELECT id FROM c WHERE lang = 'en' AND nsfw IS DISTINCT FROM true), v AS (SELECT {_SIM} AS similarity FROM embeddings WHERE vec_id IN (SELECT id FROM k)) SELECT (SELECT count(*) FROM v) AS n_candidates, (SELECT count(*) FROM k WHERE id NOT IN (SELECT vec_id FROM embeddings)) AS n_without_vector, least(10, (SELECT count(*) FROM v)) AS n_returned, round((SELECT max(similarity) FROM v), 6) AS best, 10 AS k")
def semantic_envelope(spark, sf):
    allowed = s.apply_filters(corpus(spark, sf), s.Filters(lang=["en"])).select("id")
    return s.similarity_envelope(allowed, table(spark, sf, "embeddings"), _Q, 10).withColumn("best", F.round("best", 6))


@query("semantic_top_k_blocks", f"SELECT vec_id AS id, round({_SIM}, 6) AS similarity FROM embeddings ORDER BY {_SIM} DESC, vec_id LIMIT 20")
def semantic_top_k_blocks(spark, sf):
    return s.top_similar_blocks(table(spark, sf, "embeddings"), _Q, 20).select("id", F.round("similarity", 6).alias("similarity"))


@query("sample_size_bands")
def sample_size_bands(spark, sf):
    """O-A6, O-A7: a quota for each source, at least a tenth of it from each size band that has rows enough."""
    rows = corpus(spark, sf).select("id", "source", "n_chars_bucket", F.concat_ws("/", "source", "n_chars_bucket").alias("stratum"))
    counts: dict[str, dict[str, int]] = {}
    for x in rows.groupBy("source", "n_chars_bucket").agg(F.count("*").alias("n")).orderBy("source", "n_chars_bucket").collect():  # three rows a source
        counts.setdefault(x["source"], {})[x["n_chars_bucket"]] = x["n"]
    parts = {f"{source}/{band}": n for source, bands in counts.items() for band, n in a.allocate_bands(min(20, sum(bands.values())), bands, 0.1).items()}
    return a.stratified_sample(rows, "stratum", "id", parts).select("id", "stratum")


_KIND_PAIRS = "pr AS (SELECT x.task, x.score AS a, y.score AS b, x.kind AS ka, y.kind AS kb FROM v x JOIN v y ON x.task = y.task AND x.person < y.person)"


def _pi_sql(field: str, pairs: str, weight: str) -> str:
    """One row of the report in SQL, for pairs (a, b) and a weight of {0} and {1}."""
    n = f"(SELECT count(*) FROM ({pairs}))"
    return f"""SELECT '{field}' AS field, {n} AS n_pairs, round(o, 4) AS observed, round(e, 4) AS expected, CASE WHEN {n} >= 10 AND e < 1 THEN round((o - e) / (1 - e), 4) END AS kappa,
      CASE WHEN {n} < 10 THEN 'poucos_pares' WHEN e >= 1 THEN 'sem_variancia' END AS reason
      FROM (SELECT avg({weight.format("a", "b")}) AS o FROM ({pairs})), (SELECT sum(s.n * t.n * {weight.format("s.x", "t.x")}) / CAST(sum(s.n * t.n) AS DOUBLE) AS e FROM (SELECT x, count(*) AS n FROM (SELECT unnest([a, b]) AS x FROM ({pairs})) GROUP BY x) s, (SELECT x, count(*) AS n FROM (SELECT unnest([a, b]) AS x FROM ({pairs})) GROUP BY x) t)"""


_SCORED, _ABSENT, _KIND = "SELECT a, b FROM pr WHERE a < 5 AND b < 5", "SELECT (a = 5)::INT AS a, (b = 5)::INT AS b FROM pr", "SELECT ka AS a, kb AS b FROM pr"
_SAME = "CAST({0} = {1} AS INT)"


@query(
    "agreement_report",
    LEDGER_SQL
    + ", v AS (SELECT task, person, score, kind FROM l QUALIFY row_number() OVER (PARTITION BY task, person ORDER BY id DESC) = 1), "
    + _KIND_PAIRS
    + " "
    + " UNION ALL ".join([_pi_sql("scores[1..4]", _SCORED, "(1 - abs({0} - {1}) ^ 2 / 9.0)"), _pi_sql("not_applicable", _ABSENT, _SAME), _pi_sql("kind", _KIND, _SAME)]),
)
def agreement_report(spark, sf):
    """O-W8, O-J9: one row a scale: numbers without "not applicable", its own mark, and a category."""
    last = ledger(spark, sf).groupBy("task", "person").agg(F.max_by(F.struct("score", "kind"), "id").alias("v")).select("task", "person", "v.*")
    other = last.select("task", F.col("person").alias("p2"), F.col("score").alias("b"), F.col("kind").alias("kb"))
    pairs = last.withColumnsRenamed({"score": "a", "kind": "ka"}).join(other, "task").filter("person < p2")
    return lb.agreement_report({
        "scores[1..4]": (pairs.filter("a < 5 AND b < 5").select("a", "b"), 4, "quadratic"),
        "not_applicable": (pairs.select((F.col("a") == 5).cast("int").alias("a"), (F.col("b") == 5).cast("int").alias("b")), 2, "nominal"),
        "kind": (pairs.select(F.col("ka").alias("a"), F.col("kb").alias("b")), 5, "nominal"),
    })


_ROUNDS_SQL = "WITH r AS (SELECT conv_id, turn, text, ['A', 'B', 'tie'][(conv_id + turn) % 3 + 1] AS winner FROM conversations WHERE role = 'assistant')"


@query(
    "preference_pairs",
    _ROUNDS_SQL
    + """, p AS (SELECT conv_id, turn AS round, CASE WHEN winner = 'A' THEN text ELSE 'other ' || conv_id END AS chosen, CASE WHEN winner = 'A' THEN 'other ' || conv_id ELSE text END AS rejected, winner AS chosen_label FROM r WHERE winner <> 'tie' AND text IS NOT NULL)
    SELECT conv_id, round, chosen, rejected, chosen_label, coalesce((SELECT string_agg(role || ': ' || coalesce(c.text, ''), chr(10) ORDER BY c.turn, role) FROM conversations c WHERE c.conv_id = p.conv_id AND c.turn < p.round), '') AS context FROM p""",
)
def preference_pairs(spark, sf):
    """O-W14: chosen and rejected answers of each round that has a winner, with the turns before it."""
    turns = table(spark, sf, "conversations")
    winner = F.get(F.array(F.lit("A"), F.lit("B"), F.lit("tie")), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)).cast("int"))
    rounds = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("round"), F.col("text").alias("answer_a"), F.concat(F.lit("other "), "conv_id").alias("answer_b"), winner.alias("winner"))
    return r.preference_pairs(rounds, turns)


@query("raw_scan", "SELECT 'documents' AS source, count(*) AS n FROM documents")
def raw_scan(spark, sf):
    """O-S2: rows by file stem."""
    return raw.scan_raw(spark, sf, "documents*.parquet").groupBy("source_file").agg(F.count("*").alias("n")).withColumnRenamed("source_file", "source")


@query("raw_stamps", """SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS created_ts, '{"kind":"' || event_type || '","user":"' || user_id || '"}' AS meta_json FROM events""")
def raw_stamps(spark, sf):
    """O-S7."""
    meta = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", raw.iso_text(F.col("ts")).alias("created_ts"), raw.compact_meta(meta).alias("meta_json"))


@query(
    "creation_review",
    LEDGER_SQL
    + """, s AS (SELECT id, task, person, ['submetida', 'aprovada', 'rejeitada'][id % 3 + 1] AS status FROM l), v AS (SELECT id, id % 2 = 0 AS approve FROM l WHERE id % 5 < 3)
    SELECT s.id, CASE WHEN v.id IS NULL OR status <> 'submetida' THEN status WHEN approve THEN 'aprovada' ELSE 'rejeitada' END AS status, CASE WHEN status = 'submetida' AND approve THEN substr(sha256('plataforma:' || s.id), 1, 16) END AS promised_uid,
      v.id IS NOT NULL AND status <> 'submetida' AS refused FROM s LEFT JOIN v USING (id)""",
)
def creation_review(spark, sf):
    """O-W37: verdicts on submitted creations; others keep their state and the verdict is refused."""
    rows = ledger(spark, sf)
    states = F.get(F.array(*[F.lit(x) for x in r.CREATION_STATES]), F.pmod("id", F.lit(3)).cast("int"))
    return r.review_creations(rows.select("id", states.alias("status")), rows.filter("id % 5 < 3").select("id", (F.pmod("id", F.lit(2)) == 0).alias("approve")))


@query("gold_backfill", EVENTS_SQL + ", b AS (SELECT DISTINCT seq // 50 AS batch, (seq // 50) % 4 <> 0 AS done FROM e), g AS (SELECT seq // 50 AS batch, seq AS uid, score AS a FROM e WHERE seq % 50 < 3), r AS (SELECT seq AS uid, 1 + (seq * 3) % 5 AS a FROM e WHERE seq % 7 <> 0), m AS (SELECT batch, sum(CASE WHEN g.a = r.a THEN 1 ELSE 0 END) / count(*) AS agreement FROM g LEFT JOIN r USING (uid) GROUP BY batch) SELECT batch, done, CASE WHEN done THEN agreement END AS agreement FROM b LEFT JOIN m USING (batch)")
def gold_backfill(spark, sf):
    """O-W45: once the gold is known every finished batch gets its agreement, the others none."""
    rows = events(spark, sf).withColumn("batch", F.floor(F.col("seq") / 50))
    batches = rows.select("batch", (F.pmod("batch", F.lit(4)) != 0).alias("done")).distinct()
    gold = rows.filter("seq % 50 < 3").select("batch", F.col("seq").alias("uid"), F.col("score").alias("a"))
    answers = rows.filter("seq % 7 <> 0").select("batch", F.col("seq").alias("uid"), (1 + F.pmod(F.col("seq") * 3, F.lit(5))).alias("a"))
    done = lb.batch_agreement(gold.join(batches.filter("done"), "batch", "left_semi"), answers, ["a"]).select("batch", "agreement")
    return batches.join(done, "batch", "left")
