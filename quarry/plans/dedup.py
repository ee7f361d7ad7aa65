"""Queries of deduplication over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.operators import dedup as d
from quarry.operators.service import Filters, apply_filters, page
from quarry.plans.registry import query
from quarry.plans.text import KEY
from quarry.sources.corpus import CORPUS_SQL, corpus, table
from quarry.sources.scratch import kept

EXACT_SQL = (
    "WITH "
    + CORPUS_SQL
    + f""", k AS (SELECT *, {KEY.format("text")} AS key, CAST(substr(source, 4) AS INTEGER) AS source_rank FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY license_rank, source_rank, CAST(id AS VARCHAR), uid) AS place, count(*) OVER (PARTITION BY key) AS size,
  first_value(uid) OVER (PARTITION BY key ORDER BY license_rank, source_rank, CAST(id AS VARCHAR), uid) AS first FROM k),
e AS (SELECT id, uid, source, key, key = '' OR place = 1 AS kept, CASE WHEN key = '' THEN uid ELSE first END AS canonical_uid, CASE WHEN key <> '' AND place = 1 THEN size - 1 ELSE 0 END AS n_exact_dups, CASE WHEN key = '' THEN 1 ELSE size END AS size FROM o)
"""
)


def deduped(spark, sf):
    rows = corpus(spark, sf).withColumn("key", t.comparison_key_latin(F.col("text"))).withColumn("hash_norm", F.when(F.col("key") == "", "").otherwise(t.hash_norm(F.col("key")))).drop("text", "key")
    rank = F.substring("source", 4, 9).cast("int")
    return d.exact_dedup(rows, "hash_norm", d.canonical_order(F.col("license_rank"), rank, F.col("id").cast("string"), F.col("uid")))


@query("dedup_exact", EXACT_SQL + "SELECT id, uid, kept, canonical_uid, n_exact_dups FROM e")
def exact(spark, sf):
    return deduped(spark, sf).select("id", "uid", "kept", "canonical_uid", "n_exact_dups")


@query("filter_max_dups", EXACT_SQL + "SELECT id FROM e JOIN c USING (id) WHERE kept AND n_exact_dups <= 0 AND lang = 'en' AND nsfw IS DISTINCT FROM true")
def filter_max_dups(spark, sf):
    """O-F7: kept rows with few copies."""
    return apply_filters(deduped(spark, sf).filter("kept"), Filters(lang=["en"], max_dups=0)).select("id")


@query("page_dups", EXACT_SQL + "SELECT id FROM e WHERE kept ORDER BY n_exact_dups DESC, id LIMIT 25")
def page_dups(spark, sf):
    """O-Q3: the most duplicated first."""
    return page(deduped(spark, sf).filter("kept"), "dups", 1, 25).select("id")


@query("dedup_exact_map", EXACT_SQL + "SELECT uid, canonical_uid, source FROM e WHERE NOT kept")
def exact_map(spark, sf):
    return d.duplicate_map(deduped(spark, sf))


@query(
    "dedup_other_sources",
    EXACT_SQL + "SELECT e.canonical_uid AS uid, coalesce(array_to_string(list_sort(list_distinct(list(e.source) FILTER (WHERE e.source <> f.source))), ','), '') AS dup_sources FROM e JOIN e f ON f.uid = e.canonical_uid WHERE e.size > 1 GROUP BY e.canonical_uid",
)
def other_sources(spark, sf):
    return deduped(spark, sf).filter("kept AND n_exact_dups > 0").select("uid", F.array_join("dup_sources", ",").alias("dup_sources"))


@query("dedup_group_sizes", EXACT_SQL + "SELECT n_exact_dups + 1 AS group_size, count(*) AS n_groups FROM e WHERE kept GROUP BY 1")
def group_sizes(spark, sf):
    return deduped(spark, sf).filter("kept").groupBy((F.col("n_exact_dups") + 1).alias("group_size")).agg(F.count("*").alias("n_groups"))


@query("dedup_removed_by_source", EXACT_SQL + "SELECT source, count(*) FILTER (WHERE kept) AS n_kept, count(*) FILTER (WHERE NOT kept) AS n_removed FROM e GROUP BY source")
def removed_by_source(spark, sf):
    return deduped(spark, sf).groupBy("source").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_removed"))


@query("dedup_top_groups", EXACT_SQL + "SELECT uid, n_exact_dups FROM e WHERE kept ORDER BY n_exact_dups DESC, uid LIMIT 10")
def top_groups(spark, sf):
    return deduped(spark, sf).filter("kept").select("uid", "n_exact_dups").orderBy(F.desc("n_exact_dups"), "uid").limit(10)


@query(
    "dedup_cross_source",
    EXACT_SQL
    + ", x AS (SELECT e.source AS loser, f.source AS winner FROM e JOIN e f ON f.uid = e.canonical_uid WHERE NOT e.kept) SELECT source, coalesce(l, 0) AS n_lost, coalesce(w, 0) AS n_won FROM (SELECT loser AS source, count(*) AS l FROM x GROUP BY 1) FULL JOIN (SELECT winner AS source, count(*) AS w FROM x GROUP BY 1) USING (source)",
)
def cross_source(spark, sf):
    """O-C19."""
    rows = deduped(spark, sf)
    lost = rows.filter("NOT kept")
    won = lost.select(F.col("canonical_uid").alias("uid")).join(rows.select("uid", "source"), "uid")
    zero = F.lit(0).cast("long")
    return (
        lost.groupBy("source").agg(F.count("*").alias("l")).join(won.groupBy("source").agg(F.count("*").alias("w")), "source", "full").select("source", F.coalesce("l", zero).alias("n_lost"), F.coalesce("w", zero).alias("n_won"))
    )


@query("dedup_first_by_uid", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p = 1")
def first_by_uid(spark, sf):
    return d.first_by_uid(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query(
    "dedup_probe_corpus",
    "WITH b AS (SELECT item_id, " + KEY.format("text") + " AS key FROM benchmark), d AS (SELECT min(doc_id) AS doc_id, " + KEY.format("coalesce(text, '')") + " AS key FROM documents GROUP BY 2) SELECT item_id, doc_id AS duplicate_of FROM b LEFT JOIN d ON b.key = d.key AND b.key <> ''",
)
def probe_corpus(spark, sf):
    """O-D17: whether a new text is in the corpus already; an empty key never is."""
    docs = table(spark, sf, "documents").select("doc_id", t.hash_norm(t.comparison_key_latin(F.coalesce("text", F.lit("")))).alias("h")).groupBy("h").agg(F.min("doc_id").alias("duplicate_of"))
    items = table(spark, sf, "benchmark").select("item_id", t.comparison_key_latin(F.col("text")).alias("key")).select("item_id", F.when(F.col("key") != "", t.hash_norm(F.col("key"))).alias("h"))
    return items.join(docs, "h", "left").select("item_id", "duplicate_of")


_COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("dedup_cosine_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COSINE}, 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COSINE} >= 0.4")
def cosine_pairs(spark, sf):
    return d.cosine_pairs(table(spark, sf, "embeddings"), 0.4).select("a", "b", F.round("cosine", 5).alias("cosine"))


@query(
    "dedup_components",
    f"""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {_COSINE} >= 0.4),
r AS (SELECT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a) SELECT node, min(reached) AS root FROM r GROUP BY node""",
)
def components(spark, sf):
    return d.components(d.cosine_links(table(spark, sf, "embeddings"), 0.4))


# Thresholds that leave rows: the invented vectors are not of the documents' texts.
LIKE = {"least_jaccard": 0.02, "most_ratio": 4.0}
_LIKE = f"({_COSINE} >= 0.3 AND len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) >= 0.02 AND CASE WHEN a.n = 0 AND b.n = 0 THEN true ELSE least(a.n, b.n) > 0 AND greatest(a.n, b.n) / least(a.n, b.n) <= 4 END)"
NEAR_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id AS node, embedding, label, list_distinct(string_split(coalesce(text, ''), ' ')) AS tokens, length(coalesce(text, '')) AS n FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
p AS (SELECT a.node AS a, b.node AS b FROM v a JOIN v b ON a.label = b.label AND a.node <> b.node WHERE {_LIKE}),
r AS (SELECT a AS node, a AS reached FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.reached = p.a),
c AS (SELECT node, min(reached) AS root FROM r GROUP BY node),
k AS (SELECT root, arg_min(node, (node % 3) * 1000000000000 + node) AS canonical FROM c GROUP BY root),
m AS (SELECT a.node, b.node AS canonical, {_LIKE} AS clear FROM c JOIN k USING (root) JOIN v a ON a.node = c.node JOIN v b ON b.node = k.canonical) """
_NEAR_ROWS = "SELECT node, canonical, clear, removed, CASE WHEN node = canonical THEN count(*) FILTER (removed) OVER (PARTITION BY canonical) ELSE 0 END AS n_near_dups FROM (SELECT *, node <> canonical AND {} AS removed FROM m)"


def near(spark, sf, pairwise):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = table(spark, sf, "embeddings").join(docs, "vec_id", "left")
    held = kept(rows.select(F.col("vec_id").alias("node"), F.col("embedding").alias("v"), "label", F.array_distinct(F.split(text, " ")).alias("tokens"), F.length(text).alias("n_chars")))
    order = held.select("node", F.struct(F.pmod("node", F.lit(3)), F.col("node")).alias("order"))
    links = d.cosine_links(held, 0.3, id_col="node", vec_col="v", **LIKE)
    return d.near_dedup(links, order, held.drop("label"), 0.3, pairwise, **LIKE)


@query("dedup_near_pairwise", NEAR_SQL + _NEAR_ROWS.format("clear"))
def near_pairwise(spark, sf):
    """O-D11, O-D13, O-D14: a member goes if it is like the canonical row itself."""
    return near(spark, sf, True)


@query("dedup_near_transitive", NEAR_SQL + _NEAR_ROWS.format("true"))
def near_transitive(spark, sf):
    """O-D15: every member but the canonical row goes."""
    return near(spark, sf, False)


@query("near_map_invariant", NEAR_SQL + "SELECT count(*) AS n, count(*) FILTER (clear) AS n_clear, count(DISTINCT canonical) AS n_canonical FROM m WHERE node <> canonical")
def near_map_invariant(spark, sf):
    """O-C18: of all that chains of pairs would discard, those that are like their canonical row themselves."""
    return near(spark, sf, False).filter("removed").agg(F.count("*").alias("n"), F.count_if("clear").alias("n_clear"), F.countDistinct("canonical").alias("n_canonical"))


@query(
    "dedup_jaccard_lengths",
    "WITH x AS (SELECT conv_id, turn, text, list_distinct(string_split(lower(text), ' ')) AS s FROM conversations WHERE text IS NOT NULL) SELECT a.conv_id, a.turn, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard, round(CASE WHEN length(a.text) = 0 AND length(b.text) = 0 THEN 1.0 ELSE greatest(length(a.text), length(b.text)) / least(length(a.text), length(b.text)) END, 6) AS length_ratio FROM x a JOIN x b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
)
def jaccard_lengths(spark, sf):
    turns = table(spark, sf, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.length("text").alias("n"), F.array_distinct(F.split(F.lower("text"), " ")).alias("s"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n").alias("m"), F.col("s").alias("r"))
    met = turns.join(after, ["conv_id", "turn"])
    return met.select("conv_id", "turn", F.round(d.jaccard(F.col("s"), F.col("r")), 6).alias("jaccard"), F.round(d.length_ratio(F.col("n"), F.col("m")), 6).alias("length_ratio"))
