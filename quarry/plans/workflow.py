"""Queries of planning, validation and delivery in the annotation workflow."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as t
from quarry.operators.fragments import shared_counts
from quarry.operators.sampling import ranked
from quarry.plans.ledger import LEDGER_SQL, ledger
from quarry.plans.registry import query
from quarry.sources.corpus import CORPUS_SQL, corpus, table

C = "WITH " + CORPUS_SQL
CL = "WITH " + CORPUS_SQL + ", " + LEDGER_SQL.removeprefix("WITH ")


@query("platform_creations", LEDGER_SQL + "SELECT id, substr(sha256('plataforma:' || id), 1, 16) AS uid, task FROM l WHERE status IN ('avaliada', 'escalada') AND rating = 'excepcional'")
def platform_creations(spark, sf):
    """O-S17: approved creations; a uid that differs from the promised one would end the export."""
    rows = ledger(spark, sf).filter("status IN ('avaliada', 'escalada') AND rating = 'excepcional'")
    promised = F.substring(F.sha2(F.concat(F.lit("plataforma:"), "id"), 256), 1, 16)
    uid = t.stable_id(F.lit("plataforma"), F.col("id").cast("string"), F.lit(""))
    return rows.select("id", F.when(uid == promised, uid).otherwise(F.raise_error(F.lit("uid differs from the promised one"))).alias("uid"), "task")


@query("join_federated", "SELECT e.event_id, coalesce(d.lang, 'demo-' || l.quality) AS lang, CASE WHEN d.doc_id IS NOT NULL THEN 'corpus' WHEN l.doc_id IS NOT NULL THEN 'demo' END AS origin FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id AND d.doc_id % 2 = 0 LEFT JOIN labels l ON l.doc_id = e.user_id")
def join_federated(spark, sf):
    """O-J8: the corpus first, then the demonstration table."""
    docs = table(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("user_id"), "lang")
    demo = table(spark, sf, "labels").select(F.col("doc_id").alias("user_id"), F.concat(F.lit("demo-"), "quality").alias("demo"))
    met = table(spark, sf, "events").join(docs, "user_id", "left").join(demo, "user_id", "left")
    return met.select("event_id", F.coalesce("lang", "demo").alias("lang"), F.when(F.col("lang").isNotNull(), "corpus").when(F.col("demo").isNotNull(), "demo").alias("origin"))


@query("exists_in_corpus", C + "SELECT user_id, count(*) AS n FROM events WHERE EXISTS (SELECT 1 FROM c WHERE c.id = user_id AND redistributable) GROUP BY user_id")
def exists_in_corpus(spark, sf):
    """O-D18, O-J4."""
    open_ = corpus(spark, sf).filter("redistributable").select(F.col("id").alias("user_id"))
    return table(spark, sf, "events").join(open_, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query("pool_filter", C + "SELECT lang, count(*) FILTER (WHERE redistributable) AS n_pool, count(*) FILTER (WHERE NOT redistributable) AS n_excluded_by_policy FROM c WHERE lang IN ('en', 'es') AND n_chars BETWEEN 50 AND 4000 AND nsfw IS DISTINCT FROM true GROUP BY lang")
def pool_filter(spark, sf):
    """O-F12, O-W43."""
    rows = corpus(spark, sf).filter(F.col("lang").isin("en", "es") & F.col("n_chars").between(50, 4000) & ~F.col("nsfw").eqNullSafe(True))
    return rows.groupBy("lang").agg(F.count_if("redistributable").alias("n_pool"), F.count_if(~F.col("redistributable")).alias("n_excluded_by_policy"))


@query("catalogue_filter", C + "SELECT id FROM c WHERE id IN (SELECT doc_id FROM labels) AND lang = 'en' AND source IN ('src1', 'src2', 'src3') AND n_chars >= 600 AND n_chars < 2000")
def catalogue_filter(spark, sf):
    """O-F13: a half-open range of sizes within a pool."""
    pool = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return corpus(spark, sf).filter("lang = 'en' AND source IN ('src1', 'src2', 'src3') AND n_chars >= 600 AND n_chars < 2000").join(pool, "id", "left_semi").select("id")


@query("pool_material_coverage", CL + "SELECT lang, count(*) AS n, count(r.n) AS n_with_response, count(*) FILTER (WHERE r.n >= 2) AS n_with_pair FROM c LEFT JOIN (SELECT task AS id, count(DISTINCT person) AS n FROM l GROUP BY 1) r USING (id) GROUP BY lang")
def pool_material_coverage(spark, sf):
    """O-G14, O-W22."""
    responses = ledger(spark, sf).groupBy(F.col("task").alias("id")).agg(F.countDistinct("person").alias("n"))
    return corpus(spark, sf).select("id", "lang").join(responses, "id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count(F.col("n")).alias("n_with_response"), F.count_if(F.col("n") >= 2).alias("n_with_pair"))


@query("composition", "SELECT coalesce(json_extract_string(props, '$.' || (json_keys(props))[1]), '') AS family, event_type, count(*) AS n FROM events GROUP BY ALL")
def composition(spark, sf):
    """O-G15: counts by a field of a JSON payload."""
    family = F.coalesce(F.get(F.map_values(F.from_json("props", "map<string,string>")), 0), F.lit(""))
    return table(spark, sf, "events").groupBy(family.alias("family"), "event_type").agg(F.count("*").alias("n"))


@query("request_facets", LEDGER_SQL + "SELECT rating, kind, count(*) AS n FROM l WHERE NOT in_progress OR expires < (SELECT (min(sec) + max(sec)) // 2 FROM l) GROUP BY ALL")
def request_facets(spark, sf):
    """O-G17, O-W26: over requests that are free: not reserved, or reserved too long ago."""
    rows = ledger(spark, sf)
    now = rows.agg(F.floor((F.min("sec") + F.max("sec")) / 2).alias("now"))
    return rows.crossJoin(F.broadcast(now)).filter("NOT in_progress OR expires < now").groupBy("rating", "kind").agg(F.count("*").alias("n"))


@query("tasks_by_kind_for_person", LEDGER_SQL + ", t AS (SELECT kind, task, count(*) FILTER (WHERE in_progress) AS live FROM l GROUP BY ALL) SELECT kind, count(*) AS n FROM t WHERE live < 2 AND task NOT IN (SELECT task FROM l WHERE person = 5) GROUP BY kind")
def tasks_by_kind_for_person(spark, sf):
    """O-G18."""
    rows = ledger(spark, sf)
    open_ = rows.groupBy("kind", "task").agg(F.count_if("in_progress").alias("live")).filter("live < 2")
    return open_.join(rows.filter("person = 5").select("task"), "task", "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


@query("projects_with_counts", CL + "SELECT source, count(DISTINCT c.id) AS n_tasks, count(l.id) AS n_work FROM c LEFT JOIN l ON l.task = c.id GROUP BY source")
def projects_with_counts(spark, sf):
    """O-G19; work is counted by task before it meets the corpus."""
    work = ledger(spark, sf).groupBy(F.col("task").alias("id")).agg(F.count("*").alias("w"))
    return corpus(spark, sf).select("id", "source").join(work, "id", "left").groupBy("source").agg(F.countDistinct("id").alias("n_tasks"), F.coalesce(F.sum("w"), F.lit(0)).alias("n_work"))


@query("labels_axes_combined", C + "SELECT id, least(coalesce(a, 0), coalesce(b, 0)) AS label_confidence, coalesce(a, 0) < 0.5 OR coalesce(b, 0) < 0.5 AS needs_review FROM (SELECT id, (id * 7 % 100) / 100.0 AS a, CASE WHEN id % 6 <> 0 THEN (id * 13 % 100) / 100.0 END AS b FROM c)")
def labels_axes_combined(spark, sf):
    """O-C11: the least confidence, and a review if any axis needs one."""
    a, b = F.pmod(F.col("id") * 7, F.lit(100)) / 100.0, F.when(F.pmod("id", F.lit(6)) != 0, F.pmod(F.col("id") * 13, F.lit(100)) / 100.0)
    rows = corpus(spark, sf).select("id", F.coalesce(a, F.lit(0.0)).alias("a"), F.coalesce(b, F.lit(0.0)).alias("b"))
    return rows.select("id", F.least("a", "b").alias("label_confidence"), ((F.col("a") < 0.5) | (F.col("b") < 0.5)).alias("needs_review"))


@query("export_collection", C + "SELECT id, license FROM c WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AND redistributable")
def export_collection(spark, sf):
    """O-E9: the rows of a collection."""
    members = table(spark, sf, "labels").filter("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("id"))
    return corpus(spark, sf).filter("redistributable").join(members, "id", "left_semi").select("id", "license")


@query("export_attribution", C + "SELECT source, 'Data from ' || source || ', ' || string_agg(DISTINCT license, '/' ORDER BY license) AS attribution FROM c GROUP BY source")
def export_attribution(spark, sf):
    """O-E11."""
    held = corpus(spark, sf).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("license")), "/").alias("l"))
    return held.select("source", F.concat(F.lit("Data from "), "source", F.lit(", "), "l").alias("attribution"))


_GRAMS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@query(
    "disclosure_probe",
    f"WITH p AS (SELECT conv_id, w, unnest(range(1, greatest(len(w) - 7, 0) + 1)) AS i FROM (SELECT conv_id, {_GRAMS} AS w FROM conversations)), g AS (SELECT DISTINCT array_to_string(list_slice(w, i, i + 7), ' ') AS gram FROM p), d AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 7, 0) + 1)) AS i FROM (SELECT doc_id, {_GRAMS} AS w FROM documents)), h AS (SELECT doc_id, array_to_string(list_slice(w, i, i + 7), ' ') AS gram FROM d) SELECT doc_id, count(DISTINCT gram) AS n_fragments FROM h WHERE gram IN (SELECT gram FROM g) GROUP BY doc_id",
)
def disclosure_probe(spark, sf):
    """O-E12: fragments of eight words of one table that stand in another."""
    return shared_counts(table(spark, sf, "documents"), table(spark, sf, "conversations"), "doc_id")


@query("delivery_records", LEDGER_SQL + "SELECT task, count(*) AS n, array_to_string(list(person || ':' || score ORDER BY id), ',') AS ratings FROM l WHERE kind = 'purchase' GROUP BY task")
def delivery_records(spark, sf):
    """O-W15: nested records, in order."""
    held = ledger(spark, sf).filter("kind = 'purchase'").groupBy("task").agg(F.array_sort(F.collect_list(F.struct("id", "person", "score"))).alias("all"))
    return held.select("task", F.size("all").cast("long").alias("n"), F.array_join(F.transform("all", lambda x: F.concat(x["person"], F.lit(":"), x["score"])), ",").alias("ratings"))


@query("task_planning", CL + ", p AS (SELECT doc_id AS id FROM labels WHERE quality = 1) SELECT id FROM c WHERE id IN (SELECT id FROM p) AND lang = 'en' AND id NOT IN (SELECT task FROM l WHERE in_progress) AND id IN (SELECT task FROM l) ORDER BY id LIMIT 40")
def task_planning(spark, sf):
    """O-W21: in the pool and the filter, without an open task, with material; the first in pool order."""
    rows = ledger(spark, sf).withColumnRenamed("task", "key")
    pool = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    found = corpus(spark, sf).filter("lang = 'en'").select("id").join(pool, "id", "left_semi")
    busy, material = rows.filter("in_progress").select(F.col("key").alias("id")), rows.select(F.col("key").alias("id"))
    return found.join(busy, "id", "left_anti").join(material, "id", "left_semi").orderBy("id").limit(40)


@query("rubric_errors", LEDGER_SQL + "SELECT id, CASE WHEN score > 4 THEN 'scale' WHEN score = 1 AND rating = 'excepcional' THEN 'outcome' WHEN NOT in_progress AND status = 'devolvida' AND rating <> 'incorrigivel' THEN 'comment' END AS error FROM l WHERE score > 4 OR (score = 1 AND rating = 'excepcional') OR (NOT in_progress AND status = 'devolvida' AND rating <> 'incorrigivel')")
def rubric_errors(spark, sf):
    """O-W25, O-W35, O-W39: the first rule that a rating breaks."""
    error = F.when(F.col("score") > 4, "scale").when((F.col("score") == 1) & (F.col("rating") == "excepcional"), "outcome").when(~F.col("in_progress") & (F.col("status") == "devolvida") & (F.col("rating") != "incorrigivel"), "comment")
    return ledger(spark, sf).select("id", error.alias("error")).filter("error IS NOT NULL")


@query("import_window_limit", LEDGER_SQL + "SELECT id, row_number() OVER (PARTITION BY task ORDER BY id) <= 3 AS accepted FROM l")
def import_window_limit(spark, sf):
    """O-W27: three requests at most from one window of material."""
    return ledger(spark, sf).select("id", (F.row_number().over(W.partitionBy("task").orderBy("id")) <= 3).alias("accepted"))


POOL_CONFIG = "policy=redistributable;version=1"


@query("pool_signature", C + f"SELECT sha256('{POOL_CONFIG}:' || count(*) || ':' || coalesce(sum(CAST('0x' || substr(sha256(uid || ':' || text), 1, 12) AS BIGINT)), 0)) AS signature FROM c WHERE redistributable")
def pool_signature(spark, sf):
    """O-W28: of the configuration and every row's uid and text, in any order; an edit changes it."""
    mark = F.conv(F.substring(F.sha2(F.concat("uid", F.lit(":"), "text"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    one = corpus(spark, sf).filter("redistributable").agg(F.count("*").alias("n"), F.coalesce(F.sum(mark), F.lit(0)).alias("m"))
    return one.select(F.sha2(F.concat(F.lit(POOL_CONFIG + ":"), F.col("n").cast("string"), F.lit(":"), F.col("m").cast("string")), 256).alias("signature"))


@query(
    "round_robin_plan",
    LEDGER_SQL + ", t AS (SELECT task, row_number() OVER (ORDER BY task) - 1 AS r FROM (SELECT DISTINCT task FROM l)), o AS (SELECT task, (r + k) % 9 AS person, k FROM t, range(9) AS x(k)) SELECT t.task, (SELECT arg_min(o.person, o.k) FROM o WHERE o.task = t.task AND NOT EXISTS (SELECT 1 FROM l WHERE l.task = o.task AND l.person = o.person)) AS person FROM t",
)
def round_robin_plan(spark, sf):
    """O-A17: tasks to people in turn; one who had the task passes it to the next who hadn't, null if all had it."""
    tasks = ledger(spark, sf).groupBy("task").agg(F.collect_set("person").alias("had"))
    turns = ranked(tasks, [F.col("task")], "turn")
    people = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.pmod(F.col("turn") + k, F.lit(9)))
    free = F.filter(people, lambda p: ~F.array_contains("had", p))
    return turns.select("task", F.get(free, 0).alias("person"))


@query("target_quotas", "SELECT target, n FROM (VALUES ('a', 25), ('b', 13), ('c', 12)) AS v(target, n)")
def target_quotas(spark, sf):
    """O-A16: whole quotas of a distribution."""
    from quarry.operators.sampling import largest_remainder

    return spark.createDataFrame(list(largest_remainder({"a": 0.5, "b": 0.25, "c": 0.25}, 50).items()), "target string, n long")


@query("reveal_labels", LEDGER_SQL + "SELECT id, CASE WHEN in_progress THEN 'A/B' ELSE 'model-' || (id % 4) || '/model-' || (id * 3 % 4) END AS shown FROM l")
def reveal_labels(spark, sf):
    """O-W44: models are named once the answer is in."""
    named = F.concat(F.lit("model-"), F.pmod("id", F.lit(4)), F.lit("/model-"), F.pmod(F.col("id") * 3, F.lit(4)))
    return ledger(spark, sf).select("id", F.when(F.col("in_progress"), "A/B").otherwise(named).alias("shown"))


@query("criteria_normalised", "SELECT event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) IS NULL AS undeclared, coalesce(json_extract_string(props, '$.scale'), json_extract_string(props, '$.' || (json_keys(props))[1]), '') AS scale FROM events")
def criteria_normalised(spark, sf):
    """O-W40, O-W41: two shapes of a payload as one; what neither declares is flagged, never invented."""
    first = F.get(F.map_values(F.from_json("props", "map<string,string>")), 0)
    return table(spark, sf, "events").select("event_id", first.isNull().alias("undeclared"), F.coalesce(F.get_json_object("props", "$.scale"), first, F.lit("")).alias("scale"))


@query("wrong_language_guard", C + "SELECT id FROM c WHERE n_chars >= 60 AND lang = 'fr' AND len(regexp_extract_all(lower(substr(text, 1, 1000)), ' the ')) > len(regexp_extract_all(lower(substr(text, 1, 1000)), ' le '))")
def wrong_language_guard(spark, sf):
    """O-L9: text of 60 characters or more that looks like the other language."""
    head = F.lower(F.substring("text", 1, 1000))
    return corpus(spark, sf).filter((F.col("n_chars") >= 60) & (F.col("lang") == "fr") & (F.regexp_count(head, F.lit(" the ")) > F.regexp_count(head, F.lit(" le ")))).select("id")


@query("file_names", "SELECT page_id, CASE WHEN contains(u, 'BLOG') THEN 'blog' ELSE '' END AS collection, CASE WHEN regexp_matches(u, '(^|_)EXAMPLE(_|$)') THEN 'example' ELSE '' END AS subject, regexp_extract(u, '(?:^|_)(?:VOL_?)?([123])(?:_|$)', 1) AS grade FROM (SELECT page_id, regexp_replace(upper(regexp_replace(regexp_replace(url, '^.*/', ''), '[.][^.]*$', '')), '[^A-Z0-9]+', '_', 'g') AS u FROM pages)")
def file_names(spark, sf):
    """O-T19 over the last part of URLs."""
    told = table(spark, sf, "pages").select("page_id", t.file_metadata(F.col("url"), {"BLOG": "blog"}, {"EXAMPLE": "example"}).alias("m"))
    return told.select("page_id", "m.collection", "m.subject", "m.grade")


@query("skill_codes", "SELECT doc_id, array_to_string(list_distinct(['EM13MAT' || (100 + doc_id % 3)]), ',') AS skills FROM labels")
def skill_codes(spark, sf):
    """O-T21."""
    code = F.concat(F.lit("em13mat"), 100 + F.pmod("doc_id", F.lit(3)))
    return table(spark, sf, "labels").select("doc_id", F.array_join(t.valid_skills(F.array(code, F.upper(code), F.lit("EM13")) ), ",").alias("skills"))
