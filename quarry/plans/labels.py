"""Queries of labels, classifiers and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.vocabulary import DOMAINS, TASK_TYPES
from quarry.operators import labels as lb
from quarry.operators.sampling import split
from quarry.plans.registry import query
from quarry.sources.corpus import CORPUS_SQL, corpus, table

C = "WITH " + CORPUS_SQL
_METHODS = {"manual": 0, "agent": 1, "native": 2}
EVENTS_SQL = "WITH e AS (SELECT event_id AS seq, user_id % 500 AS uid, ['manual', 'agent', 'native', 'guess'][event_id % 4 + 1] AS method, 1 + (event_id * 7 + user_id) % 5 AS score, event_type, ts FROM events) "


def events(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    names = F.array(*[F.lit(m) for m in (*_METHODS, "guess")])
    return table(spark, sf, "events").select(e.alias("seq"), F.pmod(u, F.lit(500)).alias("uid"), F.get(names, F.pmod(e, F.lit(4)).cast("int")).alias("method"), (1 + F.pmod(e * 7 + u, F.lit(5))).alias("score"), "event_type", "ts")


@query("labels_resolve", EVENTS_SQL + "SELECT uid, seq, method, score FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY list_position(['manual', 'agent', 'native', 'guess'], method), seq) AS p FROM e) WHERE p = 1")
def resolve(spark, sf):
    return lb.resolve(events(spark, sf), "uid", _METHODS).select("uid", "seq", "method", "score")


@query("labels_native_map", C + ", m AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}', '{TASK_TYPES[i * 3 % 16]}', 0.5)" for i, x in enumerate(DOMAINS[:10])) + ") AS m(domain, target, weight)) SELECT id, target AS task_type, weight FROM c JOIN m USING (domain)")
def native_map(spark, sf):
    """O-C1."""
    mapping = spark.createDataFrame([(x, TASK_TYPES[i * 3 % 16], 0.5) for i, x in enumerate(DOMAINS[:10])], "domain string, target string, weight double")
    return corpus(spark, sf).join(F.broadcast(mapping), "domain").select("id", F.col("target").alias("task_type"), "weight")


@query("labels_agent_done", EVENTS_SQL + "SELECT uid, count(*) AS n FROM e WHERE event_type = 'purchase' AND uid NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY uid")
def agent_done(spark, sf):
    """O-C2: labels of finished batches without the calibration rows."""
    calibration = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("uid"))
    return events(spark, sf).filter("event_type = 'purchase'").join(calibration, "uid", "left_anti").groupBy("uid").agg(F.count("*").alias("n"))


@query(
    "labels_cross_tab",
    EVENTS_SQL
    + ", x AS (SELECT a.score AS native, b.score AS agent, count(*) AS n FROM e a JOIN e b ON b.seq = a.seq + 1 WHERE a.method = 'native' GROUP BY ALL) SELECT native, sum(n) AS n, round(sum(CASE WHEN native = agent THEN n ELSE 0 END) / sum(n), 6) AS hit_rate, arg_max(agent, n * 10 - agent) AS mode, 1 - sum(CASE WHEN native = agent THEN n ELSE 0 END) / sum(n) > 0.3 AS suspect FROM x GROUP BY native",
)
def cross_tab(spark, sf):
    """O-C4."""
    rows = events(spark, sf)
    after = rows.select((F.col("seq") - 1).alias("seq"), F.col("score").alias("agent"))
    x = rows.filter("method = 'native'").select("seq", F.col("score").alias("native")).join(after, "seq").groupBy("native", "agent").agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("native") == F.col("agent"), F.col("n")).otherwise(0)) / F.sum("n")
    return x.groupBy("native").agg(F.sum("n").alias("n"), F.round(hit, 6).alias("hit_rate"), F.max_by("agent", F.col("n") * 10 - F.col("agent")).alias("mode"), (1 - hit > 0.3).alias("suspect"))


@query("labels_load_precedence", C + "SELECT id, coalesce(CASE WHEN quality IS NOT NULL THEN task_type END, CASE WHEN id % 3 = 0 THEN 'codigo' END, domain) AS label, CASE WHEN quality IS NOT NULL AND task_type IS NOT NULL THEN 'manual' WHEN id % 3 = 0 THEN 'classifier' WHEN domain IS NOT NULL THEN 'native' END AS method, CASE WHEN NOT (quality IS NOT NULL AND task_type IS NOT NULL) AND id % 3 = 0 THEN 0.7 END AS confidence, needs_review FROM c")
def load_precedence(spark, sf):
    """O-C5, O-C6: observed labels, then the classifier's, then native ones; observed ones have no confidence."""
    seen, guessed = F.col("quality").isNotNull() & F.col("task_type").isNotNull(), F.pmod("id", F.lit(3)) == 0
    return corpus(spark, sf).select(
        "id",
        F.when(seen, F.col("task_type")).when(guessed, "codigo").otherwise(F.col("domain")).alias("label"),
        F.when(seen, "manual").when(guessed, "classifier").when(F.col("domain").isNotNull(), "native").alias("method"),
        F.when(~seen & guessed, 0.7).alias("confidence"),
        "needs_review",
    )


@query("labels_policy_divergence", C + "SELECT license, count(*) AS n, count(*) FILTER (WHERE commercial_ok <> (license NOT IN ('cc-by-nc-4.0', 'lmsys-1m', 'unknown'))) AS n_divergent, count(*) FILTER (WHERE task_type IS NULL) AS n_uncovered FROM c GROUP BY license")
def policy_divergence(spark, sf):
    """O-C7, O-G12."""
    return corpus(spark, sf).groupBy("license").agg(F.count("*").alias("n"), F.count_if(F.col("commercial_ok") != ~F.col("license").isin("cc-by-nc-4.0", "lmsys-1m", "unknown")).alias("n_divergent"), F.count_if(F.col("task_type").isNull()).alias("n_uncovered"))


def scored(spark, sf):
    rows = split(table(spark, sf, "embeddings"), "label", "vec_id", 0.2)
    weights = lb.centroid_classifier(rows.filter("NOT is_test").select("label", "embedding"))
    return rows.select(F.col("vec_id").alias("id"), "label", "is_test").join(lb.softmax_scores(rows, weights), "id")


_SCORED_SQL = """WITH s AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY sha256('0:' || vec_id), vec_id) AS p, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
r AS (SELECT *, p <= CASE WHEN n < 2 THEN 0 ELSE least(round(n * 0.2), n - 1) END AS is_test FROM s),
m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) * 8 AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM r WHERE NOT is_test) GROUP BY ALL),
w AS (SELECT label AS class, list(m ORDER BY i) AS w FROM m GROUP BY label),
z AS (SELECT vec_id AS id, label, is_test, class, list_dot_product(CAST(embedding AS DOUBLE[]), w) AS z FROM r, w),
g AS (SELECT id, label, is_test, arg_max(class, z) AS class, 1 / sum(exp(z - m)) AS confidence FROM (SELECT *, max(z) OVER (PARTITION BY id) AS m FROM z) GROUP BY ALL)
"""


@query("labels_softmax_bands", _SCORED_SQL + "SELECT id, class, round(confidence, 5) AS confidence, confidence >= 0.35 AS accepted, confidence < 0.5 AS needs_review FROM g")
def softmax_bands(spark, sf):
    """O-C9 to O-C11."""
    accepted, review = lb.bands(F.col("confidence"))
    return scored(spark, sf).select("id", "class", F.round("confidence", 5).alias("confidence"), accepted.alias("accepted"), review.alias("needs_review"))


@query(
    "labels_class_metrics",
    _SCORED_SQL
    + ", t AS (SELECT * FROM g WHERE is_test), k AS (SELECT label AS class FROM t UNION SELECT class FROM t), n AS (SELECT class, (SELECT count(*) FROM t WHERE t.label = k.class AND t.class = k.class) AS hit, (SELECT count(*) FROM t WHERE t.class = k.class) AS guessed, (SELECT count(*) FROM t WHERE t.label = k.class) AS support FROM k) SELECT class, support, round(coalesce(hit / nullif(guessed, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * hit / nullif(guessed + support, 0), 0), 6) AS f1 FROM n",
)
def class_metrics(spark, sf):
    found = lb.class_metrics(scored(spark, sf).filter("is_test"), "label", "class")
    return found.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("labels_macro_f1", _SCORED_SQL + ", t AS (SELECT * FROM g WHERE is_test), k AS (SELECT label AS class FROM t UNION SELECT class FROM t), n AS (SELECT class, (SELECT count(*) FROM t WHERE t.label = k.class AND t.class = k.class) AS hit, (SELECT count(*) FROM t WHERE t.class = k.class) AS guessed, (SELECT count(*) FROM t WHERE t.label = k.class) AS support FROM k) SELECT round(avg(coalesce(2 * hit / nullif(guessed + support, 0), 0)), 6) AS macro_f1 FROM n")
def macro_f1(spark, sf):
    return lb.class_metrics(scored(spark, sf).filter("is_test"), "label", "class").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


@query("labels_logistic")
def logistic(spark, sf):
    """O-C8: multinomial logistic regression with balanced class weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = split(table(spark, sf, "embeddings"), "label", "vec_id", 0.2).withColumn("x", array_to_vector(F.col("embedding").cast("array<double>")))
    sizes = rows.filter("NOT is_test").groupBy("label").agg((F.lit(1.0) / F.count("*")).alias("w"))
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", regParam=0.01, maxIter=30).fit(rows.filter("NOT is_test").join(F.broadcast(sizes), "label"))
    told = model.transform(rows.select("vec_id", "label", "is_test", "x"))
    return told.select("vec_id", "label", "is_test", F.col("prediction").cast("int").alias("predicted"), F.round(F.array_max(vector_to_array("probability")), 4).alias("confidence"))


PAIRS_SQL = ", l AS (SELECT seq // 6 AS task, uid % 7 AS person, score, seq FROM e), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task, person ORDER BY seq DESC) AS p FROM l) WHERE p = 1), pr AS (SELECT a.task, a.task % 4 AS field, a.score AS a, b.score AS b FROM v a JOIN v b ON a.task = b.task AND a.person < b.person)"


def rating_pairs(spark, sf):
    """O-W6, O-J9: each person's latest rating of a task, paired with the others' of the task."""
    rows = events(spark, sf).select(F.floor(F.col("seq") / 6).alias("task"), F.pmod("uid", F.lit(7)).alias("person"), "score", "seq")
    last = rows.groupBy("task", "person").agg(F.max_by("score", "seq").alias("score"))
    other = last.select("task", F.col("person").alias("other"), F.col("score").alias("b"))
    return last.join(other, "task").filter("person < other").select("task", F.pmod("task", F.lit(4)).alias("field"), F.col("score").alias("a"), "b")


for _kind, _w in {"quadratic": "1 - ((x - y) / 4.0) ** 2", "linear": "1 - abs(x - y) / 4.0", "nominal": "CASE WHEN x = y THEN 1.0 ELSE 0.0 END"}.items():

    @query(
        f"agreement_{_kind}",
        EVENTS_SQL
        + PAIRS_SQL
        + f""", o AS (SELECT field, count(*) AS n_pairs, avg(w) AS observed FROM (SELECT field, {_w.replace("x", "a").replace("y", "b") if _kind != "linear" else "1 - abs(a - b) / 4.0"} AS w FROM pr) GROUP BY field),
        mg AS (SELECT field, x, count(*) AS n FROM (SELECT field, unnest([a, b]) AS x FROM pr) GROUP BY ALL),
        ex AS (SELECT field, sum(n * m * w) AS e FROM (SELECT s.field, s.n, t.n AS m, {_w.replace("x", "s.x").replace("y", "t.x") if _kind != "linear" else "1 - abs(s.x - t.x) / 4.0"} AS w FROM mg s JOIN mg t USING (field)) GROUP BY 1),
        q AS (SELECT field, n_pairs, observed, e / (4.0 * n_pairs * n_pairs) AS expected FROM o JOIN ex USING (field))
        SELECT field, n_pairs, round(observed, 4) AS observed, round(expected, 4) AS expected, CASE WHEN n_pairs >= 10 AND expected < 1 THEN round((observed - expected) / (1 - expected), 4) END AS kappa,
        CASE WHEN n_pairs < 10 THEN 'poucos_pares' WHEN expected >= 1 THEN 'sem_variancia' END AS reason FROM q""",
    )
    def _agreement(spark, sf, kind=_kind):
        return lb.weighted_agreement(rating_pairs(spark, sf), ["field"], 5, kind)


@query("labels_batch_agreement", EVENTS_SQL + ", g AS (SELECT DISTINCT seq // 50 AS batch, seq AS uid, score AS a, score % 2 AS b FROM e WHERE seq % 50 < 3), r AS (SELECT seq // 50 AS batch, seq AS uid, 1 + (seq * 3) % 5 AS a, seq % 2 AS b FROM e WHERE seq % 7 <> 0) SELECT g.batch, sum(CASE WHEN g.a = r.a THEN 1 ELSE 0 END + CASE WHEN g.b = r.b THEN 1 ELSE 0 END) / (count(*) * 2) AS agreement, count(*) AS n_gold FROM g LEFT JOIN r USING (batch, uid) GROUP BY g.batch")
def batch_agreement(spark, sf):
    rows = events(spark, sf).withColumn("batch", F.floor(F.col("seq") / 50))
    gold = rows.filter("seq % 50 < 3").select("batch", F.col("seq").alias("uid"), F.col("score").alias("a"), F.pmod("score", F.lit(2)).alias("b"))
    answers = rows.filter("seq % 7 <> 0").select("batch", F.col("seq").alias("uid"), (1 + F.pmod(F.col("seq") * 3, F.lit(5))).alias("a"), F.pmod("seq", F.lit(2)).alias("b"))
    return lb.batch_agreement(gold, answers, ["a", "b"])


@query(
    "labels_response_errors",
    "WITH x AS (SELECT doc_id AS uid FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id AS uid, count(*) AS n, min(quality) AS low, max(quality) AS high FROM labels GROUP BY 1), a AS (SELECT coalesce(x.uid, r.uid) AS uid, list_filter([CASE WHEN n IS NULL THEN 'missing' END, CASE WHEN x.uid IS NULL THEN 'unexpected' END, CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN n IS NOT NULL AND NOT (low >= 1 AND high <= 3) THEN 'quality' END], lambda v: v IS NOT NULL) AS errors FROM x FULL JOIN r ON x.uid = r.uid) SELECT uid, array_to_string(errors, ',') AS errors FROM a WHERE len(errors) > 0",
)
def response_errors(spark, sf):
    expected = table(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("uid"))
    received = table(spark, sf, "labels").select(F.col("doc_id").alias("uid"), "quality", F.col("toxic").alias("nsfw"))
    return lb.response_errors(expected, received).select("uid", F.array_join("errors", ",").alias("errors"))


@query("labels_retry_set", "SELECT doc_id AS uid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def retry_set(spark, sf):
    """O-C15."""
    valid = table(spark, sf, "labels").filter("quality = 1")
    return table(spark, sf, "documents").join(valid, "doc_id", "left_anti").select(F.col("doc_id").alias("uid"))


@query("labels_panel", EVENTS_SQL + ", b AS (SELECT seq // 50 AS batch, mode(event_type) AS m, min(event_type) AS status, avg(score) / 5 AS agreement FROM e GROUP BY 1) SELECT status, count(*) AS n, round(avg(agreement), 6) AS mean_agreement, count(*) FILTER (WHERE agreement < 0.6) AS n_below FROM b GROUP BY status")
def panel(spark, sf):
    """O-C16."""
    b = events(spark, sf).groupBy(F.floor(F.col("seq") / 50).alias("batch")).agg(F.min("event_type").alias("status"), (F.avg("score") / 5).alias("agreement"))
    return b.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("agreement"), 6).alias("mean_agreement"), F.count_if(F.col("agreement") < 0.6).alias("n_below"))


@query("labels_gold_reuse", EVENTS_SQL + "SELECT n AS times, count(*) AS n_uids FROM (SELECT uid, count(*) AS n FROM e GROUP BY uid) GROUP BY n")
def gold_reuse(spark, sf):
    """O-C17."""
    return events(spark, sf).groupBy("uid").agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("n_uids"))
