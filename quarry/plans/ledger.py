"""Queries of the annotation ledger, over events as assignments, ratings and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions.vocabulary import DECISION_OUTCOMES, RATING_OUTCOMES, TRANSITIONS
from quarry.plans.registry import query
from quarry.sources.corpus import table

STATUSES = list(TRANSITIONS)
RATINGS = list(RATING_OUTCOMES)
#: task, person, status, rating and times follow from the event.
LEDGER_SQL = f"""WITH l AS (SELECT event_id AS id, event_id // 5 AS task, user_id % 9 AS person, {STATUSES}[event_id * 3 % 6 + 1] AS status, {RATINGS}[event_id * 5 % 4 + 1] AS rating,
  1 + (event_id * 7 + user_id) % 5 AS score, event_type AS kind, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id % 4 = 0 AS in_progress, CASE WHEN event_id % 3 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + 10800 END AS expires, event_id % 13 = 0 AS synthetic FROM events) """


def _pick(values, at):
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def ledger(spark, sf):
    i, at = F.col("event_id"), F.col("ts").cast("timestamp").cast("long")
    return table(spark, sf, "events").select(
        i.alias("id"), F.floor(i / 5).alias("task"), F.pmod("user_id", F.lit(9)).alias("person"), _pick(STATUSES, F.pmod(i * 3, F.lit(6))).alias("status"), _pick(RATINGS, F.pmod(i * 5, F.lit(4))).alias("rating"),
        (1 + F.pmod(i * 7 + F.col("user_id"), F.lit(5))).alias("score"), F.col("event_type").alias("kind"), at.alias("sec"), (F.pmod(i, F.lit(4)) == 0).alias("in_progress"), F.when(F.pmod(i, F.lit(3)) != 0, at + 10800).alias("expires"), (F.pmod(i, F.lit(13)) == 0).alias("synthetic"),
    )


_MID = "(SELECT (min(sec) + max(sec)) // 2 FROM l)"


def _with_now(rows):
    """The middle of the log stands for the present."""
    return rows.crossJoin(F.broadcast(rows.agg(F.floor((F.min("sec") + F.max("sec")) / 2).alias("now"))))


@query("ledger_lease_expiry", LEDGER_SQL + f"SELECT id, CASE WHEN in_progress AND expires < {_MID} THEN 'expired' WHEN in_progress THEN 'live' ELSE 'done' END AS state FROM l")
def lease_expiry(spark, sf):
    """O-W1, O-W2: a lease without an end never expires."""
    state = F.when(F.col("in_progress") & (F.col("expires") < F.col("now")), "expired").when(F.col("in_progress"), "live").otherwise("done")
    return _with_now(ledger(spark, sf)).select("id", state.alias("state"))


@query("ledger_claimable", LEDGER_SQL + ", t AS (SELECT task, count(*) FILTER (WHERE in_progress) AS live, max(score) AS priority, count(*) FILTER (WHERE person = 3) AS mine FROM l WHERE kind = 'click' GROUP BY task) SELECT task, live, priority FROM t WHERE live < 2 AND mine = 0 ORDER BY priority DESC, task LIMIT 30")
def claimable(spark, sf):
    """O-W3, O-J5: open tasks of a kind that person 3 has not had, below two live leases."""
    t = ledger(spark, sf).filter("kind = 'click'").groupBy("task").agg(F.count_if("in_progress").alias("live"), F.max("score").alias("priority"), F.count_if(F.col("person") == 3).alias("mine"))
    return t.filter("live < 2 AND mine = 0").select("task", "live", "priority").orderBy(F.desc("priority"), "task").limit(30)


_PAIRS = [(a, b) for a, bs in TRANSITIONS.items() for b in bs]


@query("ledger_transitions", LEDGER_SQL + ", h AS (SELECT task, status, lag(status) OVER (PARTITION BY task ORDER BY id) AS before FROM l) SELECT before, status, count(*) AS n, bool_or((before, status) IN (" + ", ".join(map(str, _PAIRS)) + ")) AS allowed FROM h WHERE before IS NOT NULL GROUP BY ALL")
def transitions(spark, sf):
    """O-W4, O-W5."""
    allowed = spark.createDataFrame([(a, b, True) for a, b in _PAIRS], "before string, status string, allowed boolean")
    h = ledger(spark, sf).select("status", F.lag("status").over(W.partitionBy("task").orderBy("id")).alias("before")).filter("before IS NOT NULL")
    return h.groupBy("before", "status").agg(F.count("*").alias("n")).join(F.broadcast(allowed), ["before", "status"], "left").select("before", "status", "n", F.coalesce("allowed", F.lit(False)).alias("allowed"))


@query("ledger_latest_versions", LEDGER_SQL + "SELECT task, person, id, version FROM (SELECT *, row_number() OVER (PARTITION BY task, person ORDER BY id) AS version, row_number() OVER (PARTITION BY task, person ORDER BY id DESC) AS p FROM l WHERE NOT synthetic AND status <> 'descartada') WHERE p = 1")
def latest_versions(spark, sf):
    """O-W6, O-W32."""
    rows = ledger(spark, sf).filter("NOT synthetic AND status <> 'descartada'")
    return rows.groupBy("task", "person").agg(F.max("id").alias("id"), F.count("*").alias("version"))


@query("ledger_funnel", LEDGER_SQL + ", v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate([*STATUSES, "arquivada"])) + ") AS v(place, status)) SELECT place, status, coalesce(n, 0) AS n FROM v LEFT JOIN (SELECT status, count(*) AS n FROM l GROUP BY 1) USING (status)")
def funnel(spark, sf):
    """O-G16."""
    words = spark.createDataFrame(list(enumerate([*STATUSES, "arquivada"])), "place long, status string")
    return words.join(ledger(spark, sf).groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("place", "status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("ledger_escalated_open", LEDGER_SQL + "SELECT task, min(id) AS id FROM l WHERE status = 'escalada' AND person <> 4 AND task NOT IN (SELECT task FROM l WHERE rating = 'adequado' AND kind = 'view') GROUP BY task")
def escalated_open(spark, sf):
    """O-J3, O-W11: escalated, not one's own, undecided."""
    rows = ledger(spark, sf)
    decided = rows.filter("rating = 'adequado' AND kind = 'view'").select("task")
    return rows.filter("status = 'escalada' AND person <> 4").join(decided, "task", "left_anti").groupBy("task").agg(F.min("id").alias("id"))


@query("ledger_outcomes", LEDGER_SQL + "SELECT rating, CASE rating " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RATING_OUTCOMES.items()) + " END AS outcome, count(*) AS n FROM l GROUP BY ALL")
def outcomes(spark, sf):
    """O-W36."""
    outcome = F.coalesce(*[F.when(F.col("rating") == k, v) for k, v in (RATING_OUTCOMES | DECISION_OUTCOMES).items()])
    return ledger(spark, sf).groupBy("rating", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "ledger_calibration",
    LEDGER_SQL + ", r AS (SELECT id, person, score AS truth, 1 + (id * 11) % 5 AS told, kind FROM l) SELECT person, count(*) AS n, round(avg(CASE WHEN truth = told THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN abs(truth - told) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_one, round(avg(abs(truth - told)), 6) AS mae FROM r GROUP BY person",
)
def calibration(spark, sf):
    """O-W16."""
    gap = F.abs(F.col("score") - (1 + F.pmod(F.col("id") * 11, F.lit(5))))
    return ledger(spark, sf).groupBy("person").agg(F.count("*").alias("n"), F.round(F.avg((gap == 0).cast("double")), 6).alias("exact"), F.round(F.avg((gap <= 1).cast("double")), 6).alias("within_one"), F.round(F.avg(gap), 6).alias("mae"))


@query("ledger_confusion", LEDGER_SQL + "SELECT score AS truth, 1 + (id * 11) % 5 AS told, count(*) AS n FROM l GROUP BY ALL")
def confusion(spark, sf):
    return ledger(spark, sf).groupBy(F.col("score").alias("truth"), (1 + F.pmod(F.col("id") * 11, F.lit(5))).alias("told")).agg(F.count("*").alias("n"))


@query("ledger_leak_rate", LEDGER_SQL + "SELECT kind, count(*) AS n, round(count(*) FILTER (WHERE status <> 'devolvida' AND rating = 'incorrigivel') / CAST(nullif(count(*) FILTER (WHERE rating = 'incorrigivel'), 0) AS DOUBLE), 6) AS leak_rate FROM l GROUP BY kind")
def leak_rate(spark, sf):
    """O-W17."""
    bad = F.col("rating") == "incorrigivel"
    return ledger(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.try_divide(F.count_if(bad & (F.col("status") != "devolvida")), F.count_if(bad)), 6).alias("leak_rate"))


@query("ledger_panorama", LEDGER_SQL + ", o AS (SELECT person, score, row_number() OVER (PARTITION BY person ORDER BY score, id) - 1 AS r, count(*) OVER (PARTITION BY person) AS n FROM l) SELECT person, n, score AS upper_median FROM o WHERE r = n // 2")
def panorama(spark, sf):
    """O-W18, O-W19: the upper median, at place n div 2; counts of scores are few, so none is collected by row."""
    by = ledger(spark, sf).groupBy("person", "score").agg(F.count("*").alias("k"))
    run = F.sum("k").over(W.partitionBy("person").orderBy("score"))
    n = F.sum("k").over(W.partitionBy("person"))
    held = by.select("person", "score", run.alias("run"), n.alias("n")).filter("run > floor(n / 2)")
    return held.groupBy("person").agg(F.max("n").alias("n"), F.min("score").alias("upper_median"))


@query("ledger_per_annotator", LEDGER_SQL + "SELECT person, count(*) AS n, round(avg(CASE WHEN status = 'devolvida' THEN 1.0 ELSE 0.0 END), 6) AS rework_rate, count(DISTINCT task) AS n_tasks FROM l GROUP BY person")
def per_annotator(spark, sf):
    return ledger(spark, sf).groupBy("person").agg(F.count("*").alias("n"), F.round(F.avg((F.col("status") == "devolvida").cast("double")), 6).alias("rework_rate"), F.countDistinct("task").alias("n_tasks"))


@query(
    "ledger_duels",
    LEDGER_SQL + ", d AS (SELECT id, 'model-' || (id % 4) AS a, 'model-' || ((id * 3 + 1) % 4) AS b, ['a', 'b', 'tie'][id * 7 % 3 + 1] AS winner FROM l), s AS (SELECT a AS model, winner = 'a' AS won, winner = 'tie' AS tied, true AS first FROM d WHERE a <> b UNION ALL SELECT b, winner = 'b', winner = 'tie', false FROM d WHERE a <> b) SELECT model, count(*) AS n, round(avg(CASE WHEN won THEN 1.0 ELSE 0 END), 6) AS win_rate, count(*) FILTER (WHERE tied) AS n_tied, round(avg(CASE WHEN won THEN 1.0 ELSE 0 END) FILTER (WHERE first), 6) AS win_rate_first FROM s GROUP BY model",
)
def duels(spark, sf):
    """O-W14, O-W20: win rates and the advantage of the first place."""
    i = F.col("id")
    a, b = F.concat(F.lit("model-"), F.pmod(i, F.lit(4))), F.concat(F.lit("model-"), F.pmod(i * 3 + 1, F.lit(4)))
    d = ledger(spark, sf).select(a.alias("a"), b.alias("b"), _pick(["a", "b", "tie"], F.pmod(i * 7, F.lit(3))).alias("winner")).filter("a <> b")
    sides = F.array(*[F.struct(F.col(s).alias("model"), (F.col("winner") == s).alias("won"), (F.col("winner") == "tie").alias("tied"), F.lit(s == "a").alias("first")) for s in "ab"])
    s = d.select(F.explode(sides).alias("s")).select("s.*")
    return s.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(F.col("won").cast("double")), 6).alias("win_rate"), F.count_if("tied").alias("n_tied"), F.round(F.avg(F.when(F.col("first"), F.col("won").cast("double"))), 6).alias("win_rate_first"))


@query("ledger_flatten_json", "WITH k AS (SELECT event_id, unnest(json_keys(props)) AS path, props FROM events) SELECT event_id, path, json_extract_string(props, '$.' || path) AS value FROM k")
def flatten_json(spark, sf):
    """O-W9 for objects of scalars: path and value of each leaf."""
    return table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))


@query(
    "ledger_payload_diff",
    "WITH k AS (SELECT event_id, unnest(json_keys(props)) AS path, props FROM events), a AS (SELECT event_id, path, json_extract_string(props, '$.' || path) AS v FROM k), b AS (SELECT event_id - 1 AS event_id, path, v FROM a), d AS (SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce(a.path, b.path) AS path, a.v AS before, b.v AS after FROM a FULL JOIN b ON a.event_id = b.event_id AND a.path = b.path WHERE a.v IS DISTINCT FROM b.v) SELECT * FROM d WHERE event_id IN (SELECT event_id FROM events) AND event_id + 1 IN (SELECT event_id FROM events)",
)
def payload_diff(spark, sf):
    """O-W10: leaves that differ from the next payload's, added and removed ones too."""
    held = table(spark, sf, "events").select("event_id", F.coalesce(F.from_json("props", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")).alias("old"))
    met = held.join(held.select((F.col("event_id") - 1).alias("event_id"), F.col("old").alias("new")), "event_id")
    leaves = F.map_zip_with("old", "new", lambda path, x, y: F.struct(x.alias("before"), y.alias("after")))
    return met.select("event_id", F.explode(leaves).alias("path", "v")).select("event_id", "path", "v.*").filter(~F.col("before").eqNullSafe(F.col("after")))


@query("ledger_trail", LEDGER_SQL + "SELECT id, kind, person, sec FROM l WHERE task = 11")
def trail(spark, sf):
    """O-W29."""
    return ledger(spark, sf).filter("task = 11").select("id", "kind", "person", "sec")


@query("ledger_effective_versions", LEDGER_SQL + "SELECT kind, max(sec) AS sec, arg_max(id, sec * 1000000 + id) AS id FROM l GROUP BY kind")
def effective_versions(spark, sf):
    """O-W30, O-J10: the latest version of each key."""
    return ledger(spark, sf).groupBy("kind").agg(F.max("sec").alias("sec"), F.max_by("id", F.struct("sec", "id")).alias("id"))


@query("ledger_abandon_reasons", LEDGER_SQL + "SELECT kind, rating AS reason, count(*) AS n FROM l WHERE status = 'descartada' GROUP BY ALL")
def abandon_reasons(spark, sf):
    """O-W33."""
    return ledger(spark, sf).filter("status = 'descartada'").groupBy("kind", F.col("rating").alias("reason")).agg(F.count("*").alias("n"))


@query("ledger_my_assignments", LEDGER_SQL + "SELECT l.id, l.task, l.status, t.n FROM l JOIN (SELECT task, count(*) AS n FROM l GROUP BY task) t USING (task) WHERE person = 2")
def my_assignments(spark, sf):
    """O-W34, O-W23."""
    rows = ledger(spark, sf)
    return rows.filter("person = 2").join(rows.groupBy("task").agg(F.count("*").alias("n")), "task").select("id", "task", "status", "n")


@query("ledger_conversation_state", "WITH u AS (SELECT conv_id, turn, (conv_id * 5 + turn) % 4 = 0 AS undecided FROM conversations), f AS (SELECT conv_id, min(turn) FILTER (WHERE undecided) AS pending, max(turn) AS last FROM u GROUP BY conv_id) SELECT conv_id, pending, (SELECT count(*) FROM u WHERE u.conv_id = f.conv_id AND (pending IS NULL OR turn < pending)) AS n_history FROM f")
def conversation_state(spark, sf):
    """O-W24: the first undecided round, and the decided ones before it."""
    u = table(spark, sf, "conversations").select("conv_id", "turn", (F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(4)) == 0).alias("undecided"))
    first = F.min(F.when(F.col("undecided"), F.col("turn"))).over(W.partitionBy("conv_id"))
    return u.withColumn("pending", first).groupBy("conv_id", "pending").agg(F.count_if(F.col("pending").isNull() | (F.col("turn") < F.col("pending"))).alias("n_history"))


@query("ledger_import_new", LEDGER_SQL + "SELECT id FROM l WHERE kind = 'purchase' AND id % 4 <> 1")
def import_new(spark, sf):
    """O-W38: insert what the natural key does not have yet."""
    rows = ledger(spark, sf)
    return rows.filter("kind = 'purchase'").join(rows.filter("id % 4 = 1").select("id"), "id", "left_anti").select("id")


@query("ledger_latency", "SELECT event_type, median(value) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency(spark, sf):
    """O-W46."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("ledger_deliverables", LEDGER_SQL + "SELECT task, person, id, status, coalesce(CASE WHEN id % 6 = 0 THEN 'corrected-' || id END, 'submitted-' || id) AS final FROM l WHERE status = 'avaliada' AND NOT synthetic")
def deliverables(spark, sf):
    """O-W12, O-W13: the corrected payload, else the submitted one."""
    corrected = F.when(F.pmod("id", F.lit(6)) == 0, F.concat(F.lit("corrected-"), "id"))
    return ledger(spark, sf).filter("status = 'avaliada' AND NOT synthetic").select("task", "person", "id", "status", F.coalesce(corrected, F.concat(F.lit("submitted-"), "id")).alias("final"))
