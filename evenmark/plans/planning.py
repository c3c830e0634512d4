"""Queries on planning and collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import planning as L
from .registry import query

EVENTS = "SELECT game AS event, local_day * 86400 + local_minute * 60 AS kickoff, season AS slate FROM schedule"


def _events(spark, sf):
    return view(spark, sf, "schedule").selectExpr("game AS event", "local_day * 86400 + local_minute * 60 AS kickoff", "season AS slate")


NY = "epoch(to_timestamp({x}) AT TIME ZONE 'America/New_York')"
PLAN = f"""e AS ({EVENTS}), d AS (SELECT *, CAST(floor({NY.format(x='kickoff')} / 86400) AS BIGINT) AS day FROM e), t AS (SELECT *, day - (day - 5 + 70) % 7 AS tue FROM d),
    s AS (SELECT event, kickoff, day, name, tue + k AS on_day, (tue + k) * 86400 + 72000 AS wall FROM t CROSS JOIN (VALUES (0, 'tuesday-opening'), (1, 'wednesday-evening'), (2, 'thursday-evening'), (3, 'friday-final-practice'), (4, 'saturday-evening'), (5, 'sunday-evening')) x(k, name)),
    i AS (SELECT event, kickoff, name, CASE WHEN {NY.format(x='wall + 14400')} = wall THEN wall + 14400 ELSE wall + 18000 END AS due FROM s WHERE on_day < day),
    a AS (SELECT * FROM i WHERE due < kickoff UNION ALL SELECT event, kickoff, 't-6h', kickoff - 21600 FROM e UNION ALL SELECT event, kickoff, 't-15m', kickoff - 900 FROM e),
    p AS (SELECT event, name AS checkpoint, due, coalesce(lead(due) OVER (PARTITION BY event ORDER BY due, name), kickoff) AS due_end FROM a)"""


@query("f14_baseline_checkpoints", f"WITH {PLAN} SELECT event, checkpoint, due, due_end FROM p")
def f14(spark, sf):
    return L.baseline_plan(_events(spark, sf))


@query("w8_checkpoint_windows", f"WITH {PLAN} SELECT checkpoint, count(*) AS n, CAST(sum(due_end - due) AS BIGINT) AS seconds FROM p GROUP BY checkpoint")
def w8(spark, sf):
    return L.baseline_plan(_events(spark, sf)).groupBy("checkpoint").agg(F.count("*").alias("n"), F.sum(F.col("due_end") - F.col("due")).alias("seconds"))


@query("f15_priority_schedule", """WITH t AS (SELECT game AS target, local_day * 86400 + local_minute * 60 AS kickoff, local_day * 86400 + local_minute * 60 - 3600 * (1 + game % 20) - 17 AS activated FROM schedule),
    u AS (SELECT target, kickoff, unnest(list_concat(CASE WHEN activated < kickoff - 21600 THEN range(activated, kickoff - 21600, 3600) ELSE [] END, range(greatest(activated, kickoff - 21600), kickoff, 300))) AS due FROM t)
    SELECT target, row_number() OVER (PARTITION BY target ORDER BY due) - 1 AS step, due, coalesce(lead(due) OVER (PARTITION BY target ORDER BY due), kickoff) AS due_end FROM u""")
def f15(spark, sf):
    t = view(spark, sf, "schedule").selectExpr("game AS target", "local_day * 86400 + local_minute * 60 AS kickoff", "local_day * 86400 + local_minute * 60 - 3600 * (1 + game % 20) - 17 AS activated")
    return L.priority_plan(t)


DUE = "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END AS status, CAST(prop % 5 AS BIGINT) * 10 AS rank, CAST(floor(value) AS BIGINT) % 12 AS cost, ts // 1000000 AS due, ts // 1000000 + 86400 * (1 + event_id % 9) AS due_end, event_id % 4 AS attempts FROM ticks"
NOW = 1705300000


def _due(spark, sf):
    return view(spark, sf, "ticks").selectExpr("event_id AS id", "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END AS status", "CAST(prop % 5 AS BIGINT) * 10 AS rank", "CAST(floor(value) AS BIGINT) % 12 AS cost", "ts div 1000000 AS due", "ts div 1000000 + 86400 * (1 + event_id % 9) AS due_end", "event_id % 4 AS attempts")


@query("t2_due_selection", f"SELECT id, rank, due FROM ({DUE}) WHERE status = 'pending' AND due <= {NOW} AND due_end > {NOW} AND rank <= 30 AND cost <= 9 ORDER BY rank, due, id LIMIT 200")
def t2(spark, sf):
    return L.select_due(_due(spark, sf), NOW, 9, 5, 4, 200).select("id", "rank", "due")


@query("t2_expired_reasons", f"SELECT CASE WHEN attempts > 0 THEN 'attempts-exhausted' WHEN cost > 8 THEN 'quota-exhausted' ELSE 'window-missed' END AS reason, count(*) AS n FROM ({DUE}) WHERE status = 'pending' AND due_end <= {NOW} GROUP BY 1")
def t2b(spark, sf):
    return L.expired_reasons(_due(spark, sf), NOW).groupBy("reason").agg(F.count("*").alias("n"))


@query("t3_baseline_events", f"SELECT slate, event, kickoff FROM (SELECT *, row_number() OVER (PARTITION BY slate ORDER BY kickoff DESC, event DESC) AS n FROM ({EVENTS}) WHERE CAST(floor({NY.format(x='kickoff')} / 86400) AS BIGINT) % 7 = 3) WHERE n = 1")
def t3(spark, sf):
    return L.baseline_events(_events(spark, sf), "free-pilot").select("slate", "event", "kickoff")


@query("p18_freshness", f"SELECT event_id, CASE WHEN event_type <> 'error' AND {NOW} - ts // 1000000 < 300000 THEN 'fresh' WHEN event_id % 3 = 0 AND {NOW} - ts // 1000000 < 600000 THEN 'pending' WHEN event_type <> 'error' THEN 'stale' ELSE 'unavailable' END AS freshness FROM ticks")
def p18(spark, sf):
    t = view(spark, sf, "ticks")
    at = F.expr("ts div 1000000")
    rows = t.select("event_id", F.when(F.col("event_type") != "error", at).alias("stored_at"), F.when(F.col("event_id") % 3 == 0, at).alias("claimed_at"))
    return L.freshness(rows, NOW, 300_000, 600_000).select("event_id", "freshness")


END = 1706600000


@query("a23_collector_health", f"""WITH r AS (SELECT *, ts // 1000000 AS t FROM requests), g AS (SELECT subject, max(t) FILTER (WHERE kind = 'view') AS wake, arg_max(kind, (t, event_id)) AS last_kind, count(*) FILTER (WHERE kind = 'error' AND {END} - t <= 200000) AS re, count(*) FILTER (WHERE kind = 'error') AS e, arg_max(k, (t, event_id)) AS quota FROM r GROUP BY subject)
    SELECT subject, concat_ws('|', CASE WHEN wake IS NULL THEN 'missing-scheduled-wake' END, CASE WHEN {END} - wake > 200000 THEN 'scheduled-wake-stale' END, CASE WHEN last_kind = 'error' THEN 'latest-scheduled-wake-failed' END, CASE WHEN re > 1 THEN 'repeated-checkpoint-failure' END, CASE WHEN e > 20 THEN 'exhausted-checkpoint-failure' END, CASE WHEN quota = 0 THEN 'quota-blocks-next-checkpoint' END) AS reasons,
    CASE WHEN quota IS NULL THEN 'quota-state-unavailable' WHEN quota BETWEEN 1 AND 20 THEN 'quota-policy-degraded' ELSE '' END AS warnings FROM g""")
def a23(spark, sf):
    r = view(spark, sf, "requests").withColumn("ts", F.expr("ts div 1000000"))
    return L.collector_health(r, END, 200_000).select("subject", F.array_join("reasons", "|").alias("reasons"), F.array_join("warnings", "|").alias("warnings"))


BUCKETS = "SELECT subject, ts // 60000000 * 60 AS minute, count(*) FILTER (WHERE kind <> 'error') AS admitted, count(*) FILTER (WHERE kind = 'error') AS denied, count(*) FILTER (WHERE kind = 'view') AS views FROM requests GROUP BY ALL"


@query("a24_usage_report", f"""WITH b AS ({BUCKETS}), l AS (SELECT p AS period, m AS measure, subject, sum(CASE WHEN {END} - minute <= s THEN CASE m WHEN 'admitted' THEN admitted WHEN 'denied' THEN denied ELSE views END ELSE 0 END) AS n FROM b CROSS JOIN (VALUES ('1h', 3600), ('24h', 86400)) x(p, s) CROSS JOIN (VALUES ('admitted'), ('denied'), ('views')) y(m) WHERE {END} - minute <= 86400 GROUP BY ALL)
    SELECT period, measure, CAST(place AS INT) AS place, subject, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY period, measure ORDER BY n DESC, subject) AS place FROM l WHERE n > 0) WHERE place <= 20 UNION ALL SELECT period, measure, 0, NULL, CAST(sum(n) AS BIGINT) FROM l GROUP BY ALL""")
def a24(spark, sf):
    k = F.col("kind")
    b = view(spark, sf, "requests").groupBy("subject", F.expr("ts div 60000000 * 60").alias("minute")).agg(F.count_if(k != "error").alias("admitted"), F.count_if(k == "error").alias("denied"), F.count_if(k == "view").alias("views"))
    return L.usage_report(b, END, ["admitted", "denied", "views"])


@query("s11_telemetry_rules", "SELECT coalesce(problem, 'valid') AS problem, count(*) AS n FROM (SELECT CASE WHEN k IS NULL THEN 'quota-missing' WHEN kind = 'error' AND value > 60 THEN 'error-with-large-cost' WHEN kind <> 'error' AND value < 0.5 THEN 'success-without-cost' WHEN k > 95 THEN 'quota-out-of-range' END AS problem FROM requests) GROUP BY 1")
def s11(spark, sf):
    good, bad = L.split_telemetry(view(spark, sf, "requests"))
    return good.withColumn("problem", F.lit("valid")).unionByName(bad).groupBy("problem").agg(F.count("*").alias("n"))
