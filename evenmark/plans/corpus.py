"""Queries on the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import corpus as K
from ..operators.identity import calendar_weeks
from .identity import WEEKS, weeks
from .registry import query

TERMS = {"league": ["the", "la"], "prop": ["and", "de"], "strong_prop": ["and"], "other": ["thou", "des"], "fantasy": ["is"], "picks": ["of"], "team": ["that"]}


def _any(text: str, name: str) -> str:
    return f"regexp_matches({text}, ' ({'|'.join(TERMS[name])}) ')"


PLACED = f"SELECT v.*, w.season, w.week FROM videos v LEFT JOIN ({WEEKS}) w ON published >= start AND published < stop"
CLASSIFIED = f"""SELECT *, CASE WHEN season IS NULL THEN 'outside-registered-regular-season' WHEN duration < 60 THEN 'short-form' WHEN {_any('t', 'other')} AND NOT {_any('t', 'league')} THEN 'other-league-in-title'
    WHEN {_any('t', 'fantasy')} AND NOT {_any('t', 'strong_prop')} THEN 'fantasy-in-title' WHEN {_any('t', 'other')} THEN 'mixed-league-title' WHEN {_any('t', 'prop')} AND {_any('t', 'league')} THEN 'prop-and-nfl-signal-in-title'
    WHEN {_any('t', 'prop')} AND {_any('t', 'team')} THEN 'nfl-signal-team-name-only' WHEN {_any('t', 'prop')} AND {_any('b', 'league')} THEN 'nfl-signal-description-only' WHEN {_any('t', 'league')} AND {_any('t', 'picks')} THEN 'picks-without-prop-signal'
    WHEN {_any('t', 'league')} AND {_any('b', 'prop')} THEN 'prop-signal-description-only' WHEN {_any('t', 'prop')} THEN 'no-nfl-signal' ELSE 'no-prop-signal' END AS reason FROM
    (SELECT *, ' ' || trim(regexp_replace(regexp_replace(lower(title), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t, ' ' || trim(regexp_replace(regexp_replace(lower(body), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) || ' ' AS b FROM ({PLACED}))"""
STATUS = f"SELECT *, CASE WHEN reason = 'prop-and-nfl-signal-in-title' THEN 'candidate' WHEN reason IN ('mixed-league-title', 'nfl-signal-team-name-only', 'nfl-signal-description-only', 'picks-without-prop-signal', 'prop-signal-description-only') THEN 'needs-review' ELSE 'excluded' END AS status FROM ({CLASSIFIED})"


def _videos(spark, sf):
    return K.classify(calendar_weeks(view(spark, sf, "videos"), weeks(spark), "published"), TERMS)


@query("f3_classify_titles", f"SELECT video, status, reason AS reasons FROM ({STATUS})")
def f3(spark, sf):
    return _videos(spark, sf).select("video", "status", F.array_join("reasons", "|").alias("reasons"))


@query("f4_title_match", """WITH p AS (SELECT c_custkey AS id, c_name AS a, CASE c_custkey % 4 WHEN 0 THEN upper(c_name) || ' ' WHEN 1 THEN replace(c_name, '#', ' - ') WHEN 2 THEN substr(c_name, 1, 12) ELSE 'Supplier' END AS b FROM customer), s AS (SELECT *, regexp_replace(lower(a), '[^a-z0-9]+', '', 'g') AS x, regexp_replace(lower(b), '[^a-z0-9]+', '', 'g') AS y FROM p)
    SELECT id, CASE WHEN lower(trim(a)) = lower(trim(b)) THEN 'exact' WHEN x = '' OR y = '' THEN 'mismatch' WHEN x = y THEN 'normalized' WHEN contains(x, y) OR contains(y, x) THEN 'partial' ELSE 'mismatch' END AS level FROM s""")
def f4(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS id", "c_name AS a", "CASE c_custkey % 4 WHEN 0 THEN upper(c_name) || ' ' WHEN 1 THEN replace(c_name, '#', ' - ') WHEN 2 THEN substr(c_name, 1, 12) ELSE 'Supplier' END AS b")
    return c.select("id", K.title_match(F.col("a"), F.col("b")).alias("level"))


@query("f5_url_ids", "SELECT page_id, CASE WHEN (regexp_extract(url, '^https?://([^/?#]+)', 1) = 'example.com' OR regexp_extract(url, '^https?://([^/?#]+)', 1) LIKE '%.example.com') AND regexp_matches(regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1), '^[a-z]{2}$') THEN regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1) END AS id FROM pages")
def f5(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", K.url_id(F.col("url"), ["example.com"]).alias("id"))


@query("f7_composite_keys", "SELECT CASE side WHEN 'Yes' THEN concat_ws(':', 'yes', event, market, player) ELSE concat_ws(':', 'line', event, market, player, CAST(CAST(point * 2 AS BIGINT) AS VARCHAR)) END AS key, count(*) AS n FROM outcomes GROUP BY 1")
def f7(spark, sf):
    o = view(spark, sf, "outcomes")
    s = lambda c: F.col(c).cast("string")
    key = F.when(F.col("side") == "Yes", F.concat_ws(":", F.lit("yes"), s("event"), "market", s("player"))).otherwise(F.concat_ws(":", F.lit("line"), s("event"), "market", s("player"), (F.col("point") * 2).cast("long").cast("string")))
    return o.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("f11_text_intake", "SELECT doc_id, sha256(t) AS sha256, length(t) AS characters, CASE WHEN regexp_matches(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') THEN 'transcript-invalid-characters' WHEN trim(t) = '' THEN 'transcript-empty' WHEN strlen(t) > 20000 THEN 'transcript-too-large' WHEN length(t) < 500 THEN 'transcript-too-short' END AS problem FROM (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents)")
def f11(spark, sf):
    return K.check_intake(spark.read.parquet(f"{sf}/documents.parquet"), "text", 500, 20_000).select("doc_id", "sha256", "characters", "problem")


@query("f16_staleness", "SELECT video, published IS NULL OR published > 20500 OR 20500 - published > 300 AS stale FROM videos")
def f16(spark, sf):
    return view(spark, sf, "videos").select("video", K.is_stale(F.col("published"), 20500, 300).alias("stale"))


@query("w6_effective_decisions", "SELECT key, position, kind FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY position DESC) AS n FROM decisions) WHERE n = 1 AND kind <> 'clear'")
def w6(spark, sf):
    return K.effective_decisions(view(spark, sf, "decisions").select("key", "position", "kind"), "key", ["position"])


@query("w9_log_states", "SELECT kind, coalesce(before, 'start') AS before, count(*) AS n, NOT (coalesce(before, 'start'), kind) IN (('start', 'clear'), ('start', 'include'), ('clear', 'include'), ('include', 'exclude'), ('exclude', 'include')) AS illegal FROM (SELECT *, lag(kind) OVER (PARTITION BY key ORDER BY position) AS before FROM decisions) GROUP BY ALL")
def w9(spark, sf):
    allowed = [(None, "clear"), (None, "include"), ("clear", "include"), ("include", "exclude"), ("exclude", "include")]
    out = K.check_log(view(spark, sf, "decisions"), "key", ["position"], allowed)
    return out.groupBy("kind", F.coalesce("before", F.lit("start")).alias("before"), "illegal").agg(F.count("*").alias("n"))


LOG = "SELECT key, row_number() OVER (PARTITION BY key ORDER BY position) AS p, sha256(coalesce(length(kind) || ':' || kind, '-') || coalesce(length(text) || ':' || text, '-')) AS f FROM decisions"


@query("w12_log_positions", f"SELECT key, p AS log_position, f AS fingerprint FROM ({LOG})")
def w12(spark, sf):
    return K.number_log(view(spark, sf, "decisions"), "key", ["position"], ["kind", "text"]).select("key", "log_position", "fingerprint")


STORED = "SELECT key, p, CASE WHEN key % 7 = 0 AND p = 2 THEN 'x' ELSE f END AS f FROM l WHERE key % 5 > 0 OR p < 3 UNION ALL SELECT key, p + 100, f FROM l WHERE key % 11 = 0"
TAIL = f"""l AS ({LOG}), s AS ({STORED}), j AS (SELECT coalesce(i.key, s.key) AS key, count(i.f) AS n, count(s.f) AS m, min(CASE WHEN i.f <> s.f THEN s.p END) AS c FROM (SELECT * FROM l WHERE key % 3 > 0 OR p < 4) i FULL JOIN s ON i.key = s.key AND i.p = s.p GROUP BY 1),
    t AS (SELECT key, CASE WHEN n < m THEN 'history-truncated' WHEN c IS NOT NULL THEN 'history-changed' ELSE 'extends' END AS status, CASE WHEN n < m THEN n + 1 WHEN c IS NOT NULL THEN c END AS position, CASE WHEN n >= m AND c IS NULL THEN n - m ELSE 0 END AS appended FROM j)"""


@query("j22_history_tail", f"WITH {TAIL} SELECT * FROM t")
def j22(spark, sf):
    return _tail(spark, sf)


def _tail(spark, sf):
    log = K.number_log(view(spark, sf, "decisions"), "key", ["position"], ["kind", "text"]).select("key", "log_position", "fingerprint")
    changed = F.when((F.col("key") % 7 == 0) & (F.col("log_position") == 2), "x").otherwise(F.col("fingerprint"))
    stored = log.where("key % 5 > 0 OR log_position < 3").withColumn("fingerprint", changed).unionByName(log.where("key % 11 = 0").withColumn("log_position", F.col("log_position") + 100))
    return K.history_tail(K.chain_log(log.where("key % 3 > 0 OR log_position < 4"), "key"), K.chain_log(stored, "key"), "key")


@query("g4_import_plan", f"WITH {TAIL}, p AS (SELECT conv_id AS key, count(*) % 4 > 0 AS same FROM conversations GROUP BY 1), k AS (SELECT coalesce(t.key, p.key) AS key, CASE WHEN status <> 'extends' THEN 'refuse' WHEN appended = 0 AND same THEN 'no-op' ELSE 'append' END AS outcome, same FROM t FULL JOIN p USING (key)) SELECT key, outcome, CASE WHEN outcome = 'refuse' THEN 'none' WHEN same THEN 'keep' ELSE 'replace' END AS rows FROM k")
def g4(spark, sf):
    parity = view(spark, sf, "decisions").groupBy("key").agg((F.count("*") % 4 > 0).alias("same"))
    return K.import_plan(_tail(spark, sf), parity, "key")


GRID = f"""s AS ({STATUS}), g AS (SELECT creator, season, week FROM (SELECT DISTINCT creator FROM videos) CROSS JOIN (SELECT season, week FROM ({WEEKS}))), n AS (SELECT creator, season, week, count(*) FILTER (WHERE status = 'candidate') AS p, count(*) FILTER (WHERE status = 'needs-review') AS r FROM s GROUP BY ALL),
    k AS (SELECT g.*, CASE WHEN p > 0 THEN 'present' WHEN r > 0 THEN 'needs-review' ELSE 'missing' END AS slot, coalesce(p, 0) AS videos FROM g LEFT JOIN n USING (creator, season, week))"""


@query("j21_slot_grid", f"WITH {GRID} SELECT * FROM k")
def j21(spark, sf):
    v = _videos(spark, sf)
    return K.slot_grid(v, weeks(spark), v)


@query("a21_coverage_screen", f"WITH {GRID} SELECT creator, season, count(*) AS slots, count(*) FILTER (WHERE slot = 'present') AS present, count(*) FILTER (WHERE slot = 'needs-review') AS needs_review, count(*) FILTER (WHERE slot = 'missing') AS missing, round(count(*) FILTER (WHERE slot = 'present') / count(*), 6) AS share FROM k GROUP BY ROLLUP (creator, season)")
def a21(spark, sf):
    v = _videos(spark, sf)
    return K.coverage_screen(K.slot_grid(v, weeks(spark), v)).withColumn("share", F.round("share", 6))


DECIDED = "d AS (SELECT CASE WHEN n_chars % 6 = 0 THEN video + 1000000 WHEN n_chars % 6 = 1 THEN video // 2 ELSE video END AS video, CASE WHEN n_chars % 4 = 0 THEN ' ' ELSE 'ok' END AS reason FROM videos), w AS (SELECT video, duration >= 60 AS in_window FROM videos)"
PROBLEMS = "p AS (SELECT d.video, CASE WHEN w.video IS NULL THEN 'unknown-video' WHEN count(*) OVER (PARTITION BY d.video) > 1 THEN 'duplicate-decision' WHEN NOT in_window THEN 'outside-window' WHEN trim(reason) = '' THEN 'missing-reason' END AS problem FROM d LEFT JOIN w ON d.video = w.video)"


@query("f20_decision_problems", f"WITH {DECIDED}, {PROBLEMS} SELECT video, problem, count(*) AS n FROM p GROUP BY ALL")
def f20(spark, sf):
    return K.decision_problems(*_decided(spark, sf)).groupBy("video", "problem").agg(F.count("*").alias("n"))


def _decided(spark, sf):
    v = view(spark, sf, "videos")
    d = v.selectExpr("CASE WHEN n_chars % 6 = 0 THEN video + 1000000 WHEN n_chars % 6 = 1 THEN video div 2 ELSE video END AS video", "CASE WHEN n_chars % 4 = 0 THEN ' ' ELSE 'ok' END AS reason")
    return d, v.withColumn("in_window", F.col("duration") >= 60)


CAPTURES = "SELECT doc_id AS video, CASE WHEN toxic = 1 THEN 'unavailable' ELSE 'captured' END AS state FROM labels"


@query("a22_readiness", f"WITH {DECIDED}, {PROBLEMS}, b AS (SELECT DISTINCT video FROM p WHERE problem IS NOT NULL), c AS ({CAPTURES}) SELECT creator, count(*) AS videos, count(*) FILTER (WHERE state = 'captured') AS captured, round(count(*) FILTER (WHERE state = 'captured') / count(*), 6) AS rate, CASE count(*) FILTER (WHERE published > 20500 OR 20500 - published > 400) WHEN 0 THEN 'fresh' WHEN count(*) THEN 'stale' ELSE 'mixed' END AS freshness, count(b.video) AS unapplied FROM videos v LEFT JOIN c ON v.video = c.video LEFT JOIN b ON v.video = b.video GROUP BY ROLLUP (creator)")
def a22(spark, sf):
    d, v = _decided(spark, sf)
    return K.readiness(v, _captures(spark, sf), d, 20500, 400).withColumn("rate", F.round("rate", 6))


def _captures(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("video"), F.when(F.col("toxic") == 1, "unavailable").otherwise("captured").alias("state"))


@query("t5_capture_queue", f"WITH c AS ({CAPTURES}) SELECT creator, count(*) AS total, count(*) FILTER (WHERE state = 'captured') AS captured, count(*) FILTER (WHERE state = 'unavailable') AS unavailable, count(*) FILTER (WHERE state IS NULL) AS pending, arg_min(v.video, (published, v.video)) FILTER (WHERE state IS NULL) AS next FROM videos v LEFT JOIN c ON v.video = c.video GROUP BY creator")
def t5(spark, sf):
    return K.capture_queue(view(spark, sf, "videos"), _captures(spark, sf))


@query("t4_newest_submissions", "SELECT o_orderkey AS id, c_name AS owner FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def t4(spark, sf):
    o, c = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/customer.parquet")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("owner"))


@query("a32_group_expiry", "SELECT creator, video FROM videos WHERE creator || CAST(video % 7 AS VARCHAR) NOT IN (SELECT creator || CAST(video % 7 AS VARCHAR) FROM videos GROUP BY 1 HAVING min(published) < 20000)")
def a32(spark, sf):
    v = view(spark, sf, "videos").withColumn("grp", F.concat("creator", (F.col("video") % 7).cast("string")))
    return K.expired_groups(v, "grp", "published", 20000).select("creator", "video")


@query("u3_requested_not_returned", "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def u3(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").exceptAll(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id"))


@query("p15_leak_scan", """WITH r AS (SELECT 'documents' AS source, text AS t FROM documents UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'events', props FROM events)
    SELECT source, CASE WHEN regexp_matches(t, '^\\{"k"') THEN 'payload' WHEN t LIKE '{%' THEN 'json' ELSE 'text' END AS kind, count(*) AS rows, CAST(sum(len(regexp_extract_all(t, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}'))) AS BIGINT) AS addresses FROM r GROUP BY ALL""")
def p15(spark, sf):
    r = lambda t, c: spark.read.parquet(f"{sf}/{t}.parquet").select(F.lit(t).alias("source"), F.col(c).alias("t"))
    rows = r("documents", "text").union(r("conversations", "text")).union(r("events", "props"))
    keys = F.when(F.col("t").startswith("{"), F.json_object_keys("t"))
    kind = F.when(F.array_contains(keys, "k"), "payload").when(F.col("t").startswith("{"), "json").otherwise("text")
    return rows.groupBy("source", kind.alias("kind")).agg(F.count("*").alias("rows"), F.sum(F.regexp_count("t", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"))).cast("long").alias("addresses"))


QUEUED = f"q AS (SELECT v.creator, v.video, published, 2024 AS season, (published - 19967) // 7 AS week, coalesce(c.state, 'needs-capture') AS state FROM videos v LEFT JOIN ({CAPTURES}) c ON c.video = v.video)"


def _items(spark, sf):
    videos = view(spark, sf, "videos").select("creator", "video", "published", F.lit(2024).alias("season"), F.floor((F.col("published") - 19967) / 7).alias("week"))
    return K.capture_items(videos, _captures(spark, sf))


@query("t5_pending_list", f"WITH {QUEUED}, n AS (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY published, video) AS place FROM q) SELECT creator, place, video, published FROM n WHERE state = 'needs-capture'")
def t5_pending(spark, sf):
    return _items(spark, sf).where("state = 'needs-capture'").select("creator", "place", "video", "published")


@query("t5_weekly_progress", f"""WITH {QUEUED}, s AS (SELECT creator, 2024 AS season, week FROM (SELECT DISTINCT creator FROM videos) CROSS JOIN (SELECT unnest(range(0, 100)) AS week))
    SELECT s.creator, s.season, s.week, count(*) FILTER (WHERE state = 'needs-capture') AS needs_capture, count(*) FILTER (WHERE state = 'captured') AS captured, count(*) FILTER (WHERE state = 'unavailable') AS unavailable FROM s LEFT JOIN q ON q.creator = s.creator AND q.week = s.week GROUP BY ALL""")
def t5_weekly(spark, sf):
    slots = view(spark, sf, "videos").select("creator").distinct().select("creator", F.lit(2024).alias("season"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))).alias("week"))
    return K.weekly_progress(slots, _items(spark, sf))
