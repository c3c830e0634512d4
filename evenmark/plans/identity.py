"""Queries on names, calendars and reference joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import calendar as C
from ..functions.names import normal_name
from ..operators import identity as I
from .registry import query

NAMES = "SELECT DISTINCT p_brand AS brand, substr(p_name, 1, length(p_name) - 1) AS name FROM part"
SCORES = f"SELECT q.brand, q.name, c.p_name AS identity, jaro_winkler_similarity(replace(q.name, ' ', ''), replace(c.p_name, ' ', '')) AS score FROM ({NAMES}) q JOIN (SELECT DISTINCT p_brand, p_name FROM part) c ON q.brand = c.p_brand"


def _names(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_brand").alias("brand"), F.expr("substr(p_name, 1, length(p_name) - 1)").alias("name")), p.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("identity"), F.col("p_name").alias("alias"))


@query("f1_name_tokens", "SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(lower(strip_accents(p_name || ' Jr.')), '[^a-z0-9]+', ' ', 'g'), '( (jr|sr|ii|iii|iv|v))+ *$', '')) AS name FROM part")
def f1(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), normal_name(F.concat("p_name", F.lit(" Jr."))).alias("name"))


@query("f2_alias_scores", f"SELECT brand, name, identity, round(score, 6) AS score FROM ({SCORES}) WHERE score >= 0.94")
def f2(spark, sf):
    names, candidates = _names(spark, sf)
    return I.scored_pairs(names, candidates, ["brand"], 0.94).withColumn("score", F.round("score", 6))


MATCH = f"SELECT brand, name, identity, score FROM (SELECT *, row_number() OVER (PARTITION BY brand, name ORDER BY score DESC, identity) AS n, lead(score) OVER (PARTITION BY brand, name ORDER BY score DESC, identity) AS next FROM ({SCORES})) WHERE n = 1 AND score >= 0.94 AND score - coalesce(next, 0) >= 0.04 - 1e-12"


@query("j13_match_identity", f"SELECT brand, name, identity, round(score, 6) AS score FROM ({MATCH})")
def j13(spark, sf):
    return I.match_identities(*_names(spark, sf), ["brand"]).where("accepted").select("brand", "name", "identity", F.round("score", 6).alias("score"))


@query("j14_crosswalk_resolution", f"WITH k AS (SELECT brand, name, 'known' AS identity FROM ({NAMES}) WHERE name LIKE 'b%') SELECT * FROM k UNION ALL SELECT brand, name, identity FROM ({MATCH}) WHERE (brand, name) NOT IN (SELECT (brand, name) FROM k)")
def j14(spark, sf):
    names, candidates = _names(spark, sf)
    known = names.where("name LIKE 'b%'").distinct().withColumn("identity", F.lit("known"))
    return I.resolve_crosswalk(names, known, candidates, ["brand"])


@query("j10_latest_snapshot", "SELECT m.season, m.week, player, team FROM (SELECT season, week FROM roster ORDER BY season DESC, week DESC LIMIT 1) m LEFT JOIN (SELECT * FROM roster WHERE team IN (3, 4, 5)) r ON m.season = r.season AND m.week = r.week")
def j10(spark, sf):
    return I.latest_snapshot(view(spark, sf, "roster"), ["season", "week"], F.col("team").isin(3, 4, 5)).select("season", "week", "player", "team")


@query("j15_reference_lookup", "SELECT s_suppkey AS id, n_name AS nation, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey + s_suppkey % 3 = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j15(spark, sf):
    n, r = spark.read.parquet(f"{sf}/nation.parquet"), spark.read.parquet(f"{sf}/region.parquet")
    s = spark.read.parquet(f"{sf}/supplier.parquet").withColumn("n_nationkey", F.col("s_nationkey") + F.col("s_suppkey") % 3)
    return s.join(n, "n_nationkey", "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("j16_nearest_weather", """WITH k AS (SELECT o_orderkey AS game, 19723 + o_orderkey % 40 AS day, (19723 + o_orderkey % 40) * 86400000000 + (o_orderkey % 1440) * 60000000 AS tm FROM orders), w AS (SELECT event_id, ts, ts // 86400000000 AS day FROM ticks WHERE event_type = 'view')
    SELECT game, event_id, far FROM (SELECT game, event_id, abs(ts - tm) AS far, row_number() OVER (PARTITION BY game ORDER BY abs(ts - tm), ts, event_id) AS n FROM k LEFT JOIN w USING (day)) WHERE n = 1""")
def j16(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    day = F.col("o_orderkey") % 40 + 19723
    k = o.select(F.col("o_orderkey").alias("game"), day.alias("day"), (day * 86_400_000_000 + (F.col("o_orderkey") % 1440) * 60_000_000).alias("at"))
    w = view(spark, sf, "ticks").where("event_type = 'view'").select("event_id", "ts", F.expr("ts div 86400000000").alias("day"))
    return I.nearest_in_time(k, w, ["day"], "at", "ts", ["event_id"]).select("game", "nearest.event_id", "far")


SEASONS = ((2024, 19971), (2025, 20335), (2026, 20699))


def weeks(spark):
    return spark.createDataFrame([(s, w, d + 7 * (w - 1), d + 7 * w) for s, d in SEASONS for w in range(1, 19)], "season int, week int, start long, end long")


WEEKS = "SELECT season, CAST(w AS INT) AS week, d + 7 * (w - 1) AS start, d + 7 * w AS stop FROM (VALUES (2024, 19971), (2025, 20335), (2026, 20699)) s(season, d) CROSS JOIN range(1, 19) r(w)"


@query("j20_calendar_weeks", f"SELECT video, season, week FROM videos LEFT JOIN ({WEEKS}) w ON published >= start AND published < stop")
def j20(spark, sf):
    return I.calendar_weeks(view(spark, sf, "videos").select("video", "published"), weeks(spark), "published").drop("published")


WALL = "local_day * 86400 + local_minute * 60"


@query("f8_wall_clock_instant", f"""WITH c AS (SELECT game, {WALL} AS wall, unnest([4, 5]) AS h FROM schedule), k AS (SELECT game, wall + h * 3600 AS tm FROM c WHERE epoch((to_timestamp(wall + h * 3600)) AT TIME ZONE 'America/New_York') = wall)
    SELECT s.game, CASE WHEN count(tm) = 1 THEN min(tm) END AS instant FROM schedule s LEFT JOIN k ON s.game = k.game GROUP BY s.game""")
def f8(spark, sf):
    return view(spark, sf, "schedule").select("game", C.wall_clock_instant(F.expr(WALL)).alias("instant"))


@query("f9_league_week", "SELECT event_id, CAST(floor((floor(epoch(to_timestamp(ts // 1000000) AT TIME ZONE 'America/New_York') / 86400) - 19725) / 7) + 1 AS BIGINT) AS week FROM ticks")
def f9(spark, sf):
    return view(spark, sf, "ticks").select("event_id", C.week_number(F.expr("ts div 1000000"), 19725).alias("week"))


@query("f9_week_labels", "WITH w AS (SELECT CAST(floor((ts // 86400000000 - 19730) / 7) + 1 AS BIGINT) AS week FROM ticks) SELECT CASE WHEN week < 1 THEN 'preseason' WHEN week > 2 THEN 'playoffs' ELSE 'Week ' || week END AS label, count(*) AS n FROM w GROUP BY 1")
def f9b(spark, sf):
    w = C.week_number(F.expr("ts div 1000000"), 19730, "UTC")
    return view(spark, sf, "ticks").groupBy(C.week_label(w, 2).alias("label")).agg(F.count("*").alias("n"))


@query("f10_season_of_date", "SELECT o_orderkey AS id, year(o_orderdate) - CASE WHEN month(o_orderdate) < 3 THEN 1 ELSE 0 END AS season FROM orders")
def f10(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), C.season_of(F.col("o_orderdate")).alias("season"))


@query("p12_slate_filter", "SELECT event_id, prop FROM ticks WHERE ts >= 1704700800000000 AND ts < 1705305600000000")
def p12(spark, sf):
    return view(spark, sf, "ticks").where((F.col("ts") >= 1_704_700_800_000_000) & (F.col("ts") < 1_705_305_600_000_000)).select("event_id", "prop")


@query("f17_label_final_instant", "WITH b AS (SELECT event_id, ts // 1000000 AS b FROM ticks), n AS (SELECT *, (b // 86400 + (7 - b // 86400 % 7) % 7) * 86400 + 43200 AS noon FROM b) SELECT event_id, greatest(b + 259200, CASE WHEN noon <= b THEN noon + 604800 ELSE noon END) AS final_at FROM n")
def f17(spark, sf):
    return view(spark, sf, "ticks").select("event_id", C.final_label_instant(F.expr("ts div 1000000")).alias("final_at"))


DURATIONS = "'PT' || CASE WHEN n_chars % 5 > 0 THEN CAST(n_chars % 5 AS VARCHAR) || 'H' ELSE '' END || CASE WHEN n_chars % 3 > 0 THEN CAST(n_chars % 60 AS VARCHAR) || 'M' ELSE '' END"


@query("f6_iso_duration", "SELECT doc_id, CASE WHEN n_chars % 15 = 0 THEN NULL ELSE (n_chars % 5) * 3600 + CASE WHEN n_chars % 3 > 0 THEN n_chars % 60 * 60 ELSE 0 END END AS seconds FROM documents")
def f6(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", C.iso_duration(F.expr(DURATIONS.replace("VARCHAR", "STRING"))).alias("seconds"))


_NIGHT = "CAST(epoch(timezone('America/New_York', TIMESTAMP '1970-01-01' + INTERVAL (19725 + (week - {}) * 7) DAY)) AS BIGINT)"


@query("f9_week_window", f"""WITH w AS (SELECT event_id, CAST(floor((floor(epoch(to_timestamp(ts // 1000000) AT TIME ZONE 'America/New_York') / 86400) - 19725) / 7) + 1 AS BIGINT) AS week FROM ticks)
    SELECT event_id, week, CASE WHEN week < 1 THEN 'preseason' WHEN week > 2 THEN 'playoffs' ELSE 'Week ' || week END AS label, CASE WHEN week < 1 THEN 'preseason' WHEN week > 2 THEN 'playoffs' ELSE 'regular-season' END AS phase, {_NIGHT.format(1)} AS start, {_NIGHT.format(0)} AS "end" FROM w""")
def f9_window(spark, sf):
    weeks = view(spark, sf, "ticks").select("event_id", C.week_number(F.expr("ts div 1000000"), 19725).alias("week"))
    return weeks.select("event_id", "week", C.week_label(F.col("week"), 2).alias("label"), C.week_phase(F.col("week"), 2).alias("phase"), C.week_window(F.col("week"), 19725).alias("w")).select("event_id", "week", "label", "phase", "w.start", "w.end")
