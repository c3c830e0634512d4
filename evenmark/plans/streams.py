"""Queries on streams by their batch equivalents, and on sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import view
from ..sources import files as R
from ..sources import sinks as S
from ..sources.folders import shared_folder
from ..streaming import live as X
from .forecast import digest_sql
from .registry import query


def _ticks(spark, sf):
    return view(spark, sf, "ticks").selectExpr("*", "price AS over_price", "1 + (event_id % 7) / 5D AS under_price", "100 + event_id % 300 AS line", "event_id div 50 AS session")


SCORING = """WITH r AS (SELECT player, list(value) AS vals FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY kickoff DESC, game DESC) AS n FROM history) WHERE n <= 5 GROUP BY player),
    t AS (SELECT *, 1 + (event_id % 7) / 5 AS u, 100 + event_id % 300 AS line FROM ticks), j AS (SELECT event_id, prop, ts, CASE WHEN is_error THEN 'feed-error' WHEN vals IS NULL THEN 'no-history' WHEN price <= 1 OR u <= 1 THEN 'no-consensus' END AS error, len(list_filter(vals, lambda v: v > line)) / len(vals) - (1 / price) / (1 / price + 1 / u) AS edge FROM t LEFT JOIN r ON player = prop)
    SELECT event_id, prop, ts, error, CASE WHEN error IS NULL THEN round(edge, 6) END AS edge FROM j"""


@query("x1_live_scoring", SCORING)
def x1(spark, sf):
    return X.score_ticks(_ticks(spark, sf), view(spark, sf, "history")).withColumn("edge", F.round("edge", 6))


QUOTE = ["*", "event_id % 7 AS book", "100D + 50 * (event_id % 3) AS line", "price AS over_price", "1 + (event_id % 11) / 5D AS under_price"]
QUOTE_TTL = 72 * 3_600_000_000
#: For each quote, every book's latest quote within the time to live; then the median at the quote's line.
CONSENSUS = f"""WITH t AS (SELECT prop, event_id, ts, is_error, event_id % 7 AS book, CAST(100 + 50 * (event_id % 3) AS DOUBLE) AS line, price AS o, 1 + (event_id % 11) / 5 AS u FROM ticks),
    p AS (SELECT *, CASE WHEN o > 1 AND u > 1 THEN (1 / o) / (1 / o + 1 / u) END AS p FROM t),
    l AS (SELECT a.event_id, b.line, b.p, row_number() OVER (PARTITION BY a.event_id, b.book ORDER BY b.ts DESC, b.event_id DESC) AS n FROM p a JOIN p b ON a.prop = b.prop AND NOT b.is_error AND b.ts > a.ts - {QUOTE_TTL} AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id))),
    c AS (SELECT l.event_id, median(l.p) AS p_over, count(*) AS books FROM l JOIN p ON p.event_id = l.event_id WHERE n = 1 AND l.line = p.line AND l.p IS NOT NULL GROUP BY l.event_id),
    r AS (SELECT player, list(value) AS vals FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY kickoff DESC, game DESC) AS n FROM history) WHERE n <= 5 GROUP BY player),
    e AS (SELECT p.*, p_over, books, vals, CASE WHEN is_error THEN 'feed-error' WHEN books IS NULL THEN 'no-consensus' WHEN p IS NULL THEN 'invalid-anchor' WHEN vals IS NULL THEN 'no-history' END AS error FROM p LEFT JOIN c USING (event_id) LEFT JOIN r ON player = prop)
    SELECT prop, event_id, ts, error, CASE WHEN NOT is_error AND p IS NOT NULL THEN round(p_over, 9) END AS p_over, CASE WHEN NOT is_error THEN books END AS books, CASE WHEN error IS NULL THEN round(len(list_filter(vals, lambda v: v > line)) / len(vals) - p_over, 9) END AS edge FROM e"""


@query("x1_consensus_scoring", CONSENSUS)
def x1_consensus(spark, sf):
    found = X.books_consensus(view(spark, sf, "ticks").selectExpr(*QUOTE), QUOTE_TTL)
    return _rounded(X.score_consensus(found, view(spark, sf, "history")))


def _rounded(scores):
    return scores.withColumn("p_over", F.round("p_over", 9)).withColumn("edge", F.round("edge", 9))


REUSE = """WITH RECURSIVE s AS (SELECT prop, ts, event_id, row_number() OVER (PARTITION BY prop ORDER BY ts, event_id) AS n FROM ticks), g(prop, n, refresh, last) AS (SELECT prop, n, true, ts FROM s WHERE n = 1
    UNION ALL SELECT s.prop, s.n, s.ts - g.last >= 21600000000, CASE WHEN s.ts - g.last >= 21600000000 THEN s.ts ELSE g.last END FROM g JOIN s ON s.prop = g.prop AND s.n = g.n + 1)
    SELECT g.prop, s.ts, event_id, refresh FROM g JOIN s ON s.prop = g.prop AND s.n = g.n"""


@query("x2_shared_reuse", REUSE)
def x2(spark, sf):
    return X.reuse_within(view(spark, sf, "ticks"), 6 * 3_600_000_000)


@query("x3_staleness", """WITH r AS (SELECT *, lead(ts) OVER (PARTITION BY prop ORDER BY ts, event_id) AS nx FROM ticks) SELECT prop, event_id, ts, CASE WHEN is_error THEN 'stale' ELSE 'live' END AS state FROM r UNION ALL SELECT prop, event_id, ts + 21600000000, 'timed-out' FROM r WHERE NOT is_error AND coalesce(nx - ts > 21600000000, true)""")
def x3(spark, sf):
    return X.staleness(view(spark, sf, "ticks"), 6 * 3_600_000_000)


CAP = "SELECT prop, event_id, attempt FROM (SELECT *, row_number() OVER (PARTITION BY prop ORDER BY ts, event_id) AS attempt FROM ticks) WHERE attempt <= 20"


@query("x4_tick_cap", CAP)
def x4(spark, sf):
    return X.capped(view(spark, sf, "ticks"), 20).select("prop", "event_id", "attempt")


HISTORY = """WITH g AS (SELECT *, event_id // 50 AS s, coalesce(CAST(lag(event_id // 50) OVER (PARTITION BY prop ORDER BY ts, event_id) <> event_id // 50 AS INT), 1) AS n FROM ticks WHERE NOT is_error), r AS (SELECT *, sum(n) OVER (PARTITION BY prop ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT prop, event_id, CAST(run AS BIGINT) AS run, row_number() OVER (PARTITION BY prop, run ORDER BY ts, event_id) AS place FROM r"""


@query("x5_ev_history", HISTORY)
def x5(spark, sf):
    return X.ev_history(_ticks(spark, sf)).select("prop", "event_id", "run", "place")


#: Sessions, sample windows and stale ticks of a watched key; a day without a tick ends a spell.
WATCHED = ["*", "event_id div 400 AS session", "5 + event_id div 900 % 2 AS sample_window", "event_id % 6 = 0 AS is_stale"]
DAY = 24 * 3_600_000_000
SPELLS = f"""WITH g AS (SELECT prop, ts, event_id, event_id // 400 AS s, event_id // 900 % 2 AS w, event_id % 6 = 0 AS stale, coalesce(CAST(ts - lag(ts) OVER (PARTITION BY prop ORDER BY ts, event_id) >= {DAY} AS INT), 1) AS n FROM ticks WHERE NOT is_error),
    p AS (SELECT *, sum(n) OVER (PARTITION BY prop ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spell FROM g), c AS (SELECT *, coalesce(CAST(lag(s) OVER o <> s OR lag(w) OVER o <> w AS INT), 1) AS n2 FROM p WINDOW o AS (PARTITION BY prop, spell ORDER BY ts, event_id)),
    r AS (SELECT *, sum(n2) OVER (PARTITION BY prop, spell ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT prop, ts, event_id, CAST(run AS BIGINT) AS run, CASE WHEN NOT stale THEN CAST(count(*) FILTER (WHERE NOT stale) OVER (PARTITION BY prop, spell, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS place FROM r"""


@query("x5_watched_history", SPELLS)
def x5_watched(spark, sf):
    return X.watched_history(view(spark, sf, "ticks").selectExpr(*WATCHED), DAY)


BUCKETS = "SELECT subject, ts // 60000000 * 60 AS minute, count(*) AS total, count(*) FILTER (WHERE kind = 'view') AS view, count(*) FILTER (WHERE kind = 'click') AS click, count(*) FILTER (WHERE kind = 'purchase') AS purchase, count(*) FILTER (WHERE kind = 'error') AS error, count(*) FILTER (WHERE kind = 'signup') AS signup FROM requests GROUP BY ALL"


@query("x6_minute_buckets", BUCKETS)
def x6(spark, sf):
    return X.minute_buckets(view(spark, sf, "requests").withColumn("time", F.timestamp_micros("ts")), "time")


GCRA = """WITH RECURSIVE s AS (SELECT subject, event_id, ts, row_number() OVER (PARTITION BY subject ORDER BY ts, event_id) AS n FROM requests), g(subject, n, event_id, allowed, retry, tat) AS (
    SELECT subject, n, event_id, true, CAST(0 AS BIGINT), ts + 28800000000 FROM s WHERE n = 1
    UNION ALL SELECT s.subject, s.n, s.event_id, s.ts >= g.tat - 57600000000, CASE WHEN s.ts >= g.tat - 57600000000 THEN 0 ELSE g.tat - 57600000000 - s.ts END, CASE WHEN s.ts >= g.tat - 57600000000 THEN greatest(s.ts, g.tat) + 28800000000 ELSE g.tat END FROM g JOIN s ON s.subject = g.subject AND s.n = g.n + 1)
    SELECT subject, event_id, allowed, retry FROM g"""


@query("x7_gcra_replay", GCRA)
def x7(spark, sf):
    return X.replay_limits(view(spark, sf, "requests"), 8 * 3_600_000_000, 3)


@query("x8_late_rows", "SELECT prop, count(*) AS ticks, count(*) FILTER (WHERE ts >= 1704067200000000 + (prop % 30) * 86400000000) AS late FROM ticks GROUP BY prop")
def x8(spark, sf):
    t = view(spark, sf, "ticks")
    starts = t.select("prop").distinct().withColumn("start", 1_704_067_200_000_000 + (F.col("prop") % 30) * 86_400_000_000)
    return X.late_rows(t, starts, "prop").groupBy("prop").agg(F.count("*").alias("ticks"), F.count_if("late").alias("late"))


@query("x9_stream_retention", "SELECT subject, count(*) AS buckets FROM (SELECT DISTINCT subject, ts // 60000000 * 60 AS minute FROM requests) WHERE minute > 1706600000 - 604800 GROUP BY subject")
def x9(spark, sf):
    b = X.minute_buckets(view(spark, sf, "requests").withColumn("time", F.timestamp_micros("ts")), "time")
    return X.purge(b, 1_706_600_000).groupBy("subject").agg(F.count("*").alias("buckets"))


@query("s6_content_addressed_append", """WITH q AS (SELECT event, market, captured_at, sha256(string_agg(length(CAST(book AS VARCHAR)) || ':' || CAST(book AS VARCHAR) || length(CAST(player AS VARCHAR)) || ':' || CAST(player AS VARCHAR) || length(CAST(CAST(point * 2 AS BIGINT) AS VARCHAR)) || ':' || CAST(CAST(point * 2 AS BIGINT) AS VARCHAR), chr(10) ORDER BY length(CAST(book AS VARCHAR)) || ':' || CAST(book AS VARCHAR) || length(CAST(player AS VARCHAR)) || ':' || CAST(player AS VARCHAR) || length(CAST(CAST(point * 2 AS BIGINT) AS VARCHAR)) || ':' || CAST(CAST(point * 2 AS BIGINT) AS VARCHAR))) AS content_hash, count(*) AS quotes FROM quotes GROUP BY ALL)
    SELECT event, market, captured_at, content_hash, quotes FROM (SELECT *, row_number() OVER (PARTITION BY event, market, content_hash ORDER BY captured_at) AS n FROM q WHERE captured_at >= 9500) WHERE n = 1 AND (event, market, content_hash) NOT IN (SELECT (event, market, content_hash) FROM q WHERE captured_at < 9500)""")
def s6(spark, sf):
    q = view(spark, sf, "quotes").withColumn("point2", (F.col("point") * 2).cast("long"))
    sets = S.quote_sets(q, ["event", "market", "captured_at"], ["book", "player", "point2"])
    return S.new_quote_sets(sets.where("captured_at >= 9500"), sets.where("captured_at < 9500"), ["event", "market"], "captured_at").select("event", "market", "captured_at", "content_hash", "quotes")


@query("s4_append_evidence", "SELECT 'versions' AS feed, CAST(job % 4 AS INT) AS snapshot_id, normalizer_version, count(*) AS rows FROM versions CROSS JOIN (SELECT unnest(['v1', 'v2']) AS normalizer_version) GROUP BY ALL")
def s4(spark, sf):
    v = view(spark, sf, "versions").select(F.lit("versions").alias("feed"), (F.col("job") % 4).alias("snapshot_id"), "natural_key", "data", "state")
    path = _folder(spark, "evidence")
    for version in ("v1", "v2", "v1"):  # the last is a retry
        S.append_evidence(v, path, version)
    return spark.read.parquet(path).groupBy("feed", "snapshot_id", "normalizer_version").agg(F.count("*").alias("rows"))


PINNED = "(SELECT * FROM history WHERE season <> 1996)"


def _pinned(spark, sf) -> str:
    h = view(spark, sf, "history")
    rows, inputs = h.where("season <> 1996"), h.where("season <> 1996").select(F.concat(F.lit("snapshot-"), F.col("season").cast("string")).alias("input"))
    left_out = h.where("season = 1996").groupBy(F.lit("warm-up-only").alias("reason")).agg(F.count("*").alias("rows"))
    return S.publish_dataset(rows, _folder(spark, "datasets"), ["player", "game"], ["player", "game", "value"], inputs, left_out, "history-v1")


@query("s7_publish_dataset", f"SELECT rows, digest, (SELECT count(DISTINCT season) FROM history WHERE season <> 1996) AS inputs, (SELECT count(*) FROM history WHERE season = 1996) AS warm_up_only FROM ({digest_sql(PINNED)})")
def s7(spark, sf):
    return S.read_manifest(spark, _pinned(spark, sf)).select("rows", "digest", "inputs", F.coalesce(F.col("exclusions")["warm-up-only"], F.lit(0)).alias("warm_up_only"))


@query("s8_read_dataset", "SELECT player, game, season, value FROM history WHERE season <> 1996")
def s8(spark, sf):
    return S.read_dataset(spark, _pinned(spark, sf)).select("player", "game", "season", "value")


def _folder(spark, name: str) -> str:
    """A new folder in the space that executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_csv_feed", "SELECT position, season, count(*) AS rows, count(DISTINCT player_id) AS players FROM feed_stats GROUP BY ALL")
def s1(spark, sf):
    feed = view(spark, sf, "feed_stats").drop("l_orderkey")
    path = _folder(spark, "feed")
    feed.write.option("header", True).option("emptyValue", "").option("compression", "gzip").csv(path)
    return R.read_csv_feed(spark, path, feed.schema).groupBy("position", "season").agg(F.count("*").alias("rows"), F.countDistinct("player_id").alias("players"))


@query("s2_nested_odds", "SELECT event, book, market, side, count(*) AS n, round(sum(price), 4) AS prices FROM outcomes GROUP BY ALL")
def s2(spark, sf):
    path = _folder(spark, "odds")
    _responses(view(spark, sf, "outcomes")).write.option("compression", "gzip").json(path)
    out = R.read_odds(spark, path).groupBy(F.col("id").cast("long").alias("event"), F.col("book").cast("long").alias("book"), "market", "side")
    return out.agg(F.count("*").alias("n"), F.round(F.sum("price"), 4).alias("prices"))


def _responses(outcomes):
    """One nested response for each capture of an event, as the feed delivers it; outcomes are dealt by capture once, and nested there."""
    capture = ["event", "captured_at", "batch"]
    one = F.struct(F.col("side").alias("name"), F.col("player").cast("string").alias("description"), "price", "point")
    dealt = outcomes.select(*capture, "book", "market", "side", "player", "price", "point").repartition(*capture)
    m = dealt.groupBy(*capture, "book", "market").agg(F.collect_list(one).alias("outcomes"))
    b = m.groupBy(*capture, "book").agg(F.collect_list(F.struct(F.col("market").alias("key"), F.lit(None).cast("string").alias("last_update"), "outcomes")).alias("markets"))
    e = b.groupBy(*capture).agg(F.collect_list(F.struct(F.col("book").cast("string").alias("key"), "markets")).alias("bookmakers"))
    return e.select(F.col("event").cast("string").alias("id"), F.lit("sport").alias("sport_key"), F.lit("2024-01-01T00:00:00Z").alias("commence_time"), "bookmakers")


@query("s3_capture_log", "SELECT key, count(*) AS events, CAST(sum(length(text)) AS BIGINT) AS characters FROM decisions GROUP BY key")
def s3(spark, sf):
    log = view(spark, sf, "decisions").withColumn("sha256", F.sha2("text", 256))
    path = _folder(spark, "log")
    log.write.json(path)
    return R.read_log(spark, path, log.schema).groupBy("key").agg(F.count("*").alias("events"), F.sum(F.char_length("text")).cast("long").alias("characters"))


def _run(spark, stream, mode: str = "append"):
    """All of a stream over files into a table in the shared folder, then that table."""
    out, mark = _folder(spark, "stream"), _folder(spark, "stream-checkpoint")
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


#: Micro-batches of each stream.
BATCHES = 5


def _source(spark, sf, name: str):
    """A view's rows as a stream of BATCHES micro-batches, about in the order of time: rows come up to half an hour late, so state and late rows cross from one to the next."""
    X.O.use_rocksdb(spark)
    rows = view(spark, sf, name).withColumn("time", F.timestamp_micros("ts"))
    comes = F.col("ts") + F.pmod(F.xxhash64("event_id"), F.lit(1_800_000_000))
    cuts = [None, *rows.select(comes.cast("double").alias("c")).approxQuantile("c", [k / BATCHES for k in range(1, BATCHES)], 0.01), None]
    path = _folder(spark, "source")
    files = 1 + rows.count() // (BATCHES * 2_000_000)
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = rows.where((F.lit(True) if low is None else comes >= low) & (F.lit(True) if high is None else comes < high))
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _delayed(spark, sf, name: str):
    return _source(spark, sf, name).withWatermark("time", "1 hour")


WITH_LINES = ["*", "price AS over_price", "1 + (event_id % 7) / 5D AS under_price", "100 + event_id % 300 AS line", "event_id div 50 AS session"]
#: Where the watermark of an hour stands when all events are read, in milliseconds; and the rows that it has passed.
MARK = "(SELECT max(ts) // 1000 - 3600000 FROM {})"


def _passed(sql: str, table: str, columns: str = "*") -> str:
    return f"SELECT {columns} FROM ({sql}) WHERE ts <= 1000 * {MARK.format(table)}"


@query("x1_stream_scoring", SCORING)
def x1_stream(spark, sf):
    return _run(spark, X.score_ticks(_source(spark, sf, "ticks").selectExpr(*WITH_LINES), view(spark, sf, "history"))).withColumn("edge", F.round("edge", 6))


@query("x1_stream_consensus", _passed(CONSENSUS, "ticks"))
def x1_stream_consensus(spark, sf):
    found = X.stream_consensus(_delayed(spark, sf, "ticks").selectExpr(*QUOTE), QUOTE_TTL)
    return _rounded(_run(spark, X.score_consensus(found, view(spark, sf, "history"))))


@query("x2_stream_reuse", _passed(REUSE, "ticks"))
def x2_stream(spark, sf):
    return _run(spark, X.stream_reuse(_delayed(spark, sf, "ticks"), 6 * 3_600_000_000))


@query("x3_stream_staleness", f"""WITH r AS (SELECT *, lead(ts) OVER (PARTITION BY prop ORDER BY ts, event_id) AS nx FROM ticks) SELECT prop, event_id, ts, CASE WHEN is_error THEN 'stale' ELSE 'live' END AS state FROM r
    UNION ALL SELECT prop, event_id, ts + 270000000, 'timed-out' FROM r WHERE NOT is_error AND coalesce(nx - ts > 270000000, true) AND (ts + 270000000) // 1000 < {MARK.format('ticks')}""")
def x3_stream(spark, sf):
    return _run(spark, X.stream_staleness(_delayed(spark, sf, "ticks"), 270_000_000))


#: A day of silence closes a connection; the first three attempts of each.
CONNECTIONS = f"""WITH g AS (SELECT *, coalesce(CAST(ts - lag(ts) OVER (PARTITION BY prop ORDER BY ts, event_id) >= {DAY} AS INT), 1) AS n FROM ticks), c AS (SELECT *, sum(n) OVER (PARTITION BY prop ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM g)
    SELECT * FROM (SELECT prop, ts, event_id, row_number() OVER (PARTITION BY prop, c ORDER BY ts, event_id) AS attempt FROM c) WHERE attempt <= 3"""


@query("x4_stream_cap", _passed(CONNECTIONS, "ticks"))
def x4_stream(spark, sf):
    return _run(spark, X.stream_capped(_delayed(spark, sf, "ticks"), 3, DAY))


@query("x5_stream_history", _passed(SPELLS, "ticks"))
def x5_stream(spark, sf):
    return _run(spark, X.stream_history(_delayed(spark, sf, "ticks").selectExpr(*WATCHED), DAY))


@query("x6_stream_buckets", f"SELECT * FROM ({BUCKETS}) WHERE minute * 1000 + 60000 <= {MARK.format('requests')}")
def x6_stream(spark, sf):
    return _run(spark, X.minute_buckets(_source(spark, sf, "requests"), "time", "1 hour"))


@query("x7_stream_limits", _passed(GCRA.replace("SELECT subject, event_id, allowed, retry FROM g", "SELECT g.subject, g.event_id, allowed, retry, ts FROM g JOIN s ON s.subject = g.subject AND s.n = g.n"), "requests", "subject, event_id, allowed, retry"))
def x7_stream(spark, sf):
    return _run(spark, X.stream_limits(_delayed(spark, sf, "requests"), 8 * 3_600_000_000, 3))


@query("x8_stream_late", "SELECT prop, event_id, coalesce(ts >= 1704067200000000 + (prop % 30) * 86400000000, false) AS late FROM ticks")
def x8_stream(spark, sf):
    starts = view(spark, sf, "ticks").select("prop").distinct().withColumn("start", 1_704_067_200_000_000 + (F.col("prop") % 30) * 86_400_000_000)
    return _run(spark, X.late_rows(_source(spark, sf, "ticks"), starts, "prop").select("prop", "event_id", "late"))


@query("x9_stream_purge", f"SELECT subject, count(*) AS buckets FROM ({BUCKETS}) WHERE minute * 1000 + 60000 <= {MARK.format('requests')} AND minute > 1706600000 - 604800 GROUP BY subject")
def x9_stream(spark, sf):
    kept = X.purge(X.minute_buckets(_source(spark, sf, "requests"), "time", "1 hour"), 1_706_600_000)
    return _run(spark, kept).groupBy("subject").agg(F.count("*").alias("buckets"))
