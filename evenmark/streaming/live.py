"""Streaming forms of live scoring, staleness, reuse, caps, histories, minute buckets and rate limits, with their batch equivalents.

Rules over a key's rows in event order are in `ordered`; batches and streams both use them.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.pricing import devig_over
from ..operators.odds import last_n
from . import ordered as O


def score_ticks(ticks: DataFrame, history: DataFrame, n: int = 5) -> DataFrame:
    """Each tick with its expected value against the key's history, or the reason why not; history is static, so this also runs on a stream.

    ticks: prop, ts, event_id, over_price, under_price, line, is_error.
    """
    recent = last_n(history, ["player"], [F.desc("kickoff"), F.desc("game")], n).groupBy(F.col("player").alias("prop")).agg(F.collect_list("value").alias("values"))
    p = devig_over(F.col("over_price"), F.col("under_price"))
    hit = F.size(F.filter("values", lambda v: v > F.col("line"))) / F.size("values")
    out = ticks.join(recent, "prop", "left").withColumn("implied_p", p)
    why = F.when(F.col("is_error"), "feed-error").when(F.col("values").isNull(), "no-history").when(F.col("implied_p").isNull(), "no-consensus")
    return out.select("event_id", "prop", "ts", why.alias("error"), F.when(why.isNull(), hit - F.col("implied_p")).alias("edge"))


def score_consensus(consensus: DataFrame, history: DataFrame, n: int = 5) -> DataFrame:
    """Consensus rows (prop, event_id, ts, line, error, p_over, books) with the edge of Over against the key's history, or the first reason against it.

    history is static, so this also runs on a stream.
    """
    recent = last_n(history, ["player"], [F.desc("kickoff"), F.desc("game")], n).groupBy(F.col("player").alias("prop")).agg(F.collect_list("value").alias("values"))
    hit = F.size(F.filter("values", lambda v: v > F.col("line"))) / F.size("values")
    out = consensus.join(recent, "prop", "left")
    why = F.coalesce("error", F.when(F.col("values").isNull(), "no-history"))
    return out.select("prop", "event_id", "ts", why.alias("error"), "p_over", "books", F.when(why.isNull(), hit - F.col("p_over")).alias("edge"))


def books_consensus(quotes: DataFrame, ttl_us: int, key: str = "prop") -> DataFrame:
    """Batch: (key, ts, event_id, line, error, p_over, books): at each quote the median of all books' latest quotes at its line, `ttl` old at most. See ordered.Books."""
    return O.replay(quotes, O.Books(ttl_us), key)


def stream_consensus(quotes: DataFrame, ttl_us: int, key: str = "prop") -> DataFrame:
    """Stream: the same, once the watermark has passed a quote."""
    return O.stream(quotes, O.Books(ttl_us), key)


def replay_limits(requests: DataFrame, interval: int, burst: int, key: str = "subject") -> DataFrame:
    """(subject, event_id, allowed, retry): the generic cell rate rule over each subject's requests in order. Times in microseconds."""
    return O.replay(requests, O.Limit(interval, burst), key).drop("ts")


def stream_limits(requests: DataFrame, interval: int, burst: int, key: str = "subject") -> DataFrame:
    """Stream: the same; a subject's state is dropped when its theoretical arrival time has come, as it allows what no state does."""
    return O.stream(requests, O.Limit(interval, burst), key).drop("ts")


def reuse_within(ticks: DataFrame, ttl_us: int, key: str = "prop") -> DataFrame:
    """Batch: each row, and whether it begins a refresh: the first of its key, or a TTL or more after the last refresh."""
    return O.replay(ticks, O.Reuse(ttl_us), key)


def stream_reuse(ticks: DataFrame, ttl_us: int, key: str = "prop") -> DataFrame:
    """Stream: the same; a key's last refresh is dropped after the TTL."""
    return O.stream(ticks, O.Reuse(ttl_us), key)


def staleness(ticks: DataFrame, limit_us: int, key: str = "prop") -> DataFrame:
    """Batch: (key, ts, state): an error is stale at once, a tick is live, and stale `limit` after it if no tick follows by then."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    rows = ticks.withColumn("_next", F.lead("ts").over(w))
    now = rows.select(key, "event_id", "ts", F.when(F.col("is_error"), "stale").otherwise("live").alias("state"))
    gap = rows.where(~F.col("is_error") & (F.coalesce(F.col("_next") - F.col("ts") > limit_us, F.lit(True)))).select(key, "event_id", (F.col("ts") + limit_us).alias("ts"), F.lit("timed-out").alias("state"))
    return now.unionByName(gap)


class Watch(StatefulProcessor):
    """The states of one key's ticks, see stream_staleness. `held`: the places (ts, event_id) of what may still time out, and of ticks that later ones may precede."""

    def __init__(self, limit: int, key: str):
        self.limit, self.key = limit, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.through = handle, set()  # keys that are done in this micro-batch
        self.state = handle.getValueState("held", "places binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self.advance(key, O.plain(rows, ["ts", "event_id", "is_error"]), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if key not in self.through:
            yield from self.advance(key, [], timerValues.getCurrentWatermarkInMs())

    def advance(self, key, fresh: list[tuple], mark: int) -> Iterator[Row]:
        self.through.add(key)
        stored = self.state.get()
        open_, seen = pickle.loads(stored[0]) if stored else ([], [])
        found = [(e, t, "stale" if b else "live") for t, e, b in sorted(fresh)]
        if fresh:
            seen = sorted(seen + [(t, e) for t, e, _ in fresh])
            open_ = sorted(open_ + [(t, e) for t, e, b in fresh if not b])
            ahead = [bisect.bisect_right(seen, x) for x in open_]
            open_ = [x for x, i in zip(open_, ahead, strict=True) if i == len(seen) or seen[i][0] - x[0] > self.limit]
        found += [(e, t + self.limit, "timed-out") for t, e in open_ if (t + self.limit) // 1000 < mark]
        open_ = [x for x in open_ if (x[0] + self.limit) // 1000 >= mark]
        seen = [x for x in seen if x[0] // 1000 >= mark]
        if open_ or seen:
            self.state.update((pickle.dumps((open_, seen)),))
            self.handle.registerTimer((open_[0][0] + self.limit if open_ else seen[-1][0]) // 1000 + 1)
        elif stored:
            self.state.clear()
        if found:
            yield Row(**{self.key: key[0]} | dict(zip(("event_id", "ts", "state"), map(list, zip(*found, strict=True)), strict=True)))

    def close(self) -> None:
        pass


def stream_staleness(ticks: DataFrame, limit_us: int, key: str = "prop") -> DataFrame:
    """Stream with a watermark on `time`: the same events. A tick's state comes with it; its time-out once no tick can follow in time any more.

    That is when the watermark has passed its limit, so ticks may come in any order within the watermark's delay. A key's
    state is what may still time out, and the ticks that later ones may precede; it goes when both are empty. Sets the state
    store to RocksDB.
    """
    O.use_rocksdb(ticks.sparkSession)
    needed = ticks.select(key, "ts", "event_id", "is_error", "time")
    found = needed.groupBy(key).transformWithState(Watch(limit_us, key), f"{key} long, event_id array<long>, ts array<long>, state array<string>", "append", "eventTime")
    return found.select(key, F.inline(F.arrays_zip("event_id", "ts", "state")))


def capped(ticks: DataFrame, most: int, key: str = "prop") -> DataFrame:
    """Batch: the first `most` ticks of each connection."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return ticks.withColumn("attempt", F.row_number().over(w)).where(F.col("attempt") <= most)


def stream_capped(ticks: DataFrame, most: int, idle_us: int, key: str = "prop") -> DataFrame:
    """Stream: the first `most` ticks of each connection. One that was silent for `idle` is closed, its state is dropped, and a later tick opens another."""
    return O.stream(ticks, O.Cap(most, idle_us), key)


def ev_history(ticks: DataFrame, key: str = "prop", session: str = "session") -> DataFrame:
    """Batch: valid ticks numbered within runs of one session of each key; a change of session begins a new history."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    good = ticks.where(~F.col("is_error")).withColumn("_new", F.coalesce((F.lag(session).over(w) != F.col(session)).cast("int"), F.lit(1)))
    runs = good.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(key, "run").orderBy("ts", "event_id")))


def watched_history(ticks: DataFrame, idle_us: int, key: str = "prop") -> DataFrame:
    """Batch: each valid tick's run and place. A change of session or of sample window begins a run; a stale tick has no place; after `idle` runs count from 1 again."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    good = ticks.where(~F.col("is_error")).withColumn("_spell", F.coalesce((F.col("ts") - F.lag("ts").over(w) >= idle_us).cast("int"), F.lit(1)))
    good = good.withColumn("_spell", F.sum("_spell").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy(key, "_spell").orderBy("ts", "event_id")
    changed = F.coalesce(((F.lag("session").over(v) != F.col("session")) | (F.lag("sample_window").over(v) != F.col("sample_window"))).cast("int"), F.lit(1))
    runs = good.withColumn("_new", changed).withColumn("run", F.sum("_new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.sum((~F.col("is_stale")).cast("long")).over(Window.partitionBy(key, "_spell", "run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return runs.select(key, "ts", "event_id", "run", F.when(~F.col("is_stale"), before).alias("place"))


def stream_history(ticks: DataFrame, idle_us: int, key: str = "prop") -> DataFrame:
    """Stream: the runs and places of watched_history; a key idle for so long keeps no state."""
    return O.stream(ticks, O.History(idle_us), key)


def minute_buckets(requests: DataFrame, time: str, watermark: str | None = None) -> DataFrame:
    """Six counters for each subject and minute; with a watermark also on a stream."""
    rows = requests.withWatermark(time, watermark) if watermark else requests
    k = F.col("kind")
    names = ("view", "click", "purchase", "error", "signup")
    n = [F.count_if(k == x).alias(x) for x in names]
    return rows.groupBy("subject", F.window(time, "1 minute").alias("w")).agg(F.count("*").alias("total"), *n).select("subject", F.unix_seconds(F.col("w.start").cast("timestamp")).alias("minute"), "total", *names)


def late_rows(ticks: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Each tick with whether it comes at or after its event's start; a static join, so it also runs on a stream."""
    return ticks.join(starts, key, "left").withColumn("late", F.coalesce(F.col("ts") >= F.col("start"), F.lit(False)))


def purge(buckets: DataFrame, now: int, days: int = 7) -> DataFrame:
    """Buckets of the last days."""
    return buckets.where(F.col("minute") > now - days * 86_400)
