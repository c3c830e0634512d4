"""Streams over several micro-batches against their batch forms."""

import random

import pytest
from evenmark.streaming import live as X
from evenmark.streaming import ordered as O
from pyspark.sql import functions as F

SECOND = 1_000_000
SCHEMA = "event_id long, prop long, ts long, is_error boolean, session long"


def ticks(n, jump):
    rng, at, rows = random.Random(7), 1_700_000_000, []
    for k in range(n):
        at += rng.choice([1, 2, 5, 40])
        rows.append((k, rng.choice([1, 1, 1, 2, 3]), (at - rng.randint(0, jump)) * SECOND + k, rng.random() < 0.2, k // 37))
    return rows


def streamed(spark, folder, rows, batches, form):
    """What a stream gives that reads the rows in so many micro-batches."""
    size = -(-len(rows) // batches)
    for b in range(batches):
        df = spark.createDataFrame(rows[b * size : (b + 1) * size], SCHEMA).withColumn("time", F.timestamp_micros("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream = form(source)
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.createDataFrame(rows, SCHEMA), spark.read.schema(stream.schema).parquet(f"{folder}/out")


def same(a, b, columns):
    rows = [sorted(map(tuple, df.select(*columns).collect())) for df in (a, b)]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("jump", [0, 50])
def test_staleness(spark, tmp_path, jump):
    """Ticks come up to 50 seconds late, within the watermark's minute; each time-out comes once, none too soon."""
    limit = 30 * SECOND
    rows = ticks(200, jump)
    batch, out = streamed(spark, str(tmp_path), rows, 5, lambda s: X.stream_staleness(s.withWatermark("time", "60 seconds"), limit))
    mark = max(r[2] for r in rows) // 1000 - 60_000
    want = X.staleness(batch, limit).where((F.col("state") != "timed-out") | (F.floor(F.col("ts") / 1000) < mark))
    same(out, want, ["prop", "event_id", "ts", "state"])


HOUR, DAY = 3600 * SECOND, 24 * 3600 * SECOND
RULES = {
    "reuse": (lambda s: X.stream_reuse(s, 20 * SECOND), lambda d: X.reuse_within(d, 20 * SECOND)),
    "capped": (lambda s: X.stream_capped(s, 4, 100 * SECOND), lambda d: O.replay(d, O.Cap(4, 100 * SECOND), "prop")),
    "history": (lambda s: X.stream_history(s, 100 * SECOND), lambda d: X.watched_history(d, 100 * SECOND)),
    "limits": (lambda s: O.stream(s, O.Limit(30 * SECOND, 3), "prop"), lambda d: O.replay(d, O.Limit(30 * SECOND, 3), "prop")),
    "consensus": (lambda s: X.stream_consensus(s, 90 * SECOND), lambda d: X.books_consensus(d, 90 * SECOND)),
}
MORE = ["*", "session div 1 AS sample_window", "event_id % 5 = 0 AS is_stale", "event_id % 4 AS book", "1D + event_id % 2 AS line", "1.5D + event_id % 3 AS over_price", "0.5D + event_id % 4 AS under_price"]


def on_time(rows, batches, delay):
    """The rows that are not behind the watermark, and the last watermark (ms). A micro-batch takes what the one before it has not passed."""
    size, marks, kept = -(-len(rows) // batches), [0], []
    for b in range(batches):
        part = rows[b * size : (b + 1) * size]
        kept += [r for r in part if r[2] > marks[max(0, b - 1)] * 1000]
        marks.append(max(marks[-1], max(r[2] for r in part) // 1000 - delay))
    return kept, marks[-1]


@pytest.mark.parametrize("jump", [50, 1500])
@pytest.mark.parametrize("name", RULES)
def test_ordered_rules(spark, tmp_path, name, jump):
    """Rows come shuffled over five micro-batches; those within the delay of a minute count in their order, later ones do not."""
    form, batch = RULES[name]
    rows = ticks(200, jump)
    O.use_rocksdb(spark)
    kept, mark = on_time(rows, 5, 60_000)
    assert (len(kept) < len(rows)) == (jump > 60)
    _, out = streamed(spark, str(tmp_path), rows, 5, lambda s: form(s.withWatermark("time", "60 seconds").selectExpr(*MORE)))
    want = batch(spark.createDataFrame(kept, SCHEMA).selectExpr(*MORE)).where(F.col("ts") <= mark * 1000)
    same(out, want, out.columns)


@pytest.mark.parametrize("name", RULES)
def test_state_leaves(spark, tmp_path, name):
    """Three days after the last row of a key nothing of it is stored, neither its state nor waiting rows."""
    form, _ = RULES[name]
    O.use_rocksdb(spark)
    last = ticks(200, 0)[-1][2]
    rows = [*ticks(200, 0), (900, 77, last + 3 * DAY, False, 5), (901, 78, last + 3 * DAY + 1, False, 5)]
    streamed(spark, str(tmp_path), rows, 4, lambda s: form(s.withWatermark("time", "60 seconds").selectExpr(*MORE)))
    for state in ("held", "waiting"):
        stored = spark.read.format("statestore").option("stateVarName", state).load(f"{tmp_path}/mark")
        assert {r.key.prop for r in stored.select("key").collect()} == (set() if state == "held" else {77, 78})


def test_limits_remember_as_long_as_the_arrival_time_lies_ahead(spark, tmp_path):
    """Three requests at once with an interval of a day: the state counts for three days, though none comes for two."""
    O.use_rocksdb(spark)
    rows = [(k, 1, (1_700_000_000 * SECOND + t), False, 0) for k, t in enumerate([0, 1, 2, 45 * HOUR, 46 * HOUR, 200 * HOUR])] + [(9, 2, 1_700_000_000 * SECOND + 300 * HOUR, False, 0)]
    batch, out = streamed(spark, str(tmp_path), rows, 7, lambda s: O.stream(s.withWatermark("time", "60 seconds"), O.Limit(DAY, 3), "prop"))
    found = {r.event_id: (r.allowed, r.retry) for r in out.collect()}
    assert found == {r.event_id: (r.allowed, r.retry) for r in O.replay(batch, O.Limit(DAY, 3), "prop").collect() if r.event_id != 9}
    assert [found[k][0] for k in range(6)] == [True, True, True, True, False, True]


def test_consensus_by_hand(spark):
    """Medians over live books at the line; errors quote nothing, invalid prices take a book out, entries leave after the time to live."""
    at = lambda k: k * SECOND
    rows = [
        (0, 1, at(0), 1, 10.0, 2.0, 2.0, False), (1, 1, at(1), 2, 10.0, 1.5, 3.0, False), (2, 1, at(2), 3, 11.0, 2.0, 2.0, False),
        (3, 1, at(3), 4, 10.0, 0.5, 2.0, False), (4, 1, at(4), 2, 10.0, 9.0, 9.0, True), (5, 1, at(100), 5, 10.0, 3.0, 1.5, False),
        (6, 1, at(101), 6, 12.0, None, 2.0, False), (7, 2, at(5), 1, 10.0, 4.0, 4.0 / 3, False), (8, 1, None, 1, 10.0, 2.0, 2.0, False),
    ]
    df = spark.createDataFrame(rows, "event_id long, prop long, ts long, book long, line double, over_price double, under_price double, is_error boolean")
    found = {r.event_id: (r.error, r.p_over and round(r.p_over, 6), r.books) for r in X.books_consensus(df, 100 * SECOND).collect()}
    assert found == {0: (None, 0.5, 1), 1: (None, 0.583333, 2), 2: (None, 0.5, 1), 3: ("invalid-anchor", None, 2), 4: ("feed-error", None, None), 5: (None, 0.5, 2), 6: ("no-consensus", None, None), 7: (None, 0.25, 1)}
