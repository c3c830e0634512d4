"""Rules over each key's rows in event order, with state that leaves: one rule runs over a batch and over a stream.

On a stream a row waits until the watermark has passed it, so rows may come in any order within the watermark's delay and
the result is that of the batch. State is pruned by event-time timers: what no later row can need goes, and a key that
has been idle long enough leaves nothing behind.
"""

from __future__ import annotations

import itertools
import operator
import pickle
import statistics
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.scans import by_key

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that stream rules need: keys, lists, maps and timers on disk, their changes in the stream's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Rule:
    """What happens at each row (ts, event_id, *needs) of a key. `held` is the key's state, None at first; times are microseconds."""

    needs: tuple[str, ...] = ()
    needs_types: tuple[str, ...] = ()
    out = ""
    state = ""

    def step(self, held, row: tuple) -> tuple[tuple | None, object]:
        """What the row gives (None: nothing) after ts and event_id, and the new state."""
        raise NotImplementedError

    def prune(self, held, now: int):
        """The state without what no row at `now` or later can need."""
        return None if now >= self.wake(held) else held

    def wake(self, held) -> int:
        """The first time at which `prune` takes something away."""
        raise NotImplementedError

    def pack(self, held) -> tuple:
        """The state as a value of the columns `state`."""
        return held

    def unpack(self, stored: tuple):
        return stored


class Reuse(Rule):
    """Whether a row begins a refresh: the first of its key, or `ttl` or more after the last refresh."""

    out, state = "refresh boolean", "last long"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def step(self, held, row):
        return ((held is None,), held or (row[0],))

    def wake(self, held):
        return held[0] + self.ttl


class Cap(Rule):
    """The first `most` rows of a connection and their numbers. A connection that was silent for `idle` is closed; what follows is another."""

    out, state = "attempt long", "n long, last long"

    def __init__(self, most: int, idle: int):
        self.most, self.idle = most, idle

    def step(self, held, row):
        n = min(held[0] if held else 0, self.most) + 1
        return ((n,) if n <= self.most else None, (n, row[0]))

    def wake(self, held):
        return held[1] + self.idle


class History(Rule):
    """The history of a watched key: runs of one session and sample window, and a row's place in its run.

    A stale row is not appended (its place is null) but begins a run if its session or window is another. A row that came
    with an error is none at all. After `idle` a key begins again at run 1.
    """

    needs, needs_types, out, state = ("session", "sample_window", "is_stale", "is_error"), ("long", "long", "boolean", "boolean"), "run long, place long", "session long, sample_window long, run long, place long, last long"

    def __init__(self, idle: int):
        self.idle = idle

    def step(self, held, row):
        at, _, session, window, stale, error = row
        if error:
            return None, held
        run, place = (held[2], held[3]) if held and held[:2] == (session, window) else ((held[2] if held else 0) + 1, 0)
        place += not stale
        return ((run, None if stale else place), (session, window, run, place, at))

    def wake(self, held):
        return held[4] + self.idle


class Limit(Rule):
    """The generic cell rate rule: a request is denied while the theoretical arrival time lies `burst` intervals ahead; state goes when that time has come."""

    out, state = "allowed boolean, retry long", "tat long"

    def __init__(self, interval: int, burst: int):
        self.interval, self.burst = interval, burst

    def step(self, held, row):
        wait = held[0] - (self.burst - 1) * self.interval - row[0] if held else 0
        return ((False, wait), held) if wait > 0 else ((True, 0), (max(row[0], held[0] if held else row[0]) + self.interval,))

    def wake(self, held):
        return held[0]


class Books(Rule):
    """The consensus at each quote's line: the median chance of Over, without the margin, of all books' latest quotes there.

    State is a map: book -> its latest quote, stored as columns. A quote counts for `ttl` after its time; an entry leaves at its own time. An
    error quotes nothing; a quote without two prices over 1 takes its book out until it quotes again.
    """

    needs, needs_types = ("book", "line", "over_price", "under_price", "is_error"), ("long", "double", "double", "double", "boolean")
    out = "line double, error string, p_over double, books long"
    state = "book array<long>, at array<long>, line array<double>, p array<double>"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def step(self, held, row):
        at, _, book, line, over, under, error = row
        if error:
            return ((line, "feed-error", None, None), held)
        good = line is not None and line == line and all(x is not None and 1 < x < float("inf") for x in (over, under))
        held = dict(held or {})
        held[book] = (at, line, (1 / over) / (1 / over + 1 / under) if good else None)
        live = [p for _, q, p in held.values() if q == line and p is not None]
        if not live:
            return ((line, "no-consensus", None, None), held)
        return ((line, None if good else "invalid-anchor", statistics.median(live) if good else None, len(live)), held)

    def prune(self, held, now):
        return {k: v for k, v in held.items() if v[0] + self.ttl > now} or None

    def wake(self, held):
        return min(v[0] for v in held.values()) + self.ttl

    def pack(self, held):
        return ([*held], *map(list, zip(*held.values(), strict=True)))

    def unpack(self, stored):
        return dict(zip(stored[0], zip(*stored[1:], strict=True), strict=True))


def _walk(rule: Rule, held, rows) -> tuple[list[tuple], object]:
    """The rows of one key, in order, through a rule."""
    found = []
    for row in rows:
        held = held and rule.prune(held, row[0])
        out, held = rule.step(held, row)
        if out is not None:
            found.append((row[0], row[1], *out))
    return found, held


def _schema(key: str, rule: Rule) -> str:
    return f"{key} long, ts long, event_id long, {rule.out}"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _tuples(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    """Rows as plain values; missing ones are None."""
    cols = [frame[c].tolist() if not frame[c].hasnans else frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in columns]
    return list(zip(*cols, strict=True))


def plain(rows: Iterator[Row], columns: list[str]) -> list[tuple]:
    """Rows of a stream as plain values; missing ones are None."""
    out, pick = [], None
    for row in rows:
        pick = pick or operator.itemgetter(*map(row.__fields__.index, columns))
        out.append(tuple(None if x != x else x for x in pick(tuple(row))))
    return out


def replay(rows: DataFrame, rule: Rule, key: str) -> DataFrame:
    """(key, ts, event_id, what the rule gives) over a batch: each key's rows in order through a sorted shuffle, a batch at a time, only the key's state between. Rows without a time or id are left out."""
    columns = ["ts", "event_id", *rule.needs]
    names = _names(_schema(key, rule))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whose, held = None, None
        for frame in frames:
            out: list[tuple] = []
            for k, part in itertools.groupby(_tuples(frame, [key, *columns]), key=operator.itemgetter(0)):
                found, held = _walk(rule, held if k == whose else None, (x[1:] for x in part))
                whose = k
                out += [(k, *x) for x in found]
            yield pd.DataFrame(out, columns=names, dtype=object)

    return by_key(rows.select(key, *columns).dropna(subset=columns[:2]), [key], ["ts", "event_id"]).mapInPandas(run, _schema(key, rule))


class Ordered(StatefulProcessor):
    """A rule on a stream: rows wait until the watermark has passed them, then go through the rule in order.

    A call to the state store costs more than a row, so a key makes few of them in a micro-batch: its waiting rows are one
    value, and they go through the rule where its new rows come. Timers are for keys without new rows. What a key gives is
    one row of arrays, which `stream` makes rows of again.
    """

    def __init__(self, rule: Rule, key: str):
        self.rule, self.key = rule, key
        self.columns = ["ts", "event_id", *rule.needs]
        self.names = _names(_schema(key, rule))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.through = handle, set()  # keys that are done in this micro-batch
        self.waiting = handle.getValueState("waiting", "rows binary")
        self.state = handle.getValueState("held", self.rule.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self.advance(key, plain(rows, self.columns), timerValues.getCurrentWatermarkInMs() * 1000, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if key not in self.through:
            yield from self.advance(key, [], timerValues.getCurrentWatermarkInMs() * 1000, True)

    def advance(self, key, new: list[tuple], mark: int, due: bool) -> Iterator[Row]:
        """Takes the key's rows up to the watermark through the rule, and keeps the others; `due`: its state may have to leave."""
        stored = self.waiting.get()
        rows = pickle.loads(stored[0]) + new if stored else new
        ready = sorted((x for x in rows if x[0] <= mark), key=lambda x: x[:2])
        rest = [x for x in rows if x[0] > mark] if ready else rows
        if new or ready:
            self.waiting.update((pickle.dumps(rest),)) if rest else self.waiting.clear()
        times = [min(x[0] for x in rest)] if rest else []
        found: list[tuple] = []
        if ready or due:
            self.through.add(key)
            stored = self.state.get()
            was = self.rule.unpack(stored) if stored else None
            found, held = _walk(self.rule, was, ready)
            held = held and self.rule.prune(held, mark)
            if held != was:
                self.state.update(self.rule.pack(held)) if held else self.state.clear()
            times += [self.rule.wake(held)] if held else []
        if times:
            self.handle.registerTimer(max(-(-min(times) // 1000), mark // 1000 + 1))
        if found:
            yield Row(**{self.key: key[0]} | dict(zip(self.names[1:], map(list, zip(*found, strict=True)), strict=True)))

    def close(self) -> None:
        pass


def stream(rows: DataFrame, rule: Rule, key: str) -> DataFrame:
    """(key, ts, event_id, what the rule gives) of a stream with a watermark on `time`, which is `ts` as a timestamp.

    A row's result comes once the watermark has passed the row; rows behind the watermark, or without a time or id, are left out. Needs use_rocksdb.
    """
    needed = rows.dropna(subset=["ts", "event_id"]).select(key, "ts", "event_id", *rule.needs, "time")
    schema = _schema(key, rule)
    arrays = ", ".join([f"{key} long", *(f"{n} array<{t}>" for n, t in (x.split() for x in schema.split(", ")[1:]))])
    found = needed.groupBy(key).transformWithState(Ordered(rule, key), arrays, "append", "eventTime")
    return found.select(key, F.inline(F.arrays_zip(*_names(schema)[1:])))
