"""What a step costs as its input grows: calls to a state store, rows on hand, jobs."""

import duckdb
from evenmark.operators import forecast as M
from evenmark.operators import governance as G
from evenmark.operators import temporal as T
from evenmark.plans import all as plans
from evenmark.streaming import live, ordered
from pyspark.sql import Row
from pyspark.sql import functions as F


class Store:
    """A key's state variables and timers, with the number of calls."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        store = self

        class Value:
            def get(self):
                store.calls += 1
                return store.values.get(name)

            def update(self, value):
                store.calls += 1
                store.values[name] = value

            def clear(self):
                store.calls += 1
                store.values.pop(name, None)

        return Value()

    getListState = getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)


class Clock:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.mark


def test_a_key_makes_few_calls_to_the_store():
    """Five for a key with rows, however many; none for a timer of a key that was seen to already; states of many books are one value."""
    store, processor = Store(), ordered.Ordered(ordered.Books(50_000), "prop")
    processor.init(store)
    quote = lambda k: Row(prop=1, ts=1000 * k, event_id=k, book=k % 7, line=1.0, over_price=2.0 + k % 3, under_price=float("nan") if k == 9 else 2.0, is_error=k % 10 == 3, time=None)
    given = []
    for batch, mark in enumerate([0, 70, 160, 260]):
        processor.init(store)
        store.calls = 0
        given += list(processor.handleInputRows((1,), iter([quote(k) for k in range(100 * batch + 99, 100 * batch, -1)]), Clock(mark)))
        assert store.calls <= 5
        list(processor.handleExpiredTimer((1,), Clock(mark), None)) if mark else None
        assert store.calls <= 5
    processor.init(store)
    given += list(processor.handleExpiredTimer((1,), Clock(1000), None))
    found = [x for r in given for x in zip(*[r[n] for n in processor.names[1:]], strict=True)]
    rows = [quote(k) for k in range(1, 400) if k % 100]
    plain = ordered.plain(iter(rows), processor.columns)
    assert found == ordered._walk(processor.rule, None, plain)[0] and plain[8][5] is None
    assert not store.values


def test_a_watched_key_makes_few_calls_to_the_store():
    """Three for a key with ticks, none for its timer in the same micro-batch; its time-outs come once, and nothing of it is left."""
    store, processor, given = Store(), live.Watch(2_000, "prop"), []
    for batch, mark in enumerate([0, 100, 900]):
        processor.init(store)
        store.calls = 0
        rows = [Row(prop=1, ts=1000 * k, event_id=k, is_error=k % 4 == 0) for k in range(100 * batch + 99, 100 * batch, -5)]
        given += [*processor.handleInputRows((1,), iter(rows), Clock(mark)), *processor.handleExpiredTimer((1,), Clock(mark), None)]
        assert store.calls <= 3
    processor.init(store)
    given += list(processor.handleExpiredTimer((1,), Clock(1000), None))
    found = sorted(x for r in given for x in zip(r.ts, r.event_id, r.state, strict=True))
    ticks = [k for b in range(3) for k in range(100 * b + 99, 100 * b, -5)]
    assert found == sorted([(1000 * k, k, "live" if k % 4 else "stale") for k in ticks] + [(1000 * k + 2000, k, "timed-out") for k in ticks if k % 4])
    assert not store.values


def test_rounds_move_edges_of_their_kinds_only(spark, monkeypatch):
    """Edges are neither made distinct nor counted by child where kinds have an order, and a round joins those of its kinds; equal edges, a kind in two places and chains inside a kind give the same nodes as before."""
    jobs = []
    cut = T.cut
    monkeypatch.setattr(T, "cut", lambda df: jobs.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    node = lambda k, i: (k, str(i))
    edges = [(node("a", i % 5), node("b", i)) for i in range(40)] * 2 + [(node("b", i), node("c", i % 7)) for i in range(40)] + [(node("a", 1), node("c", 99))]
    roots = spark.createDataFrame([("a", "1"), ("a", "2"), ("z", "0")], "kind string, id string")
    table = lambda rows: spark.createDataFrame([(*p, *c) for p, c in rows], "parent_kind string, parent string, child_kind string, child string")
    found = {(r.kind, r.id): r.depth for r in T.typed_closure(table(edges), roots).collect()}
    want = {("a", "1"): 0, ("a", "2"): 0, ("z", "0"): 0, ("c", "99"): 1} | {("b", str(i)): 1 for i in range(40) if i % 5 in (1, 2)} | {("c", str(i % 7)): 2 for i in range(40) if i % 5 in (1, 2)}
    assert found == want
    assert "Aggregate" not in jobs[0] and all("LeftSemi" in j for j in jobs[2:]) and len(jobs) == 5
    chain = [(node("d", i), node("d", i + 1)) for i in range(300)] * 2 + [(node("a", 1), node("d", 0))]
    assert {(r.kind, r.id): r.depth for r in T.typed_closure(table(chain), roots).where(F.col("kind") == "d").collect()} == {("d", str(i)): i + 1 for i in range(301)}


def test_sources_are_compared_in_one_shuffle(spark):
    """Games are counted where they are grouped, no row is expanded; nulls, NaN, one source only and two values at a key."""
    rows = [(1, 1, "a", 2.0), (1, 1, "b", 2.0), (2, 1, "a", 1.0), (3, 1, "c", 1.0), (None, 1, "a", 1.0), (None, 1, "b", 3.0), (4, 1, "a", float("nan")), (4, 1, "b", float("nan"))]
    table = lambda more=(): spark.createDataFrame([*rows, *more], "game long, key long, source string, value double")
    out = G.source_compatibility(table(), ("a", "b"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Join" not in plan and plan.count("hashpartitioning") == 1
    given = lambda *more: tuple(G.source_compatibility(table(more), ("a", "b")).first())
    assert given() == (2, "compatible") and given((2, 2, "b", 1.0)) == (3, "incompatible")
    assert given((1, 2, "a", None), (1, 2, "b", None)) == (2, "incompatible") and given((1, 1, "a", 2.0)) == (2, "incompatible")
    assert tuple(G.source_compatibility(table().where("game = 2"), ("a", "b")).first()) == (0, "insufficient-overlap")


def test_absences_group_nothing_twice(spark, tmp_path):
    """Rows are made distinct once, and the presence that rows are held against not at all."""
    duckdb.sql(f"COPY (SELECT CAST(k % 50 AS BIGINT) AS l_partkey, 'A' AS l_returnflag, CAST(1 AS BIGINT) AS l_suppkey, 1.0 AS l_quantity, 0.1 AS l_discount, 0.1 AS l_tax, DATE '1995-01-01' + CAST(k % 9 AS INT) AS l_shipdate, CAST(k AS BIGINT) AS l_orderkey, 1 AS l_linenumber, 'O' AS l_linestatus FROM range(300) t(k)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    plan = plans.QUERIES["j25_validated_absences"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2


def test_tasks_of_wide_rows_grow_with_them(spark):
    """Rows of 17 games are dealt to as many tasks as they need, with the same result."""
    h = spark.range(400).selectExpr("id % 40 AS player", "id AS game", "CAST(id % 97 AS INT) AS kickoff", "1 AS season", "id AS value")
    out, plain = M.lagged_features(h, wide=50), M.lagged_features(h)
    assert "player#" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and ", 16" in plan[plan.index("RepartitionByExpression") :].split("\n")[0]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(out) == key(plain)
