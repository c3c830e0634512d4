"""Running aggregates in slabs and the two-clock search against plain Python, and what a hot key costs."""

import random
import time

import pytest
from evenmark.operators import feeds as D
from evenmark.operators import forecast as M
from evenmark.operators import governance as G
from evenmark.operators import identity as I
from evenmark.operators import temporal as T
from evenmark.operators.scans import Run, running
from pyspark.sql import functions as F


def keyed(n, seed, span=40):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(span)]), k, rng.choice([None, *range(9)])) for k in range(n)]


def nulls_first(x):
    return (x is not None, x or 0)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("most", [2_000_000, 60, 9])
def test_running_equals_a_loop(spark, most, descending):
    rows = keyed(400, 11)
    df = spark.createDataFrame(rows, "k string, at int, id int, v int")
    runs = {"top": Run("max", "v"), "total": Run("sum", "v"), "newest": Run("last", "v")}
    out = {r.id: r for r in running(df, ["k"], "at", runs, [F.asc("id")], descending, most).collect()}
    order = sorted(rows, key=lambda r: ((r[1] is not None, -r[1] if descending else r[1]) if r[1] is not None else (False, 0), r[2]))
    state = {}
    for k, _, i, v in order:
        top, total, newest = state.get(k, (None, None, None))
        if v is not None:
            top, total, newest = max(v, v if top is None else top), v + (total or 0), v
        state[k] = (top, total, newest)
        assert (out[i].top, out[i].total, out[i].newest) == (top, total, newest)


@pytest.mark.parametrize("most", [2_000_000, 50, 5])
def test_tail_across_slabs(spark, most):
    rows = [(k, at, i, i) for k, at, i, _ in keyed(300, 12) if at is not None]
    out = {r.id: r.last for r in running(spark.createDataFrame(rows, "k string, at int, id int, v int"), ["k"], "at", {"last": Run("tail", "v", 7)}, [F.asc("id")], most=most).collect()}
    seen = {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k] = [*seen.get(k, []), v][-7:]
        assert out[i] == seen[k]


def test_operators_give_the_same_in_slabs(spark):
    rows = keyed(300, 13)
    spans = spark.createDataFrame([(k, at, None if at is None or i % 7 == 0 else at + i % 9, i % 3) for k, at, i, _ in rows], "k string, valid_from int, valid_until int, value int")
    asked = spark.createDataFrame([(i, k, at) for k, at, i, _ in keyed(200, 14)], "id int, k string, at int")
    right = spark.createDataFrame([(k, at, i) for k, at, i, _ in rows], "k string, clock int, v int")
    captures = spark.createDataFrame([(i, k, at, i % 3 > 0) for k, at, i, _ in rows], "capture int, scope string, captured_at int, full boolean")
    wanted = spark.createDataFrame([(i % 20, k, at) for k, at, i, _ in keyed(200, 15)], "id int, scope string, captured_at int")
    present = spark.createDataFrame([(i, i % 20) for _, _, i, _ in rows], "capture int, id int")
    versions = spark.createDataFrame([(k, at, None if at is None else at + i % 5, f"r{i}", ("usable", "refused")[i % 2], i, i % 13) for k, at, i, _ in rows], "k string, available_at int, ingested_at int, row_id string, state string, data int, job int")
    requests = spark.createDataFrame([(i, k, at, None if at is None else at + 3) for k, at, i, _ in keyed(200, 16)], "id int, k string, cutoff int, checkpoint int")
    history = spark.createDataFrame([(k, i, at, 1, v) for k, at, i, v in rows], "player string, game int, kickoff int, season int, value int")
    forms = [
        lambda n: T.interval_value(asked, spans, ["k"], "id", most=n), lambda n: I.nearest_in_time(asked, right, ["k"], "at", "clock", ["v"], most=n), lambda n: G.validated_absences(wanted, captures, present, most=n),
        lambda n: G.model_context(requests, versions, "k", "id", most=n), lambda n: M.lagged_features(history, 1, 4, most_rows=n), lambda n: G.input_sets(versions, "k", most=n),
    ]
    for form in forms:
        whole, parts = (sorted(map(str, form(n).collect())) for n in (2_000_000, 12))
        assert whole == parts and len(whole) > 10


def test_lagged_features_equal_all_pairs(spark):
    history = [(k, i, at, 1, v) for k, at, i, v in keyed(250, 17, 60)]
    out = {r.game: r for r in M.lagged_features(spark.createDataFrame(history, "player string, game int, kickoff int, season int, value int"), 2, 5).collect()}
    for player, game, kickoff, _, _ in history:
        before = sorted((h for h in history if h[0] == player and None not in (h[2], kickoff) and h[2] < kickoff - 2), key=lambda h: (-h[2], h[1]))
        used, kicks = before[:5], [h[2] for h in before[:5]]
        assert [(x.game, x.kickoff, x.value) for x in out[game].history] == [(h[1], h[2], h[4]) for h in used]
        tied = len(set(kicks)) < len(kicks) or (len(before) > 5 and before[5][2] == kicks[-1])
        assert out[game].reasons == ["insufficient-history"] * (len(used) < 2) + ["history-order-ambiguous"] * tied


def test_input_sets(spark):
    """The set that a request names holds the jobs known by its cutoff."""
    rows = [(k, at, None if at is None else at + i % 5, f"r{i}", "usable", i, i % 13 or None) for k, at, i, _ in keyed(200, 18) if k]
    schema = "k string, available_at int, ingested_at int, row_id string, state string, data int, job int"
    requests = [(i, k, at, at) for k, at, i, _ in keyed(80, 19) if k]
    versions = spark.createDataFrame(rows, schema)
    out = {r.id: r.inputs for r in G.model_context(spark.createDataFrame(requests, "id int, k string, cutoff int, checkpoint int"), versions, "k", "id").collect()}
    sets = G.input_sets(versions, "k").collect()
    for i, k, cutoff, _ in requests:
        want = {v[6] for v in rows if v[0] == k and v[6] and None not in (v[1], v[2], cutoff) and max(v[1], v[2]) <= cutoff}
        assert {s.job for s in sets if s.k == k and s.nth <= out[i]} == want


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_rights_equal_all_pairs(spark, most):
    rng = random.Random(20)
    day = lambda: rng.choice([None, *range(50)])
    decisions = [(rng.choice(["a", "a", "a", "b", None]), k, day(), day(), rng.choice([None, *range(60)]), f"u{k}") for k in range(200)]
    requests = [(k, rng.choice(["a", "a", "b", "c", None]), day(), day()) for k in range(300)] + [(5, "a", 3, 3)] * 2
    requests = [*dict.fromkeys(requests)]
    out = T.effective_rights(spark.createDataFrame(requests, "request int, profile string, valid_at int, known_at int"), spark.createDataFrame(decisions, "profile string, decision int, recorded_at int, valid_from int, valid_until int, uses string"), "request", most).collect()
    got = sorted((r.request, r.profile or "", -1 if r.decision is None else r.decision, r.uses or "none" if r.uses is None else r.uses) for r in out)
    want = []
    for i, profile, valid, known in requests:
        seen = [d for d in decisions if profile and d[0] == profile and None not in (d[2], d[3], valid, known) and d[2] <= known and d[3] <= valid]
        d = max(seen, key=lambda d: (d[2], d[1]), default=None)
        want.append((i, profile or "", d[1] if d else -1, "none" if not d else d[5] if d[4] is None or d[4] > valid else ""))
    assert got == sorted(want)


def test_rights_of_one_profile_take_time_in_proportion(spark):
    """20,000 and 80,000 decisions and as many requests of one profile: no array of decisions in the plan, and not much more than four times the time."""
    took = []
    for n in (20_000, 20_000, 80_000):
        h = lambda c, m: F.pmod(F.xxhash64("id", F.lit(c)), F.lit(m))
        decisions = spark.range(n).select(F.lit("p").alias("profile"), F.col("id").alias("decision"), h(1, n).alias("recorded_at"), h(2, n).alias("valid_from"), F.lit(None).cast("long").alias("valid_until"), F.lit("display").alias("uses"))
        requests = spark.range(n).select(F.col("id").alias("request"), F.lit("p").alias("profile"), h(3, n).alias("valid_at"), h(4, n).alias("known_at"))
        out = T.effective_rights(requests, decisions, "request")
        assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
        began = time.perf_counter()
        assert out.agg(F.count("decision")).first()[0] > 0.95 * n
        took.append(time.perf_counter() - began)
    assert took[2] < 8 * took[1] + 2


def test_a_hot_key_is_many_tasks(spark):
    """A key with half of all rows: no part of it has more than twice `most` rows, so no task has more than one such part of it."""
    df = spark.range(40_000).select((F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 400)).alias("k"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("at"), F.col("id").alias("v"))
    out = running(df, ["k"], "at", {"total": Run("sum", "v")}, [F.asc("v")], most=1_000)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_slab" in text
    from evenmark.operators.scans import hot_cuts

    cuts = hot_cuts(df, ["k"], "at", 1_000).collect()
    assert [r.k for r in cuts] == [0]
    parts = df.where("k = 0").groupBy(F.size(F.filter(F.array(*map(F.lit, cuts[0]._cuts)), lambda c: c <= F.col("at")))).count().collect()
    assert len(parts) >= 20 and max(r["count"] for r in parts) < 2_000
    want = running(df, ["k"], "at", {"total": Run("sum", "v")}, [F.asc("v")])
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()


@pytest.mark.parametrize("most", [2_000_000, 50, 7])
def test_history_counts_equal_all_pairs(spark, most):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([None, *range(30)]), rng.choice([None, *range(12)])) for _ in range(300)] + [("alone", 1, 3), ("alone", 1, 4)]
    want = {}
    for p, g, at in rows:
        for q, h, other in rows:
            if p is not None and p == q and g is not None and h is not None and g != h:
                n, e = want.get((p, g), (0, 0))
                want[p, g] = (n + 1, e + (at is not None and other is not None and other < at))
    df = spark.createDataFrame(rows, "player string, game int, kickoff int")
    got = D.history_counts(df, "player", "game", "kickoff", most).collect()
    assert {(r.player, r.game): (r.requests, r.earlier) for r in got} == want and len(got) == len(want)
    assert D.history_counts(df.limit(0), "player", "game", "kickoff", most).count() == 0


def test_retain_tells_differing_rows(spark):
    rows = [("a", 1, None, []), ("a", 1, None, []), ("b", 1, None, []), ("b", 1, 2, []), ("c", 1, 1, ["x"]), ("d", None, None, ["x"]), ("d", None, None, [])]
    got = {r.k: (r.state, r.reasons, r.repeats) for r in D.retain(spark.createDataFrame(rows, "k string, v int, w int, reasons array<string>"), ["k"], ["v", "w"]).collect()}
    assert got == {"a": ("usable", [], 1), "b": ("ambiguous", ["conflicting-source-rows"], 1), "c": ("refused", ["x"], 0), "d": ("ambiguous", ["conflicting-source-rows"], 1)}
