"""Findings of the third round, each on rows that the small tables do not hold."""

import re

import duckdb
from compare import rows_of
from evenmark.operators import corpus as K
from evenmark.operators import feeds as D
from evenmark.operators import forecast as M
from evenmark.operators import odds as O
from evenmark.operators import planning as L
from evenmark.plans import all as plans
from evenmark.plans import streams
from evenmark.streaming import ordered
from pyspark.sql import functions as F


def same(spark, folder, name, **tables):
    """A query gives what its SQL gives on these tables (SQL texts) in `folder`."""
    c = duckdb.connect()
    for t, sql in tables.items():
        c.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = plans.QUERIES[name](spark, str(folder))
    r = c.execute(plans.SQL[name])
    want = rows_of([d[0] for d in r.description], r.fetchall())
    assert rows_of(df.columns, df.collect()) == want
    return want


def test_sources_whose_names_run_together(spark, tmp_path):
    """Brand#1 and part 11 has the name of Brand#11 and part 1."""
    part = "SELECT CASE k WHEN 1 THEN 'Brand#11' ELSE 'Brand#1' END AS p_brand, CAST(k AS BIGINT) AS p_partkey, CAST(k AS INT) AS p_size FROM range(1, 13) t(k)"
    got = same(spark, tmp_path, "s10_sync_guard", part=part, supplier="SELECT CAST(k AS BIGINT) AS s_suppkey FROM range(1, 13) t(k)")
    assert len(got) == 12


def test_digest_of_more_rows_than_one_level_was_made_for(spark, tmp_path):
    orders = "SELECT CAST(k % 999 AS BIGINT) AS o_custkey, CAST(k % 69000 AS BIGINT) AS o_orderkey, DATE '1995-01-01' + CAST(k % 900 AS INT) AS o_orderdate, CAST(k % 5000 AS DOUBLE) * 1000 AS o_totalprice FROM range(70000) t(k)"
    for name in ("f19_content_digest", "s7_publish_dataset"):
        same(spark, tmp_path, name, orders=orders)
        (tmp_path / "orders.parquet").unlink()


def test_leaves_are_hashed_across_batches(spark):
    """A leaf has the same digest whatever the size of batches."""
    rows = spark.range(9000).select((F.col("id") % 4500).alias("k"))
    want = M.content_digest(rows, [F.col("k")], [F.col("k")]).first()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert M.content_digest(rows, [F.col("k")], [F.col("k")]).first() == want and want["rows"] == 9000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def united(spark, small=20):
    """Two tables dealt by one key, the second much smaller, so that their shuffles are coalesced differently."""
    log = spark.range(20_000).selectExpr("id % 4000 AS key", "id DIV 4000 + 1 AS log_position", "repeat(cast(id AS string), 20) AS fingerprint")
    part = lambda df: df.groupBy("key").agg(F.collect_list(F.struct("log_position", "fingerprint")).alias("x")).select("key", F.inline("x"))
    more = part(log.where(F.col("key") % small == 0)).withColumn("log_position", F.col("log_position") + 100)
    return part(log).unionByName(more)


def coalesced(spark, act):
    """Runs with partitions merged up to 64 KB."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return act()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_log_of_a_union_is_one_chain(spark):
    n = coalesced(spark, lambda: {r.key: r.n for r in K.chain_log(united(spark), "key").groupBy("key").agg(F.max("nth").alias("n")).collect()})
    assert n == {k: 10 if k % 20 == 0 else 5 for k in range(4000)}


def test_rule_over_a_union_is_in_one_order(spark):
    class Count(ordered.Rule):
        out = "n long"

        def step(self, held, row):
            return ((held or 0) + 1,), (held or 0) + 1

        def prune(self, held, now):
            return held

    rows = united(spark).withColumnsRenamed({"log_position": "ts"}).withColumn("event_id", F.col("ts"))
    n = coalesced(spark, lambda: {r.key: r.n for r in ordered.replay(rows, Count(), "key").groupBy("key").agg(F.max("n").alias("n")).collect()})
    assert n == {k: 10 if k % 20 == 0 else 5 for k in range(4000)}


def test_long_logs_with_two_events_at_a_position(spark, tmp_path):
    """The stored copy of a log of over 100 turns meets itself."""
    talk = "SELECT CAST(c AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, CASE t % 3 WHEN 0 THEN 'user' ELSE 'assistant' END AS role, 'n' || t AS text FROM range(1, 80) a(c), range(0, 260) b(t) WHERE t < 3 OR c % 11 = 0 OR c % 13 = 0"
    for name in ("j22_history_tail", "g4_import_plan"):
        same(spark, tmp_path, name, conversations=talk)
        (tmp_path / "conversations.parquet").unlink()


def test_consensus_meets_a_line_not_a_snapshot(spark):
    """Each join of requests and quotes is on the player too, so that a snapshot of n quotes does not make n * n pairs."""
    quotes = spark.createDataFrame([(1, "m", p, 0.5, 2.0, 2.0 + p % 2, 10) for p in range(4)] + [(1, "m", 1, 0.5, 2.0, 2.0, 10), (1, "m", 2, 1.5, 0.5, 2.0, 10)], "event long, market string, player long, point double, over_price double, under_price double, captured_at long")
    asked = spark.createDataFrame([(1, "m", p, x, 20) for p, x in ((0, 0.5), (1, 0.5), (1, 1.5), (2, 1.5), (9, 0.5))] + [(2, "m", 1, 0.5, 20)], "event long, market string, player long, point double, cutoff long")
    out = O.historical_consensus(asked, quotes)
    joins = re.findall(r"Join \[([^\]]*)\]", out._jdf.queryExecution().executedPlan().toString())
    assert joins and all("player" in keys for keys in joins)
    assert {(r.event, r.player, r.point): (r.reason, r.books, r.p_over and round(r.p_over, 4)) for r in out.collect()} == {
        (1, 0, 0.5): (None, 1, 0.5), (1, 1, 0.5): (None, 2, 0.55), (1, 1, 1.5): ("exact-line-not-found", 0, None), (1, 2, 1.5): ("no-valid-two-way-quotes", 0, None),
        (1, 9, 0.5): ("player-not-found-in-observation", 0, None), (2, 1, 0.5): ("no-observation", 0, None),
    }


def test_population_without_a_shuffle_of_pairs(spark):
    """Equal to the distinct union of all pairs, for nulls, players of two teams, games of two weeks and equal sides; one join makes the pairs of plain games and nothing shuffles them."""
    roster = spark.createDataFrame([(p or None, 2000 + p % 2, 1 + k % 2, None if k == 5 else (p * k) % 4) for p in range(9) for k in range(6)], "player long, season int, week int, team int")
    schedule = spark.createDataFrame([(g or None, 2000 + g % 2, 1 + (g + w) % 2, g % 4, None if g == 6 else (g * 3 + 1) % 5) for g in range(12) for w in range(1 + (g % 5 == 0))] + [(3, 2001, 2, 3, 0)], "game long, season int, week int, home int, away int")
    played = spark.createDataFrame([(p or None, g or None) for p in range(11) for g in range(0, 12, 3)] * 2, "player long, game long")
    out = D.candidate_population(roster, schedule, played)
    pairs = roster.alias("r").join(schedule.alias("s"), F.expr("r.season = s.season AND r.week = s.week AND r.team IN (s.home, s.away)")).select("player", "game")
    want = pairs.union(played).distinct()
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(out) == key(want) and want.count() > 60
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_population_is_small_when_written(spark, tmp_path):
    """Pairs of more players and games than a tile holds, each once, null ones too, take less than a byte each in the file: a game's players come one after another."""
    roster = spark.range(1300).selectExpr("nullif(id, 0) AS player", "2000 AS season", "1 + id % 13 div 12 AS week", "1 AS team")
    roster = roster.unionByName(roster.where("player % 10 = 0").withColumn("team", F.lit(2)))
    schedule = spark.range(1500).selectExpr("nullif(id * 7919 % 1000003, 0) AS game", "2000 AS season", "1 + id % 2 AS week", "1 + id % 3 AS home", "1 + id div 3 % 4 AS away")
    played = spark.range(50).selectExpr("id AS player", "id * 7919 % 1000003 AS game")
    out = D.candidate_population(roster, schedule, played)
    out.write.parquet(str(tmp_path / "pairs"))
    pairs = roster.alias("r").join(schedule.alias("s"), F.expr("r.season = s.season AND r.week = s.week AND r.team IN (s.home, s.away)")).select("player", "game")
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("player", "game").cast("decimal(38)")), F.bit_xor(F.xxhash64("player", "game"))).first()
    got = total(spark.read.parquet(str(tmp_path / "pairs")))
    assert got == total(pairs.union(played).distinct()) and got[0] > 300_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < got[0]


def test_responses_are_nested_in_one_shuffle(spark):
    rows = spark.createDataFrame([(1, 5, 7, b, m, s, 3, 1.5, 0.5) for b in (1, 2) for m in ("x", "y") for s in ("Over", "Under")], "event long, captured_at int, batch long, book long, market string, side string, player long, price double, point double")
    out = streams._responses(rows)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    one = out.collect()
    assert len(one) == 1 and sorted((b.key, m.key, len(m.outcomes)) for b in one[0].bookmakers for m in b.markets) == [(b, m, 2) for b in ("1", "2") for m in ("x", "y")]


def test_steps_of_a_schedule_are_not_shuffled(spark):
    targets = spark.createDataFrame([(1, 0, 30_000), (2, 29_000, 30_000), (3, 30_000, 30_000)], "target long, activated long, kickoff long")
    out = L.priority_plan(targets)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = [*range(0, 8400, 3600), *range(8400, 30_000, 300)], [*range(29_000, 30_000, 300)]
    assert sorted(tuple(r) for r in out.collect()) == [(t + 1, k, due, [*w, 30_000][k + 1]) for t, w in enumerate(want) for k, due in enumerate(w)]


def test_replay_joins_digests_of_32_bytes(spark, tmp_path):
    assert len(same(spark, tmp_path, "g8_consumer_replay", orders="SELECT CAST(k AS BIGINT) AS o_orderkey FROM range(1, 200) t(k)", lineitem="SELECT CAST(k % 210 AS BIGINT) AS l_orderkey, CAST(k % 9 AS BIGINT) AS l_suppkey FROM range(1, 900) t(k)")) > 500
    assert "unhex" in plans.QUERIES["g8_consumer_replay"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_references_are_shuffled_once(spark):
    """References are counted where they are joined with their folds; one without a fold counts too."""
    h = "array<struct<game: long, kickoff: long, value: long>>"
    folds = spark.createDataFrame([(1, 10, 5, []), (1, 11, 6, [(10, 5, 0)]), (1, 12, 7, [(11, 6, 0), (10, 5, 0)]), (2, 10, None, [(99, 1, 0)])], f"player long, game long, cutoff long, history {h}")
    assert M.walk_forward(folds).first().asDict() == {"history_references": 4, "player_games": 3, "reused": 1, "folds_with_prior": 2, "prior_references": 3}
    assert "Join LeftOuter" in M.walk_forward(folds)._jdf.queryExecution().optimizedPlan().toString()
