"""Queries on odds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import pricing as P
from ..operators import odds as O
from .registry import query

DEVIG = "(1 / over_price) / (1 / over_price + 1 / under_price)"
CONSENSUS = f"SELECT event, player, point, median({DEVIG}) AS p_over, count(*) AS books FROM quotes WHERE over_price > 1 AND under_price > 1 GROUP BY ALL"
FIRST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event, market, book, player, side ORDER BY captured_at, batch, seq, point, price) AS n FROM outcomes) WHERE n = 1"""


@query("f12_devig", f"SELECT batch, seq, player, book, round({DEVIG}, 6) AS p_over, round(1 - {DEVIG}, 6) AS p_under FROM quotes WHERE over_price > 1 AND under_price > 1")
def f12(spark, sf):
    p = P.devig_over(F.col("over_price"), F.col("under_price"))
    return view(spark, sf, "quotes").withColumn("p", p).where("p IS NOT NULL").select("batch", "seq", "player", "book", F.round("p", 6).alias("p_over"), F.round(1 - F.col("p"), 6).alias("p_under"))


@query("p9_valid_outcomes", "SELECT market, side, count(*) AS n, count(*) FILTER (WHERE price > 1 AND point IS NOT NULL AND side IN ('Over', 'Under')) AS valid FROM outcomes GROUP BY ALL")
def p9(spark, sf):
    return view(spark, sf, "outcomes").groupBy("market", "side").agg(F.count("*").alias("n"), F.count_if(O.valid_outcome()).alias("valid"))


@query("a3_line_consensus", f"SELECT event, player, point, round(p_over, 6) AS p_over, round(1 - p_over, 6) AS p_under, books FROM ({CONSENSUS})")
def a3(spark, sf):
    return O.line_consensus(view(spark, sf, "quotes"), ["event", "player"]).select("event", "player", "point", F.round("p_over", 6).alias("p_over"), F.round("p_under", 6).alias("p_under"), "books")


@query("t1_last_n", "SELECT player, game, kickoff, value, recency FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY kickoff DESC, game DESC) AS recency FROM history) WHERE recency <= 7")
def t1(spark, sf):
    return O.last_n(view(spark, sf, "history"), ["player"], [F.desc("kickoff"), F.desc("game")], 7).select("player", "game", "kickoff", "value", "recency")


@query("a2_recent_average", "SELECT player, round(avg(value), 6) AS average, count(*) AS sample_size FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY kickoff DESC, game DESC) AS r FROM history) WHERE r <= 5 GROUP BY player")
def a2(spark, sf):
    return O.recent_average(view(spark, sf, "history"), "player", 5).withColumn("average", F.round("average", 6))


@query(
    "a1_ev_scoring",
    f"""WITH c AS ({CONSENSUS}), r AS (SELECT player, value FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY kickoff DESC, game DESC) AS n FROM history) WHERE n <= 5),
    j AS (SELECT c.player, 100 * point AS point, p_over, event % 25 AS wind, event % 3 AS rain, 0.35 AS coverage, d AS direction, count(*) AS n_games,
      count(*) FILTER (WHERE CASE WHEN d = 'over' THEN value > 100 * point ELSE value < 100 * point END) / count(*) AS base_rate
      FROM c JOIN r ON c.player = r.player CROSS JOIN (VALUES ('over'), ('under')) t(d) GROUP BY ALL),
    e AS (SELECT *, CASE WHEN direction = 'over' THEN -1 ELSE 1 END AS s, greatest(0, wind - 10) * 0.004 + CASE WHEN rain > 0 THEN 0.03 ELSE 0 END AS drag FROM j),
    a AS (SELECT *, least(1, greatest(0, base_rate + s * drag)) AS after_environment FROM e),
    m AS (SELECT *, least(1, greatest(0, after_environment + s * coverage * 0.1)) AS model_p, CASE WHEN direction = 'over' THEN p_over ELSE 1 - p_over END AS implied_p FROM a)
    SELECT player, CAST(point AS DOUBLE) AS point, direction, n_games, round(CAST(base_rate AS DOUBLE), 6) AS base_rate, round(CAST(model_p AS DOUBLE), 6) AS model_p, round(implied_p, 6) AS implied_p, round(model_p - implied_p, 6) AS edge FROM m""",
)
def a1(spark, sf):
    lines = O.line_consensus(view(spark, sf, "quotes"), ["event", "player"])
    lines = lines.select("player", (100 * F.col("point")).alias("point"), "p_over", (F.col("event") % 25).alias("wind"), (F.col("event") % 3).alias("rain"), F.lit(0.35).alias("coverage"))
    out = O.expected_value(lines, view(spark, sf, "history"))
    return out.select("player", "point", "direction", "n_games", *[F.round(c, 6).alias(c) for c in ("base_rate", "model_p", "implied_p", "edge")])


@query("f13_price_side", f"""WITH c AS (SELECT batch, seq, player, over_price, {DEVIG} * 0.9 AS win, (1 - {DEVIG}) * 0.9 AS loss FROM quotes WHERE over_price > 1 AND under_price > 1)
    SELECT batch, seq, player, round(win / 0.9, 6) AS no_push_p, round((win + loss) / win, 6) AS fair, round(win * (over_price - 1) - loss, 6) AS profit FROM c""")
def f13(spark, sf):
    q = view(spark, sf, "quotes").withColumn("p", P.devig_over(F.col("over_price"), F.col("under_price"))).where("p IS NOT NULL")
    win, loss, push = F.col("p") * 0.9, (1 - F.col("p")) * 0.9, F.lit(1.0) - 0.9
    return q.select("batch", "seq", "player", F.round(P.no_push(win, push), 6).alias("no_push_p"), F.round(P.fair_price(win, loss), 6).alias("fair"), F.round(P.expected_profit(win, loss, F.col("over_price")), 6).alias("profit"))


@query("a16_joint_probability", f"SELECT batch, count(*) AS legs, round(product({DEVIG}), 6) AS probability FROM quotes WHERE over_price > 1 AND under_price > 1 GROUP BY batch")
def a16(spark, sf):
    q = view(spark, sf, "quotes").withColumn("p", P.devig_over(F.col("over_price"), F.col("under_price"))).where("p IS NOT NULL")
    return O.joint_probability(q, "batch", "p").withColumn("probability", F.round("probability", 6))


@query("p11_player_lines", f"WITH g AS (SELECT event, market, book, player, max(point) FILTER (WHERE side = 'Over') AS point, max(point) FILTER (WHERE side = 'Under') AS other, max(price) FILTER (WHERE side = 'Over') AS over_price, max(price) FILTER (WHERE side = 'Under') AS under_price FROM ({FIRST}) GROUP BY ALL) SELECT event, market, book, player, point, over_price, under_price FROM g WHERE point = other")
def p11(spark, sf):
    return O.player_lines(view(spark, sf, "outcomes"), ["captured_at", "batch", "seq", "point", "price"]).select("event", "market", "book", "player", "point", "over_price", "under_price")


@query("a17_regroup_by_player", "SELECT event, player, count(DISTINCT market) AS markets, count(*) AS lines, round(sum(price), 4) AS prices FROM outcomes GROUP BY ALL")
def a17(spark, sf):
    out = O.regroup_by_player(view(spark, sf, "outcomes"))
    flat = F.flatten(F.transform("markets", lambda m: m["lines"]))
    return out.select("event", "player", F.size("markets").alias("markets"), F.size(flat).alias("lines"), F.round(F.aggregate(F.transform(flat, lambda x: x["price"]), F.lit(0.0), lambda a, x: a + x), 4).alias("prices"))


PIVOT = """SELECT event, market, player, book, arg_max(point, o) FILTER (WHERE point IS NOT NULL) AS point, arg_max(price, o) FILTER (WHERE side = 'Over') AS over_price,
    arg_max(price, o) FILTER (WHERE side = 'Under') AS under_price, arg_max(price, o) FILTER (WHERE side = 'Yes') AS yes_price
    FROM (SELECT *, (captured_at, batch, seq, coalesce(point, 0), price) AS o FROM outcomes) GROUP BY ALL"""


@query("a18_pivot_sides", PIVOT)
def a18(spark, sf):
    return O.pivot_sides(view(spark, sf, "outcomes"), ["captured_at", "batch", "seq", F.coalesce("point", F.lit(0.0)), "price"])


@query(
    "a19_best_book",
    f"""WITH r AS ({PIVOT}), n AS (SELECT event, market, player, point, count(*) AS n FROM r WHERE point IS NOT NULL GROUP BY ALL),
    m AS (SELECT event, market, player, point FROM (SELECT *, row_number() OVER (PARTITION BY event, market, player ORDER BY n DESC, point) AS k FROM n) WHERE k = 1),
    c AS (SELECT r.*, row_number() OVER (PARTITION BY event, market, player ORDER BY over_price DESC, book) AS k FROM r JOIN m USING (event, market, player, point) WHERE over_price IS NOT NULL AND under_price IS NOT NULL),
    y AS (SELECT *, row_number() OVER (PARTITION BY event, market, player ORDER BY yes_price DESC, book) AS k FROM r WHERE (event, market, player) NOT IN (SELECT (event, market, player) FROM m))
    SELECT event, market, player, book, point, over_price AS price, 'line' AS kind FROM c WHERE k = 1 UNION ALL SELECT event, market, player, book, NULL, yes_price, 'yes' FROM y WHERE k = 1 AND yes_price IS NOT NULL""",
)
def a19(spark, sf):
    return O.best_book(O.pivot_sides(view(spark, sf, "outcomes"), ["captured_at", "batch", "seq", F.coalesce("point", F.lit(0.0)), "price"]), "over")


@query(
    "a20_market_status",
    """WITH w AS (SELECT event, market FROM (SELECT DISTINCT event FROM quotes) CROSS JOIN (SELECT unnest(['A', 'N', 'R', 'X']) AS market)),
    v AS (SELECT DISTINCT event, market, book, player, point, side, price FROM outcomes WHERE point IS NOT NULL AND price > 1),
    p AS (SELECT event, market, book, player, point FROM v GROUP BY ALL HAVING count(*) FILTER (WHERE side = 'Over') = 1 AND count(*) FILTER (WHERE side = 'Under') = 1),
    g AS (SELECT event, market, 2 * count(*) AS quotes FROM p GROUP BY ALL), r AS (SELECT event, market, count(*) AS raw FROM outcomes GROUP BY ALL)
    SELECT w.event, w.market, CASE WHEN raw IS NULL THEN 'unavailable' WHEN quotes IS NULL THEN 'invalid' ELSE 'returned' END AS status, coalesce(quotes, 0) AS quotes FROM w LEFT JOIN r USING (event, market) LEFT JOIN g USING (event, market)""",
)
def a20(spark, sf):
    out = view(spark, sf, "outcomes")
    wanted = out.select("event").distinct().withColumn("market", F.explode(F.array(*map(F.lit, "ANRX"))))
    return O.market_status(out, wanted)


@query("a30_book_keys", "SELECT DISTINCT book FROM outcomes")
def a30(spark, sf):
    return view(spark, sf, "outcomes").select("book").distinct().orderBy("book")


REGISTRY = [("A", "over_under", "passing_yards", "QB"), ("N", "yes_only", "touchdowns", "RB"), ("R", "over_under", "receptions", "WR")]


@query("p8_market_registry", "SELECT market, stat, position, count(*) AS n FROM outcomes JOIN (VALUES ('A', 'over_under', 'passing_yards', 'QB'), ('N', 'yes_only', 'touchdowns', 'RB'), ('R', 'over_under', 'receptions', 'WR')) m(market, shape, stat, position) USING (market) WHERE shape = 'over_under' AND side <> 'Yes' GROUP BY ALL")
def p8(spark, sf):
    known = spark.createDataFrame(REGISTRY, "market string, shape string, stat string, position string").where("shape = 'over_under'")
    return view(spark, sf, "outcomes").where("side <> 'Yes'").join(F.broadcast(known), "market").groupBy("market", "stat", "position").agg(F.count("*").alias("n"))


@query("p10_slice_and_merge", "SELECT event, book, market, side, price, point FROM (SELECT *, row_number() OVER (PARTITION BY event, book, market ORDER BY captured_at DESC, batch DESC, seq DESC, player DESC, side) AS n FROM outcomes WHERE market IN ('A', 'R')) WHERE n = 1")
def p10(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("event", "book", "market").orderBy(F.desc("captured_at"), F.desc("batch"), F.desc("seq"), F.desc("player"), "side")
    out = view(spark, sf, "outcomes").where(F.col("market").isin("A", "R"))
    return out.withColumn("n", F.row_number().over(w)).where("n = 1").select("event", "book", "market", "side", "price", "point")


#: Every quote asks for what its event and market showed at most 20 days after it.
REQUESTS = "SELECT DISTINCT event, market, player, point, captured_at + 20 AS cutoff FROM quotes"


@query(
    "j5_as_of_observation",
    f"WITH r AS ({REQUESTS}) SELECT r.event, r.market, r.player, r.point, r.cutoff, o.captured_at AS at FROM r ASOF LEFT JOIN (SELECT DISTINCT event, market, captured_at FROM quotes) o ON r.event = o.event AND r.market = o.market AND r.cutoff >= o.captured_at",
)
def j5(spark, sf):
    q = view(spark, sf, "quotes")
    return O.as_of_observations(_requests(q), q.select("event", "market", "captured_at", F.lit(0).cast("long").alias("batch")).distinct(), ["event", "market"]).drop("tie")


def _requests(q):
    return q.select("event", "market", "player", "point", (F.col("captured_at") + 20).alias("cutoff")).distinct()


@query(
    "a4_historical_consensus",
    f"""WITH r AS ({REQUESTS}), h AS (SELECT r.event, r.market, r.player, r.point, r.cutoff, o.captured_at FROM r ASOF LEFT JOIN (SELECT DISTINCT event, market, captured_at FROM quotes) o ON r.event = o.event AND r.market = o.market AND r.cutoff >= o.captured_at),
    g AS (SELECT h.*, count(*) FILTER (WHERE q.player = h.player) AS a, count(*) FILTER (WHERE q.player = h.player AND q.point = h.point) AS b,
      count(*) FILTER (WHERE q.player = h.player AND q.point = h.point AND over_price > 1 AND under_price > 1) AS books, median({DEVIG}) FILTER (WHERE q.player = h.player AND q.point = h.point AND over_price > 1 AND under_price > 1) AS p_over
      FROM h LEFT JOIN quotes q ON h.event = q.event AND h.market = q.market AND h.captured_at = q.captured_at GROUP BY ALL)
    SELECT event, market, player, point, cutoff, captured_at, CASE WHEN captured_at IS NULL THEN 'no-observation' WHEN a = 0 THEN 'player-not-found-in-observation' WHEN b = 0 THEN 'exact-line-not-found' WHEN books = 0 THEN 'no-valid-two-way-quotes' END AS reason,
      CASE WHEN captured_at IS NOT NULL THEN CASE WHEN cutoff - captured_at <= 30 THEN 'closing-candidate' ELSE 'latest-pregame' END END AS label, books, round(p_over, 6) AS p_over FROM g""",
)
def a4(spark, sf):
    q = view(spark, sf, "quotes")
    return O.historical_consensus(_requests(q), q).withColumn("p_over", F.round("p_over", 6))


@query("j9_crosswalk", "SELECT market, count(*) AS n, count(*) FILTER (WHERE c.c_custkey IS NULL) AS unresolved, count(DISTINCT coalesce(c.c_name, 'raw-' || CAST(player AS VARCHAR))) AS identities FROM quotes LEFT JOIN customer c ON quotes.player = c.c_custkey GROUP BY market")
def j9(spark, sf):
    names = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name")
    j = view(spark, sf, "quotes").join(names, F.col("player") == F.col("c_custkey"), "left")
    return j.groupBy("market").agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey").isNull()).alias("unresolved"), F.countDistinct(F.coalesce("c_name", F.concat(F.lit("raw-"), F.col("player").cast("string")))).alias("identities"))


@query(
    "w10_observed_movement",
    """WITH o AS (SELECT prop, ts, arg_min(price, event_id) AS v, arg_min(event_type, event_id) AS x FROM ticks GROUP BY prop, ts),
    g AS (SELECT prop, count(*) AS n, arg_min(v, ts) AS first, arg_max(v, ts) AS last, count(DISTINCT CASE WHEN prop % 3 = 0 THEN x ELSE 'one' END) AS c FROM o GROUP BY prop)
    SELECT prop, n, round(first, 6) AS first, round(last, 6) AS last, CASE WHEN n < 2 THEN 'single' WHEN c > 1 THEN 'not-comparable' WHEN abs(last - first) < 0.0005 THEN 'unchanged' WHEN last > first THEN 'up' ELSE 'down' END AS movement FROM g""",
)
def w10(spark, sf):
    t = view(spark, sf, "ticks").withColumn("context", F.when(F.col("prop") % 3 == 0, F.col("event_type")).otherwise("one"))
    return O.movement(t, "prop", "ts", "price", "context", "event_id").withColumn("first", F.round("first", 6)).withColumn("last", F.round("last", 6))


@query("a20_provider_clock", """WITH c AS (SELECT event, market, book, max(CASE WHEN book % 5 > 0 AND seq % 3 > 0 THEN captured_at * 86400 END) AS clock FROM outcomes GROUP BY ALL) SELECT event, market, count(*) AS books, count(*) FILTER (WHERE clock IS NULL) AS silent, CAST(max(clock) AS BIGINT) AS updated_at FROM c GROUP BY ALL""")
def a20_clock(spark, sf):
    day = F.date_format(F.timestamp_seconds(F.col("captured_at") * 86_400), "yyyy-MM-dd'T'HH:mm:ssXXX")
    text = F.when(F.col("book") % 5 == 0, F.lit(None)).when(F.col("seq") % 3 == 0, "soon").otherwise(day)
    clocks = O.market_clocks(view(spark, sf, "outcomes").withColumn("last_update", text))
    return clocks.withColumn("updated_at", F.unix_seconds("updated_at"))
