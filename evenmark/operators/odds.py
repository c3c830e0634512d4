"""Quotes and outcomes of priced markets: consensus, expected value, best lines, market snapshots.

Outcomes have the columns event, market, book, player, side, point, price; quotes have over_price and under_price on one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import clamp01, devig_over, valid_price
from .scans import MOST, rows_in
from .temporal import newest_in_time

#: Weights of the adjustments to a hit rate.
WIND_FREE, WIND_RATE, WET, COVERAGE_RATE = 10, 0.004, 0.03, 0.1


def valid_outcome(name: str = "player") -> Column:
    """A named Over or Under outcome with a finite point and a price over 1."""
    text = F.trim(F.col(name).cast("string"))
    point = F.col("point")
    finite = point.isNotNull() & ~F.isnan(point) & (F.abs(point) < float("inf"))
    return F.coalesce((F.length(text) > 0) & finite & valid_price(F.col("price")) & F.col("side").isin("Over", "Under"), F.lit(False))


def line_consensus(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, point, p_over, p_under, books): the median of devigged quotes at each point."""
    p = quotes.withColumn("p", devig_over(F.col("over_price"), F.col("under_price"))).where(F.col("p").isNotNull() & ~F.isnan("point"))
    out = p.groupBy(*keys, "point").agg(F.median("p").alias("p_over"), F.count("*").alias("books"))
    return out.withColumn("p_under", 1 - F.col("p_over"))


def last_n(history: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key, with `recency` 1 for the newest."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return history.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def expected_value(lines: DataFrame, history: DataFrame, key: str = "player", n: int = 5) -> DataFrame:
    """Scores each line for both directions against the last n values of its key.

    lines: key, point, p_over, wind, rain, coverage. Keys without history have no score. Adds direction, base_rate,
    after_environment, model_p, implied_p, edge and n_games.
    """
    recent = last_n(history, [key], [F.desc("kickoff"), F.desc("game")], n).groupBy(key).agg(F.collect_list("value").alias("values"))
    hits = lambda f: F.size(F.filter("values", f))
    counted = lines.join(recent, key).withColumn("n_games", F.size("values"))
    sides = F.array(F.struct(F.lit("over").alias("direction"), hits(lambda v: v > F.col("point")).alias("hits")), F.struct(F.lit("under").alias("direction"), hits(lambda v: v < F.col("point")).alias("hits")))
    both = counted.withColumn("_s", sides).drop("values").withColumn("_s", F.explode("_s")).select("*", "_s.*").drop("_s")
    over = F.col("direction") == "over"
    sign = F.when(over, -1.0).otherwise(1.0)
    drag = F.greatest(F.lit(0), F.col("wind") - WIND_FREE) * WIND_RATE + F.when(F.col("rain") > 0, WET).otherwise(0.0)
    out = both.withColumn("base_rate", F.col("hits") / F.col("n_games")).drop("hits")
    out = out.withColumn("after_environment", clamp01(F.col("base_rate") + sign * drag))
    out = out.withColumn("model_p", clamp01(F.col("after_environment") + sign * F.col("coverage") * COVERAGE_RATE))
    out = out.withColumn("implied_p", F.when(over, F.col("p_over")).otherwise(1 - F.col("p_over")))
    return out.withColumn("edge", F.col("model_p") - F.col("implied_p"))


def recent_average(history: DataFrame, key: str, n: int) -> DataFrame:
    """(key, average, sample_size) of the last n values."""
    return last_n(history, [key], [F.desc("kickoff"), F.desc("game")], n).groupBy(key).agg(F.avg("value").alias("average"), F.count("*").alias("sample_size"))


def joint_probability(legs: DataFrame, key: str, p: str) -> DataFrame:
    """(key, legs, probability): the product of the legs' probabilities, in ascending order of the factors."""
    return legs.groupBy(key).agg(F.count(p).alias("legs"), F.array_sort(F.collect_list(p)).alias("ps")).select(key, "legs", F.aggregate("ps", F.lit(1.0), lambda a, x: a * x).alias("probability"))


def first_outcomes(outcomes: DataFrame, order: list[str]) -> DataFrame:
    """The first outcome of each event, market, book, player and side."""
    w = Window.partitionBy("event", "market", "book", "player", "side").orderBy(*order)
    return outcomes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def player_lines(outcomes: DataFrame, order: list[str]) -> DataFrame:
    """Over and Under of one book as a row, where the first of each stand at the same point."""
    place = F.struct(*order)
    first = lambda side: F.min_by(F.struct("point", "price"), F.when(F.col("side") == side, place))
    both = outcomes.groupBy("event", "market", "book", "player").agg(first("Over").alias("o"), first("Under").alias("u"))
    return both.where("o.point = u.point").select("event", "market", "book", "player", "o.point", F.col("o.price").alias("over_price"), F.col("u.price").alias("under_price"))


def regroup_by_player(outcomes: DataFrame) -> DataFrame:
    """Nested rows: player -> markets -> lines; unnamed outcomes are left out."""
    line = F.struct("book", "side", "point", "price")
    named = outcomes.where("player IS NOT NULL AND length(cast(player AS string)) > 0")
    markets = named.groupBy("event", "player", "market").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return markets.groupBy("event", "player").agg(F.array_sort(F.collect_list(F.struct("market", "lines"))).alias("markets"))


def pivot_sides(outcomes: DataFrame, order: list[str]) -> DataFrame:
    """One row for each event, market, player and book with the last price of each side and the last point."""
    newest = F.struct(*order)
    agg = [F.max_by(F.when(F.col("side") == s, F.col("price")), F.when(F.col("side") == s, newest)).alias(f"{s.lower()}_price") for s in ("Over", "Under", "Yes")]
    return outcomes.groupBy("event", "market", "player", "book").agg(F.max_by("point", F.when(F.col("point").isNotNull(), newest)).alias("point"), *agg)


def best_book(rows: DataFrame, direction: str) -> DataFrame:
    """(event, market, player, book, point, price): the best book at the point that most books quote.

    A prop whose rows have no two-way price takes the highest Yes price. Ties go to the lower point, then the smaller book.
    """
    keys = ["event", "market", "player"]
    prop = Window.partitionBy(*keys)
    # the counts of points, the modal point and the best row all need the rows of a prop together: one shuffle
    n = rows.withColumn("_n", F.when(F.col("point").isNotNull(), F.count("*").over(Window.partitionBy(*keys, "point"))))
    n = n.withColumn("_m", F.max(F.when(F.col("_n").isNotNull(), F.struct("_n", (-F.col("point")).alias("low")))).over(prop))
    price = F.col(f"{direction}_price")
    full = F.col("over_price").isNotNull() & F.col("under_price").isNotNull() & (F.col("point") == -F.col("_m.low"))
    low = (-F.col("book")).alias("low")
    out = n.groupBy(*keys).agg(F.count("point").alias("points"), F.max(F.when(full, F.struct(price.alias("price"), low, "point"))).alias("two"), F.max(F.when(F.col("yes_price").isNotNull(), F.struct(F.col("yes_price").alias("price"), low, F.lit(None).cast("double").alias("point")))).alias("yes"))
    b = F.when(F.col("points") > 0, F.col("two")).otherwise(F.col("yes"))
    out = out.withColumn("b", b).where("b IS NOT NULL")
    return out.select(*keys, (-F.col("b.low")).alias("book"), F.col("b.point").alias("point"), F.col("b.price").alias("price"), F.when(F.col("points") > 0, "line").otherwise("yes").alias("kind"))


def market_status(outcomes: DataFrame, markets: DataFrame) -> DataFrame:
    """(event, market, status, quotes): what a snapshot of each wanted market holds.

    Equal outcomes of a book count once; a pair is a quote if there is one Over and one Under price at its point.
    unavailable: no rows; invalid: rows but no quote; returned: quotes.
    """
    valid = outcomes.where(valid_outcome()).select("event", "market", "book", "player", "point", "side", "price").distinct()
    pairs = valid.groupBy("event", "market", "book", "player", "point").agg(F.count_if(F.col("side") == "Over").alias("o"), F.count_if(F.col("side") == "Under").alias("u")).where("o = 1 AND u = 1")
    good = pairs.groupBy("event", "market").agg((2 * F.count("*")).alias("quotes"))
    raw = outcomes.groupBy("event", "market").agg(F.count("*").alias("raw"), F.count_if(F.col("side").isNotNull()).alias("named"))
    out = markets.join(raw, ["event", "market"], "left").join(good, ["event", "market"], "left")
    status = F.when(F.col("raw").isNull(), "unavailable").when(F.col("named") == 0, "empty").when(F.col("quotes").isNull(), "invalid").otherwise("returned")
    return out.select("event", "market", status.alias("status"), F.coalesce("quotes", F.lit(0)).alias("quotes"))


def as_of_observations(requests: DataFrame, observations: DataFrame, keys: list[str], cutoff: str = "cutoff", clock: str = "captured_at", tie: str = "batch", most: int = MOST, bound: int | None = None) -> DataFrame:
    """Each request with the newest observation of its keys at or before its cutoff; requests without one keep nulls.

    Both stand in one order of their keys' clocks, where each request takes the last observation before it: no request
    is paired with all observations. Equal requests are one. Keys of more than `most` rows are cut by time.
    """
    right = observations.dropna(subset=[clock]).select(*keys, F.col(clock).alias("_at"), F.struct(F.col(clock).alias("at"), F.col(tie).alias("tie")).alias("_v"))
    best = newest_in_time(right, requests.distinct().withColumn("_at", F.col(cutoff)).withColumn("_asked", F.lit(True)), keys, most, rows_in(requests, observations) if bound is None else bound)
    return best.select(*requests.columns, F.col("v.at").alias("at"), F.col("v.tie").alias("tie"))


def historical_consensus(requests: DataFrame, quotes: DataFrame, most: int = MOST) -> DataFrame:
    """Consensus of each request (event, market, player, point, cutoff) from the newest snapshot at its cutoff, or the first reason why not.

    A snapshot is what was captured of an event and market at one clock. The label is closing-candidate when it was
    captured `lead` or less before the cutoff. Quotes are told up to one row for each line of a snapshot before requests
    meet them, so a request meets its line and its player, not all quotes of its snapshot.
    """
    snapshots = quotes.select("event", "market", "captured_at").distinct().withColumn("batch", F.lit(0).cast("long"))
    held = as_of_observations(requests, snapshots, ["event", "market"], most=most, bound=rows_in(requests, quotes)).drop("tie").withColumnRenamed("at", "captured_at")
    player = ["event", "market", "captured_at", "player"]
    p = devig_over(F.col("over_price"), F.col("under_price"))
    lines = quotes.groupBy(*player, "point").agg(F.count(p).alias("b"), F.median(p).alias("p_over"))
    players = quotes.select(*player).distinct().withColumn("a", F.lit(True))
    out = held.join(lines, [*player, "point"], "left").join(players, player, "left").withColumn("books", F.coalesce("b", F.lit(0)))
    reason = F.when(F.col("captured_at").isNull(), "no-observation").when(F.col("a").isNull(), "player-not-found-in-observation").when(F.col("b").isNull(), "exact-line-not-found").when(F.col("books") == 0, "no-valid-two-way-quotes")
    label = F.when(F.col("captured_at").isNotNull(), F.when(F.col("cutoff") - F.col("captured_at") <= 30, "closing-candidate").otherwise("latest-pregame"))
    return out.select("event", "market", "player", "point", "cutoff", "captured_at", reason.alias("reason"), label.alias("label"), "books", "p_over")


def movement(points: DataFrame, key: str, clock: str, value: str, context: str, tie: str, still: float = 0.0005) -> DataFrame:
    """First against last value of each key, after dropping repeated clocks (the smallest tie stays)."""
    one = points.groupBy(key, F.col(clock).alias("c")).agg(F.min_by(F.struct(F.col(value).alias("v"), F.col(context).alias("x")), tie).alias("r"))
    out = one.groupBy(key).agg(F.count("*").alias("n"), F.min_by("r.v", "c").alias("first"), F.max_by("r.v", "c").alias("last"), F.countDistinct("r.x").alias("contexts"))
    change = F.col("last") - F.col("first")
    state = F.when(F.col("n") < 2, "single").when(F.col("contexts") > 1, "not-comparable").when(F.abs(change) < still, "unchanged").when(change > 0, "up").otherwise("down")
    return out.select(key, "n", "first", "last", state.alias("movement"))


def provider_clocks(markets: DataFrame) -> DataFrame:
    """(event, market, book, updated_at): the latest clock that a book gives for a market in its responses; null if none of them is an instant.

    markets: event, market, book, last_update as text.
    """
    return markets.groupBy("event", "market", "book").agg(F.max(F.col("last_update").try_cast("timestamp")).alias("updated_at"))


def market_clocks(markets: DataFrame) -> DataFrame:
    """(event, market, books, silent, updated_at): books of a snapshot, those without a clock, and the latest clock of all."""
    return provider_clocks(markets).groupBy("event", "market").agg(F.count("*").alias("books"), F.count_if(F.col("updated_at").isNull()).alias("silent"), F.max("updated_at").alias("updated_at"))
