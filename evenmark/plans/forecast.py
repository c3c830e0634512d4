"""Queries on features, datasets and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import forecast as M
from .registry import query

PRIOR = """SELECT t.player, t.game, t.season, t.kickoff AS cutoff, t.value AS label, h.game AS hg, h.kickoff AS hk, h.value AS hv, row_number() OVER (PARTITION BY t.player, t.game ORDER BY h.kickoff DESC, h.game) AS n,
    count(*) OVER (PARTITION BY t.player, t.game, h.kickoff) AS same FROM {h} t JOIN {h} h ON t.player = h.player AND h.kickoff < t.kickoff AND h.game <> t.game"""


def folds_sql(h: str = "history") -> str:
    return f"SELECT player, game, any_value(season) AS season, any_value(cutoff) AS cutoff, any_value(label) AS label, count(*) AS sample_size, list(hv ORDER BY n) AS vals, list(hg ORDER BY n) AS games, bool_or(same > 1) AS tied FROM ({PRIOR.format(h=h)}) WHERE n <= 16 GROUP BY player, game"


@query("w2_lagged_features", f"""WITH f AS ({folds_sql('history_deep')}) SELECT t.player, t.game, coalesce(sample_size, 0) AS sample_size, coalesce(array_to_string(games, ','), '') AS games, coalesce(list_sum(vals), 0) AS total,
    concat_ws('|', CASE WHEN coalesce(sample_size, 0) < 2 THEN 'insufficient-history' END, CASE WHEN tied THEN 'history-order-ambiguous' END) AS reasons FROM history_deep t LEFT JOIN f USING (player, game)""")
def w2(spark, sf):
    out = M.lagged_features(view(spark, sf, "history_deep"))
    return out.select("player", "game", "sample_size", F.array_join(F.transform("history", lambda x: x["game"].cast("string")), ",").alias("games"), F.aggregate("history", F.lit(0).cast("long"), lambda a, x: a + x["value"]).alias("total"), F.array_join("reasons", "|").alias("reasons"))


@query("w13_labels", "SELECT game, CASE WHEN value IS NULL OR kickoff >= 10000 THEN 'unavailable' ELSE 'usable' END AS state, concat_ws('|', CASE WHEN value IS NULL THEN 'stats-missing' END, CASE WHEN kickoff >= 10000 THEN 'game-not-before-label-cutoff' END) AS reasons, CASE WHEN kickoff < 10000 THEN value END AS value FROM (SELECT game, kickoff, CASE WHEN game % 13 <> 0 THEN value END AS value FROM history)")
def w13(spark, sf):
    h = view(spark, sf, "history").withColumn("value", F.when(F.col("game") % 13 != 0, F.col("value")))
    return M.labels(h, 10000).select("game", "state", F.array_join("reasons", "|").alias("reasons"), "value")


def _sides(spark, sf):
    v = view(spark, sf, "versions").withColumn("season", 1992 + F.col("natural_key") % 7)
    clock = F.struct("available_at", "ingested_at")
    f = v.select(F.col("natural_key").alias("key"), "season", F.col("row_id").alias("id"), "state", clock.alias("clock"))
    lab = v.where("job % 4 <> 0").select(F.col("natural_key").alias("key"), "season", F.col("row_id").alias("id"), F.when(F.col("job") % 3 == 0, "unavailable").otherwise("usable").alias("state"), clock.alias("clock"))
    return f, lab


J8 = """WITH f0 AS (SELECT natural_key AS key, 1992 + natural_key % 7 AS season, row_id AS id, state, (available_at, ingested_at, row_id) AS o FROM versions),
    l0 AS (SELECT natural_key AS key, row_id AS id, CASE WHEN job % 3 = 0 THEN 'unavailable' ELSE 'usable' END AS state, (available_at, ingested_at, row_id) AS o FROM versions WHERE job % 4 <> 0),
    f AS (SELECT key, max(season) AS season, max(o) AS h, max(o) FILTER (WHERE state = 'usable') AS v, arg_max(id, o) FILTER (WHERE state = 'usable') AS feature, arg_max(state, o) AS s FROM f0 GROUP BY key),
    l AS (SELECT key, max(o) AS h, max(o) FILTER (WHERE state = 'usable') AS v, arg_max(id, o) FILTER (WHERE state = 'usable') AS label, arg_max(state, o) AS s FROM l0 GROUP BY key),
    d AS (SELECT f.key, season, feature, label, concat_ws('|', CASE WHEN f.h > f.v THEN 'superseded-feature' END, CASE WHEN f.h > f.v AND f.s <> 'usable' THEN 'stale-feature' END, CASE WHEN l.h > l.v THEN 'superseded-label' END, CASE WHEN l.h > l.v AND l.s <> 'usable' THEN 'stale-label' END) AS flags FROM f LEFT JOIN l USING (key)),
    j AS (SELECT *, CASE WHEN season = 1992 THEN 'warm-up-only' WHEN feature IS NULL THEN 'feature-unavailable' WHEN label IS NULL THEN 'label-unavailable' WHEN flags <> '' THEN 'superseded-excluded' END AS exclusion FROM d)"""


@query("j8_dataset_join", f"{J8} SELECT key, season, feature, label, flags, exclusion FROM j")
def j8(spark, sf):
    return M.dataset_rows(*_sides(spark, sf), 1992, False).withColumn("flags", F.array_join("flags", "|"))


@query("a25_exclusions", f"{J8} SELECT exclusion, count(*) AS n FROM j WHERE exclusion IS NOT NULL GROUP BY exclusion")
def a25(spark, sf):
    return M.dataset_rows(*_sides(spark, sf), 1992, False).where("exclusion IS NOT NULL").groupBy("exclusion").agg(F.count("*").alias("n"))


@query("u2_input_lineage", "SELECT l_suppkey AS snapshot FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F'")
def u2(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("snapshot")).union(li.where("l_linestatus = 'F'").select("l_partkey")).distinct()


@query("u4_input_sets_equal", "SELECT a.k, coalesce(a.s = b.s, false) AS same FROM (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey % 3)) AS s FROM lineitem GROUP BY 1) a LEFT JOIN (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_partkey % 3)) AS s FROM lineitem GROUP BY 1) b USING (k)")
def u4(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    g = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 3)).alias("a"), F.array_sort(F.collect_set(F.col("l_partkey") % 3)).alias("b"))
    return g.select("k", (F.col("a") == F.col("b")).alias("same"))


@query("a5_support", "SELECT player, value, round(n / sum(n) OVER (PARTITION BY player), 6) AS mass FROM (SELECT player, value, count(*) AS n FROM history_deep GROUP BY player, value)")
def a5(spark, sf):
    return M.support(view(spark, sf, "history_deep"), "player", "value").withColumn("mass", F.round("mass", 6))


@query("a6_probability_at", "SELECT player, round(count(*) FILTER (WHERE value < 250) / count(*), 6) AS under, round(count(*) FILTER (WHERE value = 250) / count(*), 6) AS push, round(count(*) FILTER (WHERE value > 250) / count(*), 6) AS over FROM history_deep GROUP BY player")
def a6(spark, sf):
    p = M.probability_at(M.support(view(spark, sf, "history_deep"), "player", "value"), "player", 250)
    return p.select("player", *[F.round(c, 6).alias(c) for c in ("under", "push", "over")])


@query("p16_baseline_eligibility", """SELECT player, CASE WHEN player % 11 = 0 THEN 'unsupported-market' WHEN count(*) <> count(DISTINCT game) THEN 'duplicate-or-missing-identity' WHEN max(kickoff) >= 12400 THEN 'target-or-future-event' WHEN min(value) < 2 THEN 'invalid-outcome' WHEN count(*) < 8 THEN 'insufficient-samples' END AS reason, count(*) AS n FROM history GROUP BY player""")
def p16(spark, sf):
    g = view(spark, sf, "history").groupBy("player").agg(F.count("*").alias("n"), F.countDistinct("game").alias("d"), F.max("kickoff").alias("k"), F.min("value").alias("v"))
    why = F.when(F.col("player") % 11 == 0, "unsupported-market").when(F.col("n") != F.col("d"), "duplicate-or-missing-identity").when(F.col("k") >= 12400, "target-or-future-event").when(F.col("v") < 2, "invalid-outcome").when(F.col("n") < 8, "insufficient-samples")
    return g.select("player", why.alias("reason"), "n")


def _folds(spark, sf):
    h = view(spark, sf, "history")
    f = M.lagged_features(h).drop("reasons").join(h.select("game", F.col("value").alias("label")), "game")
    return M.qualify(f, (1993, 1998))


FOLDS = f"""WITH f AS ({folds_sql()}), q AS (SELECT t.player, t.game, t.season, t.kickoff AS cutoff, t.value AS label, coalesce(sample_size, 0) AS sample_size, vals, games,
    CASE WHEN t.season NOT BETWEEN 1993 AND 1998 THEN 'outside-evaluation-seasons' WHEN coalesce(sample_size, 0) < 2 THEN 'invalid-sample-policy' END AS reason FROM history t LEFT JOIN f USING (player, game)),
    s AS (SELECT *, CASE WHEN sample_size >= 9 THEN '9-16' WHEN sample_size >= 5 THEN '5-8' WHEN sample_size >= 2 THEN '2-4' ELSE 'unassigned' END AS stratum FROM q WHERE reason IS NULL),
    k AS (SELECT s.*, threshold, len(list_filter(vals, lambda v: v > threshold)) AS n_over, len(list_filter(vals, lambda v: v < threshold)) AS n_under, label > threshold AS hit FROM s CROSS JOIN (VALUES (199.5), (224.5), (249.5), (274.5), (299.5)) t(threshold)),
    c AS (SELECT *, n_under / sample_size AS p_under, n_over / sample_size AS p_over, CASE WHEN hit THEN 'over' ELSE 'under' END AS outcome, 2 * (n_over / sample_size - hit::INT) ** 2 AS brier_three, (n_over / sample_size - hit::INT) ** 2 AS brier_binary,
      CASE WHEN (CASE WHEN hit THEN n_over ELSE n_under END) = 0 THEN CAST('inf' AS DOUBLE) ELSE -ln((CASE WHEN hit THEN n_over ELSE n_under END) / sample_size) END AS log_loss, least(9, 10 * n_over // sample_size) AS bin_over, least(9, 10 * n_under // sample_size) AS bin_under FROM k)"""


@query("p17_fold_qualification", f"{FOLDS} SELECT season, coalesce(reason, 'qualified') AS reason, count(*) AS n FROM q GROUP BY ALL")
def p17(spark, sf):
    return _folds(spark, sf).groupBy("season", F.coalesce("reason", F.lit("qualified")).alias("reason")).agg(F.count("*").alias("n"))


def _good(spark, sf):
    return _folds(spark, sf).where("reason IS NULL").withColumn("stratum", M.stratum(F.col("sample_size")))


def _cases(spark, sf):
    return M.scored_cases(_good(spark, sf))


SIX = lambda *c: [F.round(x, 6).alias(x) for x in c]


@query("a7_scores", f"{FOLDS} SELECT season, count(*) AS n, round(avg(brier_three), 6) AS brier_three, round(avg(brier_binary), 6) AS brier_binary, avg(log_loss) AS log_loss, count(*) FILTER (WHERE isinf(log_loss)) AS infinite FROM c GROUP BY season")
def a7(spark, sf):
    return M.mean_scores(_cases(spark, sf), ["season"]).select("season", "n", *SIX("brier_three", "brier_binary"), "log_loss", "infinite")


@query("a8_version_scores", f"{FOLDS} SELECT stratum, CASE WHEN game % 2 = 0 THEN 'v1' ELSE 'v2' END AS version, count(*) AS n, round(avg(brier_three), 6) AS brier_three FROM c GROUP BY ALL")
def a8(spark, sf):
    c = _cases(spark, sf).withColumn("version", F.when(F.col("game") % 2 == 0, "v1").otherwise("v2"))
    return M.mean_scores(c, ["stratum", "version"]).select("stratum", "version", "n", *SIX("brier_three"))


@query("a9_calibration", f"""{FOLDS}, e AS (SELECT threshold, 'over' AS side, bin_over AS bin, p_over AS p, outcome = 'over' AS hit FROM c UNION ALL SELECT threshold, 'under', bin_under, p_under, outcome = 'under' FROM c),
    g AS (SELECT threshold, side, bin, count(*) AS n, avg(p) AS mp, avg(hit::INT) AS rate FROM e GROUP BY ALL)
    SELECT CAST(t AS DOUBLE) AS threshold, side, CAST(b AS INT) AS bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_probability, round(rate, 6) AS outcome_rate FROM (SELECT DISTINCT threshold AS t FROM c) CROSS JOIN (VALUES ('over'), ('under')) x(side) CROSS JOIN range(10) y(b) LEFT JOIN g ON g.threshold = t AND g.side = x.side AND g.bin = b""".replace("SELECT CAST(t AS DOUBLE) AS threshold, side,", "SELECT CAST(t AS DOUBLE) AS threshold, x.side,"))
def a9(spark, sf):
    return M.calibration(_cases(spark, sf), ["threshold"]).select("threshold", "side", "bin", "n", *SIX("mean_probability", "outcome_rate"))


@query("a10_rps", f"{FOLDS} SELECT player, game, round(list_sum(list_transform(vals, lambda x: abs(x - label))) / sample_size - list_sum(list_transform(vals, lambda x: list_sum(list_transform(vals, lambda y: abs(x - y))))) / (2 * sample_size * sample_size), 6) AS rps FROM s")
def a10(spark, sf):
    values = F.transform("history", lambda x: x["value"].cast("double"))
    return _good(spark, sf).select("player", "game", F.round(M.rps(values, F.col("label")), 6).alias("rps"))


@query("a11_report_cube", f"""{FOLDS}, g AS (SELECT coalesce(CAST(season AS VARCHAR), 'all') AS season, coalesce(stratum, 'all') AS stratum, threshold, count(*) AS n, avg(brier_three) AS b, avg(log_loss) AS l FROM c GROUP BY GROUPING SETS ((season, stratum, threshold), (season, threshold), (stratum, threshold), (threshold)))
    SELECT x.season, y.stratum, CAST(z.threshold AS DOUBLE) AS threshold, coalesce(n, 0) AS n, round(b, 6) AS brier_three, l AS log_loss FROM (VALUES ('all'), ('1993'), ('1994'), ('1995'), ('1996'), ('1997'), ('1998')) x(season) CROSS JOIN (VALUES ('all'), ('2-4'), ('5-8'), ('9-16'), ('unassigned')) y(stratum)
    CROSS JOIN (VALUES (199.5), (224.5), (249.5), (274.5), (299.5)) z(threshold) LEFT JOIN g USING (season, stratum, threshold)""")
def a11(spark, sf):
    return M.report_cube(_cases(spark, sf), list(range(1993, 1999))).withColumn("brier_three", F.round("brier_three", 6))


@query("a12_extreme_probabilities", f"{FOLDS} SELECT stratum, CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE isinf(log_loss)) AS infinite, round(count(*) FILTER (WHERE isinf(log_loss)) / count(*), 6) AS fraction, count(*) FILTER (WHERE p_over = 0) AS over_zero, count(*) FILTER (WHERE p_over = 1) AS over_one, count(*) FILTER (WHERE p_under = 0) AS under_zero, count(*) FILTER (WHERE p_under = 1) AS under_one FROM c GROUP BY ALL")
def a12(spark, sf):
    m = M.mean_scores(_cases(spark, sf), ["stratum", "threshold"])
    return m.select("stratum", "threshold", "infinite", F.round(F.col("infinite") / F.col("n"), 6).alias("fraction"), "over_zero", "over_one", "under_zero", "under_one")


@query("a13_combined_scores", f"{FOLDS} SELECT season, CAST(sum(n) AS BIGINT) AS cases, round(avg(b), 6) AS brier_three FROM (SELECT season, threshold, count(*) AS n, avg(brier_three) AS b FROM c GROUP BY ALL) GROUP BY season")
def a13(spark, sf):
    return M.combined_scores(_cases(spark, sf), ["season"]).select("season", "cases", *SIX("brier_three"))


@query("a14_coverage_ledger", "SELECT lang, season, count(*) AS candidates, count(*) FILTER (WHERE feature_ok) AS available, count(*) FILTER (WHERE label_ok) AS usable_labels, count(*) FILTER (WHERE feature_ok AND label_ok) AS scored, count(*) FILTER (WHERE NOT feature_ok) AS missing_features, count(*) FILTER (WHERE NOT label_ok) AS missing_labels, count(DISTINCT source) AS players, count(DISTINCT doc_id) AS games FROM ledger GROUP BY ALL")
def a14(spark, sf):
    return M.coverage_ledger(view(spark, sf, "ledger").withColumnsRenamed({"source": "player", "doc_id": "game"}), ["lang", "season"])


@query("a15_walk_forward", f"""{FOLDS}, u AS (SELECT player, game AS fold, cutoff AS at, unnest(games) AS game FROM s), n AS (SELECT player, game, count(*) AS n FROM u GROUP BY ALL), p AS (SELECT u.player, u.fold FROM u JOIN s ON s.player = u.player AND s.game = u.game WHERE (s.cutoff, s.game) < (u.at, u.fold))
    SELECT CAST(sum(n) AS BIGINT) AS history_references, count(*) AS player_games, count(*) FILTER (WHERE n > 1) AS reused, (SELECT count(DISTINCT (player, fold)) FROM p) AS folds_with_prior, (SELECT count(*) FROM p) AS prior_references FROM n""")
def a15(spark, sf):
    return M.walk_forward(_good(spark, sf))


@query("s9_report_encoding", f"{FOLDS} SELECT stratum, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN isinf(avg(log_loss)) THEN 'positive-infinity' ELSE 'finite' END AS log_loss FROM c GROUP BY ALL")
def s9(spark, sf):
    m = M.mean_scores(_cases(spark, sf), ["stratum", "threshold"])
    return m.select("stratum", "threshold", F.when(F.isnan("log_loss"), F.raise_error(F.lit("invalid-nonfinite-report-value"))).when(F.col("log_loss") == float("inf"), "positive-infinity").otherwise("finite").alias("log_loss"))


def digest_sql(source: str) -> str:
    """The content digest of player, game and value by player and game: leaves of one digit, or one leaf."""
    text = lambda *names: " || ".join(f"length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR)" for c in names)
    return f"""WITH l AS (SELECT sha256({text('player', 'game')}) AS k, sha256({text('player', 'game', 'value')}) AS h FROM {source}), n AS (SELECT count(*) AS n FROM l),
    u AS (SELECT CASE WHEN n <= 4096 THEN '' ELSE substr(k, 1, 1) END AS p, k, h || CASE WHEN count(*) > 1 THEN 'x' || count(*) ELSE '' END AS t, count(*) AS c FROM l CROSS JOIN n GROUP BY n, k, h),
    f AS (SELECT p, sum(c) AS c, sha256(string_agg(t, '' ORDER BY k, t)) AS d FROM u GROUP BY p)
    SELECT CAST(sum(c) AS BIGINT) AS rows, CASE WHEN max(p) = '' THEN max(d) ELSE sha256(string_agg(p || d, '' ORDER BY p)) END AS digest FROM f"""


@query("f19_content_digest", digest_sql("history"))
def f19(spark, sf):
    return M.content_digest(view(spark, sf, "history"), [F.col("player"), F.col("game")], [F.col("player"), F.col("game"), F.col("value")])


@query("a14_coverage_reasons", """WITH l AS (SELECT lang, doc_id, feature_ok, label_ok, CASE WHEN sample_size % 4 = 0 THEN ['rights', 'rights'] ELSE [] END AS policy, CASE WHEN NOT feature_ok THEN ['insufficient-history'] ELSE [] END AS fr, CASE WHEN NOT label_ok THEN ['stats-missing', 'late'] ELSE [] END AS lr, CASE WHEN toxic = 1 THEN ['stale-label'] ELSE [] END AS flags, sample_size % 3 AS gaps, CASE WHEN sample_size > 2 THEN sample_size % 5 = 0 END AS zero FROM ledger),
    e AS (SELECT lang, 'exclusion' AS kind, CASE WHEN NOT feature_ok THEN 'feature-unavailable' WHEN NOT label_ok THEN 'label-unavailable' WHEN len(policy) > 0 THEN 'policy-excluded' END AS reason FROM l UNION ALL SELECT lang, 'policy', unnest(list_distinct(policy)) FROM l UNION ALL SELECT lang, 'flag', unnest(flags) FROM l UNION ALL SELECT lang, 'gap', unnest(list_transform(range(gaps), lambda x: 'bye')) FROM l
      UNION ALL SELECT lang, 'reason', 'feature:' || unnest(fr) FROM l UNION ALL SELECT lang, 'reason', 'label:' || unnest(lr) FROM l UNION ALL SELECT lang, 'history', 'candidates' FROM l WHERE gaps > 0 UNION ALL SELECT lang, 'history', unnest(list_transform(range(gaps), lambda x: 'records')) FROM l
      UNION ALL SELECT lang, 'zero-opportunity', CASE WHEN zero THEN 'zero-attempts' WHEN zero IS NULL THEN 'unknown' END FROM l)
    SELECT lang, kind, reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY ALL""")
def a14_reasons(spark, sf):
    some = lambda test, *names: F.when(test, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    n = F.col("sample_size")
    rows = view(spark, sf, "ledger").withColumn("policy", some(n % 4 == 0, "rights", "rights")).withColumn("feature_reasons", some(~F.col("feature_ok"), "insufficient-history")).withColumn("label_reasons", some(~F.col("label_ok"), "stats-missing", "late"))
    rows = rows.withColumn("flags", some(F.col("toxic") == 1, "stale-label")).withColumn("gaps", F.array_repeat(F.array(F.lit("bye")), (n % 3).cast("int"))).withColumn("zero_attempts", F.when(n > 2, n % 5 == 0))
    return M.coverage_reasons(rows, ["lang"])
