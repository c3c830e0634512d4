"""Queries on governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import forecast as M
from ..operators import governance as G
from ..operators import temporal as T
from .forecast import folds_sql
from .registry import query


@query("j11_unmatched", "SELECT o_custkey % 1700 AS player, count(*) AS n, o_custkey % 1700 NOT IN (SELECT player FROM roster WHERE position = 'QB') AS no_roster, o_custkey % 1700 NOT IN (SELECT p_partkey FROM part) AS no_part FROM orders GROUP BY ALL")
def j11(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").groupBy((F.col("o_custkey") % 1700).alias("player")).agg(F.count("*").alias("n"))
    return G.unmatched(o, {"roster": view(spark, sf, "roster").where("position = 'QB'"), "part": spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("player"))}, "player")


@query("a27_population_diagnostics", "SELECT season, count(*) AS candidates, count(*) FILTER (WHERE player NOT IN (SELECT player FROM roster WHERE position = 'QB')) AS no_roster FROM history GROUP BY season")
def a27(spark, sf):
    h = G.unmatched(view(spark, sf, "history"), {"roster": view(spark, sf, "roster").where("position = 'QB'")}, "player")
    return h.groupBy("season").agg(F.count("*").alias("candidates"), F.count_if("no_roster").alias("no_roster"))


INVENTORY = """l AS (SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS address, n_chars AS size, sha256(text) AS digest FROM documents WHERE doc_id % 10 <> 3), r AS (SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS address, CASE WHEN doc_id % 10 = 4 THEN n_chars + 1 ELSE n_chars END AS size, CASE WHEN doc_id % 10 = 5 THEN 'x' ELSE sha256(text) END AS digest FROM documents WHERE doc_id % 10 <> 6)"""


@query("j23_inventory", f"WITH {INVENTORY} SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.address IS NULL THEN 'missing' WHEN r.address IS NULL THEN 'orphan' WHEN l.size <> r.size THEN 'size-mismatch' WHEN l.digest <> r.digest THEN 'corrupt' ELSE 'ok' END AS status FROM l FULL JOIN r ON l.address = r.address) GROUP BY status")
def j23(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("address"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("digest"))
    k = F.col("doc_id") % 10
    refs = d.where(k != 6).withColumn("size", F.when(k == 4, F.col("size") + 1).otherwise(F.col("size"))).withColumn("digest", F.when(k == 5, "x").otherwise(F.col("digest")))
    return G.reconcile_inventory(d.where(k != 3), refs).groupBy("status").agg(F.count("*").alias("n"))


@query("j24_replay_parity", "SELECT status, count(*) AS rows FROM (SELECT CASE WHEN a.game IS NULL THEN 'unexpected' WHEN b.game IS NULL THEN 'missing' WHEN a.value IS NOT DISTINCT FROM b.value AND a.kickoff = b.kickoff THEN 'equal' ELSE 'different' END AS status FROM (SELECT * FROM history WHERE game % 9 > 0) a FULL JOIN (SELECT game, kickoff, CASE WHEN game % 13 = 0 THEN value + 1 ELSE value END AS value FROM history WHERE game % 7 > 0) b ON a.game = b.game) GROUP BY status")
def j24(spark, sf):
    h = view(spark, sf, "history")
    replay = h.where("game % 7 > 0").withColumn("value", F.when(F.col("game") % 13 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return G.replay_parity(h.where("game % 9 > 0"), replay, ["game"], ["kickoff", "value"])


@query("j25_validated_absences", """WITH c AS (SELECT DISTINCT captured_at * 100 + event AS capture, event AS scope, captured_at, captured_at % 3 > 0 AS full_scope FROM quotes), r AS (SELECT DISTINCT player AS id, event AS scope, captured_at FROM quotes),
    f AS (SELECT r.id, r.scope, r.captured_at, c.captured_at AS later FROM r ASOF JOIN (SELECT * FROM c WHERE full_scope) c ON r.scope = c.scope AND r.captured_at < c.captured_at)
    SELECT id, scope, later * 100 + scope AS capture FROM f ANTI JOIN quotes q ON q.player = f.id AND q.event = f.scope AND q.captured_at = later""")
def j25(spark, sf):
    q = view(spark, sf, "quotes")
    capture = (F.col("captured_at") * 100 + F.col("event")).alias("capture")
    caps = q.select(capture, F.col("event").alias("scope"), "captured_at", (F.col("captured_at") % 3 > 0).alias("full")).distinct()
    rows = q.select(F.col("player").alias("id"), F.col("event").alias("scope"), "captured_at")
    return G.validated_absences(rows, caps, q.select(capture, F.col("player").alias("id"))).select("id", "scope", "capture")


CLAIMS = "SELECT l_orderkey AS id, l_suppkey % 4 AS source, CASE WHEN l_discount > 0.02 THEN CAST(l_quantity AS BIGINT) // 25 END AS value FROM lineitem"
RECONCILED = f"SELECT id, CASE WHEN count(value) = 0 THEN 'none' WHEN count(value) = 1 THEN 'single' WHEN count(DISTINCT value) = 1 THEN 'agree' ELSE 'conflict' END AS result, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value FROM ({CLAIMS}) GROUP BY id"


def _reconciled(spark, sf):
    c = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 4).alias("source"), F.expr("CASE WHEN l_discount > 0.02 THEN CAST(l_quantity AS BIGINT) div 25 END").alias("value"))
    return G.reconcile_sources(c, "id", "source", "value")


@query("a28_source_reconciliation", RECONCILED)
def a28(spark, sf):
    return _reconciled(spark, sf)


CONSENSUS = """c AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'played' WHEN 'N' THEN 'absent' END AS claim FROM lineitem WHERE l_linenumber = 1), s AS (SELECT l_orderkey AS id, count(*) AS n, bool_and(l_quantity > 10) AS p FROM lineitem WHERE l_linenumber = 2 GROUP BY 1),
    g AS (SELECT id, list(DISTINCT claim) FILTER (WHERE claim IS NOT NULL) AS k FROM c GROUP BY id), u AS (SELECT coalesce(g.id, s.id) AS id, list_distinct(list_concat(coalesce(k, []), CASE WHEN p THEN ['played'] ELSE [] END)) AS k FROM g FULL JOIN s ON g.id = s.id)"""


@query("a29_participation_consensus", f"WITH {CONSENSUS} SELECT id, CASE WHEN len(k) > 1 THEN 'conflicting' WHEN len(k) = 1 THEN k[1] ELSE 'unresolved' END AS state FROM u")
def a29(spark, sf):
    return _participation(spark, sf)


def _participation(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").withColumnRenamed("l_orderkey", "id")
    claims = li.where("l_linenumber = 1").select("id", F.expr("CASE l_returnflag WHEN 'A' THEN 'played' WHEN 'N' THEN 'absent' END").alias("claim"))
    return G.participation_consensus(claims, li.where("l_linenumber = 2").select("id", (F.col("l_quantity") > 10).alias("positive")), "id")


@query("a31_source_compatibility", "WITH t AS (SELECT l_orderkey AS game, l_linenumber AS key, 's' || CAST(l_suppkey % 3 AS VARCHAR) AS source, l_quantity AS value FROM lineitem), g AS (SELECT game FROM t WHERE source IN ('s0', 's1') GROUP BY game HAVING count(DISTINCT source) = 2), k AS (SELECT game, key, count(*) FILTER (WHERE source = 's0') AS a, count(*) FILTER (WHERE source = 's1') AS b, count(DISTINCT value) AS d FROM t JOIN g USING (game) WHERE source IN ('s0', 's1') GROUP BY ALL) SELECT count(DISTINCT game) AS overlap, CASE WHEN count(*) = 0 THEN 'insufficient-overlap' WHEN bool_or(a <> 1 OR b <> 1 OR d <> 1) THEN 'incompatible' ELSE 'compatible' END AS result FROM k")
def a31(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("key"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("source"), F.col("l_quantity").alias("value"))
    return G.source_compatibility(t, ("s0", "s1"))


MARKERS = "SELECT l_orderkey AS game, CASE l_suppkey % 7 WHEN 0 THEN 'final' WHEN 1 THEN 'terminal' WHEN 2 THEN 'totals' WHEN 3 THEN 'suspended' WHEN 4 THEN 'postponed' ELSE 'other' END AS marker, @day(l_shipdate) AS moment FROM lineitem WHERE l_linenumber < 3"
STATES = f"""SELECT game, CASE WHEN greatest(f, t, o, s, p) > 1 OR ((s > 0 OR p > 0) AND f + t + o > 0) OR (s > 0 AND p > 0) THEN 'conflicting' WHEN s > 0 THEN 'suspended' WHEN p > 0 THEN 'postponed' WHEN f > 0 AND t + o > 0 THEN 'completed' WHEN f + t + o > 0 THEN 'in-progress' ELSE 'scheduled' END AS state, fa, ta, oa FROM
    (SELECT game, count(*) FILTER (WHERE marker = 'final') AS f, count(*) FILTER (WHERE marker = 'terminal') AS t, count(*) FILTER (WHERE marker = 'totals') AS o, count(*) FILTER (WHERE marker = 'suspended') AS s, count(*) FILTER (WHERE marker = 'postponed') AS p,
     max(moment) FILTER (WHERE marker = 'final') AS fa, max(moment) FILTER (WHERE marker = 'terminal') AS ta, max(moment) FILTER (WHERE marker = 'totals') AS oa FROM ({MARKERS}) GROUP BY game)"""


def _states(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber < 3")
    m = F.expr("CASE l_suppkey % 7 WHEN 0 THEN 'final' WHEN 1 THEN 'terminal' WHEN 2 THEN 'totals' WHEN 3 THEN 'suspended' WHEN 4 THEN 'postponed' ELSE 'other' END")
    return G.event_states(li.select(F.col("l_orderkey").alias("game"), m.alias("marker"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("at")), "game")


@query("a33_event_states", f"SELECT game, state, CASE WHEN state = 'completed' THEN greatest(fa, least(ta, oa)) END AS observed_at FROM ({STATES})")
def a33(spark, sf):
    return _states(spark, sf)


@query("f18_retention_expiry", "SELECT video FROM videos WHERE published + 90 < 20500 AND video NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def f18(spark, sf):
    pins = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("id"), F.when(F.col("quality") != 0, 1).alias("unpinned_at"))
    return G.expired(view(spark, sf, "videos").select(F.col("video").alias("id"), F.col("published").alias("stored_at")), pins, 20500).select(F.col("id").alias("video"))


@query("p14_evidence_quality", """WITH r AS (SELECT quantity IS NULL AS a, tax > 0.07 AS b, discount > tax AS c, price > 90000 AS d FROM wide_stats), v AS (SELECT unnest(list_filter([CASE WHEN a THEN 'missing-attempts' END, CASE WHEN b THEN 'tax-range' END, CASE WHEN c THEN 'completions-over-attempts' END, CASE WHEN d THEN 'yards-range' END], lambda x: x IS NOT NULL)) AS rule FROM r)
    SELECT rule, count(*) AS rows FROM v GROUP BY rule UNION ALL SELECT 'clean', count(*) FROM r WHERE NOT (coalesce(a, false) OR coalesce(b, false) OR coalesce(c, false) OR coalesce(d, false))""")
def p14(spark, sf):
    c = F.col
    return G.violations(view(spark, sf, "wide_stats"), [("missing-attempts", c("quantity").isNull()), ("tax-range", c("tax") > 0.07), ("completions-over-attempts", c("discount") > c("tax")), ("yards-range", c("price") > 90000)])


CONTEXT = """q AS (SELECT o_orderkey AS request, o_orderkey AS natural_key, @day(o_orderdate) + 60 AS cutoff, @day(o_orderdate) + 80 AS checkpoint FROM orders), x AS (SELECT q.request, v.*, (available_at, ingested_at, row_id) AS o, available_at <= cutoff AND ingested_at <= cutoff AS t, ingested_at <= checkpoint AS n FROM q LEFT JOIN versions v USING (natural_key)),
    g AS (SELECT request, max(o) FILTER (WHERE t AND state = 'usable') AS sel, max(o) FILTER (WHERE t) AS vis, max(o) FILTER (WHERE n) AS cur, arg_max(state, o) FILTER (WHERE n) AS cs, arg_max(row_id, o) FILTER (WHERE t AND state = 'usable') AS selected, arg_max(row_id, o) FILTER (WHERE t) AS visible_head, arg_max(row_id, o) FILTER (WHERE n) AS current_head, arg_max(data, o) FILTER (WHERE t AND state = 'usable') AS data, count(DISTINCT job) FILTER (WHERE t) AS inputs FROM x GROUP BY request),
    c AS (SELECT *, CASE WHEN sel IS NULL THEN 'unavailable' WHEN cur > sel AND cs <> 'usable' THEN 'stale' WHEN cur > sel THEN 'superseded' ELSE 'current' END AS display FROM g)"""


def _context(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    q = o.select(F.col("o_orderkey").alias("request"), F.col("o_orderkey").alias("natural_key"), (day + 60).alias("cutoff"), (day + 80).alias("checkpoint"))
    return G.model_context(q, view(spark, sf, "versions"), "natural_key", "request")


@query("g1_model_context", f"WITH {CONTEXT} SELECT request, selected, visible_head, current_head, display, data, inputs FROM c")
def g1(spark, sf):
    return _context(spark, sf).select("request", "selected", "visible_head", "current_head", "display", "data", "inputs")


@query("g2_batch_forecast", f"""WITH {CONTEXT}, f AS ({folds_sql()}), r AS (SELECT profile, arg_max(CASE WHEN valid_until IS NULL OR valid_until > 10400 THEN uses ELSE '' END, (recorded_at, decision)) AS uses FROM rights WHERE recorded_at <= 10400 AND valid_from <= 10400 GROUP BY profile),
    k AS (SELECT o_orderkey AS request, o_custkey, CASE WHEN NOT coalesce(list_contains(string_split(uses, ','), 'display'), false) THEN 'rights-refused' WHEN coalesce(display, 'unavailable') = 'unavailable' THEN 'context-unavailable' WHEN display = 'stale' THEN 'context-stale' WHEN coalesce(sample_size, 0) < 2 THEN 'insufficient-history' END AS refusal, vals, sample_size
      FROM orders o LEFT JOIN c ON c.request = o_orderkey LEFT JOIN f ON f.game = o_orderkey LEFT JOIN r ON r.profile = 'Brand#' || CAST(o_custkey % 26 + 1 AS VARCHAR))
    SELECT request, refusal, CASE WHEN refusal IS NULL THEN round(len(list_filter(vals, lambda v: v > 249.5)) / sample_size, 6) END AS p_over, CASE WHEN refusal IS NULL THEN round(len(list_filter(vals, lambda v: v < 249.5)) / sample_size, 6) END AS p_under FROM k""")
def g2(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    q = o.select(F.col("o_orderkey").alias("request"), F.col("o_orderkey").alias("game"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 26 + 1).cast("string")).alias("profile"), F.lit(249.5).alias("line"))
    asked = view(spark, sf, "rights").select("profile").distinct().select("profile", F.col("profile").alias("rq"), F.lit(10400).alias("valid_at"), F.lit(10400).alias("known_at"))
    out = G.batch_forecast(q, _context(spark, sf), M.lagged_features(view(spark, sf, "history")), T.effective_rights(asked, view(spark, sf, "rights"), "rq"), "request")
    return out.select("request", "refusal", F.round("p_over", 6).alias("p_over"), F.round("p_under", 6).alias("p_under"))


@query("g3_deletion_plan", "WITH RECURSIVE r(node) AS (SELECT id FROM chain WHERE id % 60 = 0 UNION SELECT c.id FROM r JOIN chain c ON c.predecessor = r.node), o AS (SELECT id, value FROM chain) SELECT value AS address, CASE WHEN count(*) FILTER (WHERE id NOT IN (SELECT node FROM r)) > 0 THEN 'shared-retained' ELSE 'removed' END AS action FROM (SELECT id, value * 40 + id % 40 AS value FROM o) GROUP BY value HAVING count(*) FILTER (WHERE id IN (SELECT node FROM r)) > 0")
def g3(spark, sf):
    c = view(spark, sf, "chain")
    edges = c.where("predecessor IS NOT NULL").select(F.col("predecessor").alias("parent"), F.col("id").alias("child"))
    objects = c.select(F.col("id").alias("node"), (F.col("value") * 40 + F.col("id") % 40).alias("address"))
    return G.deletion_plan(edges, c.where("id % 60 = 0").select(F.col("id").alias("node")), objects)


HEADS = "h AS (SELECT natural_key, count(*) AS rivals, min(state) AS state, min(data) AS data, min(available_at) AS moment FROM (SELECT *, dense_rank() OVER (PARTITION BY natural_key ORDER BY available_at DESC, ingested_at DESC) AS r FROM versions) WHERE r = 1 GROUP BY natural_key)"
PLAN = f"""{HEADS}, b AS (SELECT h.natural_key AS id, h.rivals, h.state, o.o_orderkey AS game, count(DISTINCT r.decision % 3) AS d, min(r.decision % 3) AS v FROM h LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 6 > 0) o ON o.o_orderkey = h.natural_key LEFT JOIN rights r ON r.profile = 'Brand#' || CAST(h.natural_key % 26 + 1 AS VARCHAR) AND r.valid_from <= h.moment AND (r.valid_until IS NULL OR h.moment < r.valid_until) GROUP BY ALL),
    p AS (SELECT id, CASE WHEN rivals > 1 THEN 'capture-ambiguous' WHEN state <> 'usable' THEN 'capture-refused' WHEN game IS NULL THEN 'schedule-missing' WHEN d = 0 THEN 'identity-missing' WHEN d > 1 THEN 'identity-conflict' END AS reason, v FROM b)"""


def _plan(spark, sf):
    v = view(spark, sf, "versions")
    heads = T.normalized_as_of(v, 99999, 99999, T.STRICT)
    clock = v.groupBy("natural_key").agg(F.max("available_at").alias("at"))
    caps = heads.join(clock, "natural_key").select(F.col("natural_key").alias("id"), "rivals", "state", "at", F.col("natural_key").alias("game"), F.concat(F.lit("Brand#"), (F.col("natural_key") % 26 + 1).cast("string")).alias("profile"))
    bridges = view(spark, sf, "rights").withColumn("value", F.col("decision") % 3)
    games = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 6 > 0").select(F.col("o_orderkey").alias("game"), F.lit(1).alias("kickoff"))
    return G.normalization_plan(caps, bridges, games, "id")


@query("g5_normalization_plan", f"WITH {PLAN} SELECT id, reason, CASE WHEN reason IS NULL THEN v END AS value FROM p")
def g5(spark, sf):
    return _plan(spark, sf)


CURRENT = "k AS (SELECT * FROM chain WHERE known_at <= 10600 AND state = 'usable'), hd AS (SELECT id, entity FROM k WHERE id NOT IN (SELECT predecessor FROM k WHERE predecessor IS NOT NULL))"


@query("g6_decision_currency", f"WITH {CURRENT}, i AS (SELECT entity AS decision, entity, list_sort(list(DISTINCT id)) AS was FROM chain WHERE known_at > 10300 AND known_at <= 10600 AND state = 'usable' GROUP BY entity), n AS (SELECT entity, list_sort(list(DISTINCT id)) AS now FROM hd GROUP BY entity) SELECT decision, coalesce(was = now, false) AS current FROM i LEFT JOIN n USING (entity)")
def g6(spark, sf):
    c = view(spark, sf, "chain")
    inputs = c.where("known_at > 10300 AND known_at <= 10600 AND state = 'usable'").withColumn("decision", F.col("entity"))
    return G.decision_currency(inputs, T.chain_heads(c, 10600), "decision", "entity")


@query("g7_evidence_witness", f"WITH {PLAN}, w AS (SELECT o_orderkey AS id FROM orders), a AS (SELECT natural_key AS id FROM versions GROUP BY 1) SELECT w.id, CASE WHEN a.id IS NULL THEN 'missing' WHEN reason IS NOT NULL THEN 'withheld' ELSE 'current' END AS status, CASE WHEN a.id IS NOT NULL THEN reason END AS reason FROM w LEFT JOIN a USING (id) LEFT JOIN p USING (id)")
def g7(spark, sf):
    wanted = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return G.witness(wanted, view(spark, sf, "versions").select(F.col("natural_key").alias("id")), _plan(spark, sf).select("id", "reason"), "id")


@query("g8_consumer_replay", "WITH d AS (SELECT o_orderkey AS input, sha256(CAST(o_orderkey AS VARCHAR)) AS digest, o_orderkey % 17 = 0 AS withheld FROM orders WHERE o_orderkey % 19 > 0), u AS (SELECT l_suppkey * 100 + l_orderkey % 100 AS record, l_orderkey AS input, sha256(CAST(l_orderkey + CASE WHEN l_orderkey % 23 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS digest FROM lineitem) SELECT record, ['ok', 'decision-stale', 'decision-withheld', 'decision-missing'][max(CASE WHEN d.input IS NULL THEN 3 WHEN withheld THEN 2 WHEN u.digest <> d.digest THEN 1 ELSE 0 END) + 1] AS status FROM u LEFT JOIN d USING (input) GROUP BY record")
def g8(spark, sf):
    digest = lambda c: F.unhex(F.sha2(c.cast("string"), 256))  # noqa: E731 -- 32 bytes, not 64 digits
    d = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 19 > 0").select(F.col("o_orderkey").alias("input"), digest(F.col("o_orderkey")).alias("digest"), (F.col("o_orderkey") % 17 == 0).alias("withheld"))
    u = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_suppkey") * 100 + F.col("l_orderkey") % 100).alias("record"), F.col("l_orderkey").alias("input"), digest(F.col("l_orderkey") + F.when(F.col("l_orderkey") % 23 == 0, 1).otherwise(0)).alias("digest"))
    return G.consumer_replay(u, d, "record")


@query("g9_label_consistency", f"WITH st AS ({STATES}), {CONSENSUS}, pa AS (SELECT id, CASE WHEN len(k) > 1 THEN 'conflicting' WHEN len(k) = 1 THEN k[1] ELSE 'unresolved' END AS state FROM u), re AS ({RECONCILED}) SELECT o_orderkey AS id, CASE WHEN NOT coalesce(st.state = 'completed', false) THEN 'completion' WHEN NOT coalesce(pa.state = 'played', false) THEN 'participation' WHEN NOT coalesce(result IN ('single', 'agree') AND re.value = o_orderkey % 2, false) THEN 'selection' WHEN o_custkey % 3 > 0 THEN 'identity' END AS broken FROM orders o LEFT JOIN st ON st.game = o_orderkey LEFT JOIN pa ON pa.id = o_orderkey LEFT JOIN re ON re.id = o_orderkey")
def g9(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    lab = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("game"), (F.col("o_orderkey") % 2).alias("value"))
    bridge = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 == 0, "one").otherwise("conflict").alias("status"))
    return G.label_consistency(lab, _states(spark, sf), _participation(spark, sf), _reconciled(spark, sf), bridge)


@query("g8_dependency_sets", """WITH a AS (SELECT DISTINCT l_orderkey AS record, 'part' AS kind, l_partkey AS input FROM lineitem WHERE l_linenumber % 7 > 0), b AS (SELECT DISTINCT l_orderkey AS record, 'part' AS kind, l_partkey + CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END AS input FROM lineitem)
    SELECT record, count(*) FILTER (WHERE x IS NULL) AS missing, count(*) FILTER (WHERE y IS NULL) AS extra, count(*) FILTER (WHERE x IS NULL OR y IS NULL) = 0 AS equal FROM (SELECT record, x, y FROM (SELECT *, 1 AS x FROM a) FULL JOIN (SELECT *, 1 AS y FROM b) USING (record, kind, input)) GROUP BY record""")
def g8_sets(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("record", F.col("l_orderkey")).withColumn("kind", F.lit("part"))
    expected = li.withColumn("input", F.col("l_partkey") + F.when(F.col("l_suppkey") % 9 == 0, 1).otherwise(0))
    return G.dependency_sets(li.where("l_linenumber % 7 > 0").withColumn("input", F.col("l_partkey")), expected, "record", ["kind", "input"])
