"""Queries on versions, chains, rights and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import temporal as T
from .registry import query

CUT, CHECK = 10500, 10800
STRICT_SQL = f"SELECT *, dense_rank() OVER (PARTITION BY natural_key ORDER BY available_at DESC, ingested_at DESC) AS r FROM versions WHERE available_at <= {CUT} AND ingested_at <= {CUT}"
OV = "ORDER BY available_at DESC, ingested_at DESC, row_id DESC"


@query("w1_as_of_heads", f"SELECT natural_key, count(*) AS rivals, string_agg(row_id, ',' ORDER BY row_id) AS row_ids, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE min(state) END AS state, CASE WHEN count(*) = 1 THEN min(data) END AS data FROM ({STRICT_SQL}) WHERE r = 1 GROUP BY natural_key")
def w1(spark, sf):
    return T.normalized_as_of(view(spark, sf, "versions"), CUT, CHECK, T.STRICT).withColumn("row_ids", F.array_join("row_ids", ",")).drop("flags")


@query("w1_as_of_retrospective", f"SELECT state, count(*) AS keys, sum(rivals) AS versions FROM (SELECT natural_key, count(*) AS rivals, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE min(state) END AS state FROM (SELECT *, dense_rank() OVER (PARTITION BY natural_key ORDER BY available_at DESC, ingested_at DESC) AS r FROM versions WHERE ingested_at <= {CHECK}) WHERE r = 1 GROUP BY natural_key) GROUP BY state")
def w1r(spark, sf):
    return T.normalized_as_of(view(spark, sf, "versions"), CUT, CHECK, T.RETROSPECTIVE).groupBy("state").agg(F.count("*").alias("keys"), F.sum("rivals").alias("versions"))


def newest():
    return [F.desc("available_at"), F.desc("ingested_at"), F.desc("row_id")]


def _j4(mode: str) -> str:
    ok = "v.available_at <= least(cutoff, checkpoint) AND v.ingested_at <= least(cutoff, checkpoint)" if mode == T.STRICT else "v.ingested_at <= checkpoint"
    return f"""WITH q AS (SELECT o_orderkey AS request, o_orderkey AS natural_key, @day(o_orderdate) + 60 AS cutoff, @day(o_orderdate) + 90 AS checkpoint FROM orders),
    h AS (SELECT q.request, v.*, dense_rank() OVER (PARTITION BY q.request ORDER BY v.available_at DESC, v.ingested_at DESC) AS r FROM q JOIN versions v ON q.natural_key = v.natural_key AND {ok}),
    g AS (SELECT request, count(*) AS rivals, min(row_id) AS row_id, min(available_at) AS available_at, min(ingested_at) AS ingested_at, CASE WHEN count(*) = 1 THEN min(data) END AS data FROM h WHERE r = 1 GROUP BY request)
    SELECT q.request, q.natural_key, coalesce(rivals, 0) AS rivals, row_id, available_at, ingested_at, data FROM q LEFT JOIN g USING (request)"""


def _asof(spark, sf, mode):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    q = o.select(F.col("o_orderkey").alias("request"), F.col("o_orderkey").alias("natural_key"), (day + 60).alias("cutoff"), (day + 90).alias("checkpoint"))
    return T.as_of_join(q, view(spark, sf, "versions"), ["natural_key"], mode, "request")


query("j4_as_of_strict", _j4(T.STRICT))(lambda spark, sf: _asof(spark, sf, T.STRICT))
query("j4_as_of_retrospective", _j4(T.RETROSPECTIVE))(lambda spark, sf: _asof(spark, sf, T.RETROSPECTIVE))


@query("w3_heads", f"SELECT natural_key, row_id, state, head, valid_head FROM (SELECT *, row_number() OVER (PARTITION BY natural_key {OV}) AS head, row_number() OVER (PARTITION BY natural_key, state {OV}) AS valid_head FROM versions) WHERE head = 1 OR valid_head = 1")
def w3(spark, sf):
    return T.heads(view(spark, sf, "versions"), ["natural_key"], newest()).where("head = 1 OR valid_head = 1").select("natural_key", "row_id", "state", "head", "valid_head")


@query("w4_newest_with_rivals", "SELECT natural_key, row_id, rivals FROM (SELECT *, count(*) OVER (PARTITION BY natural_key, available_at, ingested_at) AS rivals, row_number() OVER (PARTITION BY natural_key ORDER BY available_at DESC, ingested_at DESC, row_id) AS n FROM versions) WHERE n = 1")
def w4(spark, sf):
    return T.newest_with_rivals(view(spark, sf, "versions"), ["natural_key"], ["available_at", "ingested_at"], "row_id").select("natural_key", "row_id", "rivals")


@query(
    "w5_last_valid_display",
    """WITH h AS (SELECT natural_key, arg_max(state, (available_at, ingested_at, row_id)) AS hs FROM versions GROUP BY natural_key),
    u AS (SELECT natural_key, data AS value, lag(data) OVER (PARTITION BY natural_key ORDER BY available_at, ingested_at, row_id) AS b, row_number() OVER (PARTITION BY natural_key ORDER BY available_at DESC, ingested_at DESC, row_id DESC) AS n FROM versions WHERE state = 'usable')
    SELECT h.natural_key, value, CASE WHEN value IS NULL THEN 'missing' WHEN hs <> 'usable' THEN 'stale' WHEN b IS NOT NULL AND b <> value THEN 'corrected' ELSE 'current' END AS status FROM h LEFT JOIN u ON h.natural_key = u.natural_key AND n = 1""",
)
def w5(spark, sf):
    return T.last_valid_display(view(spark, sf, "versions"), ["natural_key"], ["available_at", "ingested_at", "row_id"])


@query("w7_retention_candidates", f"SELECT natural_key, row_id FROM (SELECT *, row_number() OVER (PARTITION BY natural_key {OV}) AS head, row_number() OVER (PARTITION BY natural_key, state {OV}) AS vh FROM versions) WHERE head > 1 AND NOT (state = 'usable' AND vh = 1) AND job NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def w7(spark, sf):
    pins = spark.read.parquet(f"{sf}/supplier.parquet").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("job"))
    return T.retention_candidates(view(spark, sf, "versions"), ["natural_key"], newest(), pins, "job").select("natural_key", "row_id")


@query("w11_supersession", "SELECT id, predecessor FROM (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS predecessor FROM orders)")
def w11(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("predecessor"))


@query("j12_completed_jobs", "SELECT state, count(*) AS n FROM versions WHERE job IN (SELECT job FROM jobs WHERE status = 'succeeded' AND finished_at <= 10300) GROUP BY state")
def j12(spark, sf):
    return T.completed_by(view(spark, sf, "versions"), view(spark, sf, "jobs"), 10300).groupBy("state").agg(F.count("*").alias("n"))


@query("j17_chain_heads", "WITH k AS (SELECT * FROM chain WHERE known_at <= 10600 AND state = 'usable') SELECT id, entity, value FROM k WHERE id NOT IN (SELECT predecessor FROM k WHERE predecessor IS NOT NULL)")
def j17(spark, sf):
    return T.chain_heads(view(spark, sf, "chain"), 10600).select("id", "entity", "value")


@query("j18_lineage_closure", "WITH RECURSIVE r(node, depth) AS (SELECT id, 0 FROM chain WHERE id % 50 = 0 UNION SELECT c.id, r.depth + 1 FROM r JOIN chain c ON c.predecessor = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def j18(spark, sf):
    c = view(spark, sf, "chain")
    return T.closure(c.where("predecessor IS NOT NULL").select(F.col("predecessor").alias("parent"), F.col("id").alias("child")), c.where("id % 50 = 0").select(F.col("id").alias("node")))


RIGHTS = "SELECT 'Brand#' || CAST(s_suppkey % 26 + 1 AS STRING) AS profile, s_suppkey AS request, 10300 + s_suppkey AS valid_at, 10400 AS known_at FROM supplier"


@query("j6_effective_rights", f"""WITH q AS ({RIGHTS}), d AS (SELECT q.request, r.*, q.valid_at, row_number() OVER (PARTITION BY q.request ORDER BY r.recorded_at DESC, r.decision DESC) AS n FROM q JOIN rights r ON q.profile = r.profile AND r.recorded_at <= known_at AND r.valid_from <= valid_at)
    SELECT q.request, q.profile, decision, CASE WHEN decision IS NOT NULL THEN CASE WHEN valid_until IS NULL OR valid_until > d.valid_at THEN uses ELSE '' END END AS uses FROM q LEFT JOIN d ON q.request = d.request AND n = 1""")
def j6(spark, sf):
    return T.effective_rights(_rights(spark, sf), view(spark, sf, "rights"), "request")


def _rights(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    return s.select(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 26 + 1).cast("string")).alias("profile"), F.col("s_suppkey").alias("request"), (F.col("s_suppkey") + 10300).alias("valid_at"), F.lit(10400).alias("known_at"))


@query("j7_rights_gate", """WITH r AS (SELECT profile, arg_max(CASE WHEN valid_until IS NULL OR valid_until > 10400 THEN uses ELSE '' END, (recorded_at, decision)) AS uses FROM rights WHERE recorded_at <= 10400 AND valid_from <= 10400 GROUP BY profile),
    i AS (SELECT l_orderkey AS dataset, 'Brand#' || CAST(l_suppkey % 26 + 1 AS STRING) AS profile, l_tax = 0.08 AS deleted FROM lineitem),
    k AS (SELECT dataset, coalesce(list_contains(string_split(uses, ','), 'display'), false) AND NOT deleted AS ok FROM i LEFT JOIN r USING (profile)) SELECT dataset, bool_and(ok) AS allowed, count(*) FILTER (WHERE NOT ok) AS refused FROM k GROUP BY dataset""")
def j7(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("dataset"), F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 26 + 1).cast("string")).alias("profile"), (F.col("l_tax") == 0.08).alias("deleted"))
    asked = view(spark, sf, "rights").select("profile").distinct().select("profile", F.col("profile").alias("request"), F.lit(10400).alias("valid_at"), F.lit(10400).alias("known_at"))
    return T.rights_gate(li, T.effective_rights(asked, view(spark, sf, "rights"), "request"), "dataset", "display")


@query("j19_interval_join", f"""WITH q AS ({RIGHTS}), j AS (SELECT q.request, CASE WHEN valid_from <= valid_at AND (valid_until IS NULL OR valid_at < valid_until) THEN decision % 3 END AS v FROM q LEFT JOIN rights r ON q.profile = r.profile)
    SELECT request, CASE count(DISTINCT v) WHEN 0 THEN 'missing' WHEN 1 THEN 'one' ELSE 'conflict' END AS status, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS value FROM j GROUP BY request""")
def j19(spark, sf):
    spans = view(spark, sf, "rights").withColumn("value", F.col("decision") % 3)
    return T.interval_value(_rights(spark, sf).withColumn("at", F.col("valid_at")), spans, ["profile"], "request")


@query(
    "w5_linked_display",
    """WITH h AS (SELECT entity, arg_max(id, (known_at, id)) AS head, arg_max(id, (known_at, id)) FILTER (WHERE state = 'usable') AS displayed FROM chain GROUP BY entity)
    SELECT h.entity, head, displayed, v.value, displayed IS NOT NULL AND displayed <> head AS stale, displayed IS NOT NULL AND EXISTS (SELECT 1 FROM chain n WHERE n.predecessor = displayed) AS superseded,
      CASE WHEN displayed IS NULL THEN 'unavailable' WHEN displayed <> head THEN 'stale' WHEN p.id IS NOT NULL AND p.value IS DISTINCT FROM v.value THEN 'corrected' ELSE 'current' END AS status
    FROM h LEFT JOIN chain v ON v.id = displayed LEFT JOIN chain p ON p.id = v.predecessor""",
)
def w5_linked(spark, sf):
    return T.linked_display(view(spark, sf, "chain"), ["entity"], ["known_at", "id"], "id", "predecessor")


#: Captures (suppliers) give observations (line items), these features (orders), these datasets (customers), these releases (nations).
LINEAGE = """SELECT 'capture' AS parent_kind, CAST(l_suppkey AS STRING) AS parent, 'observation' AS child_kind, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS child FROM lineitem
    UNION ALL SELECT 'observation', CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING), 'feature', CAST(l_orderkey AS STRING) FROM lineitem
    UNION ALL SELECT 'feature', CAST(o_orderkey AS STRING), 'dataset', CAST(o_custkey AS STRING) FROM orders UNION ALL SELECT 'dataset', CAST(c_custkey AS STRING), 'release', CAST(c_nationkey AS STRING) FROM customer"""


@query("j18_typed_lineage", f"""WITH RECURSIVE e AS ({LINEAGE}), r(kind, id, depth) AS (SELECT 'capture', CAST(s_suppkey AS STRING), 0 FROM supplier WHERE s_suppkey % 4 = 0 UNION SELECT child_kind, child, depth + 1 FROM r JOIN e ON e.parent_kind = r.kind AND e.parent = r.id)
    SELECT kind, count(*) AS records, min(depth) AS nearest, max(depth) AS farthest FROM (SELECT kind, id, min(depth) AS depth FROM r GROUP BY ALL) GROUP BY kind""")
def j18_typed(spark, sf):
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("lineitem", "orders", "customer")}
    edges = spark.sql(LINEAGE.replace("FROM lineitem", "FROM {lineitem}").replace("FROM orders", "FROM {orders}").replace("FROM customer", "FROM {customer}"), **t)
    roots = spark.read.parquet(f"{sf}/supplier.parquet").where("s_suppkey % 4 = 0").select(F.lit("capture").alias("kind"), F.col("s_suppkey").cast("string").alias("id"))
    return T.impact(T.typed_closure(edges, roots))
