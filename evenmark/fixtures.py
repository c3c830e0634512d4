"""The driver's tables in the shapes of the domain, as SQL text that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: @us(x): microseconds since 1970 of a timestamp; @day(x): days since 1970; @json(x, k): text of a JSON member; @each(x): a row for each element; @list(...): a list.
VIEWS = {
    "quotes": """SELECT l_partkey AS player, l_partkey % 40 AS event, l_returnflag AS market, l_suppkey AS book,
        CAST(floor(l_quantity) AS BIGINT) % 3 + CAST(0.5 AS DOUBLE) AS point, round(CAST(0.95 AS DOUBLE) + 10 * l_discount, 4) AS over_price,
        round(CAST(1.0 AS DOUBLE) + 10 * l_tax, 4) AS under_price, @day(l_shipdate) AS captured_at, l_orderkey AS batch, l_linenumber AS seq,
        l_linestatus = 'O' AND l_linenumber = 7 AS yes_only FROM lineitem""",
    "outcomes": """SELECT event, market, book, player, side, CASE WHEN side <> 'Yes' THEN point END AS point, CASE WHEN side = 'Under' THEN under_price ELSE over_price END AS price, captured_at, batch, seq
        FROM (SELECT *, @each(CASE WHEN yes_only THEN @list('Yes') ELSE @list('Over', 'Under') END) AS side FROM quotes) AS sides""",
    "history": """SELECT o_custkey AS player, o_orderkey AS game, @day(o_orderdate) AS kickoff, year(o_orderdate) AS season,
        CAST(floor(o_totalprice / 1000) AS BIGINT) AS value FROM orders""",
    "history_deep": """SELECT o_custkey % 200 AS player, o_orderkey AS game, @day(o_orderdate) AS kickoff, year(o_orderdate) AS season,
        CAST(floor(o_totalprice / 1000) AS BIGINT) AS value FROM orders""",
    "versions": """SELECT l_orderkey AS natural_key, @day(make_date(year(l_shipdate), month(l_shipdate), 1)) AS available_at,
        @day(make_date(year(l_shipdate), month(l_shipdate), 1)) + l_linenumber AS ingested_at, l_quantity AS data,
        CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS row_id,
        CASE WHEN l_discount = 0 THEN 'refused' ELSE 'usable' END AS state, l_suppkey AS job FROM lineitem""",
    "chain": """SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS predecessor,
        o_custkey AS entity, @day(o_orderdate) AS known_at, CASE WHEN o_orderkey % 5 = 0 THEN 'refused' ELSE 'usable' END AS state,
        CAST(floor(o_totalprice / 1000) AS BIGINT) AS value FROM orders""",
    "rights": """SELECT p_brand AS profile, p_partkey AS decision, 10227 + p_partkey % 365 AS recorded_at, 10227 + p_partkey % 365 + p_size % 10 AS valid_from,
        CASE WHEN p_size % 4 = 0 THEN NULL ELSE 10227 + p_partkey % 365 + p_size % 10 + 10 * p_size END AS valid_until,
        CASE p_size % 3 WHEN 0 THEN 'display,research' WHEN 1 THEN 'display' ELSE '' END AS uses FROM part""",
    "jobs": """SELECT s_suppkey AS job, CASE s_suppkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'succeeded' END AS status,
        9862 + 10 * s_suppkey AS finished_at FROM supplier""",
    "wide_stats": """SELECT l_orderkey AS game, l_partkey AS player, l_linenumber AS seq, CASE l_returnflag WHEN 'A' THEN 'QB' WHEN 'R' THEN 'RB' ELSE 'WR' END AS position,
        l_linestatus AS team, nullif(l_quantity, 1) AS quantity, nullif(l_extendedprice, 0) AS price, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax FROM lineitem""",
    "schedule": """SELECT o_orderkey AS game, year(o_orderdate) AS season, CAST(floor((@day(o_orderdate) % 126) / 7) AS BIGINT) + 1 AS week,
        o_custkey % 25 AS home, (o_custkey + 7) % 25 AS away, @day(o_orderdate) AS local_day, o_orderkey % 1440 AS local_minute,
        CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) % 50 END AS home_score FROM orders""",
    "roster": """SELECT c_custkey AS player, c_name AS full_name, c_nationkey AS team, 1992 + c_custkey % 8 AS season, 1 + c_custkey % 18 AS week,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'QB' WHEN 'MACHINERY' THEN '' ELSE 'RB' END AS position, c_custkey % 300 AS source_id FROM customer""",
    "feed_stats": """SELECT CASE WHEN l_partkey % 37 = 0 THEN 'bad' ELSE '00-' || lpad(CAST(l_partkey AS STRING), 7, '0') END AS player_id,
        CASE l_returnflag WHEN 'A' THEN 'QB' WHEN 'R' THEN 'QB' ELSE 'RB' END AS position, CAST(year(l_shipdate) AS STRING) AS season, lpad(CAST(l_linenumber AS STRING), 2, '0') AS week,
        CASE WHEN l_linestatus = 'O' THEN 'REG' ELSE 'POST' END AS season_type,
        CAST(year(l_shipdate) AS STRING) || '_' || lpad(CAST(l_linenumber AS STRING), 2, '0') || '_T' || chr(65 + CAST(l_suppkey AS INT) % 20) || '_T' || chr(66 + CAST(l_suppkey AS INT) % 20) AS game_id,
        'T' || chr(65 + CAST(l_suppkey AS INT) % 22) AS team, CASE WHEN l_quantity = 1 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS attempts,
        CASE WHEN l_tax = 0 THEN 'x' ELSE CAST(CAST(floor(l_extendedprice / 100) AS BIGINT) AS STRING) END AS passing_yards, l_orderkey FROM lineitem""",
    "feed_roster": """SELECT CASE WHEN c_custkey % 29 = 0 THEN '' ELSE '00-' || lpad(CAST(c_custkey % 900 AS STRING), 7, '0') END AS gsis_id, 1992 + c_custkey % 3 AS season, 1 + c_custkey % 2 AS week,
        CASE WHEN c_nationkey = 3 THEN '1x' ELSE 'T' || chr(65 + c_nationkey) END AS team, CASE WHEN c_custkey % 7 = 0 THEN 'POST' ELSE 'REG' END AS game_type,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'RB' ELSE 'QB' END AS position, c_name AS full_name FROM customer""",
    "feed_schedule": """SELECT CAST(year(o_orderdate) AS STRING) AS season, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS week, CASE WHEN o_orderstatus = 'P' THEN 'POST' ELSE 'REG' END AS game_type,
        'T' || chr(65 + CAST(o_custkey AS INT) % 25) AS home, 'T' || chr(65 + (CAST(o_custkey AS INT) + 7) % 25) AS away,
        CAST(year(o_orderdate) AS STRING) || '_' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '_T' || chr(65 + (CAST(o_custkey AS INT) + 7) % CASE WHEN o_orderkey % 11 = 0 THEN 24 ELSE 25 END) || '_T' || chr(65 + CAST(o_custkey AS INT) % 25) AS game_id, o_orderkey FROM orders""",
    "plays": """SELECT l_orderkey % 500 AS game_id, l_linenumber + 10 * (l_orderkey % 900) AS play_id, CASE WHEN l_discount = 0 THEN '00-junk' ELSE '00-' || lpad(CAST(l_suppkey AS STRING), 7, '0') || '; ' || '00-' || lpad(CAST(l_suppkey % 7 AS STRING), 7, '0') END AS players FROM lineitem""",
    "ticks": """SELECT event_id, user_id AS prop, @us(ts) AS ts, 1 + value / 100 AS price, event_type = 'error' AS is_error, event_type, value FROM events""",
    "requests": """SELECT event_id, user_id AS subject, @us(ts) AS ts, event_type AS kind, CAST(@json(props, k) AS BIGINT) AS k, value FROM events""",
    "videos": """SELECT doc_id AS video, 'ch' || CAST(doc_id % 20 AS STRING) AS creator, substr(text, 1, 80) AS title, text AS body, 19967 + doc_id % 900 AS published,
        n_chars % 600 AS duration, source, lang, n_chars FROM documents""",
    "decisions": """SELECT conv_id AS key, turn AS position, CASE role WHEN 'system' THEN 'clear' WHEN 'user' THEN 'include' ELSE 'exclude' END AS kind, text FROM conversations""",
    "ledger": """SELECT d.doc_id, d.lang, d.source, d.n_chars, d.n_chars % 3 <> 0 AS feature_ok, l.doc_id IS NOT NULL AS label_ok, l.quality, l.toxic,
        1992 + d.doc_id % 5 AS season, d.n_chars % 17 AS sample_size FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPARK = {
    r"@us\(([^()]*)\)": r"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(\1 AS TIMESTAMP_NTZ))",
    r"@json\((\w+), (\w+)\)": r"get_json_object(\1, '$.\2')",
    r"@list\(([^()]*)\)": r"array(\1)",
    r"@each\(": "explode(",
}
DUCK = {r"@us\(([^()]*)\)": r"epoch_us(\1)", r"@json\((\w+), (\w+)\)": r"json_extract_string(\1, '$.\2')", r"@list\(([^()]*)\)": r"[\1]", r"@each\(": "unnest("}


def _days(text: str, before: str, after: str) -> str:
    """Replaces @day(...), whose argument may hold parentheses."""
    while (at := text.find("@day(")) >= 0:
        depth, end = 1, at + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}{before}{text[at + 5 : end - 1]}{after}{text[end:]}"
    return text




def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame on the tables of sf_dir."""
    text = _days(VIEWS[name], "datediff(CAST(", " AS DATE), DATE'1970-01-01')")
    for pattern, by in SPARK.items():
        text = re.sub(pattern, by, text)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", text)}
    frames |= {v: view(spark, sf_dir, v) for v in VIEWS if re.search(rf"(FROM|JOIN) {v}\b", text)}
    for t in frames:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **frames)


def duck(sql: str) -> str:
    """SQL for DuckDB with the views that it reads as common table expressions."""
    views = [v for v in VIEWS if re.search(rf"(FROM|JOIN|,) *{v}\b", sql)]
    order: list[str] = []

    def add(v: str) -> None:
        for w in VIEWS:
            if w != v and re.search(rf"(FROM|JOIN) {w}\b", VIEWS[v]):
                add(w)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    body = sql.strip()
    parts = [f"{v} AS ({VIEWS[v]})" for v in order]
    if body[:5].upper() == "WITH ":
        recursive = body[5:15].upper() == "RECURSIVE "
        text = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*parts, body[15:] if recursive else body[5:]])}"
    else:
        text = f"WITH {', '.join(parts)} {body}" if parts else body
    text = _days(text, "datediff('day', DATE '1970-01-01', CAST(", " AS DATE))")
    for pattern, by in DUCK.items():
        text = re.sub(pattern, by, text)
    return text
