"""Bitemporal evidence: as-of selection, heads, correction chains, closures, intervals.

Versions carry two clocks: available_at (when the source had it) and ingested_at (when it was stored).
"""

from __future__ import annotations

import graphlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.folders import shared_folder
from .scans import MOST, Run, rows_in, running

STRICT, RETROSPECTIVE = "strict-point-in-time-v1", "retrospective-reconstruction-v1"
UNVERIFIED = "historical-availability-unverified"


def cut(df: DataFrame) -> DataFrame:
    """The rows without their lineage, in the shared checkpoint folder of the session."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def visible(clocks: tuple[str, str], cutoff: Column, checkpoint: Column, mode: str) -> Column:
    """Whether a version counts: in strict mode both clocks are at or before the earlier boundary, else the second at or before the checkpoint."""
    if mode == STRICT:
        limit = F.least(cutoff, checkpoint)
        return (F.col(clocks[0]) <= limit) & (F.col(clocks[1]) <= limit)
    return F.col(clocks[1]) <= checkpoint


def normalized_as_of(versions: DataFrame, cutoff, checkpoint, mode: str, keys: tuple[str, ...] = ("natural_key",)) -> DataFrame:
    """(keys, rivals, row_ids, state, data, flags): the head of each key; rivals at equal clocks make it ambiguous, without data."""
    seen = versions.where(visible(("available_at", "ingested_at"), F.lit(cutoff), F.lit(checkpoint), mode))
    w = Window.partitionBy(*keys).orderBy(F.desc("available_at"), F.desc("ingested_at"))
    head = seen.withColumn("_r", F.dense_rank().over(w)).where("_r = 1")
    out = head.groupBy(*keys).agg(F.count("*").alias("rivals"), F.array_sort(F.collect_list("row_id")).alias("row_ids"), F.first("state").alias("s"), F.first("data").alias("d"))
    many = F.col("rivals") > 1
    flags = F.array(F.lit(UNVERIFIED)) if mode == RETROSPECTIVE else F.array().cast("array<string>")
    return out.select(*keys, "rivals", "row_ids", F.when(many, "ambiguous").otherwise(F.col("s")).alias("state"), F.when(~many, F.col("d")).alias("data"), flags.alias("flags"))


def in_time(right: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides as rows of one table, whose running aggregates in the order of time are what requests may see.

    right and requests: keys and times of one type; requests also have `_asked`. At equal times right rows come first. No
    request is paired with the rows of its key.
    """
    return right.dropna(subset=keys).unionByName(requests, allowMissingColumns=True)


def newest_in_time(right: DataFrame, requests: DataFrame, keys: list[str], most: int = MOST, bound: int | None = None) -> DataFrame:
    """requests with `v`, the greatest `_v` of their keys' right rows up to their `_at`. Keys of more than `most` rows are cut by time."""
    both = in_time(right, requests, keys)
    return running(both, keys, "_at", {"v": Run("max", "_v")}, [F.asc_nulls_first("_asked")], most=most, bound=bound).where("_asked").drop("_v")


def as_of_join(requests: DataFrame, versions: DataFrame, keys: list[str], mode: str, request_id: str, most: int = MOST) -> DataFrame:
    """Each request (keys, request_id, cutoff, checkpoint) with its newest visible version and the rivals at its clocks; none gives nulls.

    A version is visible from the later of its clocks on (in strict mode), so the newest visible one is a running maximum.
    Keys of more than `most` rows are cut by time.
    """
    strict = mode == STRICT
    clocks = ["available_at", "ingested_at"]
    one = versions.dropna(subset=clocks if strict else clocks[1:]).groupBy(*keys, *clocks).agg(F.count("*").alias("rivals"), F.min(F.struct("row_id", "data")).alias("v"))
    right = one.select(*keys, (F.greatest(*clocks) if strict else F.col("ingested_at")).alias("_at"), F.struct(*clocks, "rivals", "v").alias("_v"))
    limit = F.least("cutoff", "checkpoint") if strict else F.col("checkpoint")
    asked = requests.select(request_id, *keys, (F.when(F.col("cutoff").isNotNull() & F.col("checkpoint").isNotNull(), limit) if strict else limit).alias("_at"), F.lit(True).alias("_asked"))
    best = newest_in_time(right, asked, keys, most, rows_in(versions, requests))
    return best.select(request_id, *keys, F.coalesce("v.rivals", F.lit(0)).alias("rivals"), "v.v.row_id", "v.available_at", "v.ingested_at", F.when(F.col("v.rivals") == 1, F.col("v.v.data")).alias("data"))


def heads(versions: DataFrame, keys: list[str], order: list[Column], state: str = "state") -> DataFrame:
    """All rows with `head` (place among all of the key) and `valid_head` (place among those of the same state)."""
    return versions.withColumn("head", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("valid_head", F.row_number().over(Window.partitionBy(*keys, state).orderBy(*order)))


def newest_with_rivals(versions: DataFrame, keys: list[str], clocks: list[str], tie: str) -> DataFrame:
    """The newest row of each key and how many rows share its clocks."""
    out = versions.withColumn("rivals", F.count("*").over(Window.partitionBy(*keys, *clocks)))
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in clocks], tie)
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_valid_display(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, value, status): the newest usable value, and current, stale, corrected or missing."""
    usable = F.when(F.col("state") == "usable", F.struct(*order))
    out = versions.groupBy(*keys).agg(F.max_by("state", F.struct(*order)).alias("head_state"), F.max(usable).alias("top"))
    rows = versions.where("state = 'usable'").withColumn("_before", F.lag("data").over(Window.partitionBy(*keys).orderBy(*order)))
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    last = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, F.col("data").alias("value"), "_before")
    status = F.when(F.col("top").isNull(), "missing").when(F.col("head_state") != "usable", "stale").when(F.col("_before").isNotNull() & (F.col("_before") != F.col("value")), "corrected").otherwise("current")
    return out.join(last, keys, "left").select(*keys, "value", status.alias("status"))


def retention_candidates(versions: DataFrame, keys: list[str], order: list[Column], pins: DataFrame, pin: str) -> DataFrame:
    """Versions that are neither head nor last valid nor pinned."""
    return heads(versions, keys, order).where("head > 1 AND NOT (state = 'usable' AND valid_head = 1)").join(pins, pin, "left_anti")


def chain_heads(records: DataFrame, at) -> DataFrame:
    """Usable records known by `at` that no usable record known by `at` supersedes."""
    known = records.where((F.col("known_at") <= F.lit(at)) & (F.col("state") == "usable"))
    after = known.where("predecessor IS NOT NULL").select(F.col("predecessor").alias("id"))
    return known.join(after, "id", "left_anti")


def closure(edges: DataFrame, roots: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, depth): what the roots reach along edges (parent, child), roots at depth 0, others at their least depth.

    Where every child has one parent, each node looks up its chain to the first root, twice as far in each round. Else, and
    where nodes are structs with a `kind` and no kind leads back to itself, so that there are few rounds, the search goes
    breadth first and joins only the nodes that the last round found; of edges between kinds, a round moves only those that
    leave the kinds found. Lineage is cut after each round.
    """
    e = cut(edges.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL"))
    start = roots.select("node").where("node IS NOT NULL").distinct()
    kinds = isinstance(e.schema["parent"].dataType, StructType) and "kind" in e.schema["parent"].dataType.names
    hashed = e.select(F.xxhash64("child").alias("c"), F.xxhash64("parent").alias("p"))
    if not (kinds and _ordered_kinds(e)) and hashed.groupBy("c").agg(F.min("p").alias("least"), F.max("p").alias("most")).where("least <> most").isEmpty():
        one = e.distinct()
        if one.groupBy("child").count().where("count > 1").isEmpty():
            return _up_chains(one, start)
    reached = cut(start.withColumn("depth", F.lit(0)))
    front, parts = reached, reached
    for depth in range(1, most):
        live = e.join(F.broadcast(front.select("node.kind").distinct()), F.col("parent.kind") == F.col("kind"), "left_semi") if kinds else e
        step = live.join(front.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node")).distinct()
        front = cut(step.join(parts.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return parts
        parts = parts.union(front)
    raise RuntimeError("closure: too deep")


def _ordered_kinds(edges: DataFrame, most: int = 1000) -> bool:
    """Whether edges between kinds, at most `most` pairs of them, lead from no kind back to itself."""
    pairs = edges.select(F.col("parent.kind").alias("p"), F.col("child.kind").alias("c")).distinct().limit(most + 1).collect()
    order = graphlib.TopologicalSorter()
    for r in pairs:
        order.add(r.c, r.p)
    try:
        order.prepare()
    except graphlib.CycleError:
        return False
    return len(pairs) <= most


def _up_chains(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """closure of edges that give each child one parent: (node, top, depth) with no root between node and top, doubled until top is a root or has no parent."""
    marked = roots.withColumn("root", F.lit(True))
    at = edges.select(F.col("child").alias("node"), F.col("parent").alias("top"), F.lit(1).cast("long").alias("depth")).join(roots, "node", "left_anti")
    at = cut(at.join(marked.withColumnRenamed("node", "top"), "top", "left").select("node", "top", "depth", F.coalesce("root", F.lit(False)).alias("done")))
    for _ in range(at.count().bit_length() + 1):  # the nodes of a cycle without a root stay undone
        live = at.where("NOT done")
        if live.isEmpty():
            break
        up = at.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        at = cut(at.where("done").union(live.join(up, "top").select("node", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))))
    return roots.withColumn("depth", F.lit(0)).union(at.where("done").select("node", F.col("depth").cast("int").alias("depth")))


def newest_of_two_clocks(requests: DataFrame, records: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """requests (key, _x, _y, ...) with `v`, the greatest `_v` of their key's records with _x and _y at or before theirs.

    `_v` begins with the record's _y. Records are numbered in the order of _x, so what a request may see by _x is the first p
    of them, and p is a sum of powers of two: a block of records for each. A record stands in the blocks of its number
    that begin at an even place, at most one for each power up to its key's size. In a block, the order of _y gives the
    newest by a running maximum; a request takes the best of its blocks. n records and requests make n log n rows, and no
    row holds a key's records. Blocks of more than `most` rows are cut by time.
    """
    n = rows_in(records, requests)
    rows = records.dropna(subset=[key, "_x", "_y"]).select(key, "_x", "_y", "_v", F.lit(1).cast("long").alias("_one"))
    both = rows.unionByName(requests.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    placed = running(both, [key], "_x", {"_p": Run("sum", "_one")}, [F.asc_nulls_first("_asked")], most=most, bound=n)
    if n <= most:  # in the same shuffle
        placed = placed.withColumn("_all", F.sum("_one").over(Window.partitionBy(key)))
    else:
        sizes = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_all"))
        placed = placed.join(sizes, F.col(key) == F.col("_key"), "left").drop("_key")
    top = F.floor(F.log2(F.greatest(F.col("_all"), F.lit(1)))).cast("int")
    level = F.sequence(F.lit(0), top)
    at = F.when(F.col("_asked").isNull(), F.expr("filter(transform(_levels, k -> struct(k AS level, shiftright(_p - 1, k) AS block)), b -> b.block % 2 = 0 AND shiftleft(b.block + 1, b.level) <= _all)"))
    at = at.otherwise(F.expr("transform(filter(_levels, k -> shiftright(coalesce(_p, 0L), k) % 2 = 1), k -> struct(k AS level, shiftright(_p, k) - 1 AS block))"))
    spread = placed.withColumn("_levels", level).withColumn("_b", F.explode_outer(at)).select("*", "_b.*").drop("_levels", "_b", "_p", "_all", "_one")
    best = running(spread, [key, "level", "block"], "_y", {"v": Run("max", "_v")}, [F.asc_nulls_first("_asked")], most=most, bound=n * n.bit_length()).where("_asked")
    names = [c for c in requests.columns if c not in ("_x", "_y")]
    return best.groupBy(*names, "_x", "_y").agg(F.max("v").alias("v"))


def effective_rights(requests: DataFrame, decisions: DataFrame, request_id: str, most: int = MOST) -> DataFrame:
    """Each request (request_id, profile, valid_at, known_at) with the newest known and started decision; an expired one allows nothing.

    Equal requests are one. Decisions without a clock are never known or started. See newest_of_two_clocks.
    """
    records = decisions.select("profile", F.col("valid_from").alias("_x"), F.col("recorded_at").alias("_y"), F.struct("recorded_at", "decision", "valid_until", "uses").alias("_v"))
    asked = requests.select(request_id, "profile", F.col("valid_at").alias("_x"), F.col("known_at").alias("_y")).distinct()
    # a request may name its own columns like the profile
    out = newest_of_two_clocks(asked.select(F.col(request_id).alias("_request"), "profile", "_x", "_y"), records, "profile", most)
    live = F.col("v.valid_until").isNull() | (F.col("v.valid_until") > F.col("_x"))
    return out.select(F.col("_request").alias(request_id), "profile", F.col("v.decision").alias("decision"), F.when(F.col("v").isNotNull(), F.when(live, F.col("v.uses")).otherwise(F.lit(""))).alias("uses"))


def rights_gate(inputs: DataFrame, rights: DataFrame, key: str, use: str) -> DataFrame:
    """(key, allowed, refused): whether every input's profile allows the use; a missing decision or a deleted input refuses."""
    ok = F.coalesce(F.array_contains(F.split("uses", ","), use), F.lit(False)) & ~F.col("deleted")
    return inputs.join(rights.select("profile", "uses"), "profile", "left").groupBy(key).agg(F.bool_and(ok).alias("allowed"), F.count_if(~ok).alias("refused"))


def interval_value(requests: DataFrame, intervals: DataFrame, keys: list[str], request_id: str, most: int = MOST) -> DataFrame:
    """(request_id, status, value): values whose interval [valid_from, valid_until) holds the request's `at`: missing, one or conflict.

    Intervals of one value that meet or overlap are one first. Then begins and ends stand with the requests in the order
    of time, and a request counts the values begun and not ended: a running sum, not a pair of request and interval.
    `request_id` names a row; requests of one id are taken together. Keys of more than `most` rows are cut by time.
    """
    whole = intervals.dropna(subset=[*keys, "value", "valid_from"]).where("valid_until IS NULL OR valid_until > valid_from")
    end = F.struct(F.col("valid_until").isNull().alias("open"), F.col("valid_until").alias("at"))
    in_order = Window.partitionBy(*keys, "value").orderBy("valid_from")
    before = F.max(end).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = whole.withColumn("_b", before).withColumn("_new", F.coalesce((~F.col("_b.open") & (F.col("_b.at") < F.col("valid_from"))).cast("int"), F.lit(1)))
    islands = fresh.withColumn("_n", F.sum("_new").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "value", "_n").agg(F.min("valid_from").alias("b"), F.max(end).alias("e"))
    coded = islands.withColumn("code", F.dense_rank().over(Window.partitionBy(*keys).orderBy("value")).cast("long"))
    event = lambda at, step: F.struct(at.alias("at"), F.lit(step).alias("step"))
    marks = coded.withColumn("x", F.explode(F.array(event(F.col("b"), 1), event(F.when(~F.col("e.open"), F.col("e.at")), -1)))).where("x.at is not null").select(*keys, F.col("x.at").alias("_at"), F.col("x.step").alias("n"), (F.col("x.step") * F.col("code")).alias("code"))
    marks = marks.groupBy(*keys, "_at").agg(F.sum("n").alias("n"), F.sum("code").alias("code"))
    both = in_time(marks.withColumnsRenamed({"n": "_n", "code": "_code"}), requests.select(request_id, *keys, F.col("at").alias("_at"), F.lit(True).alias("_asked")), keys)
    summed = running(both, keys, "_at", {"n": Run("sum", "_n"), "code": Run("sum", "_code")}, [F.asc_nulls_first("_asked")], most=most, bound=rows_in(requests, intervals, intervals))
    seen = summed.where("_asked").select(request_id, *keys, "n", F.when(F.col("n") == 1, F.col("code")).alias("code"))
    held = seen.join(coded.select(*keys, "code", "value").distinct(), [*keys, "code"], "left")
    out = held.groupBy(request_id).agg(F.max(F.coalesce("n", F.lit(0))).alias("most"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    many = (F.col("most") > 1) | (F.col("lo") != F.col("hi"))
    return out.select(request_id, F.when(many, "conflict").when(F.col("most") == 0, "missing").otherwise("one").alias("status"), F.when(~many, F.col("lo")).alias("value"))


def completed_by(rows: DataFrame, jobs: DataFrame, at, job: str = "job") -> DataFrame:
    """Rows whose job succeeded by the boundary."""
    return rows.join(jobs.where((F.col("status") == "succeeded") & (F.col("finished_at") <= F.lit(at))).select(job), job, "left_semi")


def linked_display(versions: DataFrame, keys: list[str], order: list[str], id_col: str, supersedes: str) -> DataFrame:
    """(keys, head, displayed, value, stale, superseded, status): the newest usable value of each key, whether a newer result is not usable, and whether a record names it as replaced.

    status: unavailable without a usable value, stale under a newer result, corrected if the record that it replaces had another value, else current.
    """
    top = F.struct(*order)
    ends = versions.groupBy(*keys).agg(F.max_by(id_col, top).alias("head"), F.max_by(F.struct(id_col, "value", supersedes), F.when(F.col("state") == "usable", top)).alias("v"))
    ends = ends.withColumn("displayed", F.col(f"v.{id_col}")).withColumn("_was", F.col(f"v.{supersedes}"))
    named = versions.dropna(subset=[supersedes]).select(F.col(supersedes).alias("displayed"), F.lit(True).alias("superseded")).distinct()
    before = versions.select(F.col(id_col).alias("_was"), F.col("value").alias("_old"), F.lit(True).alias("_known"))
    out = ends.join(named, "displayed", "left").join(before, "_was", "left")
    stale = F.col("displayed").isNotNull() & (F.col("displayed") != F.col("head"))
    changed = F.col("_known") & ~F.col("_old").eqNullSafe(F.col("v.value"))
    status = F.when(F.col("displayed").isNull(), "unavailable").when(stale, "stale").when(changed, "corrected").otherwise("current")
    return out.select(*keys, "head", "displayed", F.col("v.value").alias("value"), stale.alias("stale"), F.coalesce("superseded", F.lit(False)).alias("superseded"), status.alias("status"))


def typed_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(kind, id, depth): what roots (kind, id) reach along edges (parent_kind, parent, child_kind, child) between records of several kinds."""
    node = lambda kind, key: F.struct(F.col(kind).alias("kind"), F.col(key).cast("string").alias("id"))
    whole = edges.dropna(subset=["parent_kind", "parent", "child_kind", "child"]).select(node("parent_kind", "parent").alias("parent"), node("child_kind", "child").alias("child"))
    return closure(whole, roots.dropna(subset=["kind", "id"]).select(node("kind", "id").alias("node"))).select("node.kind", "node.id", "depth")


def impact(reached: DataFrame) -> DataFrame:
    """(kind, records, nearest, farthest) of what a deletion reaches."""
    return reached.groupBy("kind").agg(F.count("*").alias("records"), F.min("depth").alias("nearest"), F.max("depth").alias("farthest"))
