"""Rights, lineage, reconciliation, retention, evidence quality and replay checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import temporal as T
from .scans import MOST, Run, rows_in, running


def first_of(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules], F.lit(None).cast("string"))


def unmatched(rows: DataFrame, others: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows with a flag for each other set that lacks their key."""
    for name, df in others.items():
        rows = rows.join(df.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left").withColumn(f"no_{name}", F.col(f"_{name}").isNull()).drop(f"_{name}")
    return rows


def reconcile_inventory(listed: DataFrame, referenced: DataFrame) -> DataFrame:
    """(address, status): objects (address, size, digest) against references: missing, orphan, size-mismatch, corrupt or ok."""
    a = listed.select("address", F.col("size").alias("s"), F.col("digest").alias("d"), F.lit(True).alias("l"))
    b = referenced.select("address", F.col("size").alias("rs"), F.col("digest").alias("rd"), F.lit(True).alias("r"))
    j = a.join(b, "address", "full")
    return j.select("address", F.coalesce(first_of(("missing", F.col("l").isNull()), ("orphan", F.col("r").isNull()), ("size-mismatch", F.col("s") != F.col("rs")), ("corrupt", F.col("d") != F.col("rd"))), F.lit("ok")).alias("status"))


def replay_parity(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(status, rows): rows of two sets that match, differ or stand on one side only; nulls equal nulls."""
    a, b = left.select(*keys, F.struct(*values).alias("a")), right.select(*keys, F.struct(*values).alias("b"))
    j = a.join(b, keys, "full")
    status = F.when(F.col("a").isNull(), "unexpected").when(F.col("b").isNull(), "missing").when(F.col("a").eqNullSafe(F.col("b")), "equal").otherwise("different")
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("rows"))


def validated_absences(rows: DataFrame, captures: DataFrame, present: DataFrame, most: int = MOST) -> DataFrame:
    """Rows that the first later full capture of their scope lacks.

    rows: id, scope, captured_at; captures: capture, scope, captured_at, full; present: capture, id. Both stand in one
    order of their scope from the newest on, where each row takes the last capture before it: none is paired with all.
    Scopes of more than `most` rows are cut by time.
    """
    full = captures.where("full AND scope IS NOT NULL AND captured_at IS NOT NULL").select("scope", "captured_at", F.struct("capture").alias("c"))
    both = rows.dropna(subset=["scope", "captured_at"]).select("id", "scope", "captured_at").distinct().withColumn("row", F.lit(True)).unionByName(full, allowMissingColumns=True)
    seen = running(both, ["scope"], "captured_at", {"later": Run("last", "c")}, [F.desc_nulls_last("row"), F.desc("c.capture")], descending=True, most=most, bound=rows_in(rows, captures))
    first = seen.where("row AND later IS NOT NULL").select("id", "scope", F.col("later.capture").alias("capture"))
    return first.join(present, ["capture", "id"], "left_anti")


def reconcile_sources(claims: DataFrame, key: str, source: str, value: str) -> DataFrame:
    """(key, result, value): none, single, agree or conflict; the value of the first source unless they conflict."""
    out = claims.groupBy(key).agg(F.count(value).alias("n"), F.countDistinct(value).alias("d"), F.min_by(value, F.when(F.col(value).isNotNull(), F.col(source))).alias("v"))
    result = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "single").when(F.col("d") == 1, "agree").otherwise("conflict")
    return out.select(key, result.alias("result"), F.when(result.isin("single", "agree"), F.col("v")).alias("value"))


def participation_consensus(claims: DataFrame, stats: DataFrame, key: str, positive: str = "played") -> DataFrame:
    """(key, state): conflicting, the one claim, or unresolved; positive statistics without such a claim count as one."""
    c = claims.groupBy(key).agg(F.collect_set("claim").alias("claims"))
    s = stats.groupBy(key).agg(F.count("*").alias("n"), F.bool_and("positive").alias("all"))
    j = c.join(s, key, "full")
    held = F.coalesce("claims", F.array().cast("array<string>"))
    every = F.when((F.col("n") > 0) & F.col("all"), F.array_union(held, F.array(F.lit(positive)))).otherwise(held)
    return j.select(key, F.when(F.size(every) > 1, "conflicting").when(F.size(every) == 1, every[0]).otherwise("unresolved").alias("state"))


def source_compatibility(rows: DataFrame, pair: tuple[str, str]) -> DataFrame:
    """(overlap, result) of two sources on the games that both cover: each key must have one equal, known value from each."""
    a, b = pair
    two = rows.where(F.col("source").isin(*pair)).dropna(subset=["game"]).repartition("game")  # both levels in one shuffle
    k = two.groupBy("game", "key").agg(F.count_if(F.col("source") == a).alias("na"), F.count_if(F.col("source") == b).alias("nb"), F.bool_or(F.col("value").isNull()).alias("bad"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    wrong = (F.col("na") != 1) | (F.col("nb") != 1) | F.col("bad") | (F.col("lo") != F.col("hi"))
    games = k.groupBy("game").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.bool_or(wrong).alias("wrong")).where("na > 0 AND nb > 0")
    out = games.agg(F.count("*").alias("overlap"), F.bool_or("wrong").alias("wrong"))
    return out.select("overlap", F.when(F.col("overlap") == 0, "insufficient-overlap").when(F.col("wrong"), "incompatible").otherwise("compatible").alias("result"))


def event_states(markers: DataFrame, key: str) -> DataFrame:
    """(key, state, observed_at) from marker heads (marker, at): conflicting, suspended, postponed, completed, in-progress or scheduled."""
    n = lambda m: F.count_if(F.col("marker") == m)
    at = lambda m: F.max(F.when(F.col("marker") == m, F.col("at")))
    out = markers.groupBy(key).agg(*[n(m).alias(m) for m in ("final", "terminal", "totals", "suspended", "postponed", "absent")], *[at(m).alias(f"{m}_at") for m in ("final", "terminal", "totals")])
    most = F.greatest("final", "terminal", "totals", "suspended", "postponed")
    done = F.col("final") + F.col("terminal") + F.col("totals")
    bad = (F.col("absent") > 0) | (most > 1) | (((F.col("suspended") > 0) | (F.col("postponed") > 0)) & (done > 0)) | ((F.col("suspended") > 0) & (F.col("postponed") > 0))
    state = F.when(bad, "conflicting").when(F.col("suspended") > 0, "suspended").when(F.col("postponed") > 0, "postponed").when((F.col("final") > 0) & (F.col("terminal") + F.col("totals") > 0), "completed").when(done > 0, "in-progress").otherwise("scheduled")
    return out.select(key, state.alias("state"), F.when(state == "completed", F.greatest("final_at", F.least("terminal_at", "totals_at"))).alias("observed_at"))


def expired(rows: DataFrame, pins: DataFrame, now, days: int = 90) -> DataFrame:
    """Rows older than `days` whose pin is absent or released."""
    live = pins.where("unpinned_at IS NULL").select("id").distinct()
    return rows.where(F.col("stored_at") + days < F.lit(now)).join(live, "id", "left_anti")


def violations(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(rule, rows) for each evidence rule: how many rows break it, and `clean` for those that break none."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return rows.select(F.explode(F.when(F.size(names) == 0, F.array(F.lit("clean"))).otherwise(names)).alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))


def input_sets(versions: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """(key, nth, job, known_at): the jobs of a key in the order in which they became known. A set of inputs is the first n of them, so it is named by n and holds those before it."""
    known = F.when(F.col("available_at").isNotNull() & F.col("ingested_at").isNotNull(), F.greatest("available_at", "ingested_at"))
    first = versions.select(key, "job", known.alias("known_at")).dropna(subset=[key, "job", "known_at"]).groupBy(key, "job").agg(F.min("known_at").alias("known_at"), F.lit(1).cast("long").alias("_one"))
    return running(first, [key], "known_at", {"nth": Run("sum", "_one")}, [F.asc("job")], most=most, bound=rows_in(versions)).select(key, "nth", "job", "known_at")


def model_context(requests: DataFrame, versions: DataFrame, key: str, request_id: str, most: int = MOST) -> DataFrame:
    """Each request (cutoff, checkpoint): the newest usable version at the cutoff, the heads there and now, its display state and its inputs.

    Versions and requests stand in two orders of one key, by what is known at the cutoff and by what is known now; a
    request takes the running maxima at its rows. `inputs` names a set of `input_sets`: how many distinct jobs were known.
    Keys of more than `most` rows are cut by time.
    """
    clock = F.struct("available_at", "ingested_at", "row_id")
    usable = F.col("state") == "usable"
    then = F.when(F.col("available_at").isNotNull() & F.col("ingested_at").isNotNull(), F.greatest("available_at", "ingested_at"))
    right = versions.select(key, then.alias("_then"), F.col("ingested_at").alias("_now"), clock.alias("c"), "state", "data", "job", usable.alias("u"))
    asked = requests.select(request_id, key, F.col("cutoff").alias("_then"), F.col("checkpoint").alias("_now"), F.lit(True).alias("_asked"))
    bound = rows_in(versions, requests)
    both = T.in_time(right, asked, [key])
    both = both.repartition(key) if bound <= most else both  # all windows in one shuffle
    new = F.row_number().over(Window.partitionBy(key, "job").orderBy(F.asc_nulls_last("_then"))) == 1
    both = both.withColumn("_first", F.when(F.col("job").isNotNull() & F.col("_then").isNotNull() & new, F.lit(1).cast("long")))
    known, stored = F.col("_then").isNotNull(), F.col("_now").isNotNull()
    right_first = [F.asc_nulls_first("_asked")]
    out = running(both, [key], "_then", {"s": Run("max", F.when(known & F.col("u"), F.struct("c", "data"))), "vis": Run("max", F.when(known, F.col("c"))), "inputs": Run("sum", "_first")}, right_first, most=most, bound=bound)
    out = running(out, [key], "_now", {"r": Run("max", F.when(stored, F.struct("c", "state")))}, right_first, most=most, bound=bound)
    out = out.where("_asked").withColumn("sel", F.col("s.c")).withColumn("cur", F.col("r.c"))
    state = first_of(("unavailable", F.col("sel").isNull()), ("stale", (F.col("cur") > F.col("sel")) & (F.col("r.state") != "usable")), ("superseded", F.col("cur") > F.col("sel")))
    return out.select(request_id, key, F.col("sel.row_id").alias("selected"), F.col("vis.row_id").alias("visible_head"), F.col("cur.row_id").alias("current_head"), F.coalesce(state, F.lit("current")).alias("display"), F.col("s.data").alias("data"), F.coalesce("inputs", F.lit(0)).alias("inputs"))


def batch_forecast(requests: DataFrame, context: DataFrame, folds: DataFrame, rights: DataFrame, request_id: str) -> DataFrame:
    """Over and Under probabilities of each request's line from its player's history, or the first refusal."""
    values = F.transform("history", lambda x: x["value"])
    j = requests.join(context.select(request_id, "display"), request_id, "left").join(folds.select("game", "history"), "game", "left").join(rights.select("profile", "uses"), "profile", "left")
    n = F.size("history")
    why = first_of(
        ("rights-refused", ~F.coalesce(F.array_contains(F.split("uses", ","), "display"), F.lit(False))),
        ("context-unavailable", F.coalesce(F.col("display") == "unavailable", F.lit(True))),
        ("context-stale", F.col("display") == "stale"),
        ("feature-unavailable", F.col("history").isNull()),
        ("insufficient-history", n < 2),
    )
    out = j.withColumn("refusal", why).withColumn("_v", values)
    share = lambda f: F.when(F.col("refusal").isNull(), F.size(F.filter("_v", f)) / n)
    return out.withColumn("p_over", share(lambda v: v > F.col("line"))).withColumn("p_under", share(lambda v: v < F.col("line"))).drop("_v")


def deletion_plan(edges: DataFrame, roots: DataFrame, objects: DataFrame) -> DataFrame:
    """(address, action): addresses of what the roots reach; shared-retained if something outside still refers to them."""
    gone = T.closure(edges, roots)
    j = objects.join(gone.select("node", F.lit(True).alias("gone")), "node", "left")
    out = j.groupBy("address").agg(F.count_if(F.col("gone")).alias("dead"), F.count_if(F.col("gone").isNull()).alias("live")).where("dead > 0")
    return out.select("address", F.when(F.col("live") > 0, "shared-retained").otherwise("removed").alias("action"))


def normalization_plan(captures: DataFrame, bridges: DataFrame, schedule: DataFrame, key: str) -> DataFrame:
    """The identity value of each capture row, or the first reason against it: capture, schedule, then identity."""
    held = T.interval_value(captures.select(key, "profile", F.col("at")), bridges, ["profile"], key).withColumnRenamed("status", "bridge")
    j = captures.join(schedule.select("game", "kickoff"), "game", "left").join(held, key, "left")
    why = first_of(("capture-ambiguous", F.col("rivals") > 1), ("capture-refused", F.col("state") != "usable"), ("schedule-missing", F.col("kickoff").isNull()), ("identity-missing", F.coalesce(F.col("bridge"), F.lit("missing")) == "missing"), ("identity-conflict", F.col("bridge") == "conflict"))
    return j.select(key, why.alias("reason"), F.when(why.isNull(), F.col("value")).alias("value"))


def decision_currency(inputs: DataFrame, heads: DataFrame, decision: str, entity: str) -> DataFrame:
    """(decision, current): whether the recorded inputs of each decision equal the evidence heads of its entity."""
    a = inputs.groupBy(decision, entity).agg(F.sort_array(F.collect_set("id")).alias("was"))
    b = heads.groupBy(entity).agg(F.sort_array(F.collect_set("id")).alias("is"))
    return a.join(b, entity, "left").select(decision, F.coalesce(F.col("was") == F.col("is"), F.lit(False)).alias("current"))


def witness(wanted: DataFrame, heads: DataFrame, plan: DataFrame, entity: str) -> DataFrame:
    """(entity, status, reason): current head, withheld with its reason, or missing, for each wanted entity."""
    h = heads.groupBy(entity).agg(F.count("*").alias("n"))
    j = wanted.join(h, entity, "left").join(plan, entity, "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("reason").isNotNull(), "withheld").otherwise("current")
    return j.select(entity, status.alias("status"), F.when(status == "withheld", F.col("reason")).alias("reason"))


def consumer_replay(uses: DataFrame, decisions: DataFrame, record: str) -> DataFrame:
    """(record, status): ok or the first problem over a record's inputs: a decision missing, withheld or stale by digest."""
    j = uses.join(decisions.withColumnRenamed("digest", "now"), "input", "left")
    rank = F.when(F.col("now").isNull() & F.col("withheld").isNull(), 3).when(F.col("withheld"), 2).when(F.col("digest") != F.col("now"), 1).otherwise(0)
    return j.groupBy(record).agg(F.max(rank).alias("r")).select(record, F.element_at(F.array(*map(F.lit, ("ok", "decision-stale", "decision-withheld", "decision-missing"))), F.col("r") + 1).alias("status"))


def label_consistency(labels: DataFrame, completion: DataFrame, participation: DataFrame, reconciled: DataFrame, bridge: DataFrame) -> DataFrame:
    """(id, broken): the first rule that a label breaks: completion, participation, selected value, then one identity."""
    j = labels.join(completion.select("game", F.col("state").alias("c")), "game", "left").join(participation.select("id", F.col("state").alias("p")), "id", "left").join(reconciled.select("id", "result", F.col("value").alias("v")), "id", "left").join(bridge.select("id", F.col("status").alias("b")), "id", "left")
    ok = lambda c: F.coalesce(c, F.lit(False))
    return j.select("id", first_of(("completion", ~ok(F.col("c") == "completed")), ("participation", ~ok(F.col("p") == "played")), ("selection", ~ok(F.col("result").isin("single", "agree") & (F.col("v") == F.col("value")))), ("identity", ~ok(F.col("b") == "one"))).alias("broken"))


def dependency_sets(recorded: DataFrame, expected: DataFrame, record: str, parts: list[str]) -> DataFrame:
    """(record, missing, extra, equal): whether the dependencies that a record names are those that are expected of it."""
    a = recorded.select(record, *parts).dropna(subset=[record]).distinct().withColumn("_a", F.lit(True))
    b = expected.select(record, *parts).dropna(subset=[record]).distinct().withColumn("_b", F.lit(True))
    out = a.join(b, [record, *parts], "full").groupBy(record).agg(F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_b").isNull()).alias("extra"))
    return out.withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))
