"""Collection planning, quotas, freshness, health and usage reports. Instants are whole seconds since 1970 in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import DAY, ZONE, local_day, local_seconds, wall_clock_instant

#: Evening checkpoints by days after the slate's first Tuesday.
EVENINGS = ("tuesday-opening", "wednesday-evening", "thursday-evening", "friday-final-practice", "saturday-evening", "sunday-evening")


def due_windows(checkpoints: DataFrame, key: str, due: str, kickoff: str, tie: str) -> DataFrame:
    """Adds the end of each checkpoint's window: the next one's due time, else the kickoff."""
    w = Window.partitionBy(key).orderBy(due, tie)
    return checkpoints.withColumn("due_end", F.coalesce(F.lead(due).over(w), F.col(kickoff)))


def baseline_plan(events: DataFrame, hour: int = 20, zone: str = ZONE) -> DataFrame:
    """(event, checkpoint, due, due_end): evenings of the event's week before its day, six hours and a quarter before kickoff.

    events: event, kickoff. The week begins on the Tuesday at or before the event's local day.
    """
    day = local_day(F.col("kickoff"), zone)
    tuesday = day - F.pmod(day - 5, F.lit(7))  # 1970-01-06 was a Tuesday, day 5
    e = events.withColumn("_day", day).withColumn("_tue", tuesday)
    slots = [F.struct(F.lit(name).alias("checkpoint"), wall_clock_instant((F.col("_tue") + k) * DAY + hour * 3600, zone).alias("due"), (F.col("_tue") + k < F.col("_day")).alias("ok")) for k, name in enumerate(EVENINGS)]
    fixed = [F.struct(F.lit(n).alias("checkpoint"), (F.col("kickoff") - s).alias("due"), F.lit(True).alias("ok")) for n, s in (("t-6h", 6 * 3600), ("t-15m", 900))]
    out = e.select("event", "kickoff", F.explode(F.array(*slots, *fixed)).alias("c")).select("event", "kickoff", "c.*").where("ok AND due < kickoff")
    return due_windows(out, "event", "due", "kickoff", "checkpoint").select("event", "checkpoint", "due", "due_end")


def priority_plan(targets: DataFrame, far: int = 3600, near: int = 300, active: int = 6 * 3600) -> DataFrame:
    """(target, step, due, due_end): from activation every `far` seconds, and every `near` seconds in the last `active` before kickoff.

    targets: target, activated, kickoff, activated first; each target once. A step ends where the next begins, which stands in
    the same array: no step is shuffled.
    """
    border = F.col("kickoff") - active
    early = F.when(F.col("activated") < border, F.sequence("activated", border - 1, F.lit(far))).otherwise(F.array().cast("array<bigint>"))
    late = F.sequence(F.greatest("activated", border), F.col("kickoff") - 1, F.lit(near))
    all_due = targets.where("activated < kickoff").select("target", "kickoff", F.concat(early, late).alias("_due"))
    windows = F.arrays_zip(F.col("_due").alias("due"), F.concat(F.slice("_due", 2, F.size("_due")), F.array("kickoff")).alias("due_end"))
    out = all_due.select("target", F.posexplode(windows).alias("step", "_w"))
    return out.select("target", "step", F.col("_w.due").alias("due"), F.col("_w.due_end").alias("due_end"))


def quota_rank(remaining: Column, reserve: int, cost: int) -> Column:
    """The highest priority rank that the quota left allows."""
    return F.when(remaining == 0, 0).when(remaining.isNull() | (remaining <= reserve), 20).when(remaining <= reserve + cost, 30).otherwise(40)


def select_due(rows: DataFrame, now: int, remaining: int | None, reserve: int, cost: int, k: int) -> DataFrame:
    """The first k rows by rank, due time and id among those pending, due, unexpired and allowed by the quota."""
    top = quota_rank(F.lit(remaining), reserve, cost)
    ok = (F.col("status") == "pending") & (F.col("due") <= now) & (F.col("due_end") > now) & (F.col("rank") <= top) & (F.col("cost") <= (remaining if remaining is not None else cost))
    return rows.where(ok).orderBy("rank", "due", "id").limit(k)


def expired_reasons(rows: DataFrame, now: int) -> DataFrame:
    """Why each expired pending row was never run."""
    late = rows.where((F.col("status") == "pending") & (F.col("due_end") <= now))
    return late.withColumn("reason", F.when(F.col("attempts") > 0, "attempts-exhausted").when(F.col("cost") > 8, "quota-exhausted").otherwise("window-missed"))


def baseline_events(events: DataFrame, profile: str, slate: str = "slate", zone: str = ZONE) -> DataFrame:
    """paid-baseline: all events; else the last Sunday event of each slate."""
    if profile == "paid-baseline":
        return events.withColumn("reason", F.lit("full-slate"))
    sunday = F.pmod(local_day(F.col("kickoff"), zone) - 3, F.lit(7)) == 0  # 1970-01-04 was a Sunday, day 3
    w = Window.partitionBy(slate).orderBy(F.desc("kickoff"), F.desc("event"))
    return events.where(sunday).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("reason", F.lit("latest-sunday"))


def freshness(rows: DataFrame, now: int, ttl: int, claim: int) -> DataFrame:
    """Adds fresh, pending, stale or unavailable from the age of a resource and of its refresh claim."""
    age, held = now - F.col("stored_at"), F.coalesce(now - F.col("claimed_at") < claim, F.lit(False))
    return rows.withColumn("freshness", F.when(F.col("stored_at").isNotNull() & (age < ttl), "fresh").when(held, "pending").when(F.col("stored_at").isNotNull(), "stale").otherwise("unavailable"))


def collector_health(log: DataFrame, now: int, stale: int, key: str = "subject") -> DataFrame:
    """(key, status, reasons, warnings): one pass of conditional counts over a request log, then ordered rules."""
    c = F.col
    recent = now - c("ts") <= stale
    g = log.groupBy(key).agg(F.max(F.when(c("kind") == "view", c("ts"))).alias("wake"), F.max_by("kind", F.struct("ts", "event_id")).alias("last_kind"), F.count_if((c("kind") == "purchase") & c("k").isNull()).alias("unknown_cost"), F.count_if((c("kind") == "error") & recent).alias("recent_errors"), F.count_if(c("kind") == "error").alias("errors"), F.min_by("k", F.struct(-c("ts"), -c("event_id"))).alias("quota"))
    why = F.array_compact(F.array(
        F.when(c("wake").isNull(), "missing-scheduled-wake"), F.when(now - c("wake") > stale, "scheduled-wake-stale"), F.when(c("last_kind") == "error", "latest-scheduled-wake-failed"),
        F.when(c("unknown_cost") > 0, "successful-request-unknown-cost"), F.when(c("recent_errors") > 1, "repeated-checkpoint-failure"), F.when(c("errors") > 20, "exhausted-checkpoint-failure"), F.when(c("quota") == 0, "quota-blocks-next-checkpoint"),
    ))
    warn = F.array_compact(F.array(F.when(c("quota").isNull(), "quota-state-unavailable"), F.when(c("quota").between(1, 20), "quota-policy-degraded")))
    return g.select(key, F.when(F.size(why) == 0, "healthy").otherwise("unhealthy").alias("status"), why.alias("reasons"), warn.alias("warnings"))


def usage_report(buckets: DataFrame, now: int, measures: list[str], k: int = 20) -> DataFrame:
    """(period, measure, place, subject, n): the k subjects with most of each measure in the last hour and day; place 0 is the total."""
    periods = [("1h", 3600), ("24h", DAY)]
    sums = [F.sum(F.when(now - F.col("minute") <= s, F.col(m)).otherwise(0)).alias(f"{p}_{m}") for p, s in periods for m in measures]
    per = buckets.where(now - F.col("minute") <= DAY).groupBy("subject").agg(*sums)
    long = per.select("subject", F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.lit(m).alias("measure"), F.col(f"{p}_{m}").alias("n")) for p, _ in periods for m in measures])).alias("x")).select("subject", "x.*")
    w = Window.partitionBy("period", "measure").orderBy(F.desc("n"), "subject")
    top = long.where("n > 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    total = long.groupBy("period", "measure").agg(F.sum("n").alias("n")).withColumn("place", F.lit(0)).withColumn("subject", F.lit(None).cast("long"))
    return top.unionByName(total).select("period", "measure", "place", "subject", "n")


def split_telemetry(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the rules of a request log, and the rest with the first rule broken."""
    c = F.col
    why = F.when(c("k").isNull(), "quota-missing").when((c("kind") == "error") & (c("value") > 60), "error-with-large-cost").when((c("kind") != "error") & (c("value") < 0.5), "success-without-cost").when(c("k") > 95, "quota-out-of-range")
    rows = log.withColumn("problem", why)
    return rows.where("problem IS NULL").drop("problem"), rows.where("problem IS NOT NULL")


def local_hour(instant: Column, zone: str = ZONE) -> Column:
    return F.floor(local_seconds(instant, zone) % DAY / 3600)
