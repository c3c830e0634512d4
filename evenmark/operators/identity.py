"""Matching names to identities, calendars and reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import index_keys, least_shared, normal_name, score_names, spelling
from .scans import MOST, Run, rows_in, running


def candidate_pairs(left: DataFrame, right: DataFrame, block: list[str], least: float) -> DataFrame:
    """Pairs of left (block, name, _a) and right (block, identity, alias, _b) that hold all of similarity `least`, from an inverted index of letters.

    A pair of sizes a and b shares a number of its letters at least (it grows with `least`, and is less if the first four
    letters agree), so both have the first few of those among their own rarest ones: see `index_keys`. Only texts that have
    a key in common are paired. Exact for `least` over 0.8. An initial meets the surname by its own key.
    """
    texts = left.select(F.col("_a").alias("x")).unionByName(right.select(F.col("_b").alias("x"))).dropna().distinct().select(spelling("x").alias("l"))
    counts = texts.select(F.explode("l").alias("t")).groupBy("t").count().orderBy("count", "t").collect()  # one row for each letter and times it stands in one text
    order = {r.t: k for k, r in enumerate(counts)}
    sizes = sorted(r.n for r in texts.select(F.size("l").alias("n")).distinct().collect() if r.n)

    def posted(df: DataFrame, text: str) -> DataFrame:
        parts = []
        for head in (4, 0):
            keyed = df.dropna(subset=[text]).withColumn("_t", F.explode(index_keys(order, sizes, least_shared(least, head or 3), text == "_a")(text)))
            parts.append(keyed.withColumn("_h", F.substring(F.replace(F.col(text), F.lit(" "), F.lit("")), 1, 4) if head else F.lit("")))
        return parts[0].unionByName(parts[1])

    met = posted(left, "_a").join(posted(right, "_b"), [*block, "_h", "_t"])
    words = F.split("_a", " ")
    initial = left.where(F.col("_a").rlike("^. ") & (F.size(words) == 2)).withColumn("_i", words[0]).withColumn("_s", words[1])
    surname = right.where(F.col("_b").contains(" ")).withColumn("_i", F.substring("_b", 1, 1)).withColumn("_s", F.element_at(F.split("_b", " "), -1))
    columns = [*block, "name", "_a", "identity", "alias", "_b"]
    return met.select(*columns).unionByName(initial.join(surname, [*block, "_i", "_s"]).select(*columns)).distinct()


def scored_pairs(names: DataFrame, candidates: DataFrame, block: list[str], least: float = 0.0, few: int = 5_000_000) -> DataFrame:
    """(block, name, identity, score): each distinct name against each identity of its block, by its best alias; scores under `least` are left out.

    Names are normalised once each. Where blocks make more than `few` pairs, and for a `least` over 0.8, pairs come from an
    index of letters (`candidate_pairs`); else they are all made that sizes allow. The rows are the same.
    """
    left = names.select(*block, "name").distinct().withColumn("_a", normal_name("name"))
    right = candidates.select(*block, "identity", "alias").distinct().withColumn("_b", normal_name("alias"))
    if least > 0.8 and _pairs(left, right, block) > few:
        pairs = candidate_pairs(left, right, block, least)
    else:
        size = lambda c: F.length(F.replace(c, F.lit(" "), F.lit("")))
        low, high = F.least(size(F.col("_a")), size(F.col("_b"))), F.greatest(size(F.col("_a")), size(F.col("_b")))
        # with all of the shorter one's letters matched, similarity is 0.8 + 0.2 * low / high at most
        pairs = left.join(right, block).where((0.8 * high + 0.2 * low >= (least - 1e-9) * high) | F.col("_a").rlike("^. "))
    scored = pairs.withColumn("score", score_names(least)("_a", "_b")).where("score IS NOT NULL AND NOT isnan(score)")
    return scored.groupBy(*block, "name", "identity").agg(F.max("score").alias("score"))


def _pairs(left: DataFrame, right: DataFrame, block: list[str]) -> int:
    n, m = left.groupBy(*block).agg(F.count("*").alias("n")), right.groupBy(*block).agg(F.count("*").alias("m"))
    return n.join(m, block).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]


def match_identities(names: DataFrame, candidates: DataFrame, block: list[str], least: float = 0.94, gap: float = 0.04) -> DataFrame:
    """(block, name, identity, score, accepted): the best identity of each name, accepted if it is good and clearly ahead.

    Scores under least - gap decide nothing, so names without a better one are left out.
    """
    w = Window.partitionBy(*block, "name").orderBy(F.desc("score"), "identity")
    ranked = scored_pairs(names, candidates, block, least - gap).withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("place = 1")
    ok = (F.col("score") >= least) & (F.coalesce(F.col("score") - F.col("next"), F.lit(1.0)) >= gap - 1e-12)
    return ranked.select(*block, "name", "identity", "score", ok.alias("accepted"))


def resolve_crosswalk(names: DataFrame, crosswalk: DataFrame, candidates: DataFrame, block: list[str]) -> DataFrame:
    """The crosswalk with new rows for names that it lacks and that match; known names are not matched again."""
    fresh = names.select(*block, "name").distinct().join(crosswalk.select(*block, "name"), [*block, "name"], "left_anti")
    found = match_identities(fresh, candidates, block).where("accepted").select(*block, "name", "identity")
    return crosswalk.select(*block, "name", "identity").unionByName(found)


def latest_snapshot(rows: DataFrame, order: list[str], wanted) -> DataFrame:
    """Rows of the newest snapshot that are wanted; a marker row with nulls if it has none."""
    top = rows.agg(F.max(F.struct(*order)).alias("top")).select("top.*")
    return top.join(rows.where(wanted), order, "left")


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], at: str, clock: str, value: list[str], most: int = MOST) -> DataFrame:
    """Each left row with the right row of its keys nearest in time, the earlier on ties; none gives nulls. Equal left rows are one.

    Both sides stand in one order of their clocks; a left row takes the last right row before it and, in the reverse
    order, the last one behind it. Keys of more than `most` rows are cut by time.
    """
    names = left.columns
    held = right.dropna(subset=[*keys, clock]).groupBy(*keys, F.col(clock).alias("_at")).agg(F.min(F.struct(clock, *value)).alias("_r"))
    both = held.unionByName(left.distinct().withColumn("_at", F.col(at)).withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    right_first, bound = [F.asc_nulls_first("_asked")], rows_in(left, right)
    found = running(both, keys, "_at", {"_b": Run("last", "_r")}, right_first, most=most, bound=bound)
    found = running(found, keys, "_at", {"_a": Run("last", "_r")}, right_first, descending=True, most=most, bound=bound).where("_asked")
    far = lambda r: F.when(F.col(r).isNotNull(), F.struct(F.abs(F.col(f"{r}.{clock}") - F.col(at)).alias("far"), F.col(r).alias("r")))
    out = found.withColumn("n", F.when(F.col(at).isNotNull(), F.least(far("_b"), far("_a"))))
    return out.select(*names, "n.far", F.col("n.r").alias("nearest"))


def calendar_weeks(instants: DataFrame, weeks: DataFrame, at: str, step: int = 7) -> DataFrame:
    """Each instant with the (season, week) whose [start, end) holds it. Both sides meet in steps of `step`, so there is no pair of every instant and week."""
    place = lambda x: F.floor(x / step)
    held = weeks.withColumn("_step", F.explode(F.sequence(place(F.col("start")), place(F.col("end") - 1))))
    held = held.withColumnRenamed("start", "_start").withColumnRenamed("end", "_end")
    inside = (F.col(at) >= F.col("_start")) & (F.col(at) < F.col("_end"))
    keyed = instants.withColumn("_at", place(F.col(at)))
    return keyed.join(held, (F.col("_at") == F.col("_step")) & inside, "left").drop("_start", "_end", "_step", "_at")
