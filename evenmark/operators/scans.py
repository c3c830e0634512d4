"""Running aggregates in each key's order, with the time of keys that hold very many rows cut into slabs.

An associative state (a greatest value, a sum, the last value, the last k values) is carried from slab to slab: a slab is
one task's work, and what it begins with is the state of the slabs before it, one row each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key from which on its time is cut, and the most slabs of a key.
MOST, SLABS = 2_000_000, 512


@dataclass(frozen=True)
class Run:
    """A running aggregate: max, sum, last (the last that is not null) or tail (the last `size` values that are not null, oldest first)."""

    how: str
    value: Column | str
    size: int = 0

    def over(self, w) -> Column:
        v = F.col(self.value) if isinstance(self.value, str) else self.value
        if self.how == "last":
            return F.last(v, ignorenulls=True).over(w)
        if self.how == "tail":  # rows without a value have none in `_v`, so the frame of values is that of rows
            return F.collect_list(v).over(w)
        return {"max": F.max, "sum": F.sum}[self.how](v).over(w)

    def before(self, total: str, w) -> Column:
        """The state before a slab from the totals of those before it."""
        if self.how == "tail":
            return _last_of(F.flatten(F.collect_list(total).over(w)), self.size)
        return {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}[self.how](total).over(w)

    def joined(self, inside: str, before: str) -> Column:
        i, b = F.col(inside), F.col(before)
        if self.how == "max":
            return F.greatest(i, b)
        if self.how == "sum":
            return F.when(i.isNotNull() | b.isNotNull(), F.coalesce(i, F.lit(0)) + F.coalesce(b, F.lit(0)))
        if self.how == "last":
            return F.coalesce(i, b)
        return F.when(b.isNull(), i).otherwise(_last_of(F.concat(b, i), self.size))


def _last_of(values: Column, n: int) -> Column:
    return F.when(F.size(values) > n, F.slice(values, -n, n)).otherwise(values)


def by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with all of a key in one partition, sorted by keys and `order`, for a step that reads a partition as a stream.

    A plain repartition(key) is left out of the plan where the rows seem to be dealt by the key already. That is wrong for a
    union: the shuffles under it may be coalesced differently, and a key's rows come to lie in two partitions. A hash of the
    key is never taken for the key.
    """
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def rows_in(*tables: DataFrame) -> int:
    """Rows of tables together: what bounds the rows made of them. Tables that were only selected from are counted by their files' footers."""
    return sum(t.count() for t in tables)


def hot_cuts(rows: DataFrame, keys: list[str], at: str, most: int, bound: int | None = None) -> DataFrame | None:
    """(keys, _cuts): times that cut each key of more than `most` rows into about equal slabs of at most that many; None if there is no such key.

    Counts keys only where there may be more than `most` rows; `bound` is what the caller knows of that. There are at most rows / most such keys.
    """
    if (rows.count() if bound is None else bound) <= most:
        return None
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    largest = hot.agg(F.max("_n")).first()[0]
    if largest is None:
        return None
    slabs = min(SLABS, math.ceil(largest / most) + 1)
    named = hot.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    cuts = rows.join(F.broadcast(named), same, "left_semi").groupBy(*keys).agg(F.percentile_approx(at, [k / slabs for k in range(1, slabs)], 10_000).alias("_cuts"))
    return cuts.select(*keys, F.array_sort(F.array_distinct(F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)))).alias("_cuts"))


def running(rows: DataFrame, keys: list[str], at: str, runs: dict[str, Run], tie: list[Column] = (), descending: bool = False, most: int = MOST, bound: int | None = None) -> DataFrame:
    """rows with each running aggregate of `runs` up to and including a row, in the order of `at` (null times first), then `tie`.

    Rows of one time and equal `tie` may stand in any order. A key of more than `most` rows is cut by time, so that no task
    has much more than `most` of its rows (rows of one time stay together); the others are one task's work in bounded memory.
    `bound`: a number that the rows do not exceed, where the caller knows; else they are counted.
    """
    order = [F.desc_nulls_first(at) if descending else F.asc_nulls_first(at), *tie]

    def inside(df: DataFrame, part: list[str]) -> DataFrame:
        up_to = Window.partitionBy(*part).orderBy(*order)
        frames = {n: up_to.rowsBetween(1 - r.size if r.how == "tail" else Window.unboundedPreceding, Window.currentRow) for n, r in runs.items()}
        return df.withColumns({n: r.over(frames[n]) for n, r in runs.items()} | ({"_nth": F.row_number().over(up_to)} if "_slab" in part else {}))

    cuts = hot_cuts(rows, keys, at, most, bound)
    if cuts is None:
        return inside(rows, keys)
    named = cuts.select(*[F.col(k).alias(f"_{k}") for k in keys], "_cuts")
    marked = rows.join(F.broadcast(named), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
    passed = F.size(F.filter("_cuts", lambda c: (c >= F.col(at)) if descending else (c <= F.col(at))))  # none for a null time
    marked = inside(marked.withColumn("_slab", F.when(F.col("_cuts").isNotNull(), passed).otherwise(0)), [*keys, "_slab"])
    totals = marked.where("_cuts IS NOT NULL").groupBy(*keys, "_slab").agg(*[F.max_by(n, "_nth").alias(f"_t_{n}") for n in runs])
    earlier = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    begin = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_slab").alias("_in"), *[r.before(f"_t_{n}", earlier).alias(f"_b_{n}") for n, r in runs.items()])
    both = marked.join(begin, [*[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_slab") == F.col("_in")], "left")
    return both.withColumns({n: r.joined(n, f"_b_{n}") for n, r in runs.items()}).select(*rows.columns, *runs)
