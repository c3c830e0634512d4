"""Benchmark decontamination by templates: numbers, units and names of any length become typed slots; windows join; slots must agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_ALNUM, IS_SPACE, LOWER, checkpointed, mix, packed, runs_of, slices, span_hashes, trimmed

#: Words that count as a unit after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec secs min mins h hr hrs hour hours day days week weeks month months year years "
    "second seconds minute minutes meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons percent dollar dollars cent cents euro euros degree degrees"
).split()
#: Words for numbers: those below twenty, tens with and without ones, and powers of ten.
ONES = "one two three four five six seven eight nine".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBERS = ["zero", *ONES, *"ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), *TENS, *(f"{a}-{b}" for a in TENS for b in ONES), *"hundred thousand million billion trillion".split()]
#: Capitalised words that begin a sentence and are no part of the name after them.
STARTERS = "a after all an and are as at before but by can did do does each every find for from given had has have how if in is it let now of on once one so some suppose that the then there these this those to was were what when where which while who whose why will with".split()
NUMBER, UNIT, NAME = 1, 2, 3
#: More capitalised words than this in a row are a heading or a text in capitals, so literal words.
LONGEST_NAME = 5
IS_CAPITAL = np.array([chr(c).isupper() or chr(c).istitle() for c in range(0x20000)])
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[48:58] = True
IS_STOP = np.zeros(256, bool)
IS_STOP[[10, 33, 46, 58, 63]] = True


def _hashes_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    at = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:])


def _capital(buf: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether the character of UTF-8 at each place is a capital of any script."""
    b = [buf[np.minimum(s + k, len(buf) - 1)].astype(np.int64) for k in range(4)]
    low = [x & 63 for x in b]
    two, three, four = (b[0] & 31) << 6 | low[1], (b[0] & 15) << 12 | low[1] << 6 | low[2], (b[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3]
    return IS_CAPITAL[np.minimum(np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0], [b[0], two, three], four), len(IS_CAPITAL) - 1)]


def template_words(buf: np.ndarray, at: np.ndarray, units: np.ndarray, numbers: np.ndarray, starters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot type (0: a literal word), hash of the lower-case form and slot of each word, without marks around it.

    A word that begins with a digit and a number word are numbers; a unit word after a number is a unit; a capitalised word
    that begins no sentence is a name, and so is the word before it at the begin of the sentence unless it is a starter.
    Words with only blanks between them make one slot: up to `LONGEST_NAME` names (more are literal words), and a number
    with the number words after it. A word's slot is its place among slots and literal words.
    """
    starts, ends, row = runs_of(~IS_SPACE[buf], at)
    alnum = IS_ALNUM[buf]
    n = len(buf)
    place = np.arange(n)
    following = np.minimum.accumulate(np.where(alnum, place, n)[::-1])[::-1] if n else place
    previous = np.maximum.accumulate(np.where(alnum, place, -1)) if n else place
    s, e = following[starts], previous[ends - 1] + 1
    ok = s < e
    s, e, row, bare = s[ok], e[ok], row[ok], (s == starts)[ok]
    if not len(s):
        return row, row, np.empty(0, np.uint64), row
    tail = (e == ends[ok]) & np.append(np.diff(np.flatnonzero(ok)) == 1, False)  # no mark after it, nor a lone one
    word = span_hashes(LOWER[buf], s, e)
    stops = np.concatenate([[0], np.cumsum(IS_STOP[buf])])
    begins = np.ones(len(s), bool)
    begins[1:] = (row[1:] != row[:-1]) | (stops[s[1:]] > stops[e[:-1]])
    near = np.zeros(len(s), bool)  # only blanks since the word before
    near[1:] = (row[1:] == row[:-1]) & bare[1:] & tail[:-1]
    high = _capital(buf, s)
    kind = np.where(high & ~begins, NAME, 0)
    named = np.isin(word, numbers)
    kind[IS_DIGIT[buf[s]] | named] = NUMBER
    after = np.zeros(len(s), bool)
    after[1:] = (kind[:-1] == NUMBER) & (row[1:] == row[:-1])
    kind[after & np.isin(word, units)] = UNIT
    first = np.flatnonzero((kind[:-1] == 0) & high[:-1] & begins[:-1] & near[1:] & (kind[1:] == NAME))
    kind[first[~np.isin(word[first], starters)]] = NAME
    joins = np.zeros(len(s), bool)
    joins[1:] = near[1:] & (kind[1:] == kind[:-1]) & ((kind[1:] == NAME) | ((kind[1:] == NUMBER) & named[1:]))
    run = np.cumsum(~joins) - 1
    long = (kind == NAME) & (np.bincount(run)[run] > LONGEST_NAME)
    kind[long] = 0
    return row, kind, word, np.cumsum(~joins | long) - 1


def template_windows(docs: DataFrame, id_col: str, text_col: str, n: int = 8, literals: int = 4, only: np.ndarray | None = None, forms: list[tuple[int, bool]] | None = None) -> DataFrame:
    """(id, pos, window, slots array<long>, size, exact) for each window of n words with at least `literals` literal words.

    A slot of several words counts as one word, and `pos` counts so, but exact windows are of single words. `window` hashes the words with slots replaced by their types; `slots` has what stood there, 0 for literal words.
    Texts of fewer than n words give one window of what they have, if half of it is literal. Those texts, and texts
    without a window so far, also give exact windows: of the words as they stand, without slots. With `forms`, texts
    give the windows of these (size, exact) instead, wherever they stand. `only` keeps the windows whose hashes it holds.
    """
    kind_of = dict(docs.dtypes)[id_col]
    units, numbers, starters = map(_hashes_of, (UNITS, NUMBERS, STARTERS))
    exactly = mix(np.array([0x0E8AC7], np.uint64))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = mix(np.arange(11, n + 11, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                word_row, kind, word, slot = template_words(*packed(part.column(1)), units, numbers, starters)
                lead = np.flatnonzero(np.diff(slot, prepend=-1))
                # of slots: their rows, types and values, which hash all their words in order
                many = mix(word + (np.arange(len(word)) - lead[slot]).astype(np.uint64) * factors[0])
                size = np.diff(np.append(lead, len(word)))
                value_of = np.where(size > 1, np.add.reduceat(many, lead), word[lead]) if len(lead) else word
                views = {}  # row, type, value, first of each row, slot of each word
                for exact, r, t, v, p in ((False, word_row[lead], kind[lead], value_of, np.arange(len(lead))), (True, word_row, kind, word, slot)):
                    views[exact] = r, t, v, np.searchsorted(r, np.arange(part.num_rows + 1)), p
                found = np.zeros(part.num_rows, bool)

                def windows(size: np.ndarray, exact: bool, some: np.ndarray) -> pa.RecordBatch:
                    row, kind, word, first, spot = views[exact]
                    m = len(word)
                    symbol = word if exact else np.where(kind == 0, word, mix(kind.astype(np.uint64) + np.uint64(77)))
                    plain = np.concatenate([[0], np.cumsum(kind == 0)])
                    begin = np.flatnonzero(some & (np.arange(m) + size <= first[row + 1]))
                    value = size[begin].astype(np.uint64)
                    for j in range(int(size[begin].max(initial=0))):
                        more = j < size[begin]
                        value += np.where(more, symbol[np.minimum(begin + j, m - 1)] * factors[j], np.uint64(0))
                    value = mix(value ^ exactly if exact else value).view(np.int64)
                    ok = np.ones(len(begin), bool) if exact else plain[begin + size[begin]] - plain[begin] >= np.minimum(literals, (size[begin] + 1) // 2)
                    if only is not None:
                        ok &= np.isin(value, only)
                    begin, value = begin[ok], value[ok]
                    found[row[begin]] = True
                    at = begin[:, None] + np.arange(n)
                    inside = at < (begin + size[begin])[:, None]
                    at = np.minimum(at, max(0, m - 1))
                    slots = np.where(inside & (kind[at] > 0) & (not exact), word[at], np.uint64(0)) if len(begin) else np.empty((0, n), np.uint64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1, dtype=np.int32) * n), pa.array(slots.view(np.int64).ravel()))
                    shape = [pa.array(size[begin].astype(np.int32)), pa.array(np.full(len(begin), exact))]
                    pos = spot[begin] - views[False][3][row[begin]]  # in slots, for exact windows too
                    return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[begin])), pa.array(pos.astype(np.int32)), pa.array(value), lists, *shape], ["id", "pos", "window", "slots", "size", "exact"])

                def of(exact: bool) -> tuple[np.ndarray, np.ndarray]:
                    row, _, _, first, _ = views[exact]
                    return row, (first[1:] - first[:-1])[row]

                if forms is not None:
                    for k, exact in forms:
                        count = len(views[exact][0])
                        yield windows(np.full(count, k), exact, np.ones(count, bool))
                else:
                    row, have = of(False)
                    yield windows(np.minimum(n, have), False, np.ones(len(row), bool))
                    row, have = of(True)
                    yield windows(np.minimum(n, have), True, (have < n) | ~found[row])

    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return few.mapInArrow(trimmed(run), f"id {kind_of}, pos int, window long, slots array<long>, size int, exact boolean")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 8, literals: int = 4, share: float = 0.3, bound: int = 2_000_000) -> DataFrame:
    """(id, item_id, n_windows, coverage, reparameterised) for each document and benchmark item that it holds.

    Windows of both sides join on their template; those of one document, item and distance are an occurrence, in which a
    slot value of the item must always stand for the same value in the document. The largest occurrence counts, and with
    it the others, largest first, as long as the slots still agree: so words that were put in or left out do not hide a
    leak. It covers `share` of the item's windows or more; it is re-parameterised when some slot has another value. Items of
    fewer than n words, or with no window of enough literal words, are found by their exact words too, in texts of any length.
    A leak holds at least one of the item's windows that fewest items share (all but `share` of them), so only these pair
    documents with items; windows that many items share are looked up for those pairs alone.
    Up to `bound` distinct benchmark windows go to the tasks, which then send on matching windows only; beyond it
    all windows are shuffled to a semi-join. Rows with one id are one document, null ids too; repeated items are one.
    Nulls and texts without words match nothing. Ties, empty tables and extra columns make no difference; extra columns are left out.
    """
    item = template_windows(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("t")), "item_id", "t", n, literals)
    item = checkpointed(item.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "window", F.col("slots").alias("item_slots"), "size", "exact").where("item_id is not null").distinct())
    forms = sorted((r["size"], r["exact"]) for r in item.select("size", "exact").distinct().collect())  # at most 2 n
    known = item.select("window").distinct().limit(bound + 1).toArrow().column("window").to_numpy()
    own = template_windows(docs, id_col, text_col, n, literals, None if len(known) > bound else np.sort(known), forms).select("id", "pos", "window", "slots")
    if len(known) > bound:
        own = own.join(item.select("window").distinct(), "window", "left_semi")
    own = checkpointed(own)
    totals = item.groupBy("item_id").agg(F.countDistinct("item_pos").alias("total"))
    spread = item.groupBy("window").agg(F.countDistinct("item_id").alias("items"))
    rarest = Window.partitionBy("item_id").orderBy("items", "item_pos")
    places = item.join(spread, "window").groupBy("item_id", "item_pos").agg(F.max("items").alias("items"))  # a place may have a template and exact words
    places = places.withColumn("rank", F.row_number().over(rarest)).join(totals, "item_id")
    seeds = item.join(places.where(F.col("rank") <= F.col("total") - F.greatest(F.lit(1), F.floor(F.col("total") * share)) + 1).select("item_id", "item_pos"), ["item_id", "item_pos"]).select("item_id", "window").distinct()
    pairs_ = own.select("id", "window").distinct().join(seeds, "window").select("id", "item_id").distinct()
    wanted = pairs_.join(item.select("item_id", "item_pos", "window", "item_slots"), "item_id").withColumnRenamed("id", "_id")
    hits = own.join(wanted, own["id"].eqNullSafe(F.col("_id")) & (own["window"] == wanted["window"])).withColumn("shift", F.col("pos") - F.col("item_pos"))
    pairs = F.array_distinct(F.filter(F.arrays_zip("item_slots", "slots"), lambda x: x["item_slots"] != 0))
    runs = hits.groupBy("id", "item_id", "shift").agg(F.collect_set("item_pos").alias("places"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    agree = lambda p: F.size(p) == F.size(F.array_distinct(F.transform(p, lambda x: x["item_slots"])))
    runs = runs.where(agree(F.col("pairs"))).groupBy("id", "item_id").agg(F.sort_array(F.collect_list(F.struct(F.size("places").alias("n"), F.forall("pairs", lambda x: x["item_slots"] == x["slots"]).alias("same"), (-F.abs("shift")).alias("near"), "places", "pairs")), asc=False).alias("runs"))

    def joined(held, run):
        both = F.array_union(held["pairs"], run["pairs"])
        return F.when(agree(both), F.struct(F.array_union(held["places"], run["places"]).alias("places"), both.alias("pairs"))).otherwise(held)

    none = F.struct(F.array().cast("array<int>").alias("places"), F.array().cast("array<struct<item_slots: bigint, slots: bigint>>").alias("pairs"))
    best = runs.withColumn("b", F.aggregate("runs", none, joined)).withColumn("changed", F.exists("b.pairs", lambda x: x["item_slots"] != x["slots"]))
    n_windows = F.size("b.places").cast("long")
    out = best.join(totals, "item_id").select(F.col("id").alias(id_col), "item_id", n_windows.alias("n_windows"), (n_windows / F.col("total")).alias("coverage"), F.col("changed").alias("reparameterised"))
    return out.where(F.col("coverage") >= share)


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
