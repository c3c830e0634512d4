"""Near-duplicate documents by min-max hashing: minimum and maximum under each permutation, banded, then exact sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, checkpointed, each_salt, merged, mix, packed, runs_of, salt, salts_seen, slices, span_hashes, spread_join, trimmed, trimmed_group
from .components import connected

#: Slots of the table that tells frequent shingles from rare ones.
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS


def shingle_sets(buf: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of the distinct k-word shingles of each row, sorted by row, then hash; fewer words are one shingle."""
    n = len(at) - 1
    starts, ends, row = runs_of(~IS_SPACE[buf], at)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    word = span_hashes(LOWER[buf], starts, ends)
    first = np.searchsorted(row, np.arange(n + 1))
    words = np.diff(first)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    m = len(word)
    full = np.zeros(m, np.uint64)
    if m >= k:
        for j in range(k):
            full[: m - k + 1] += word[j : m - k + 1 + j] * factors[j]
    ok = np.arange(m) + k <= first[row + 1]
    short = np.flatnonzero((words > 0) & (words < k))
    for r in short:
        lo, hi = first[r], first[r + 1]
        full[lo] = (word[lo:hi] * factors[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
        ok[lo] = True
    h, r = mix(full[ok]), row[ok]
    order = np.argsort(h)
    order = order[np.argsort(r[order], kind="stable")]
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new]


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int = 5, bands: int = 24, rows: int = 3) -> DataFrame:
    """(id, n_shingles, k1, k2, bands array<long>): set size, a 128-bit key of the set and the hash of each band.

    bands * rows signature values come from half as many permutations: each gives its minimum and its maximum.
    """
    perms = -(-bands * rows // 2)
    mul, add = _rng_pair(perms)
    kind = dict(docs.dtypes)[id_col]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                n = part.num_rows
                row, h = shingle_sets(*packed(part.column(1)), k)
                size = np.bincount(row, minlength=n)
                some = np.flatnonzero(size)
                begin = np.searchsorted(row, some)
                values = np.zeros((2 * perms, n), np.uint64)
                keys = np.zeros((2, n), np.uint64)
                if len(some):
                    for p in range(perms):
                        x = h * mul[p] + add[p]
                        values[2 * p, some] = np.minimum.reduceat(x, begin)
                        values[2 * p + 1, some] = np.maximum.reduceat(x, begin)
                    keys[0, some] = np.add.reduceat(h, begin)
                    keys[1, some] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5)), begin)
                band = np.zeros((bands, n), np.uint64)
                for b in range(bands):
                    for j in range(rows):
                        band[b] = mix(band[b] + values[b * rows + j] + np.uint64(b + 1))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(np.ascontiguousarray(band.T).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), flat], ["id", "n_shingles", "k1", "k2", "bands"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(sign), f"id {kind}, n_shingles long, k1 long, k2 long, bands array<long>")


def _rng_pair(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                row, h = shingle_sets(*packed(part.column(1)), k)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(h, row, part.num_rows)], ["id", "shingles"])

    return docs.mapInArrow(trimmed(build), f"id {dict(docs.dtypes)['id']}, shingles array<long>")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    one = spread_join(pairs, sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), ["b"], "a")
    two = _spread_join_once(one, pairs, sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")))
    both = F.size(F.array_intersect("sa", "sb"))
    return two.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _spread_join_once(rows: DataFrame, pairs: DataFrame, table: DataFrame) -> DataFrame:
    """rows (a, b, ...) joined with the table's row of a; the salts that a has come from the pairs alone, so that what
    the rows carry moves once."""
    salts = pairs.withColumn("salt", salt("b")).groupBy("a").agg(salts_seen())
    wanted = salts.join(table, "a").withColumn("salt", each_salt()).drop("mask")
    return rows.withColumn("salt", salt("b")).join(wanted, ["a", "salt"]).drop("salt")


def _frequent(sets: DataFrame) -> np.ndarray:
    """About how often the shingles of each of SLOTS hash slots stand, as an eighth of a power of two; 0 if not often.

    Tasks send only slots that stand eight times as often as their mean, at most an eighth of them; the table has the
    same size whatever the rows. It only orders shingles, so it need not be exact.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - SLOT_BITS), minlength=SLOTS)
        some = np.flatnonzero(n > 8 * n.sum() / SLOTS + 8)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["slot", "n"])

    rows = sets.select("shingles").mapInArrow(trimmed(count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(SLOTS, np.uint8)
    if rows.num_rows:
        table[rows.column("slot").to_numpy()] = np.minimum(255, 8 * np.log2(rows.column("n").to_numpy()))
    return table


def _prefixes(members: DataFrame, often: np.ndarray, percent: int) -> DataFrame:
    """(shingle, head, part, size) for the first shingles of each row's set in one order of all shingles, rare ones first.

    Two sets alike to `percent` share one of their first size - ceil(size * percent / 100) + 1 shingles in any order.
    """

    def first_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2)
        size = lists.value_lengths().to_numpy().astype(np.int64)
        h = lists.flatten().to_numpy().view(np.uint64)
        row = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((h, often[h >> np.uint64(64 - SLOT_BITS)], row))
        place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        first = np.flatnonzero(place < (size - -(-size * percent // 100) + 1)[row])
        row = row[first]
        return pa.RecordBatch.from_arrays([pa.array(h[order[first]].view(np.int64)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(size[row])], ["shingle", "head", "part", "size"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends, begin = np.cumsum(whole.column(2).value_lengths().to_numpy()), 0
            while begin < len(ends):  # half a million shingles at a time
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 500_000, "right")))
                yield first_of(whole.slice(begin, end - begin))
                begin = end

    return members.select("head", "part", "shingles").mapInArrow(trimmed(cut), "shingle long, head long, part long, size long")


def _open_rows(many: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The heads of (head, part) that share one of their first shingles, rare ones first, with a row of another part; the others are alike to none."""
    members = many.join(sets.select(F.col("id").alias("head"), "shingles"), "head")
    first = merged(_prefixes(members, _frequent(sets), percent).withColumn("salt", salt("head")))
    shared = first.groupBy("shingle").agg(F.min("part").alias("x"), F.max("part").alias("y"), salts_seen()).where("x <> y").select("shingle", each_salt())
    return first.join(shared, ["shingle", "salt"]).select("head").distinct()


def _block_pairs(rest: DataFrame, block: int) -> DataFrame:
    """(band, head, part, i, j, blk) for each row and each pair of blocks that it takes part in.

    A component with a block's rows or more has blocks of its own, which are not paired with each other; the rows of
    smaller ones share blocks. So rows of one component are compared with what is not in it only.
    """
    sizes = rest.groupBy("band", "part").agg(F.count("*").alias("n"), salts_seen())
    own = rest.join(sizes.select("band", "part", F.when(F.col("n") >= block, F.col("part")).otherwise(-1).alias("whose"), each_salt()), ["band", "part", "salt"])
    cells = own.groupBy("band", "whose").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), salts_seen())
    dealt = own.join(cells.select("band", "whose", "blocks", each_salt()), ["band", "whose", "salt"]).withColumn("blk", F.struct("whose", F.pmod(F.xxhash64("head"), "blocks").cast("int").alias("k"))).select("band", "head", "part", "blk")
    blocks = cells.select("band", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct("whose", k.alias("k")))).alias("i"))
    two = blocks.join(blocks.withColumnRenamed("i", "j"), "band").where("i <= j AND (i.whose <> j.whose OR i.whose = -1)")
    sides = two.select("band", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("blk"))
    return dealt.join(sides, ["band", "blk"])


def _block_links(keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between rows of different parts in the pairs of blocks, enough of them to join what they join; at most one for each row and pair of blocks."""

    def compare(key, table):
        first, second, ids, part = (table.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second", "head", "part"))
        lists = table.column("shingles").combine_chunks()
        size = lists.value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(ids)), size)
        _, code, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        often = times[code] > 1  # what only one row has is in no intersection
        place = np.cumsum(times > 1) - 1
        code, row = place[code[often]], row[often]
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        x, y = np.flatnonzero(first), np.flatnonzero(second)
        at = np.empty(len(ids), np.int64)
        both = np.zeros((len(x), len(y)), np.float32)
        columns = int(code[-1]) + 1 if len(code) else 0
        for lo in range(0, columns, 4_096):
            begin, end = np.searchsorted(code, [lo, lo + 4_096])
            c, r = code[begin:end] - lo, row[begin:end]
            sides = []
            for side, of in ((x, first), (y, second)):
                at[side] = np.arange(len(side))
                hit = of[r]
                m = np.zeros((len(side), min(4_096, columns - lo)), np.float32)
                m[at[r[hit]], c[hit]] = 1
                sides.append(m)
            both += sides[0] @ sides[1].T
        a, b = np.nonzero((100 * both >= percent * (size[x][:, None] + size[y][None, :] - both)) & (part[x][:, None] != part[y][None, :]))
        a, b = x[a], y[b]
        root = np.arange(len(ids))
        while True:  # the smallest place that each row reaches
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[root[some]]), "b": pa.array(ids[some])})

    full = keys.withColumn("first", F.col("blk") == F.col("i")).withColumn("second", F.col("blk") == F.col("j")).drop("blk")
    full = full.join(sets.select(F.col("id").alias("head"), "shingles"), "head")
    return full.groupBy("band", "i", "j").applyInArrow(trimmed_group(compare), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, bands: int = 24, rows: int = 3, few_rows: int = 24, block: int = 384) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs: groups linked by shingle sets alike to `percent` or more.

    Rows with the same set are one class, stood for by its smallest id. Classes that share a band are candidates; a band
    compares its members with its smallest first, and then only members that are not known to be in one component, so that
    a group of copies costs as many comparisons as it has members, and no link that joins two components is left out.
    What is left of a band of up to `few_rows` rows is compared pair by pair. Of what is left of larger bands, rows that
    share none of their rare shingles with another component are done (`_open_rows`); the others are compared in blocks of
    `block` rows, two by two, inside a task, but those of one component not with each other (`_block_pairs`).
    Every link is confirmed on full sets. At the limit of similarity, 24 bands of 3 values miss a link with a chance of
    2 in a million, the next ones with less. Empty and null texts have no shingle and link with nothing; a null id is
    a row of its own. Repeated ids count as one document with each of their texts. Extra columns are left out.
    Bands, classes and components of very many rows are dealt over SPREAD tasks wherever rows are joined with them.
    """
    small = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = checkpointed(signatures(small, "id", "text", k, bands, rows))
    live = signed.where("n_shingles > 0 and id is not null")
    key = ["n_shingles", "k1", "k2"]
    heads = merged(live.groupBy(*key).agg(F.min("id").alias("head"), F.min_by("bands", "id").alias("bands"), F.count("*").alias("members")))
    placed = heads.select("head", F.explode("bands").alias("band"), salt("head").alias("salt"))
    shared = placed.groupBy("band").agg(F.min("head").alias("low"), F.count("*").alias("n"), salts_seen()).where("n > 1").select("band", "low", "n", each_salt())
    members = merged(placed.join(shared, ["band", "salt"]))
    star = members.where("head <> low").select(F.col("low").alias("a"), F.col("head").alias("b")).distinct()
    wanted = members.select(F.col("head").alias("id")).distinct()
    sets = merged(_sets(small.join(wanted, "id", "left_semi"), k))
    links = merged(_links(star, sets, percent))
    # a row's part: the smallest that it is linked to, or what that one is linked to; rows of one part are in one component
    near = links.groupBy(F.col("b").alias("head")).agg(F.min("a").alias("to"))
    part = near.join(near.select(F.col("head").alias("to"), F.col("to").alias("far")), "to", "left").select("head", F.coalesce("far", "to").alias("part"))
    known = members.join(part, "head", "left").select("band", "salt", "n", "head", F.coalesce("part", "head").alias("part"))
    open_bands = known.groupBy("band").agg(F.min("part").alias("x"), F.max("part").alias("y"), salts_seen()).where("x <> y").select("band", each_salt())
    rest = merged(known.join(open_bands, ["band", "salt"]))
    few = rest.where(F.col("n") <= few_rows)
    left = few.select("band", F.col("head").alias("a"), F.col("part").alias("pa"))
    right = few.select("band", F.col("head").alias("b"), F.col("part").alias("pb"))
    more = left.join(right, "band").where("pa < pb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    links = links.union(merged(_links(more, sets, percent)))
    many = rest.where(F.col("n") > few_rows)
    if not many.isEmpty():
        heads_ = _open_rows(many.select("head", "part").distinct(), sets, percent)
        keys = _block_pairs(many.join(heads_, "head", "left_semi"), block)
        links = links.union(merged(_block_links(keys, sets, percent)))
    # copies get their component through their class; ids that stand in several classes join those
    classes = heads.where("members > 1").select(*key, "head")
    rows_ = spread_join(signed.select("id", *key), classes, key, "id", "left").select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("head", "id")).alias("head"))
    own = rows_.where("id is not null and head is not null").select("id", "head").distinct()
    several = own.groupBy("id").agg(F.min("head").alias("low"), F.count("*").alias("n")).where("n > 1").select("id", "low")
    same = own.join(several, "id").where("head <> low").select(F.col("low").alias("a"), F.col("head").alias("b"))
    final = connected(links.union(same))
    out = spread_join(rows_, final.withColumnRenamed("node", "head"), ["head"], "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "head", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op2(spark, sf_dir: str) -> DataFrame:
    """Every document with its set size and near-duplicate component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
