"""Near-duplicate vectors by collision counting: sorted one-dimensional projections, query-centred windows, verified pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, each_salt, salt, salts_seen, spread_join
from .components import connected


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    """n random directions, each column with normally distributed entries."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def calibrate(threshold: float, projections: int, miss: float, width: float = 3.5) -> tuple[float, int]:
    """Half the width of a window (`width` standard deviations of a pair at the threshold), and the least count that such a pair fails with a chance of `miss` at most.

    Wide windows make that count nearly all projections, so a pair is given up after the first few that do not collide.
    """
    half, p = width * math.sqrt(2 - 2 * threshold), math.erf(width / math.sqrt(2))
    below, count = 0.0, 0
    while count < projections:
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            break
        count += 1
    return half, count


def rounds_for(rows: int, threshold: float, cell: int, miss: float) -> tuple[int, int]:
    """Bits of a cell, so that it holds about `cell` of evenly spread rows, and rounds, so that a pair shares no cell with a chance of `miss`."""
    bits = max(0, min(30, math.ceil(math.log2(max(1, rows / cell)))))
    together = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, 1 if together >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - together)))


def _unit(lists, dim: int) -> np.ndarray:
    v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def collisions(p: np.ndarray, q: np.ndarray, half: float, least: int, dense: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a row of p and one of q that at least `least` of the projections put into one window.

    A window is centred on the row of p; its rows of q lie between two places of q's sorted order. All pairs are counted
    on the first projections; those that can still reach the count go on, fewer with each further one.
    """
    n = p.shape[1]
    dense = min(dense, n)
    missed = np.zeros((len(p), len(q)), np.uint8)
    for k in range(dense):
        order = np.argsort(q[:, k])
        place = np.empty(len(q), np.uint16)
        place[order] = np.arange(len(q), dtype=np.uint16)
        line = q[order, k]
        begin = np.searchsorted(line, p[:, k] - half, "left").astype(np.uint16)
        width = np.searchsorted(line, p[:, k] + half, "right").astype(np.uint16) - begin
        missed += (place[None, :] - begin[:, None]) >= width[:, None]
    x, y = np.nonzero(missed <= n - least)
    count = missed[x, y]
    for k in range(dense, n):
        count = count + (np.abs(p[x, k] - q[y, k]) > half)
        go = np.flatnonzero(count <= n - least)
        x, y, count = x[go], y[go], count[go]
    return x, y


def linked_pairs(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of unit rows a[x], b[y] have a cosine of the threshold or more: one product if they are many, else one by one."""
    if 8 * len(x) > len(a) * len(b):
        return (a @ b.T)[x, y] >= threshold
    return np.einsum("ij,ij->i", a[x], b[y]) >= threshold


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, projections: int = 24, cell: int = 256, block: int = 8192, tile: int = 1024, miss: float = 5e-4) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: how many other vectors have a cosine of `threshold` or more with it.

    Equal vectors (by a hash of 128 bits) are one class with a size. Random hyperplanes deal the classes into cells, in
    several rounds, so that a linked pair shares a cell in one of them; in a cell the collisions over the sorted
    projections are counted, and pairs with the calibrated count are verified in double precision. A pair counts in its
    first common round only. Windows over all vectors at once would hold a fixed share of them, so that candidates grew
    with the square of the rows: hence the cells.
    A cell with more than `block` classes (fewer for vectors of more than 4 KB) is split and its blocks are compared two by
    two, each pair of blocks a group of its own, `tile` rows at a time; a vector moves once for each block of its cell.
    Null, zero and non-finite vectors, vectors with null components and rows without id link with nothing. Vectors of
    different lengths are not compared. Rows that repeat an id are vectors of their own: each has its own links, and the
    id does not link them. Extra columns are left out.
    """
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    good = F.col("v").isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(good, F.lit(False))).withColumn("h1", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit("again"), "v")))
    classes = checkpointed(rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("size"), F.first("v").alias("v")).withColumn("id", F.monotonically_increasing_id()))
    bits, rounds = rounds_for(classes.count(), threshold, cell, miss)
    half, least = calibrate(threshold, projections, miss / 5)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                side = _unit(part.column(0), int(dim)) @ directions(int(dim), bits * rounds, 1) > 0
                codes = side.reshape(len(side), rounds, bits) @ (1 << np.arange(bits)) if bits else np.zeros((len(side), rounds), np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(side) + 1, dtype=np.int32) * rounds), pa.array(codes.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(0), pa.array(np.full(len(side), dim, np.int32)), flat], ["id", "size", "v", "dim", "codes"])

    def compare(key, table):
        dim, cycle, i, j = key[0].as_py(), key[1].as_py(), key[3].as_py(), key[4].as_py()
        blk = table.column("blk").to_numpy()
        sides = [np.flatnonzero(blk == i), np.flatnonzero(blk == j)]
        unit = _unit(table.column("v").combine_chunks(), dim)
        ids, size = table.column("id").to_numpy(), table.column("size").to_numpy()
        codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        shadow = unit @ directions(dim, projections, 2)
        links, root = np.zeros(len(ids)), np.arange(len(ids))
        for lo in range(0, len(sides[0]), tile):
            for hi in range(lo if i == j else 0, len(sides[1]), tile):
                a, b = sides[0][lo : lo + tile], sides[1][hi : hi + tile]
                x, y = collisions(shadow[a], shadow[b], half, least)
                if i == j and lo == hi:
                    x, y = x[x < y], y[x < y]
                if cycle:
                    early = (codes[a[x], :cycle] == codes[b[y], :cycle]).any(1)
                    x, y = x[~early], y[~early]
                there = linked_pairs(unit[a], unit[b], x, y, threshold)
                x, y = a[x[there]], b[y[there]]
                links += np.bincount(x, weights=size[y], minlength=len(ids)) + np.bincount(y, weights=size[x], minlength=len(ids))
                while len(x):  # the smallest place that each row reaches
                    low = np.minimum(root[x], root[y])
                    open_ = np.flatnonzero(root[x] != root[y])
                    if not len(open_):
                        break
                    np.minimum.at(root, root[x[open_]], low[open_])
                    np.minimum.at(root, root[y[open_]], low[open_])
                    while (root[root] != root).any():
                        root = root[root]
        some = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[some]), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(ids[root[some]])})

    dealt = checkpointed(classes.select("v", "id", "size").mapInArrow(deal, f"id long, size long, v array<{kind}>, dim int, codes array<int>"))
    placed = dealt.select("id", F.posexplode("codes").alias("cycle", "cell"), "dim", salt("id").alias("salt"))
    rows_of = F.greatest(F.lit(min(block, 1024)), F.least(F.lit(block), F.floor(F.lit(block * 4096) / (8 * F.col("dim")))))
    cells = placed.groupBy("dim", "cycle", "cell").agg(F.count("*").alias("n"), salts_seen()).where("n > 1").select("dim", "cycle", "cell", F.ceil(F.col("n") / rows_of).cast("int").alias("blocks"), each_salt())
    keys = placed.join(cells, ["dim", "cycle", "cell", "salt"]).withColumn("blk", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    keys = keys.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "dim", "cycle", "cell", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
    full = keys.join(dealt.select("id", "size", "v", "codes"), "id")
    found = checkpointed(full.groupBy("dim", "cycle", "cell", "i", "j").applyInArrow(compare, "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = checkpointed(connected(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).join(classes.select(F.col("id").alias("node"), "least"), "node"))
    lowest = parts.groupBy("component").agg(F.min("least").alias("lowest"))
    parts = spread_join(parts, lowest, ["component"], "node").select(F.col("node").alias("id"), "lowest")
    per_class = classes.select("id", "h1", "h2", "least", "size").join(links, "id", "left").join(parts, "id", "left")
    per_class = per_class.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("lowest", "least").alias("component")).where("links > 0")
    out = spread_join(rows.select("id", "h1", "h2"), per_class, ["h1", "h2"], "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op3(spark, sf_dir: str) -> DataFrame:
    """Every vector with its direct links at a cosine of 0.95 and its component."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
