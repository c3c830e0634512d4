"""Shared helpers: Arrow text buffers as numpy arrays, hashing of words, hold-out folds, checkpoints."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240611)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
#: Bytes that separate words: space and the controls 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and every byte beyond ASCII.
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Tasks over which the rows of one key are dealt, one for each bit of a long.
SPREAD = 64
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column, end to end, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of about `most` bytes of text; a longer row is a piece of its own."""
    _, at = packed(batch.column(batch.schema.get_field_index(column)))
    begin, rows = 0, len(at) - 1
    while begin < rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


_last_trim = 0.0


def give_back() -> None:
    """Hands memory that Arrow and the C library keep after it was freed back to the system: Python workers live on between tasks. At most once a second."""
    global _last_trim
    if time.monotonic() - _last_trim < 1:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass
    _last_trim = time.monotonic()


def trimmed(f):
    """A function of a task's batches that gives memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run


def trimmed_group(f):
    """The same for a function of a group, or of two."""

    def one(key, table):
        out = f(key, table)
        give_back()
        return out

    def two(key, left, right):
        out = f(key, left, right)
        give_back()
        return out

    return two if f.__code__.co_argcount == 3 else one


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        _powers[name] = have = np.cumprod(table, dtype=np.uint64)
        if size > 1 << 21:  # of one very long text: not kept
            _powers.pop(name)
    return have[:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit polynomial hashes of buf[starts:ends], equal for equal strings wherever they stand; starts ascend."""
    out = np.empty(len(starts), np.uint64)
    inverse = pow(int(BASE), -1, 2**64)
    lo = 0
    while lo < len(starts):
        first = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(starts, first + block, "left")))
        last = int(ends[lo:hi].max())
        n = last - first
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODE[buf[first:last]] * _power("up", int(BASE), n), out=sums[1:])
        s, e = starts[lo:hi] - first, ends[lo:hi] - first
        out[lo:hi] = mix((sums[e] - sums[s]) * _power("down", inverse, n + 1)[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def runs_of(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of True that cross no row's end."""
    n = len(inside)
    if not n:
        return (np.empty(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(at, starts, "right") - 1


def held_out(id_col, modulus: int, rest: int):
    """Whether crc32 of the id as text leaves `rest` when divided by `modulus`; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % modulus == rest, F.lit(False))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows cut off from what made them, in the folder of spark.checkpoint.dir, which all executors share."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def merged(df: DataFrame) -> DataFrame:
    """checkpointed rows of a shuffle in fewer files: one for sixteen of its partitions, and two for each core at least.

    A task writes its partitions one after another, so it needs no more memory. Every file costs the executor a few
    processes where Hadoop sets rights by a command, and each counts the executor's memory again while it starts.
    """
    spark = df.sparkSession
    return checkpointed(df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A session on one machine that names none gets a temporary one; a cluster does not."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SPREAD)).cast("int")


def salts_seen() -> Column:
    """A bit for each salt that a key's rows have."""
    return F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask")


def each_salt() -> Column:
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda k: F.getbit("mask", k) == 1)).alias("salt")


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """rows joined with a table that has one row for each `on`. Rows are salted by `by`, and a row of the table goes to
    each salt that its key has, so that a key with very many rows is dealt over SPREAD tasks."""
    salted = rows.withColumn("salt", salt(by))
    wanted = salted.groupBy(*on).agg(salts_seen()).join(table, on).withColumn("salt", each_salt()).drop("mask")
    return salted.join(wanted, [*on, "salt"], how).drop("salt")


def text_bytes(docs: DataFrame, column: str) -> int:
    """Bytes of text in all rows."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def lowest_hashes(rows: DataFrame, column: str, most: int) -> DataFrame:
    """The `most` rows whose ids hash lowest, or all. A share of the hashes is cut off first, so what is sorted stays near `most` rows."""
    n = rows.count()
    if n > most:
        share = min(1.0, 1.3 * most / n + 200 / n)
        rows = rows.where(F.pmod(F.xxhash64(column), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    order = F.pmod(F.xxhash64(column), F.lit(1 << 40))
    return rows.orderBy(order, column, *[c for c in rows.columns if c != column and dict(rows.dtypes)[c] != "array<float>"]).limit(most)


def parts_for(spark: SparkSession, total: int, each: int) -> int:
    """Partitions of about `each` bytes, and at least as many as the session's shuffles have when there is that much data."""
    return max(1, math.ceil(total / each))


def range_parts(rows: DataFrame, each: int = 2_000_000) -> int:
    """Ranges of about `each` rows, and at least as many as the session's shuffles have. Counts the rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def ranked(rows: DataFrame, *order: Column, rank: str = "rank") -> DataFrame:
    """The rows with their numbers 1, 2, 3 ... in an order over all of them.

    Rows are dealt in ranges of the order and sorted there; each is numbered within its range, and what comes before a range
    is the sum of the counts of earlier ones (one row a range). No task sees more than its range.
    """
    rows = checkpointed(rows)
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(done + 1, done + n + 1))], [*batch.schema.names, "_nth"])
            done += n

    ranges = rows.repartitionByRange(range_parts(rows), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = merged(ranges.mapInArrow(number, f"{kinds}, _part int, _nth long"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(rank, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")
