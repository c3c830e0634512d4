"""Repeated lines: hashes in ranges with a secondary sort, first occurrences by streaming, keep bitmaps for each document."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, merged, range_parts, slices

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
#: What a row of the streaming pass is: a line that goes, one whose key crosses a range's end, or what a range knows of such a key.
GONE, OPEN, EDGE = 0, 1, 2


def line_keys(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(h1, h2, doc, version, n_lines, pos) for each line whose key has `least_chars` code points: the key's 128-bit hash, and where it stands.

    `version` is a hash of the whole text, which tells rows of one id apart. That two of n keys have one hash has a chance
    of n^2 / 2^129: one in 10^14 for 10^12 keys.
    """
    kind = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                digests, row, pos, count = [], [], [], []
                for k, text in enumerate(part.column(2).to_pylist()):
                    lines = (text or "").encode().split(b"\n")
                    for at, line in enumerate(lines):
                        if len(line) >= least_chars:
                            key = line.strip(BLANK).lower()
                            if (len(key) if key.isascii() else len(key.decode())) >= least_chars:
                                digests.append(hashlib.blake2b(key, digest_size=16).digest())
                                row.append(k)
                                pos.append(at)
                                count.append(len(lines))
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                of = pa.array(row, pa.int32())
                cols = [pa.array(h[:, 0]), pa.array(h[:, 1]), part.column(0).take(of), part.column(1).take(of), pa.array(count, pa.int32()), pa.array(pos, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["h1", "h2", "doc", "version", "n_lines", "pos"])

    few = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    return few.mapInArrow(cut, f"h1 long, h2 long, doc {kind}, version long, n_lines int, pos int")


def _differs(column, before) -> np.ndarray:
    """Whether each value differs from the one before it; nulls are equal to each other."""
    shifted = pa.concat_arrays([pa.array([before], column.type), column.slice(0, len(column) - 1)])
    same = pc.or_kleene(pc.and_(pc.is_null(column), pc.is_null(shifted)), pc.fill_null(pc.equal(column, shifted), False))
    return ~same.to_numpy(zero_copy_only=False)


class Stream:
    """One range of sorted lines, a batch at a time; of a key that is not decided yet, the lines of less than `least` documents are held."""

    def __init__(self, part: int, least: int, kind: pa.DataType):
        self.part, self.least, self.kind = part, least, kind
        self.key: tuple[int, int] | None = None
        self.leading = True  # the key of the range's first line may have begun in an earlier range
        self.first = self.last = None
        self.docs = 0
        self.held: list[tuple[pa.RecordBatch, np.ndarray]] = []

    def rows(self, kind: int, lines: pa.RecordBatch) -> pa.RecordBatch:
        n = lines.num_rows
        cols = [np.full(n, kind, np.int32), lines.column(0), lines.column(1), lines.column(2), pa.nulls(n, self.kind), *(lines.column(k) for k in (3, 4, 5)), np.full(n, self.part, np.int32), pa.nulls(n, pa.int64())]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], NAMES)

    def edge(self) -> pa.RecordBatch:
        cols = [pa.array([EDGE], pa.int32()), *(pa.array([x], pa.int64()) for x in self.key), *(pa.array([x], self.kind) for x in (self.first, self.last)), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([self.part], pa.int32()), pa.array([self.docs], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, NAMES)

    def ended(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """The current key has no more lines in this range."""
        if self.leading or last:
            yield self.edge()
            yield from (self.rows(OPEN, lines) for lines, _ in self.held)
        self.held, self.leading = [], False

    def take(self, lines: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not lines.num_rows:
            return
        h1, h2 = (lines.column(k).to_numpy() for k in (0, 1))
        fresh = np.ones(len(h1), bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        fresh[0] = (h1[0], h2[0]) != self.key
        begins, steps = np.flatnonzero(fresh), np.cumsum(fresh | _differs(lines.column(2), self.last))
        nth = steps + self.docs  # which of its key's documents a line is in
        if len(begins):
            nth[begins[0] :] = steps[begins[0] :] - np.repeat(steps[begins] - 1, np.diff(np.append(begins, len(h1))))
        ahead = int(begins[0]) if len(begins) else len(h1)  # lines of the key that was current
        if ahead:
            yield from self.more(lines.slice(0, ahead), nth[:ahead])
        if not len(begins):
            return
        leading = self.key is None and len(begins) == 1
        if self.key is None and len(begins) > 1:
            self.begin(lines.slice(0, int(begins[1])), nth[: begins[1]], leading=True)
            begins = begins[1:]
        if self.key is not None:
            yield from self.ended()
        low, high = int(begins[0]), int(begins[-1])  # keys that begin and end in this batch
        docs = np.repeat(nth[begins[1:] - 1], np.diff(begins))
        gone = low + np.flatnonzero((docs >= self.least) & (nth[low:high] > 1))
        if len(gone):
            yield self.rows(GONE, lines.take(pa.array(gone)))
        self.begin(lines.slice(high), nth[high:], leading)
        yield from self.settle()

    def begin(self, lines: pa.RecordBatch, n: np.ndarray, leading: bool) -> None:
        self.key = (int(lines.column(0)[0].as_py()), int(lines.column(1)[0].as_py()))
        self.first, self.last, self.docs, self.leading = lines.column(2)[0].as_py(), lines.column(2)[-1].as_py(), int(n[-1]), leading
        self.held = [(lines, n)]

    def more(self, lines: pa.RecordBatch, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.last, self.docs = lines.column(2)[-1].as_py(), int(n[-1])
        self.held.append((lines, n))
        yield from self.settle()

    def settle(self) -> Iterator[pa.RecordBatch]:
        """What is held goes out as soon as more lines cannot change it."""
        if self.leading:
            yield from (self.rows(OPEN, lines) for lines, _ in self.held)
        elif self.docs >= self.least:
            yield from (self.rows(GONE, lines.filter(pa.array(n > 1))) for lines, n in self.held)
        else:
            return
        self.held = []


NAMES = ["kind", "h1", "h2", "doc", "last", "version", "n_lines", "pos", "part", "docs"]


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int, least_docs: int) -> DataFrame:
    """(doc, version, n_lines, pos) of each line that goes.

    Hashes are dealt in ranges and sorted by document, the largest first, and position; a task streams its range, so it
    holds a batch and the lines of a few documents. Ranges are cut by document and position too, so a line that very many
    documents hold is the work of several tasks. A key at the end of a range is settled by the at most two rows that each
    range sends on its first and last key.
    """
    lines = checkpointed(line_keys(docs, id_col, text_col, least_chars))
    order = ["h1", "h2", F.desc_nulls_last("doc"), "version", "pos"]
    kind = dict(lines.dtypes)["doc"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            state = state or Stream(batch.column(6)[0].as_py(), least_docs, batch.schema.field("doc").type)
            yield from state.take(batch)
        if state and state.key is not None:
            yield from state.ended(last=True)

    ranges = lines.repartitionByRange(range_parts(lines), *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    found = merged(ranges.mapInArrow(stream, f"kind int, h1 long, h2 long, doc {kind}, last {kind}, version long, n_lines int, pos int, part int, docs long"))
    edges = found.where(F.col("kind") == EDGE)
    along = Window.partitionBy("h1", "h2").orderBy("part")
    again = (F.row_number().over(along) > 1) & F.lag("last").over(along).eqNullSafe(F.col("doc"))
    keys = edges.withColumn("again", again.cast("int")).groupBy("h1", "h2").agg(F.sum(F.col("docs") - F.col("again")).alias("docs"), F.min_by(F.struct("doc"), "part").alias("first"))
    keys = F.broadcast(keys.where(F.col("docs") >= least_docs).drop("docs"))  # at most two keys for each range
    crossing = found.where(F.col("kind") == OPEN).join(keys, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("first.doc")))
    columns = ["doc", "version", "n_lines", "pos"]
    return found.where(F.col("kind") == GONE).select(*columns).unionByName(crossing.select(*columns))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """(id, version, n_lines, n_dropped, keep binary) for each text that loses a line: a bit for each line, set if it stays, packed and deflated.

    A line's key is the line without blanks at its ends, in small letters (A-Z). Keys of `least_chars` code points or more
    in at least `least_docs` documents lose all their lines but those of the largest id that holds it. Texts without a row
    keep all lines. `version` is xxhash64 of the text. Null ids are one document, the smallest; rows of one id are one
    document, and equal rows share one bitmap. Null and empty texts are one empty line and keep it. An empty table gives
    no rows; extra columns are left out.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone = batch.column(2).to_numpy(), batch.column(3)
            flat, at = gone.flatten().to_numpy(), gone.offsets.to_numpy()
            flat, at = flat, at - at[0]
            maps, dropped = [], []
            for k in range(len(n)):
                keep = np.ones(n[k], bool)
                keep[flat[at[k] : at[k + 1]]] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
                dropped.append(int(n[k] - keep.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())], ["doc", "version", "n_lines", "n_dropped", "keep"])

    lines = repeated_lines(docs, id_col, text_col, least_chars, least_docs)
    kind = dict(docs.dtypes)[id_col]
    each = lines.groupBy("doc", "version").agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    return each.mapInArrow(pack, f"doc {kind}, version long, n_lines int, n_dropped int, keep binary").withColumnRenamed("doc", id_col)


def keep_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, text) for each row of docs: its lines by the bitmaps, joined by newlines; null texts count as empty."""
    kind = dict(docs.dtypes)[id_col]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, total, dropped = [], [], []
                for text, keep in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    text = text or ""
                    n = text.count("\n") + 1
                    gone = 0
                    if keep is not None:
                        stays = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n).astype(bool)
                        gone = int(n - stays.sum())
                        text = "\n".join(x for x, k in zip(text.split("\n"), stays, strict=True) if k)
                    texts.append(text)
                    total.append(n)
                    dropped.append(gone)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], ["id", "n_lines", "n_dropped", "text"])

    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("of"))
    maps = bitmaps.select(F.col(id_col).alias("whose"), "version", "keep")
    both = few.join(maps, F.col("id").eqNullSafe(F.col("whose")) & (F.col("of") == F.col("version")), "left").select("id", "text", "keep")
    return both.mapInArrow(apply, f"id {kind}, n_lines long, n_dropped long, text string").withColumnRenamed("id", id_col)


def op12(spark, sf_dir: str) -> DataFrame:
    """Every document's lines, how many went, and the digest of those that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return keep_lines(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
