"""Resampling towards a target text by hashed words and pairs: a head vocabulary with known CRC states, direct CRC for the tail."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, checkpointed, merged, packed, ranked, runs_of, slices, span_hashes

#: Bytes of words once A-Z are small: digits, a-z and all beyond ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
ONES = np.uint32(0xFFFFFFFF)
#: Words of more bytes than this go through zlib one by one.
SHORT = 32


def _crc_table() -> np.ndarray:
    """The CRC-32 register after one byte, from the reversed polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


def _shift_tables() -> np.ndarray:
    """[k, i, b]: what byte b at place i of a CRC becomes when k zero bytes follow; the shift is linear, so places add up by xor."""
    out = np.empty((SHORT + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32)[:, None] * 8)
    for k in range(SHORT):
        out[k + 1] = CRC[out[k] & 0xFF] ^ (out[k] >> 8)
    return out


SHIFT = _shift_tables()


def crc_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each buf[start:end], all words a byte at a time."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    s, n = starts[order], size[order]
    longer = int(np.searchsorted(-n, -SHORT, "left"))
    reg = np.full(len(s), ONES)
    for k in range(int(n[longer]) if longer < len(n) else 0):
        live = slice(longer, int(np.searchsorted(-n, -k, "left")))
        reg[live] = CRC[(reg[live] ^ buf[s[live] + k]) & 0xFF] ^ (reg[live] >> 8)
    out = np.empty(len(s), np.uint32)
    out[order] = reg ^ ONES
    for k in order[:longer]:
        out[k] = zlib.crc32(buf[starts[k] : ends[k]])
    return out


def crc_joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings end to end, from the CRC of each and the second's size, at most SHORT."""
    return SHIFT[size, 0, first & 0xFF] ^ SHIFT[size, 1, first >> 8 & 0xFF] ^ SHIFT[size, 2, first >> 16 & 0xFF] ^ SHIFT[size, 3, first >> 24] ^ second


def then_space(crc: np.ndarray) -> np.ndarray:
    """CRC-32 of the strings with a space behind them."""
    reg = crc ^ ONES
    return CRC[(reg ^ np.uint32(0x20)) & 0xFF] ^ (reg >> 8) ^ ONES


@dataclass(frozen=True)
class Head:
    """Frequent words (64-bit hashes in order, and their CRCs) and frequent pairs of them (by places in that order, and their buckets)."""

    words: np.ndarray
    crcs: np.ndarray
    pairs: np.ndarray
    buckets: np.ndarray


def _found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def words_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Small letters, starts, ends and rows of words, and which of them the next word of its row follows."""
    buf, at = packed(column)
    low = LOWER[buf]
    starts, ends, row = runs_of(IS_WORD[low], at)
    return low, starts, ends, row, np.flatnonzero(row[1:] == row[:-1])


def _pair_key(h: np.ndarray, lead: np.ndarray) -> np.ndarray:
    return h[lead] * np.uint64(0x9E3779B97F4A7C15) ^ (h[lead + 1] + np.uint64(0x632BE59BD9B4E019))


def features_of(column, head: Head, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each word and pair of neighbouring words, and the words of each row."""
    low, starts, ends, row, lead = words_of(column)
    n = np.bincount(row, minlength=len(column)) if len(row) else np.zeros(len(column), np.int64)
    if not len(row):
        return row, np.empty(0, np.int64), n
    known = _found(head.words, span_hashes(low, starts, ends))
    crc = head.crcs[known] if len(head.crcs) else np.empty(len(known), np.uint32)
    tail = np.flatnonzero(known < 0)
    crc[tail] = crc_of(low, starts[tail], ends[tail])
    single = (crc % np.uint32(buckets)).astype(np.int64)
    pair = np.full(len(lead), -1)
    both = np.flatnonzero((known[lead] >= 0) & (known[lead + 1] >= 0))
    place = _found(head.pairs, known[lead[both]] * len(head.words) + known[lead[both] + 1])
    pair[both] = np.where(place >= 0, head.buckets[place] if len(head.buckets) else -1, -1)
    rest = np.flatnonzero(pair < 0)
    a, b = lead[rest], lead[rest] + 1
    size = ends[b] - starts[b]
    value = crc_joined(then_space(crc[a]), crc[b], np.minimum(size, SHORT))
    for k in np.flatnonzero(size > SHORT):
        value[k] = zlib.crc32(low[starts[b[k]] : ends[b[k]]], int(then_space(crc[a[k : k + 1]])[0]))
    pair[rest] = value % np.uint32(buckets)
    return np.concatenate([row, row[lead]]), np.concatenate([single, pair]), n


def head_vocabulary(docs: DataFrame, text_col: str, buckets: int, most: int = 1 << 16, share: float = 2e-5) -> Head:
    """The commonest words and pairs, `most` of each at most, among those that make up `share` of a piece of text.

    All texts are counted. A word of that share of the corpus has it in some piece, so none is overlooked, and a piece of
    2 MB sends at most 1 / share words and pairs. What is not in the head only costs time: the results are the same.
    """
    kinds = "second boolean, key long, word string, next string, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                low, starts, ends, _, lead = words_of(part.column(0))
                if not len(starts):
                    continue
                h, out = span_hashes(low, starts, ends), []
                for second, keys, at in ((False, h, np.arange(len(h))), (True, _pair_key(h, lead), lead)):
                    found, first, n = np.unique(keys, return_index=True, return_counts=True)
                    often = np.flatnonzero(n >= max(2, share * len(h)))
                    text = [[bytes(low[starts[k + d] : ends[k + d]]).decode() for k in at[first[often]]] if d <= second else [None] * len(often) for d in (0, 1)]
                    out.append(([second] * len(often), found[often].astype(np.int64), *text, n[often]))
                cols = [pa.array(np.concatenate([x[k] for x in out])) if k in (1, 4) else pa.array([y for x in out for y in x[k]], t) for k, t in enumerate((pa.bool_(), None, pa.string(), pa.string(), None))]
                yield pa.RecordBatch.from_arrays(cols, ["second", "key", "word", "next", "n"])

    seen = docs.select(F.col(text_col).alias("text")).mapInArrow(count, kinds).groupBy("second", "key").agg(F.min("word").alias("word"), F.min("next").alias("next"), F.sum("n").alias("n"))
    # classes of about equal counts, the commonest first, as long as they fit: no task sends more than one row a class
    seen = merged(seen.withColumn("size", F.floor(8 * F.log2("n")).cast("int")))
    classes = seen.groupBy("second", "size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()
    top = {}
    for second in (False, True):
        sizes = [(r.size, r.n) for r in classes if r.second == second]
        fits = [size for (size, _), total in zip(sizes, itertools.accumulate(n for _, n in sizes), strict=True) if total <= most]
        top[second] = seen.where((F.col("second") == second) & (F.col("size") >= fits[-1])).select("word", "next").collect() if fits else []
    words = [r.word.encode() for r in top[False]]
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    buf = np.frombuffer(b"".join(words), np.uint8)
    h = span_hashes(buf, ends - [len(w) for w in words], ends) if words else np.empty(0, np.uint64)
    order = np.argsort(h)
    place = {words[k]: i for i, k in enumerate(order)}
    crcs = np.array([zlib.crc32(words[k]) for k in order], np.uint32)
    pairs = sorted((place[a] * len(words) + place[b], zlib.crc32(a + b" " + b) % buckets) for a, b in ((r.word.encode(), r.next.encode()) for r in top[True]) if a in place and b in place)
    return Head(h[order], crcs, np.array([k for k, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64))


def bucket_totals(texts: DataFrame, text_col: str, head: Head, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: one row of counts a task, added up by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(features_of(part.column(0), head, buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["n"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "n array<long>").select(F.posexplode("n")).groupBy("pos").agg(F.sum("col").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("pos").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(ratio of the smoothed shares)) of each bucket."""
    t, s = target.astype(float), source.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, head: Head, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean of the gains of a text's features."""
    kind = dict(docs.dtypes)[id_col]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, bucket, words = features_of(part.column(1), head, len(gain))
                n = np.bincount(row, minlength=part.num_rows)
                total = np.bincount(row, weights=gain[bucket], minlength=part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1))], ["id", "n_words", "n_features", "weight"])

    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return few.mapInArrow(apply, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, most: int = 1 << 16) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): documents drawn without replacement, likelier the more they are like the target.

    weight is the floored mean log-ratio (in thousandths) of the target's and the documents' smoothed shares of the buckets of
    a text's words and neighbouring pairs; score adds Gumbel noise from a hash of seed and id. Of the texts of `least_words`
    words, the floor of `percent` in a hundred with the highest scores get ranks 1, 2, 3 ...; the others have a null rank.

    Null and empty texts have no features and the weight 0. Rows of one id have the same noise; a null id counts as an empty
    one, and comes first among equal scores. Repeated rows stay rows. An empty table gives no rows; an empty target only
    smooths. Extra columns are left out. `most` bounds the head vocabulary, the only thing that is sent to all tasks besides
    the buckets. Texts are read three times and never shuffled.
    """
    head = head_vocabulary(docs, text_col, buckets, most)
    gain = gains(bucket_totals(target, target_col, head, buckets), bucket_totals(docs, text_col, head, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = checkpointed(weigh(docs, gain, head, id_col, text_col).withColumn("score", F.col("weight") + noise))
    able = scored.where(F.col("n_words") >= least_words)
    n = percent * able.count() // 100
    placed = ranked(able, F.desc("score"), F.asc(id_col), F.asc("n_features"), F.asc("weight"))
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return drawn.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op13(spark, sf_dir: str) -> DataFrame:
    """Every document's weight and score against the benchmark's texts, and the rank of those drawn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")
