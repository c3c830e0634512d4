"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, fitted to document labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_ALNUM, LOWER, checkpointed, held_out, lowest_hashes, packed, runs_of, slices, span_hashes

IS_END = np.zeros(256, bool)
IS_END[[10, 33, 46, 63]] = True
BUCKETS = 1 << 20
#: Besides whole words, their beginnings of so many bytes count, so that inflected forms share what is learnt.
STEMS = (5, 6, 8)


def _tokens(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, row, sentence (numbered over all rows) of each word and stem; row and begin of each sentence that has words."""
    starts, ends, row = runs_of(IS_ALNUM[buf], at)
    if not len(starts):
        return (np.empty(0, np.int64),) * 5
    bucket = (span_hashes(LOWER[buf], starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    stops = np.concatenate([[0], np.cumsum(IS_END[buf], dtype=np.int64)])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(new) - 1
    low, parts = LOWER[buf], [(bucket, row, sentence)]
    for size in STEMS:
        longer = np.flatnonzero(ends - starts > size)
        h = span_hashes(low, starts[longer], starts[longer] + size) * np.uint64(2 * size + 1)
        parts.append(((h >> np.uint64(20)).astype(np.int64) % BUCKETS, row[longer], sentence[longer]))
    bucket, of, sentence = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(sentence, kind="stable")
    return bucket[order], of[order], sentence[order], row[new], starts[new]


def sentence_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bucket array<int>, sentence array<int>): a row's distinct hashed words in each of its sentences."""
    kind = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                buf, at = packed(part.column(1))
                bucket, row, sentence, *_ = _tokens(buf, at)
                first = np.searchsorted(row, np.arange(len(at)))
                b, s = [], []
                for lo, hi in zip(first[:-1], first[1:], strict=True):
                    pair = np.unique((sentence[lo:hi] - (sentence[lo] if hi > lo else 0)) * BUCKETS + bucket[lo:hi])
                    b.append((pair % BUCKETS).astype(np.int32))
                    s.append((pair // BUCKETS).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(b, pa.list_(pa.int32())), pa.array(s, pa.list_(pa.int32()))], ["id", "bucket", "sentence"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {kind}, bucket array<int>, sentence array<int>").withColumnRenamed("id", id_col)


class Words:
    """A weight for each word bucket and a bias; a sentence's logit is their sum."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias


def fit_noisy_or(buckets: list[np.ndarray], sentences: list[np.ndarray], y: np.ndarray, steps: int = 120, rate: float = 0.3, least: int = 4, l2: float = 2e-3) -> Words:
    """Adam on the likelihood of document labels under 1 - prod(1 - p(sentence)).

    Only words in at least `least` labelled documents get a weight; it starts from their damped log-odds.
    Without rows of both classes the model is a constant.
    """
    n, pos = len(y), float(y.sum())
    if not n or pos in (0.0, float(n)):
        return Words(np.zeros(BUCKETS, np.float32), 3.0 if pos else -9.0)
    prior = pos / n
    df, hits = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, label in zip(buckets, y, strict=True):
        own = np.unique(b)
        df[own] += 1
        hits[own] += label
    odds = np.log((hits + 8 * prior) / (df - hits + 8 * (1 - prior))) - np.log(prior / (1 - prior))
    keep = np.flatnonzero((df >= least) & (np.abs(odds) > 0.5))
    code = np.full(BUCKETS, -1, np.int32)
    code[keep] = np.arange(len(keep))
    used = [code[b] >= 0 for b in buckets]
    w_of = np.concatenate([code[b[u]] for b, u in zip(buckets, used, strict=True)])
    count = np.array([int(s[-1]) + 1 if len(s) else 0 for s in sentences])
    base = np.concatenate([[0], np.cumsum(count)])
    s_of = np.concatenate([s[u] + k for s, u, k in zip(sentences, used, base, strict=False)])
    sent_doc = np.repeat(np.arange(n), count)
    theta = np.append(np.where(np.abs(odds[keep]) > 1, odds[keep], 0), np.log(prior / 20))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = np.bincount(s_of, weights=theta[w_of], minlength=len(sent_doc)) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = np.bincount(sent_doc, weights=np.logaddexp(0, z), minlength=n)
        pull = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0)
        dz = pull[sent_doc] * p
        grad = np.append(np.bincount(w_of, weights=dz[s_of], minlength=len(keep)), dz.sum()) / n
        grad[:-1] += l2 * theta[:-1] / 50
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (1 - t / steps / 1.1) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
    weight = np.zeros(BUCKETS, np.float32)
    weight[keep] = theta[:-1]
    return Words(weight, float(theta[-1]))


def _each(lists: pa.ListArray) -> list[np.ndarray]:
    """The values of each list, without a copy."""
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 8_000, most_bytes: int = 64_000_000) -> Words:
    """The model of labelled documents: all, or those whose ids hash lowest, `most` of them and `most_bytes` of text at most (the first always). Both bound what the driver holds.

    The sample is chosen on ids and sizes before any text moves, so only its texts are shuffled to it. Null labels and ids,
    and labels without a document, teach nothing; a repeated id teaches with each of its rows.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("double").alias("y"))
    known = lowest_hashes(known, id_col, most)
    sizes = docs.select(F.col(id_col), F.octet_length(text_col).alias("bytes")).join(F.broadcast(known.select(id_col).distinct()), id_col).groupBy(id_col).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    order = Window.orderBy(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)), id_col)  # at most `most` rows
    some = sizes.withColumn("before", F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where((F.col("before") == 0) | (F.col("before") + F.col("bytes") <= most_bytes)).select(id_col)
    known = checkpointed(known.join(F.broadcast(some), id_col, "left_semi"))
    few = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(known), id_col)
    words = sentence_words(few.select(F.struct(id_col, "y").alias("key"), "text"), "key", "text")
    rows = words.select("key.y", "bucket", "sentence").toArrow()
    cut = {c: [x for chunk in rows.column(c).chunks for x in _each(chunk)] for c in ("bucket", "sentence")}
    return fit_noisy_or(cut["bucket"], cut["sentence"], rows.column("y").to_numpy())


def score_toxicity(docs: DataFrame, model: Words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_sentences, offending) for each row: the noisy-or of its sentences, and where sentences of 0.5 or more begin (in bytes).

    Texts without words, null and empty ones too, have the score 0. Whole texts count, whatever their length. Repeated
    rows and ids stay rows, an empty table gives none, extra columns are left out.
    """
    kind = dict(docs.dtypes)[id_col]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                buf, at = packed(part.column(1))
                n = len(at) - 1
                bucket, row, sentence, owner, begin = _tokens(buf, at)
                pair = np.unique(sentence * BUCKETS + bucket)
                z = np.bincount(pair // BUCKETS, weights=model.weight[pair % BUCKETS], minlength=len(owner)) + model.bias
                score = -np.expm1(-np.bincount(owner, weights=np.logaddexp(0, z), minlength=n)) if len(owner) else np.zeros(n)
                bad = np.flatnonzero(z >= 0) if len(owner) else np.empty(0, np.int64)
                cut = np.searchsorted(owner[bad], np.arange(n + 1)) if len(owner) else np.zeros(n + 1, int)
                where = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(begin[bad] - at[owner[bad]] if len(bad) else np.empty(0, np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(score, 0, 1).astype(float)), pa.array(np.bincount(owner, minlength=n).astype(np.int32)), where], ["id", "score", "n_sentences", "offending"])

    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return few.mapInArrow(apply, f"id {kind}, score double, n_sentences int, offending array<long>").withColumnRenamed("id", id_col)


def op9(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity score and offending sentences, fitted on labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 5, 0))
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")
