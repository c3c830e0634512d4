"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_ALNUM, IS_SPACE, LOWER, checkpointed, held_out, lowest_hashes, packed, runs_of, slices, span_hashes

CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": [32, *range(9, 14)], "line": [10],
    "high": range(128, 256), "bar": [124], "shout": [33, 63], "stop": [44, 46], "mark": [35, 36, 37, 38, 42, 94, 126, 64],
}
MASK = np.zeros((len(CLASSES), 256), bool)
for _k, _bytes in enumerate(CLASSES.values()):
    MASK[_k, list(_bytes)] = True
STATISTICS = [*(f"{name}_share" for name in CLASSES), "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "distinct_lines", "alnum_edge"]


def _statistics(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    n, size = len(at) - 1, np.diff(at).astype(float)
    some = np.maximum(size, 1)
    out = np.zeros((n, len(STATISTICS)))
    for k in range(len(CLASSES)):
        sums = np.concatenate([[0], np.cumsum(MASK[k][buf], dtype=np.int64)])
        out[:, k] = (sums[at[1:]] - sums[at[:-1]]) / some
    starts, ends, row = runs_of(~IS_SPACE[buf], at)
    words = np.bincount(row, minlength=n).astype(float)
    k = len(CLASSES)
    out[:, k], out[:, k + 1] = np.log1p(size), np.log1p(words)
    out[:, k + 2] = np.bincount(row, weights=ends - starts, minlength=n) / np.maximum(words, 1)
    for s, e, r, most in ((starts, ends, row, True), (*runs_of(buf != 10, at), False)):
        if not len(s):
            continue
        h = span_hashes(LOWER[buf], s, e)
        order = np.lexsort((h, r))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (r[order][1:] != r[order][:-1])
        first = np.flatnonzero(new)
        runs = np.diff(np.append(first, len(order)))
        total = np.maximum(np.bincount(r, minlength=n), 1)
        out[:, k + (3 if most else 5)] = np.bincount(r[order][first], minlength=n) / total
        if most:
            top = np.zeros(n)
            np.maximum.at(top, r[order][first], runs)
            out[:, k + 4] = top / total
    if len(starts):
        out[:, k + 6] = np.bincount(row, weights=IS_ALNUM[buf[ends - 1]], minlength=n) / np.maximum(words, 1)
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<float>): the statistics named in STATISTICS of each whole text; null and empty texts have zeros. Repeated rows and ids stay rows; extra columns are left out."""
    kind = dict(docs.dtypes)[id_col]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                x = _statistics(*packed(part.column(1))).astype(np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], ["id", "x"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(measure, f"id {kind}, x array<float>").withColumnRenamed("id", id_col)


class Trees:
    """Boosted trees of one depth, flattened: node k of a tree has the children 2k+1 and 2k+2."""

    def __init__(self, feature, threshold, leaf, base):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 48, rate: float = 0.15, l2: float = 1.0, least: int = 5) -> Trees:
    """Logistic loss, second-order gain, histograms over quantile bins. One class only, or no rows: a constant."""
    inner = 2**depth - 1
    p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    width, total = bins + 1, np.full(len(y), base)
    flat = code + np.arange(x.shape[1]) * width
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-total))
        g, h = y - q, q * (1 - q)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            begin, count = 2**level - 1, 2**level
            size = count * x.shape[1] * width
            key = ((node - begin) * x.shape[1] * width)[:, None] + flat
            sums = [np.bincount(key.ravel(), weights=np.repeat(w, x.shape[1]), minlength=size).reshape(count, x.shape[1], width) for w in (g, h, np.ones(len(y)))]
            (gl, hl, nl), (ga, ha, na) = ([s.cumsum(2) for s in sums], [s.sum(2, keepdims=True) for s in sums])
            gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
            gain[(nl < least) | (na - nl < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                j, b = divmod(int(best[k]), width)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[begin + k], threshold[begin + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = rate * np.bincount(node - inner, weights=g, minlength=inner + 1) / (np.bincount(node - inner, weights=h, minlength=inner + 1) + l2)
        total = total + leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)


def fit_quality(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most: int = 20_000) -> Trees:
    """Trees fitted on labelled rows: all of them, or the `most` whose ids hash lowest. `most` bounds what the driver holds. Null labels teach nothing."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("double").alias("y"))
    rows = stats.join(lowest_hashes(known, id_col, most), id_col).select("x", "y").toArrow()
    x = rows.column("x").combine_chunks()
    x = (x.flatten().to_numpy() if rows.num_rows else np.empty(0)).astype(np.float64).reshape(rows.num_rows, len(STATISTICS))
    order = np.lexsort(x.T)  # the rows' order is not fixed; trees fitted to them should be
    return fit_trees(x[order], rows.column("y").to_numpy()[order])


def score_quality(stats: DataFrame, model: Trees, id_col: str = "doc_id") -> DataFrame:
    """(id, score) for each row of statistics, those of null and empty texts as well. Repeated rows and ids stay rows, equal statistics have equal scores, an empty table gives none."""
    kind = dict(stats.dtypes)[id_col]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    return stats.select(F.col(id_col).alias("id"), "x").mapInArrow(apply, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op8(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score, fitted on labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 4, 2))
    stats = checkpointed(document_statistics(docs))
    scored = score_quality(stats, fit_quality(stats, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
