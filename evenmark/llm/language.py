"""Language ID by rank-order profiles: the out-of-place distance of a text's most frequent n-grams to each language's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, packed, slices, trimmed

#: A gram is one number: its order, then three letters of 18 bits each, 0 for what is no letter; no letter lies beyond.
LETTER_BITS = 18
ORDER_AT = 3 * LETTER_BITS
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """The lower-case letter of each code point below 2^18, 0 for what is no letter."""
    if not _letters:
        table = np.zeros(1 << LETTER_BITS, np.uint32)
        for k in range(1 << LETTER_BITS):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                table[k] = ord(low) if len(low) == 1 else k
        _letters.append(table)
    return _letters[0]


def letters(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-case letters of UTF-8 rows, 0 for other characters, and the offsets of the rows in characters."""
    lead = (buf & 0xC0) != 0x80
    begin = np.flatnonzero(lead)
    if len(begin) == len(buf):
        return letter_table()[buf], at
    first = buf[begin]
    wide = np.concatenate([buf, np.zeros(3, np.uint8)])
    point = first.astype(np.uint32)
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        some = np.flatnonzero((first >= low) & (first < (0xE0, 0xF0, 0x100)[size - 2]))
        value = point[some] & mask
        for k in range(1, size):
            value = (value << 6) | (wide[begin[some] + k] & np.uint32(0x3F))
        point[some] = value
    return np.where(point < 1 << LETTER_BITS, letter_table()[np.minimum(point, (1 << LETTER_BITS) - 1)], 0).astype(np.uint32), np.searchsorted(begin, at)


def row_grams(buf: np.ndarray, at: np.ndarray, apart: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, gram and count of the distinct grams of orders 1 to 3 of each row (not all blank), by row, then gram; of all rows together unless `apart`."""
    s, cut = letters(buf, at)
    n = len(s)
    held = np.flatnonzero(np.bincount(s, minlength=1)) if n else np.empty(0, np.int64)
    if not n or held[-1] == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    held = np.union1d([0], held)
    bits = max(1, int(len(held) - 1).bit_length())
    place = np.zeros(int(held[-1]) + 1, np.uint64)
    place[held] = np.arange(len(held))
    d = place[s]
    row = np.repeat(np.arange(len(cut) - 1, dtype=np.uint64), np.diff(cut))
    keys, top = [], 3 * bits + 2
    for order in (1, 2, 3):
        m = n - order + 1
        if m < 1:
            break
        code = d[:m].copy()
        for k in range(1, order):
            code = (code << np.uint64(bits)) | d[k : m + k]
        ok = (code != 0) & (row[:m] == row[order - 1 :])
        tag = code | np.uint64(order << (3 * bits))
        keys.append((tag | (row[:m] << np.uint64(top)) if apart else tag)[ok])
    key = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count, key = np.diff(np.append(new, len(key))), key[new]
    mask = np.uint64((1 << bits) - 1)
    gram = ((key >> np.uint64(3 * bits)) & np.uint64(3)).astype(np.int64) << ORDER_AT
    for k in range(3):
        gram |= held[((key >> np.uint64(k * bits)) & mask).astype(np.int64)].astype(np.int64) << (k * LETTER_BITS)
    return (key >> np.uint64(top)).astype(np.int64), gram, count


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language and gram, summed over the rows of a task."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for lang in set(langs):
            rows = batch.filter(pa.array(langs == lang))
            for part in slices(rows, "text", 400_000):
                buf, at = packed(part.column(0))
                _, gram, count = row_grams(buf, at, False)
                old, n = sums.get(lang, (gram[:0], count[:0]))
                every, of = np.unique(np.concatenate([old, gram]), return_inverse=True)
                sums[lang] = every, np.bincount(of, weights=np.concatenate([n, count]), minlength=len(every)).astype(np.int64)
    for lang, (gram, total) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(total)], ["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = 400) -> DataFrame:
    """Rows (lang, gram, rank): the `size` most frequent n-grams of each language over all given rows, ties by code.

    Counts are summed in each task before the shuffle, so that it carries at most one row per task, language and n-gram.
    Rows without text or language teach nothing; repeated rows count as often as they stand. An empty table has no profile.
    """
    few = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    n = few.mapInArrow(trimmed(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


def identify(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 300, carry_text: bool = False) -> DataFrame:
    """(id, lang_pred, score) for each row, and the text if `carry_text`; `und` with score 0 where the text is null or has no letter.

    A text's profile ranks its n-grams by count, then code; each of the `top` first adds its displacement in a language's
    profile, or `size` if the language lacks it. The least sum wins, ties by name. The score is how far the best is below
    the mean of the others: 0 no difference, 1 no displacement at all. Letters are characters in lower case, of any script;
    all else is a blank. Without profiles every row is `und`. Repeated rows and ids stay rows; extra columns are left out.
    The profiles are a few hundred rows a language, whatever the corpus; they travel with the task.
    """
    rows = profiles.collect()
    langs = sorted({r["lang"] for r in rows})
    known = np.array(sorted({r["gram"] for r in rows}), np.int64)
    size = max([r["rank"] for r in rows], default=0) + 1
    ranks = np.full((max(1, len(langs)), len(known) + 1), -1, np.int64)  # the last is no language's
    for r in rows:
        ranks[langs.index(r["lang"]), np.searchsorted(known, r["gram"])] = r["rank"]
    kind = dict(docs.dtypes)[id_col]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 400_000):
                n = part.num_rows
                row, gram, count = row_grams(*packed(part.column(1)))
                order = np.lexsort((-count, row))  # stable: ties stay by code
                row, gram = row[order], gram[order]
                place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row] if len(row) else row
                row, gram, place = row[place < top], gram[place < top], place[place < top]
                at = np.searchsorted(known, gram)
                at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != gram if len(known) else True)] = len(known)
                far = np.stack([np.bincount(row, weights=np.where(r[at] < 0, size, np.abs(r[at] - place)), minlength=n) for r in ranks], 1)
                pred, best = far.argmin(1), far.min(1)
                rest = (far.sum(1) - best) / max(1, len(langs) - 1)
                score = np.where(rest > 0, 1 - best / np.where(rest > 0, rest, 1), 0) if len(langs) > 1 else np.bincount(row, minlength=n) > 0
                ok = np.array(part.column(2).to_pylist(), bool) & bool(langs)
                names = [langs[k] if good else "und" for k, good in zip(pred, ok, strict=True)]
                out = [part.column(0), pa.array(names, pa.string()), pa.array(np.where(ok, np.clip(score, 0, 1), 0.0).astype(float))]
                yield pa.RecordBatch.from_arrays(out + [part.column(1)] * carry_text, ["id", "lang_pred", "score"] + ["text"] * carry_text)

    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("ok"))
    return few.mapInArrow(trimmed(predict), f"id {kind}, lang_pred string, score double{', text string' if carry_text else ''}").withColumnRenamed("id", id_col)


def op7(spark, sf_dir: str) -> DataFrame:
    """Every document with its predicted language; learnt from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = held_out(F.col("doc_id"), 3, 1)
    profiles = learn_profiles(docs.where(~fold))
    return identify(docs, profiles).select("doc_id", fold.alias("held_out"), "lang_pred", "score")
