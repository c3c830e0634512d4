"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

A string of `least` bytes is found by the anchor inside it: of its `GRAM`-byte grams, the leftmost with the least hash.
Equal strings have equal anchors, so only suffixes that begin at anchors are indexed (a sparse suffix array, about one
suffix in twenty bytes), and only those whose gram occurs in two documents or more. They are dealt out by gram; each
group takes its suffixes in batches of ascending documents. A batch is sorted into a suffix array and scanned against
the levels of the family: its grams are searched in each level's order, and only the suffixes found there are compared.
Then it becomes a level itself; two levels of equal size merge into one, by one pass over both orders, so a group holds
a number of levels that grows with the logarithm of its batches, and a suffix is merged as many times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE_CODE, mix, packed, parts_for, span_hashes, text_bytes, trimmed_group

GRAM = 16
_BLOCK = 1 << 19
_POS = np.uint64((1 << 20) - 1)


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h, step = BYTE_CODE[buf], 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(int(BASE), step, 2**64)) + h[step:]
        step *= 2
    return mix(h)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for each i."""
    step, m = 1, x
    while 2 * step <= w:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[: len(m) - (w - step)], m[w - step :]) if w > step else m


def anchors(buf: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and gram hash of the anchors, and the first and last begin of the strings that each stands for."""
    n = len(buf)
    w = least - GRAM + 1
    out: list[tuple[np.ndarray, ...]] = []
    whole = np.zeros(n + 1, np.int32)  # +1 at the first begin of a string in a row, -1 after the last
    size = np.diff(at)
    long = size >= least
    np.add.at(whole, at[:-1][long], 1)
    np.add.at(whole, at[1:][long] - least + 1, -1)
    valid = np.cumsum(whole[:-1]) > 0
    for lo in range(0, n, _BLOCK):
        hi = min(lo + _BLOCK, n - least + 1)
        if hi <= lo:
            break
        ok = valid[lo:hi]
        if not ok.any():
            continue
        h = _gram_hashes(buf[lo : hi + least - 1])
        place = np.arange(len(h), dtype=np.uint64)
        low = (_sliding_min((h & ~_POS) | place, w) & _POS).astype(np.int64)
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])
        row_start = at[(at > lo) & (at < hi)] - lo
        new[row_start] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(low)) - 1
        good = ok[first]
        first, last = first[good], last[good]
        a = low[first]
        out.append((a + lo, h[a], first + lo, last + lo))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _context_keys(buf: np.ndarray, a: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """A hash of what an anchor stands for: the bytes of its strings and its place among them."""
    return mix(span_hashes(buf, first, last + least) + (a - first).astype(np.uint64) * np.uint64(0x9E37))


def _short(h: np.ndarray) -> np.ndarray:
    """40 bits of a gram's hash: what tells grams apart between parts. Grams that collide are only compared in vain."""
    return h >> np.uint64(24)


def _pack_grams(u: np.ndarray, n: np.ndarray) -> bytes:
    """Six bytes for each gram: its 40 bits, and how often it stands as an eighth of a power of two."""
    code = np.minimum(255, np.rint(8 * np.log2(n))).astype(np.uint64)
    return ((u << np.uint64(8)) | code).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack_grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    value = wide.view(np.uint64).ravel()
    return value >> np.uint64(8), 2.0 ** ((value & np.uint64(255)).astype(float) / 8)


def _grams_by_group(g: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams ordered by group, then value, how often each stands, and the offsets of the groups."""
    u, n = np.unique(g, return_counts=True)
    group = (u % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    return u[order], n[order], np.searchsorted(group[order], np.arange(groups + 1))


def _hashes_at(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hashes of places in any order."""
    order, out = np.argsort(starts), np.empty(len(starts), np.uint64)
    out[order] = span_hashes(buf, starts[order], ends[order])
    return out


def _part(table: pa.Table):
    """A part's texts in the order of ids: bytes, offsets, ids."""
    table = table.sort_by([("id", "ascending")])
    buf, at = packed(table.column("text"))
    return buf, at, table.column("id").combine_chunks().to_numpy()


def _row_of(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(at, places, "right") - 1


def _seen_in_two(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that stand in two different documents of this part."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    return np.unique(h[1:][(h[1:] == h[:-1]) & (doc[1:] != doc[:-1])])


class Level:
    """A suffix array over anchors, in the order of what stands right of them; with it what stands left, strings covered, document."""

    FIELDS = ("key", "gram", "left", "lo", "hi", "doc")

    def __init__(self, right, left, lo, hi, doc):
        key = right.astype(">u8").view(f"S{8 * right.shape[1]}").ravel()
        self.order = np.argsort(key, kind="stable")
        self.key, self.left, self.lo, self.hi, self.doc = (x[self.order] for x in (key, left, lo, hi, doc))
        self.gram = np.ascontiguousarray(self.key.view(np.uint8).reshape(len(key), key.itemsize)[:, :GRAM]).view(f"S{GRAM}").ravel()

    def __len__(self):
        return len(self.doc)

    @classmethod
    def of(cls, fields) -> Level:
        level = cls.__new__(cls)
        for name, value in zip(cls.FIELDS, fields, strict=True):
            setattr(level, name, value)
        return level

    @property
    def right(self) -> np.ndarray:
        return self.key.view(">u8").reshape(len(self), self.key.itemsize // 8).astype(np.uint64)

    @classmethod
    def merged(cls, a: Level, b: Level) -> Level:
        """Both levels in one order: each suffix of b is searched in a, nothing is sorted again."""
        place = np.searchsorted(a.key, b.key, "right") + np.arange(len(b))
        first = np.ones(len(a) + len(b), bool)
        first[place] = False

        def both(x, y):
            out = np.empty((len(first), *x.shape[1:]), x.dtype)
            out[place], out[first] = y, x
            return out

        return cls.of(both(getattr(a, k), getattr(b, k)) for k in cls.FIELDS)

    def near(self, grams: np.ndarray) -> Level:
        """The suffixes that begin with one of the grams, which are sorted and distinct."""
        lo, hi = np.searchsorted(self.gram, grams, "left"), np.searchsorted(self.gram, grams, "right")
        n = hi - lo
        some = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Level.of(getattr(self, k)[some] for k in self.FIELDS)


def _common_prefix(x: np.ndarray) -> np.ndarray:
    """Bytes in which each row of sorted big-endian words agrees with the one before (0 for the first)."""
    if len(x) < 2:
        return np.zeros(len(x), np.int64)
    raw = x.astype(">u8").view(np.uint8).reshape(len(x), -1)
    differ = raw[1:] != raw[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), raw.shape[1])
    return np.concatenate([[0], lcp])


def scan(parts: list[Level], doc: np.ndarray, least: int) -> np.ndarray:
    """For each suffix of the first part: a bit for each of its strings that also stands in an earlier document of any part.

    Bit i is the string that begins i bytes before the anchor. Two such strings are equal when the suffixes agree in
    least - i bytes and what stands before the anchors agrees in i bytes; both are ranges of a sorted order, so equal
    strings have equal pairs of range numbers.
    """
    right, left, lo, hi, docs = (np.concatenate([getattr(p, k) for p in parts]) for k in ("right", "left", "lo", "hi", "doc"))
    n, mine = len(docs), len(parts[0])
    by_right, by_left = np.lexsort(right.T[::-1]), np.lexsort(left.T[::-1])
    lcp_right, lcp_left = _common_prefix(right[by_right]), _common_prefix(left[by_left])
    rank_right, rank_left = np.empty(n, np.int64), np.empty(n, np.int64)
    rank_right[by_right] = np.arange(n)
    rank_left[by_left] = np.arange(n)
    found = np.zeros(mine, np.uint64)
    for i in range(least - GRAM + 1):
        some = np.flatnonzero((lo <= i) & (i <= hi))
        if len(some) < 2:
            continue
        range_right = np.cumsum(lcp_right < least - i)[rank_right[some]]
        key = range_right if not i else range_right * (n + 1) + np.cumsum(lcp_left < i)[rank_left[some]]
        order = np.argsort(key, kind="stable")
        k = key[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        earliest = np.minimum.reduceat(docs[some][order], start)
        low = np.empty(len(k), np.int64)
        low[order] = np.repeat(earliest, np.diff(np.append(start, len(k))))
        hit = some[(low < docs[some]) & (some < mine)]
        found[hit] |= np.uint64(1) << np.uint64(i)
    return found


class Family:
    """Levels of suffix arrays; adding a batch scans it against what all levels have of its grams, then merges levels of equal size."""

    def __init__(self, least: int):
        self.least, self.levels = least, []

    def add(self, batch: Level) -> np.ndarray:
        grams = np.unique(batch.gram)
        found = scan([batch, *(level.near(grams) for _, level in self.levels)], batch.doc, self.least)
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            batch, size = Level.merged(level, batch), 2 * size
        self.levels.append((size, batch))
        return found


def _words(raw: np.ndarray) -> np.ndarray:
    pad = -raw.shape[1] % 8
    wide = np.pad(raw, ((0, 0), (0, pad)))
    return np.ascontiguousarray(wide).view(">u8").astype(np.uint64)


def _around(buf: np.ndarray, a: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes right of the anchors, and left of them from the anchor on backwards; 0 beyond what the anchor stands for."""
    r, l_ = np.arange(least), np.arange(1, least - GRAM + 1)
    at_right = a[:, None] + r
    right = np.where(at_right < (last + least)[:, None], buf[np.minimum(at_right, len(buf) - 1)], 0).astype(np.uint8)
    at_left = a[:, None] - l_
    left = np.where(at_left >= first[:, None], buf[np.maximum(at_left, 0)], 0).astype(np.uint8)
    return right, left


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, part_bytes: int = 4_000_000, group_bytes: int = 16_000_000, batch: int = 65_536, hot: int = 65_536, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, text binary, kept binary, n_bytes, n_spans) for each row: `kept` lacks every byte that a string of `least`
    bytes covers which also begins in a document with a smaller id.

    Null texts count as empty, null ids as larger than all others; rows with one id are one document and do not remove
    each other's strings. Texts shorter than `least` stay whole. The columns named in `carry` come back beside their row;
    other extra columns are left out.
    `part_bytes` of text make a part, within which equal strings are told apart by document only, so a group of copies
    sends one suffix from each part; `group_bytes` of text stand for one group of grams. A part sends one row to each
    group that it has a gram of: at most one for each gram.
    The suffixes of a gram that stands `hot` times or more would all meet in one group. They go twice: the strings with
    the longer half right of the anchor are dealt out by the bytes of that half, those with the longer half left by that
    one; both are matched in suffix arrays like all others.
    """
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(True)
    small = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.col(id_col).cast("long").alias("own"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), row.alias("row"))
    total = text_bytes(docs, text_col)
    parts, groups = parts_for(docs.sparkSession, total, part_bytes), parts_for(docs.sparkSession, total, group_bytes)
    half = (least - GRAM) // 2  # strings that begin up to so many bytes before the anchor have their longer half right of it
    dealt = small.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

    def grams(key, table):
        buf, at, _ = _part(table)
        _, h, _, _ = anchors(buf, at, least)
        u, n, cut = _grams_by_group(_short(h), groups)
        some = np.flatnonzero(np.diff(cut))
        return pa.table({"grp": pa.array(some.astype(np.int32)), "part": pa.array([key[0].as_py()] * len(some), pa.int32()), "data": pa.array([_pack_grams(u[cut[g] : cut[g + 1]], n[cut[g] : cut[g + 1]]) for g in some], pa.binary())})

    def shared(key, table):
        pairs = [_unpack_grams(x) for x in table.column("data").to_pylist()]
        each = [x for x, _ in pairs]
        u, of, parts_with = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        times = np.bincount(of, weights=np.concatenate([n for _, n in pairs]), minlength=len(u))
        twice, often = (parts_with > 1)[of], (times >= hot)[of]
        ends = np.cumsum([len(x) for x in each])
        flags = [np.packbits(twice[e - len(x) : e]).tobytes() + np.packbits(often[e - len(x) : e]).tobytes() for x, e in zip(each, ends, strict=True)]
        return pa.table({"part": table.column("part"), "grp": table.column("grp"), "data": pa.array(flags, pa.binary())})

    def suffixes(key, texts, flags):
        buf, at, ids = _part(texts)
        a, h, first, last = anchors(buf, at, least)
        short = _short(h)
        u, _, cut = _grams_by_group(short, groups)
        mark, often = np.zeros(len(u), bool), np.zeros(len(u), bool)
        for g, data in zip(flags.column("grp").to_pylist(), flags.column("data").to_pylist(), strict=True):
            n, raw = cut[g + 1] - cut[g], np.frombuffer(data, np.uint8)
            mark[cut[g] : cut[g + 1]] = np.unpackbits(raw[: len(raw) // 2])[:n]
            often[cut[g] : cut[g + 1]] = np.unpackbits(raw[len(raw) // 2 :])[:n]
        doc = ids[_row_of(at, a)]
        take = np.flatnonzero(np.isin(short, np.union1d(u[mark], _seen_in_two(short, doc))))
        keys = _context_keys(buf, a[take], first[take], last[take], least)
        order = np.lexsort((doc[take], keys))
        lead = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(order) else np.empty(0, bool)
        take, keys = take[order][lead], keys[order][lead]
        low, high, deal = a[take] - last[take], a[take] - first[take], short[take]
        is_hot = np.isin(deal, u[often])
        right_of, left_of = np.flatnonzero(is_hot & (low <= half)), np.flatnonzero(is_hot & (high > half))
        both = np.concatenate([np.flatnonzero(~is_hot), right_of, left_of])
        if len(right_of) + len(left_of):
            r, l_ = a[take[right_of]], a[take[left_of]]
            deal = np.concatenate([deal[~is_hot], _hashes_at(buf, r, r + least - half), _hashes_at(buf, l_ - half - 1, l_ + GRAM)])
            low, high = low[both], high[both]
            n_plain = len(both) - len(right_of) - len(left_of)
            high[n_plain : n_plain + len(right_of)] = np.minimum(high[n_plain : n_plain + len(right_of)], half)
            low[n_plain + len(right_of) :] = np.maximum(low[n_plain + len(right_of) :], half + 1)
        take, keys = take[both], keys[both]
        grp = (deal % np.uint64(groups)).astype(np.int64)
        order = np.argsort(grp, kind="stable")
        take, keys, grp, low, high = take[order], keys[order], grp[order], low[order], high[order]
        begin = np.searchsorted(grp, np.arange(groups + 1))
        rows: list[tuple[int, bytes, int]] = []
        for g in np.flatnonzero(np.diff(begin)):
            own = slice(begin[g], begin[g + 1])
            t = take[own]
            right, left = _around(buf, a[t], first[t], last[t], least)
            bounds = np.stack([low[own], high[own]], 1).astype(np.uint8)
            packed_rows = np.concatenate([keys[own].view(np.uint8).reshape(-1, 8), doc[t].astype(np.int64).view(np.uint8).reshape(-1, 8), bounds, right, left], 1)
            rows.append((int(g), pa.compress(np.ascontiguousarray(packed_rows.T).tobytes(), codec="zstd", asbytes=True), len(t)))
        return pa.table({"grp": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([key[0].as_py()] * len(rows), pa.int32()), "n": pa.array([r[2] for r in rows], pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})

    width = 8 + 8 + 2 + least + least - GRAM

    def matched(key, table):
        raws, sizes = [], table.column("n").to_pylist()
        for x, n in zip(table.column("data").to_pylist(), sizes, strict=True):
            raws.append(np.frombuffer(pa.decompress(x, n * width, codec="zstd"), np.uint8).reshape(width, n).T)
        raw = np.concatenate(raws)
        keys = np.ascontiguousarray(raw[:, :8]).view(np.uint64).ravel()
        doc = np.ascontiguousarray(raw[:, 8:16]).view(np.int64).ravel()
        order = np.argsort(doc, kind="stable")
        found, family = np.zeros(len(doc), np.uint64), Family(least)
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            right, left = _words(raw[rows, 18 : 18 + least]), _words(raw[rows, 18 + least :])
            new = Level(right, left, raw[rows, 16].astype(np.int64), raw[rows, 17].astype(np.int64), doc[rows])
            found[rows[new.order]] = family.add(new)
        out, begin = [], 0
        for n in sizes:  # rows stand part by part
            own = begin + np.flatnonzero(found[begin : begin + n])
            out.append(np.stack([keys[own], found[own]]).tobytes())
            begin += n
        return pa.table({"part": table.column("part"), "data": pa.array(out, pa.binary())})

    def removed(key, texts, marks):
        texts = texts.sort_by([("id", "ascending")])
        buf, at, ids = _part(texts)
        a, h, first, last = anchors(buf, at, least)
        doc = ids[_row_of(at, a)]
        keys = _context_keys(buf, a, first, last, least)
        cover = np.zeros(len(buf) + 1, np.int32)
        order = np.lexsort((doc, keys))
        k = keys[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
        lead = np.empty(len(k), np.int64)
        lead[order] = np.repeat(doc[order][start], np.diff(np.append(start, len(k)))) if len(k) else lead
        later = doc > lead
        np.add.at(cover, first[later], 1)
        np.add.at(cover, last[later] + least, -1)
        each = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in marks.column("data").to_pylist()]
        if each:
            known, bits = np.concatenate(each, 1)
            by = np.argsort(known, kind="stable")
            known, bits = known[by], bits[by]
            start = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]]))[: len(known)]
            known, bits = known[start], np.bitwise_or.reduceat(bits, start) if len(start) else bits
            where = np.searchsorted(known, keys)
            hit = np.flatnonzero(~later & (where < len(known)))
            hit = hit[known[where[hit]] == keys[hit]]
            word = bits[where[hit]]
            for i in range(least - GRAM + 1):
                x = hit[(word >> np.uint64(i)) & np.uint64(1) > 0]
                np.add.at(cover, a[x] - i, 1)
                np.add.at(cover, a[x] - i + least, -1)
        gone = np.cumsum(cover[:-1]) > 0
        kept, spans = [], []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            g = gone[lo:hi]
            kept.append(buf[lo:hi][~g].tobytes())
            spans.append(int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum()))
        return pa.table({"own": texts.column("own"), "row": texts.column("row"), "n_bytes": pa.array(np.diff(at)), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    by_part = dealt.groupBy("part")
    flags = by_part.applyInArrow(trimmed_group(grams), "grp int, part int, data binary").groupBy("grp").applyInArrow(trimmed_group(shared), "part int, grp int, data binary")
    sent = by_part.cogroup(flags.groupBy("part")).applyInArrow(trimmed_group(suffixes), "grp int, part int, n long, data binary")
    marks = sent.groupBy("grp").applyInArrow(trimmed_group(matched), "part int, data binary")
    out = by_part.cogroup(marks.groupBy("part")).applyInArrow(trimmed_group(removed), f"own long, row {dict(dealt.dtypes)['row']}, n_bytes long, n_spans long, kept binary")
    return out.select(F.col("own").alias(id_col), *[F.col(f"row.{c}").alias(c) for c in carry], "n_bytes", "n_spans", "kept")


def op1(spark, sf_dir: str) -> DataFrame:
    """Every document with how much of it earlier documents hold already, and a digest of what is left."""
    out = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
