"""SentencePiece encoding, sampling and decoding over a lattice of a public vocabulary.

A text gets the model's leading blank and is cut before each run of spaces and around each line end; a word's lattice has
an edge for each vocabulary piece that stands there, and byte pieces where a character is in no piece. Long words (texts
without blanks) are cut further, where no piece crosses. The best
segmentation maximises the sum of the pieces' log-probabilities. A unigram model has these as scores. The scores of a
BPE model are ranks of frequency; their pieces get the probabilities of Zipf's law with an offset, 1 / (10 + rank), scaled
to a sum of 1: an estimate that belongs to the lattice, since such a model has none, and not its merges. Samples are a Gumbel top-k without replacement: the best perturbed segmentation is drawn from the lattice, the
subtrees that branch off from it get maxima that are conditioned to be lower, and the search expands the subtree with
the highest maximum next (perturbed A-star), until k distinct segmentations stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE_CODE, mix, packed, slices, span_hashes, trimmed

#: How much less likely a byte is than the least likely piece, in logarithms.
BYTE_STEP = 2.0


class Vocabulary:
    """Pieces of a SentencePiece model with log-probabilities, in hash tables of their prefixes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts, self.byte_id = [], np.full(256, -1, np.int32)
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_id[int(piece[3:5], 16)] = k
            texts.append(bytes([int(piece[3:5], 16)]) if model.is_byte(k) else b"" if model.is_control(k) or model.is_unknown(k) else piece.replace("▁", " ").encode())
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        score = np.array([model.get_score(k) for k in range(len(texts))])
        plain = np.array([bool(t) for t in texts])
        plain[self.byte_id] = False
        if (score[plain] == np.rint(score[plain])).all():  # ranks
            score = -np.log(10 - np.minimum(score, 0))
            score -= np.log(np.exp(score[plain]).sum())
        self.weights = np.where(plain, score, score[plain].min() - BYTE_STEP)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        table: dict[int, int] = {}
        is_byte = set(self.byte_id.tolist())
        for k, t in enumerate(texts):
            if t and k not in is_byte and (b" " not in t[1:] or not t.strip(b" ")):
                h = 0
                for b in t[:-1]:
                    h = (h * int(BASE) + int(BYTE_CODE[b])) % 2**64
                    table.setdefault(h, -1)
                table[(h * int(BASE) + int(BYTE_CODE[t[-1]])) % 2**64] = k
        size = 1 << max(4, (8 * len(table)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -2, np.int32)
        for h, k in table.items():
            at = int(self._slot(np.array([h], np.uint64))[0])
            while self.values[at] != -2:
                at = (at + 1) % size
            self.keys[at], self.values[at] = h, k

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(33)) ^ h) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 for a prefix only, -2 for neither."""
        at = self._slot(h)
        out = np.where(self.keys[at] == h, self.values[at], -3)
        out[self.values[at] == -2] = -2
        todo = np.flatnonzero(out == -3)
        while len(todo):
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
            slot = at[todo]
            hit, free = self.keys[slot] == h[todo], self.values[slot] == -2
            out[todo[hit & ~free]] = self.values[slot[hit & ~free]]
            out[todo[free]] = -2
            todo = todo[~hit & ~free]
        return out


def cut_words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins, ends and rows of the words: a word starts at a row's begin, at the first of some spaces, and at and after each line end."""
    n = len(buf)
    start = np.zeros(n + 1, bool)
    start[:n] = (buf == 32) | (buf == 10)
    start[1:n] &= (buf[1:] != 32) | (buf[:-1] != 32)
    start[1:][buf == 10] = True
    start[at] = True
    start[n] = False
    begins = np.flatnonzero(start)
    return begins, np.append(begins[1:], n) if len(begins) else begins, np.searchsorted(at, begins, "right") - 1


def cut_long(vocabulary: Vocabulary, buf: np.ndarray, at: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of more than `least` bytes are cut between characters that no piece crosses; others stay.

    Every segmentation of such a word has a border there, so the parts' lattices, one after another, are the word's own.
    """
    long = np.flatnonzero(ends - begins > least)
    if len(long):
        size = (ends - begins)[long]
        local = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place, stop = np.repeat(begins[long], size) + local, np.repeat(ends[long], size)
        reach, active, h, length = place + 1, np.arange(len(place)), np.zeros(len(place), np.uint64), 0
        while len(active):
            length += 1
            h = h * BASE + BYTE_CODE[buf[place[active] + length - 1]]
            k = vocabulary.find(h)
            hit = active[k >= 0]
            reach[hit] = place[hit] + length
            go = (k > -2) & (place[active] + length < stop[active])
            active, h = active[go], h[go]
        free = np.zeros(len(place), bool)
        free[1:] = np.maximum.accumulate(reach)[:-1] <= place[1:]
        begins = np.sort(np.concatenate([begins, place[free & (local > 0) & ((buf[place] & 0xC0) != 0x80)]]))
        ends = np.append(begins[1:], ends[-1])
    return begins, ends, np.searchsorted(at, begins, "right") - 1


def _narrow(x: np.ndarray) -> np.ndarray:
    """Small numbers as 16 bits, which sort by radix."""
    return x.astype(np.uint16) if len(x) and x.max() < 65_536 else x


class Lattice:
    """All segmentations of distinct words. Nodes are places between bytes; edges are sorted by the node where they end."""

    def __init__(self, vocabulary: Vocabulary, buf: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        size = ends - begins
        first = np.concatenate([[0], np.cumsum(size + 1)])
        self.head, self.tail = first[:-1], first[1:] - 1
        word = np.repeat(np.arange(len(size)), size)
        local = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        place, node = begins[word] + local, first[word] + local
        room = size[word] - local
        active, h = np.arange(len(word)), np.zeros(len(word), np.uint64)
        source, target, piece, step, reach = [], [], [], [], np.zeros(len(word), np.int64)
        char = (buf[place] & 0xC0) != 0x80
        char[local == 0] = True
        span = np.diff(np.append(np.flatnonzero(char), len(word)))
        width = np.zeros(len(word), np.int64)
        width[char] = span
        length = 0
        while len(active):
            length += 1
            h = h * BASE + BYTE_CODE[buf[place[active] + length - 1]]
            k = vocabulary.find(h)
            hit = np.flatnonzero(k >= 0)
            if len(hit):
                a = active[hit]
                source.append(node[a])
                target.append(node[a] + length)
                piece.append(k[hit])
                step.append(local[a])
                reach[a[width[a] == length]] = 1
            go = (k > -2) & (room[active] > length)
            active, h = active[go], h[go]
        # the bytes of characters that are no piece
        owner = np.maximum.accumulate(np.where(char, np.arange(len(word)), 0))
        lone = np.flatnonzero(reach[owner] == 0)
        source.append(node[lone])
        target.append(node[lone] + 1)
        piece.append(vocabulary.byte_id[buf[place[lone]]])
        step.append(local[lone])
        # longer pieces first: they are likelier, so walks find them first
        source, target, piece, step = (np.concatenate(x[::-1]) for x in (source, target, piece, step))
        weight = vocabulary.weights[piece]
        order = np.argsort(_narrow(step), kind="stable")
        bounds = np.searchsorted(step[order], np.arange(int(step.max()) + 2 if len(step) else 1))
        total = np.full(first[-1], -np.inf)
        total[self.head] = 0
        best, via = total.copy(), np.full(first[-1], -1, np.int64)
        froms, tos, weights = source[order], target[order], weight[order]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):  # edges from one place have different ends
            s, t, w = froms[lo:hi], tos[lo:hi], weights[lo:hi]
            total[t] = np.logaddexp(total[t], total[s] + w)
            score = best[s] + w
            better = np.flatnonzero(score > best[t])
            best[t[better]] = score[better]
            via[t[better]] = order[lo + better]
        by_end = np.argsort(_narrow(target), kind="stable")
        place_of = np.empty(len(by_end), np.int64)
        place_of[by_end] = np.arange(len(by_end))
        self.source, self.piece, end = source[by_end], piece[by_end], target[by_end]
        with np.errstate(invalid="ignore"):
            self.log = np.nan_to_num(total[self.source] + weight[by_end] - total[end], nan=-np.inf, neginf=-np.inf)
        self.via = np.where(via >= 0, place_of[via], -1)
        p = np.exp(self.log)
        run = np.cumsum(p)
        new = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.empty(0, np.int64)
        stop = np.append(new[1:], len(end)) - 1
        base = np.where(new > 0, run[new - 1], 0)
        count = stop - new + 1
        whole = 1 / np.maximum(run[stop] - base, 1e-300)
        share = run * np.repeat(whole, count) - np.repeat(base * whole, count)
        share[stop] = 1
        self.share = np.minimum(share, 1)
        self.first_in = np.full(first[-1] + 1, -1, np.int64)
        self.first_in[end[new]] = new
        self.count_in = np.zeros(first[-1] + 1, np.int64)
        self.count_in[end[new]] = count

    def pick(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge into each node, by its share of the paths there; u is uniform on (0, 1)."""
        e = self.first_in[nodes]
        todo = np.flatnonzero(self.share[e] < u)
        while len(todo):
            e[todo] += 1
            todo = todo[self.share[e[todo]] < u[todo]]
        return e

    def walk(self, words: np.ndarray, choose) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the ends of the words back to their begins: the edges chosen, the item and the step (from the end) of each."""
        at, live = self.tail[words], np.arange(len(words))
        live = live[at != self.head[words]]
        edges, items, steps, k = [], [], [], 0
        while len(live):
            e = choose(at[live], live, k)
            edges.append(e)
            items.append(live)
            steps.append(np.full(len(live), k))
            at[live] = self.source[e]
            live = live[at[live] != self.head[words[live]]]
            k += 1
        if not edges:
            return (np.empty(0, np.int64),) * 3
        return np.concatenate(edges), np.concatenate(items), np.concatenate(steps)

    def divert(self, words: np.ndarray, taken: np.ndarray, at: np.ndarray, uniform) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As walk: a segmentation of each word, drawn among all but the one whose edges (from the end) begin at taken[at]."""
        mass = np.exp(np.add.reduceat(np.append(self.log[taken], 0.0), at)) if len(at) else np.empty(0)
        node, live, scale, on = self.tail[words], np.arange(len(words)), np.ones(len(words)), np.ones(len(words), bool)
        edges, items, steps, k = [], [], [], 0
        while len(live):
            u, e = uniform(live, k), np.empty(len(live), np.int64)
            off = ~on[live]
            e[off] = self.pick(node[live[off]], u[off])
            held = live[~off]
            own = taken[at[held] + k]
            p, v = np.exp(self.log[own]), u[~off]
            last = self.source[own] == self.head[words[held]]
            stay = np.where(last, 0.0, np.clip((scale[held] * p - mass[held]) / np.maximum(scale[held] - mass[held], 1e-300), 0, 1))
            stay[self.count_in[node[held]] == 1] = 1.0
            keep = v < stay
            # among the other edges: their shares closed up over the gap of the one taken
            c = np.where(keep, 0.5, (v - stay) / np.maximum(1 - stay, 1e-300)) * (1 - p)
            c = np.where(c >= self.share[own] - p, np.minimum(c + p, 1.0), c)
            new = self.pick(node[held], c)
            begin, n = self.first_in[node[held]], self.count_in[node[held]]
            new = np.where(new == own, np.where(own + 1 < begin + n, own + 1, own - 1), new)
            e[~off] = np.where(keep, own, new)
            scale[held] *= p
            on[held] = keep
            edges.append(e)
            items.append(live)
            steps.append(np.full(len(live), k))
            node[live] = self.source[e]
            live = live[node[live] != self.head[words[live]]]
            k += 1
        if not edges:
            return (np.empty(0, np.int64),) * 3
        return np.concatenate(edges), np.concatenate(items), np.concatenate(steps)

    def without(self, word: int, taken: list[tuple[int, ...]], uniform) -> tuple[int, ...] | None:
        """One segmentation of a word (edges from the end), drawn among those that are not taken; None if there is no other."""
        mass = [float(np.exp(sum(self.log[e] for e in t))) for t in taken]
        at, path, scale = int(self.tail[word]), (), 1.0
        while at != self.head[word]:
            lo = int(self.first_in[at])
            options, chances = range(lo, lo + int(self.count_in[at])), []
            for e in options:
                gone = sum(m for t, m in zip(taken, mass, strict=True) if t[: len(path) + 1] == (*path, e))
                only = any(t == (*path, e) for t in taken) and self.source[e] == self.head[word]
                left = scale * float(np.exp(self.log[e])) - gone
                chances.append(0.0 if only or left < 1e-14 * scale else left)
            whole = sum(chances)
            if whole <= 0:
                return None
            pick, u = 0, uniform(len(path)) * whole
            while pick < len(chances) - 1 and (u >= chances[pick] or chances[pick] == 0):
                u -= chances[pick]
                pick += 1
            while chances[pick] == 0:
                pick -= 1
            e = options[pick]
            scale *= float(np.exp(self.log[e]))
            path = (*path, e)
            at = int(self.source[e])
        return path


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _seeds(*keys) -> np.ndarray:
    """One hash for each element of the keys, which broadcast."""
    x = np.array([0x1234567], np.uint64)
    for k in keys:
        x = mix(x + np.atleast_1d(k).astype(np.uint64) * _STEP + np.uint64(1))
    return x


def _uniform(seeds: np.ndarray, n) -> np.ndarray:
    """The n-th uniform numbers on (0, 1) of the seeds."""
    return ((mix(seeds + np.asarray(n).astype(np.uint64) * _STEP) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _uniform_of(seed: int, n: int) -> float:
    """The same for one seed, without arrays."""
    x = (seed + n * int(_STEP)) % 2**64
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) % 2**64
    return (((x ^ (x >> 31)) >> 12) + 0.5) / 2.0**52


class _Path:
    """One segmentation of each row: for each word its edges (from the end), as offsets into a flat array, and log share."""

    def __init__(self, lattice: Lattice, words: np.ndarray, edges: np.ndarray, items: np.ndarray, steps: np.ndarray):
        self.count = np.bincount(items, minlength=len(words))
        self.offset = np.concatenate([[0], np.cumsum(self.count)])
        self.edges = np.empty(len(edges), np.int64)
        self.edges[self.offset[items] + steps] = edges
        self.log = np.bincount(items, weights=lattice.log[edges], minlength=len(words))


def _ids(lattice: Lattice, path: _Path, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids in reading order, and the offsets of the rows."""
    n = len(path.count)
    word = np.repeat(np.arange(n), path.count)
    back = path.offset[word + 1] - 1 - (np.arange(len(word)) - path.offset[word])
    return lattice.piece[path.edges[back]], path.offset[first]


def _below(phi: np.ndarray, limit: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at phi, conditioned to be below the limit."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        g = phi - np.log(-np.log(u))
        return np.where(np.isneginf(phi), -np.inf, limit - np.log1p(np.exp(limit - g)))


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", k: int = 2, seed: int = 0, prefix: bool = True) -> DataFrame:
    """(id, ids, samples) for each row: the best segmentation and up to k distinct sampled ones, in descending perturbed order.

    A sample has ids, logp (its log-probability among all segmentations), perturbed (its Gumbel value) and inclusion
    (1 - exp(-exp(logp - threshold)), where the threshold is the next perturbed value; 1 if there is none).
    Random numbers come from the hash of the id as text and places in the row, so a row's samples do not depend on
    partitions. Null texts have null ids and no samples, empty texts have no ids and one empty sample. Rows that repeat an
    id and its text repeat its samples; a null id is as good as any. An empty table gives none; extra columns are left out.
    With `prefix` a text that is not empty gets a blank before it, as models of this kind are fed; `decode` drops it.
    """
    kind = dict(docs.dtypes)[id_col]
    sample_type = pa.struct([("ids", pa.list_(pa.int32())), ("logp", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 200_000):
                buf, at = packed(part.column(1))
                n = len(at) - 1
                begins, ends, row = cut_words(buf, at)
                begins, ends, row = cut_long(vocabulary, buf, at, begins, ends)
                first = np.searchsorted(row, np.arange(n + 1))
                h = span_hashes(buf, begins, ends)
                _, lead, word = np.unique(h, return_index=True, return_inverse=True)
                lattice = Lattice(vocabulary, buf, begins[lead], ends[lead])
                key = part.column(2).to_numpy().view(np.uint64)
                owner, index = key[row], np.arange(len(row)) - first[row]
                # the best segmentation, once for each distinct word
                edges, items, steps = lattice.walk(np.arange(len(lead)), lambda node, *_: lattice.via[node])
                best = _Path(lattice, lead, edges, items, steps)
                source = np.repeat(best.offset[word] - np.concatenate([[0], np.cumsum(best.count[word])[:-1]]) if len(word) else best.offset[:0], best.count[word])
                whole = _Path.__new__(_Path)
                whole.count, whole.edges = best.count[word], best.edges[source + np.arange(len(source))]
                whole.offset = np.concatenate([[0], np.cumsum(whole.count)])
                ids, cut = _ids(lattice, whole, first)
                found = _search(lattice, word, row, first, owner, index, key, n, k, seed)
                null = part.column(1).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column(0), _list(ids, cut, null), _samples(found, null, sample_type)], ["id", "ids", "samples"])

    text = F.when(F.octet_length(text_col) > 0, F.concat(F.lit(" "), text_col)).otherwise(F.col(text_col)) if prefix else F.col(text_col)
    few = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string") if not kind.startswith("struct") else F.to_json(id_col)).alias("key"))
    return few.mapInArrow(trimmed(run), f"id {kind}, ids array<int>, samples array<struct<ids: array<int>, logp: double, perturbed: double, inclusion: double>>").withColumnRenamed("id", id_col)


def _list(values: np.ndarray, cut: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values.astype(np.int32)), mask=pa.array(null))


def _samples(found: list, null: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows' samples: those of all paths, put into the order of rows."""
    n = len(null)
    there = np.stack([~null & np.isfinite(f[2]) for f in found], 1)
    ids = [f[0] for f in found]
    cuts = [f[1] for f in found]
    r, j = np.nonzero(there)
    flat = pa.concat_arrays([_list(v, c, np.zeros(n, bool)) for v, c in zip(ids, cuts, strict=True)])
    lists = flat.take(pa.array(j * n + r))
    value = [np.stack([f[c] for f in found], 1)[r, j] for c in (3, 2, 4)]
    struct = pa.StructArray.from_arrays([lists, *map(pa.array, value)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)), struct)


def _search(lattice, word, row, first, owner, index, key, n, k, seed) -> list:
    """For each of k rounds: ids, offsets of rows, perturbed value, log-probability and inclusion of each row."""
    blank = np.diff(first) == 0

    seeds = _seeds(owner, index, seed)

    def draw(items: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = seeds[items]
        return lattice.walk(word[items], lambda node, live, step: lattice.pick(node, _uniform(own[live], (turn << 32) + step)))

    def top(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, where = np.full(n, -np.inf), np.zeros(n, np.int64)
        some = np.flatnonzero(~blank)
        if len(some):
            best[some] = np.maximum.reduceat(values, first[some])
            match = np.flatnonzero(values == best[row])
            where[row[match[::-1]]] = match[::-1]
        return best, where

    def siblings(path: _Path, begin: np.ndarray, limit: np.ndarray, turn: int) -> np.ndarray:
        run = np.cumsum(path.log) - path.log
        before = run - (run[np.minimum(first[:-1], max(0, len(run) - 1))][row] if len(run) else 0)
        with np.errstate(divide="ignore"):
            rest = np.log(np.maximum(-np.expm1(np.minimum(path.log, 0)), 0))
        rest[path.log > -1e-13] = -np.inf
        phi = np.where(np.arange(len(row)) >= begin[row], before + rest, -np.inf)
        return _below(phi, limit[row], _uniform(seeds, (turn << 32) + (1 << 28)))

    g0 = -np.log(-np.log(_uniform(_seeds(key, seed), 1 << 29)))
    every = np.arange(len(word))
    paths = [_Path(lattice, word, *draw(every, 0))]
    values = [g0]
    front = [siblings(paths[0], first[:-1], g0, 0)]
    taken: dict[tuple[int, int], list[tuple[int, ...]]] = {}
    for turn in range(1, k + 1):
        tops = [top(f) for f in front]
        which = np.argmax(np.stack([t[0] for t in tops]), 0)
        value = np.stack([t[0] for t in tops])[which, np.arange(n)]
        values.append(value)
        if turn == k:
            break
        spot = np.stack([t[1] for t in tops])[which, np.arange(n)]
        live = np.flatnonzero(np.isfinite(value))
        # prefix of the parent, another segmentation of the word at the spot, fresh draws after it
        parent = np.zeros(len(word), np.int64)
        state = np.full(len(word), -1)  # 0 before the spot, 1 at it, 2 after it
        alive = np.isfinite(value)[row]
        state[alive] = np.sign(np.arange(len(word)) - spot[row])[alive] + 1
        parent[alive] = which[row][alive]
        parts = []
        again = [r for r in live if (int(which[r]), int(spot[r])) in taken] if taken else []
        once = np.setdiff1d(live, again)
        for p in range(len(paths)):  # the first departure from a word's segmentation
            mine = once[which[once] == p]
            if not len(mine):
                continue
            t, path = spot[mine], paths[p]
            size = path.count[t]
            begin = np.cumsum(size) - size
            old = path.edges[np.repeat(path.offset[t] - begin, size) + np.arange(size.sum())]
            edges, items, steps = lattice.divert(word[t], old, begin, lambda some, k, t=t: _uniform(seeds[t[some]], (turn << 32) + (1 << 30) + k))
            parts.append((edges, t[items], steps))
            mass = 1 - np.exp(path.log[t]) - np.exp(np.bincount(items, weights=lattice.log[edges], minlength=len(t)))
            run = np.concatenate([[0], np.cumsum(path.log)])
            with np.errstate(divide="ignore", invalid="ignore"):
                phi = np.where(mass > 1e-13, run[t] - run[first[mine]] + np.log(mass), -np.inf)
            front[p][t] = _below(phi, value[mine], _uniform(seeds[t], (turn << 32) + (1 << 31)))
            if turn + 1 < k:
                order = np.lexsort((steps, items))
                cut = np.searchsorted(items[order], np.arange(len(t) + 1))
                for j in range(len(t)):
                    taken[p, int(t[j])] = [tuple(old[begin[j] : begin[j] + size[j]]), tuple(edges[order[cut[j] : cut[j + 1]]])]
        other: dict[int, tuple[int, ...]] = {}
        for r in again:
            t, p = int(spot[r]), int(which[r])
            done = taken[p, t]
            got = lattice.without(int(word[t]), done, lambda step, t=t: _uniform_of(int(seeds[t]), (turn << 32) + (1 << 30) + step))
            if got is None:  # rounding: nothing is left there
                state[first[r] : first[r + 1]] = -1
                front[p][t] = -np.inf
                value[r] = -np.inf
                continue
            done.append(got)
            other[t] = got
            mass = 1 - sum(float(np.exp(lattice.log[list(x)].sum())) for x in done)
            prefix = paths[p].log[first[r] : t].sum()
            front[p][t] = float(_below(np.array([prefix + np.log(mass) if mass > 1e-13 else -np.inf]), value[r : r + 1], _uniform(seeds[t : t + 1], (turn << 32) + (1 << 31)))[0])
        fresh = np.flatnonzero(state == 2)
        edges, items, steps = draw(fresh, turn)
        parts.append((edges, fresh[items], steps))
        for p in range(len(paths)):
            keep = np.flatnonzero((state == 0) & (parent == p))
            c = paths[p].count[keep]
            step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            parts.append((paths[p].edges[np.repeat(paths[p].offset[keep], c) + step], np.repeat(keep, c), step))
        if other:
            at = [t for t in other if state[t] == 1]
            parts.append((np.array([e for t in at for e in other[t]], np.int64), np.repeat(np.array(at, np.int64), [len(other[t]) for t in at]), np.array([s for t in at for s in range(len(other[t]))], np.int64)))
        path = _Path(lattice, word, *(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)))
        paths.append(path)
        front.append(siblings(path, np.where(np.isfinite(value), spot + 1, len(word)), np.where(np.isfinite(value), value, 0), turn))
    out = []
    threshold = values[-1]
    for path, value in zip(paths, values, strict=False):
        ids, cut = _ids(lattice, path, first)
        run = np.concatenate([[0], np.cumsum(path.log)])
        logp = run[first[1:]] - run[first[:-1]]
        with np.errstate(over="ignore"):
            inclusion = np.where(np.isfinite(threshold), -np.expm1(-np.exp(logp - threshold)), 1.0)
        out.append((ids, cut, value, logp, inclusion))
    return out


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids", prefix: bool = True) -> DataFrame:
    """(id, text) for each row of ids; null ids give null text. With `prefix` a text goes without its first blank."""
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.nan_to_num(whole.column(1).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends, begin = np.cumsum(size), 0
            while begin < len(ends):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 250_000, "right")))
                yield _texts(whole.slice(begin, end - begin), size[begin:end])
                begin = end

    def _texts(batch: pa.RecordBatch, size: np.ndarray) -> pa.RecordBatch:
        lists = batch.column(1)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.cumsum(size)])
        width = vocabulary.lengths[ids]
        stop = np.concatenate([[0], np.cumsum(width)])
        text = vocabulary.bytes[np.repeat(vocabulary.begins[ids] - stop[:-1], width) + np.arange(stop[-1])]
        rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(stop[cut].astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())])
        rows = pa.compute.if_else(lists.is_null(), pa.scalar(None, pa.large_binary()), rows).cast(pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), rows], ["id", "bytes"])

    back = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(trimmed(run), f"id {kind}, bytes binary")
    text = F.col("bytes").cast("string")
    return back.select(F.col("id").alias(id_col), (F.when(text.startswith(" "), F.substr(text, F.lit(2))).otherwise(text) if prefix else text).alias("text"))


#: The public 32,000-piece BPE model with byte fallback.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def default_vocabulary(path: str = MODEL) -> Vocabulary:
    return Vocabulary(path)


def op4(spark, sf_dir: str) -> DataFrame:
    """Every document: token count and digest of its best encoding, whether it decodes to the text, and two samples' digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    vocabulary = default_vocabulary()
    keyed = docs.select("doc_id", F.struct("doc_id", F.xxhash64("text").alias("was")).alias("key"), "text")
    done = encode(keyed.drop("doc_id").withColumn("doc_id", F.col("key")).drop("key"), vocabulary, "doc_id", "text")
    slim = done.select(F.struct("doc_id.doc_id", "doc_id.was", F.size("ids").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.transform("samples", lambda s: F.struct(F.size(s["ids"]).alias("n_tokens"), F.xxhash64(s["ids"]).alias("ids_hash"), s["logp"].alias("logp"), s["perturbed"].alias("perturbed"), s["inclusion"].alias("inclusion"))).alias("samples")).alias("k"), "ids")
    back = decode(slim, vocabulary, "k", "ids")
    return back.select("k.doc_id", "k.n_tokens", "k.ids_hash", (F.xxhash64("text") == F.col("k.was")).alias("round_trip"), "k.samples")
