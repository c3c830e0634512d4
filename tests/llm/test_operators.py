"""Each operator against a brute-force version, a round trip or held-out labels, and on odd inputs."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from evenmark.llm import chat, components, decontaminate, embeddings, language, licenses, minhash, pieces, quality, registry, suffixes, toxicity
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find(pairs, {x for p in pairs for x in p})
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# --- suffix arrays


def spans_brute(rows, least=50):
    first, out = {}, []
    for i, t in sorted(((math.inf if i is None else i, t) for i, t in rows), key=lambda r: (r[0], r[1] or "")):
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            first.setdefault(b[p : p + least], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < (math.inf if i is None else i):
                gone[p : p + least] = b"\1" * least
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"part_bytes": 3_000, "group_bytes": 20_000, "batch": 64}, {"part_bytes": 3_000, "group_bytes": 20_000, "batch": 64, "hot": 3}])
def test_suffix_dedup(docs, sizes):
    few = docs
    out = suffixes.repeated_spans(few, **sizes)
    got = sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()), key=str)
    want = spans_brute([(r.doc_id, r.text) for r in few.collect()])
    assert got == sorted(((None if r[0] == math.inf else r[0], *r[1:]) for r in want), key=str)


@pytest.mark.parametrize("hot", [1, 20, 65_536])
def test_suffix_dedup_finds_spans_at_every_offset(spark, hot):
    rng = np.random.default_rng(3)
    text = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 4, n))
    shared = text(55)
    rows = [(k, text(int(rng.integers(0, 80))) + shared[: 48 + k % 8] + text(int(rng.integers(0, 80)))) for k in range(60)]
    out = suffixes.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), part_bytes=1_500, group_bytes=4_000, batch=128, hot=hot)
    got = sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()), key=str)
    assert got == spans_brute(rows)


def test_family_merges_geometrically():
    f = suffixes.Family(50)
    rng = np.random.default_rng(0)
    for k in range(11):
        n = 4
        f.add(suffixes.Level(rng.integers(0, 99, (n, 7), dtype=np.uint64), rng.integers(0, 99, (n, 5), dtype=np.uint64), np.zeros(n, int), np.zeros(n, int), np.full(n, k)))
    assert [s for s, _ in f.levels] == [8, 2, 1] and sum(len(x) for _, x in f.levels) == 44
    assert all((level.key[1:] >= level.key[:-1]).all() for _, level in f.levels)


def test_later_batches_cost_no_more():
    """The suffixes that a batch is compared with do not grow with the levels, if grams do not repeat."""
    f, n, seen = suffixes.Family(50), 500, []
    rng = np.random.default_rng(4)
    whole = suffixes.scan

    def counted(parts, doc, least):
        seen.append(sum(map(len, parts)))
        return whole(parts, doc, least)

    suffixes.scan = counted
    try:
        for k in range(16):
            right = rng.integers(0, 2**63, (n, 7), dtype=np.uint64)
            right[:50] = right[0] if k == 0 else copied
            copied = right[:50].copy()
            f.add(suffixes.Level(right, np.zeros((n, 5), np.uint64), np.zeros(n, int), np.zeros(n, int), np.full(n, k)))
    finally:
        suffixes.scan = whole
    assert seen[0] == n and seen[-1] <= n + 16 * 50


# --- min-max hashing


def shingles(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    pairs = [(a, b) for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None], 2) if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return sets, union_find(pairs, {i for i, _ in sets if i is not None})


@pytest.mark.parametrize("limits", [{}, {"few_rows": 2, "block": 3}, {"few_rows": 0}])
def test_near_duplicates(spark, docs, limits):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in range(100, 180):  # a group whose members are often just beyond the limit of each other
        w = list(base)
        for j in rng.integers(0, 60, int(rng.integers(0, 4))):
            w[j] = f"v{k}"
        rows.append((k, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()
    sets, comp = near_brute(rows)
    want = sorted(((i, len(s), comp.get(i), i is None or comp[i] == i) for i, s in sets), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


# --- collision counting


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 32))
    v = [list(map(float, c + s * rng.standard_normal(32))) for c in centres for s in (0, 0, 0.05, 0.2, 0.28, 0.33)]
    v += [v[0], [0.0] * 32, [float("nan")] * 32, [1.0, None], None, [], [3.0, 4.0], [6.0, 8.0]]
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(df, cell=16, block=24, tile=10).collect()}
    ok = {k: np.array(x) / np.linalg.norm(x) for k, x in enumerate(v) if x and None not in x and np.isfinite(x).all() and any(x)}
    pairs = [(a, b) for a, b in itertools.combinations(ok, 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.95]
    n, comp = collections.Counter(x for p in pairs for x in p), union_find(pairs, range(len(v)))
    assert sum(got[k].n_links for k in got) >= 0.98 * 2 * len(pairs)
    assert all(got[k].n_links <= n[k] for k in got) and len(got) == len(v)
    assert sum(got[k].component_id == comp[k] for k in got) >= 0.98 * len(v)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_repeated_ids_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 5), (1, [0.0, 1.0], 6), (1, [0.0, 2.0], 7), (2, [0.0, 3.0], 8), (3, [1.0, 0.01], 9), (None, [1.0, 0.0], 1), (4, [-1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, size int").withColumn("v", F.lit(1)).withColumn("links", F.lit("x"))
    got = sorted((tuple(r) for r in embeddings.near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (None, 0, None, True), (4, 0, 4, True)], key=str)


def test_counts_by_windows():
    rng = np.random.default_rng(0)
    p, q = rng.standard_normal((50, 9)), rng.standard_normal((70, 9))
    for half, least in ((0.7, 5), (1.5, 9), (2.0, 8), (0.1, 0)):
        x, y = embeddings.collisions(p, q, half, least)
        want = (np.abs(p[:, None] - q[None]) <= half).sum(2) >= least
        got = np.zeros_like(want)
        got[x, y] = True
        assert (got == want).all()


def test_count_is_calibrated():
    half, least = embeddings.calibrate(0.95, 24, 1e-4)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.95 * x + math.sqrt(1 - 0.95**2) * y
    d = embeddings.directions(64, 24, 2)
    assert ((np.abs((x - z) @ d) <= half).sum(1) >= least).mean() > 0.999


# --- lattice


def test_pieces_round_trip(docs):
    v = pieces.default_vocabulary()
    out = pieces.encode(docs, v, k=3).collect()
    back = {(r.doc_id, r.text) for r in pieces.decode(pieces.encode(docs, v), v).collect()}
    assert back == {(r.doc_id, r.text) for r in docs.collect()}
    assert len(out) == docs.count()
    for r in out:
        if r.ids is None:
            assert r.samples == []
            continue
        tries = [tuple(s.ids) for s in r.samples]
        assert len(set(tries)) == len(tries) and all(a.perturbed >= b.perturbed for a, b in itertools.pairwise(r.samples))
        assert all(0 <= s.inclusion <= 1 and s.logp <= 1e-9 for s in r.samples)
        for t in tries:
            assert b"".join(bytes(v.bytes[v.begins[k] : v.begins[k] + v.lengths[k]]) for k in t) == b"".join(bytes(v.bytes[v.begins[k] : v.begins[k] + v.lengths[k]]) for k in r.ids)


def test_samples_follow_the_lattice(spark):
    """Over many seeds the first sample is distributed as the lattice, and the pair as draws without replacement."""
    v = pieces.default_vocabulary()
    rows = spark.createDataFrame([(k, "ab c") for k in range(6000)], "doc_id long, text string")
    out = pieces.encode(rows, v, k=2).collect()
    p = {}
    for r in out:
        for s in r.samples:
            p[tuple(s.ids)] = math.exp(s.logp)
    first = collections.Counter(tuple(r.samples[0].ids) for r in out)
    second = collections.Counter((tuple(r.samples[0].ids), tuple(r.samples[1].ids)) for r in out if len(r.samples) > 1)
    assert abs(sum(p.values()) - 1) < 0.02
    for t, q in p.items():
        assert abs(first[t] / 6000 - q) < 4 * math.sqrt(q * (1 - q) / 6000) + 1e-3
    for (a, b), n in second.items():
        q = p[a] * p[b] / (1 - p[a])
        assert abs(n / 6000 - q) < 5 * math.sqrt(q / 6000) + 2e-3


def test_best_segmentation_is_best(spark):
    v = pieces.default_vocabulary()
    text = "the unbelievable tea"
    table = {bytes(v.bytes[v.begins[k] : v.begins[k] + v.lengths[k]]): v.weights[k] for k in range(len(v.weights)) if v.lengths[k] and k not in set(v.byte_id.tolist())}

    def best(word):
        score = [0.0] + [-math.inf] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                if word[i:j] in table:
                    score[j] = max(score[j], score[i] + table[word[i:j]])
        return score[-1]

    want = sum(best(w.encode()) for w in re.findall(r" ?[^ ]+", " " + text))
    ids = pieces.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), v).first().ids
    assert abs(sum(v.weights[k] for k in ids) - want) < 1e-9


def test_ids_feed_the_model(spark):
    """The library reads the ids back as the text, and its own merges give the same pieces for most words."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    v = pieces.default_vocabulary()
    plain = np.exp(v.weights)[np.setdiff1d(np.arange(len(v.weights)), v.byte_id)]
    assert abs(plain[v.lengths[np.setdiff1d(np.arange(len(v.weights)), v.byte_id)] > 0].sum() - 1) < 1e-6 and v.weights[v.byte_id].max() < v.weights[300:].min() + 1e-9 + abs(v.weights[300:].min())
    texts = ["It was the best of times, it was the worst of times.", "def f(x):\n    return  x\n\n        # far in", " leading blank", "\n", "Le petit chat dort; die Entwicklung moderner Programme braucht Geduld.", "日本語 and ünïcödé", "   ", "a" * 40]
    out = {r.doc_id: r for r in pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), v).collect()}
    assert [model.decode(list(out[k].ids)) for k in range(len(texts))] == texts
    assert all(model.decode(list(s.ids)) == texts[k] for k in out for s in out[k].samples)
    assert len(out[1].ids) < 24  # runs of blanks are pieces
    words = sorted({w for k in (0, 4) for w in texts[k].split()})
    mine = {r.doc_id: list(r.ids) for r in pieces.encode(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), v).collect()}
    assert np.mean([mine[k] == model.encode(w) for k, w in enumerate(words)]) >= 0.8


# --- templates


def test_leaks(spark):
    items = [(1, "Anna had 12 apples and gave 5 kg of them to Bob before the long trip to town began today."), (2, "A short one about nothing."), (3, None), (4, "")]
    docs = [
        (10, "Noise before this. " + items[0][1] + " And after."),
        (11, items[0][1].replace("12", "99").replace("Bob", "Carl")),
        (12, "Nothing of the kind is said here at all, only words that nobody put into any test."),
        (13, None),
        (14, items[1][1]),
        (15, "Anna had 12 apples"),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for bound in (2_000_000, 1):
        got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.leaks(d, b, bound=bound).collect()}
        assert got == {(10, 1): False, (11, 1): True, (14, 2): False}
    assert decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


def test_short_and_wordless_items_are_found_anywhere(spark):
    items = [(1, "Who wrote the old song of rivers?"), (2, "12 kg 5 m 7 km 30 lb 9 oz 4 ft 8 yd"), (3, "The 12 apples weigh 5 kg")]
    docs = [
        (20, "Some noise stands here, and then they asked: Who wrote the old song of rivers? Nobody answered them at all."),
        (21, "A table that has numbers in it says 12 kg 5 m 7 km 30 lb 9 oz 4 ft 8 yd and ends with words."),
        (22, "A table that has numbers in it says 13 kg 6 m 8 km 31 lb 10 oz 5 ft 9 yd and ends with words."),
        (23, "It was said early in the day that the 40 apples weigh 9 kg when they are ripe enough."),
        (24, "Who wrote the new song of rivers, they asked again and again in the long old night?"),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for bound in (2_000_000, 1):
        got = {(r.doc_id, r.item_id): (r.reparameterised, r.coverage) for r in decontaminate.leaks(d, b, bound=bound).collect()}
        assert got == {(20, 1): (False, 1.0), (21, 2): (False, 1.0), (23, 3): (True, 1.0)}


def template_brute(text, units):
    """(slot type, lower-case word) of each word: 0 literal, 1 number, 2 unit, 3 name."""
    out, before, begins = [], 0, True
    for raw in (text or "").split():
        core = re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", raw)
        lead = raw[: len(raw) - len(re.sub(r"^[^A-Za-z0-9]+", "", raw))]
        if not core:
            begins |= bool(re.search(r"[.!?:]", raw))
            continue
        begins |= bool(re.search(r"[.!?:]", lead))
        kind = 1 if core[0].isdigit() else 2 if before == 1 and core.lower() in units else 3 if core[0].isupper() and not begins else 0
        out.append((kind, core.lower()))
        before, begins = kind, bool(re.search(r"[.!?:]", raw[raw.rindex(core) :].replace(core, "", 1)))
    return out


def leaks_brute(docs, items, share=0.3, n=8, literals=4):
    units, found = set(decontaminate.UNITS), {}
    view = lambda w: tuple(x if k == 0 else k for k, x in w)
    for (d, text), (i, question) in itertools.product(docs, items):
        q, t = template_brute(question, units), template_brute(text, units)
        places = [(p, n) for p in range(len(q) - n + 1) if sum(k == 0 for k, _ in q[p : p + n]) >= literals]
        runs = collections.defaultdict(lambda: (set(), set()))
        for p, size in places:
            for r in range(len(t) - size + 1):
                if view(q[p : p + size]) == view(t[r : r + size]):
                    runs[r - p][0].add(p)
                    runs[r - p][1].update((a[1], b[1]) for a, b in zip(q[p : p + size], t[r : r + size]) if a[0])
        one = lambda pairs: len({a for a, _ in pairs}) == len(pairs)
        held, pairs = set(), set()
        for shift, (where, slots) in sorted(runs.items(), key=lambda x: (-len(x[1][0]), any(a != b for a, b in x[1][1]), abs(x[0]))):
            if one(slots) and one(pairs | slots):
                held, pairs = held | where, pairs | slots
        if places and len(held) / len(places) >= share:
            found[d, i] = (len(held), any(a != b for a, b in pairs))
    return found


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re") for b in ("na", "lo", "s", "ver", "dim", "qua")]

    def text(size):
        out = []
        for _ in range(size):
            out.append(str(rng.choice(words)))
            x = rng.random()
            if x < 0.12:
                out.append(str(rng.integers(1, 99)))
            elif x < 0.18:
                out += [str(rng.integers(1, 99)), "kg"]
            elif x < 0.26:
                out.append(str(rng.choice(["Anna", "Bob", "Carl"])))
            elif x < 0.32:
                out[-1] += "."
        return " ".join(out)

    shared = text(12)
    items = [(k, text(int(rng.integers(10, 40))) + (" " + shared if k % 2 else "")) for k in range(12)]
    docs = [(k, text(60)) for k in range(20)]
    for k in range(60):
        w = items[k % 12][1].split()
        if k % 3 == 0:
            w.insert(int(rng.integers(0, len(w))), "inserted")
        if k % 4 == 0:
            w = [str(int(x) + 1) if x.isdigit() else x for x in w]
        if k % 5 == 0:
            w = [{"Anna": "Bob", "Bob": "Dora"}.get(x, x) for x in w]
        cut = int(rng.integers(0, len(w) // 2)) if k % 2 else 0
        docs.append((100 + k, text(int(rng.integers(0, 30))) + " and " + " ".join(w[cut:]) + " and " + text(5)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.reparameterised) for r in decontaminate.leaks(d, b).collect()}
    want = leaks_brute(docs, items)
    assert got == want and len(want) > 40 and {x[1] for x in want.values()} == {True, False}


def test_leaks_on_odd_rows(spark, docs, nothing):
    odd = docs.withColumnsRenamed({"band": "window", "part": "pos", "id": "item_id"}).select("*", F.lit(1).alias("slots"), F.lit("x").alias("coverage"))
    items = odd.select(F.monotonically_increasing_id().alias("item_id"), "text", "doc_id", "window")
    got = decontaminate.leaks(odd, items)
    assert got.columns == ["doc_id", "item_id", "n_windows", "coverage", "reparameterised"]
    rows = got.collect()
    by_text = {r.item_id: r.text for r in items.collect()}
    assert all(r.coverage >= 0.3 for r in rows) and {by_text[r.item_id] for r in rows if r.doc_id == 9} >= {docs.where("doc_id = 9").first().text}
    assert decontaminate.leaks(nothing, items).count() == 0 and decontaminate.leaks(odd, items.limit(0)).count() == 0


def test_slots_must_agree(spark):
    item = "the price of 3 and 3 more was 3 again when they met near the old bridge and waited"
    docs = [(1, item.replace("3", "7")), (2, item.replace("3", "7", 1))]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {1}


# --- licences


def test_licenses(spark):
    rows = [
        (1, "https://a.org/x/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (2, "https://a.org/x/y/z/code.py?q=1", "print(1)"),
        (3, "https://a.org/other", "<p>Released under the MIT License.</p> text"),
        (4, "https://b.org/q", "no word of it"),
        (5, None, "All rights reserved."),
        (6, "https://b.org/r", None),
        (7, "https://a.org/x/w", "This work is licensed under the GNU General Public License, version 3. " + "more words " * 5000),
        (8, "https://a.org/x/y/z/last", "licensed licensed licensed to nobody, for cooking only"),
    ]
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], "page_id long, url string, html string, id int, license string, score double")
    got = {r.page_id: (r.license, r.inherited_from) for r in licenses.scan_licenses(df).collect()}
    assert got[1] == ("Apache-2.0", None) and got[3] == ("MIT", None) and got[7] == ("GPL-3.0", None) and got[5] == ("Proprietary", None)
    assert got[2] == (got[2][0], "a.org/x") and got[2][0] in ("Apache-2.0", "GPL-3.0") and got[8] == got[2]
    assert got[4] == (None, None) and got[6] == (None, None)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_licence_texts_outweigh_rights_lines(spark):
    head = "Copyright (c) 2020 Some One\nAll rights reserved.\n\n"
    bodies = {f"{name}/{k}": text for k, (name, _, text) in enumerate(licenses.BODIES)}
    names = sorted(bodies)
    assert len({n.split("/")[0] for n in names}) >= 25 and all(any(w in t.lower() for w in licenses.OPENERS) for t in bodies.values())
    lines = {n: "\n".join(" * " + " ".join(bodies[n].split()[k : k + 9]) for k in range(0, 999, 9)) for n in names}
    rows = [(k, f"https://a.org/{n}/LICENSE", head + lines[n]) for k, n in enumerate(names)] + [(100 + k, f"https://a.org/{n}/src/x.c", "int x;") for k, n in enumerate(names)]
    rows.append((200, "https://b.org/x", head + "Permission is hereby granted, free of charge, to any person obtaining a copy of the menu in our restaurant near the river."))
    got = {r.page_id: r.license for r in licenses.scan_licenses(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {200: "Proprietary"} | {k: n.split("/")[0] for k, n in enumerate(names)} | {100 + k: n.split("/")[0] for k, n in enumerate(names)}


def test_identifiers_and_named_licences_come_first(spark):
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    rows = [
        (1, "https://a.org/1/x", "// SPDX-License-Identifier: Apache-2.0\n// All rights reserved."),
        (2, "https://a.org/2/x", "# SPDX-License-Identifier: (MIT OR Apache-2.0)\n" + gnu),
        (3, "https://a.org/3/x", "Released under the MIT License.\nAll rights reserved."),
        (4, "https://a.org/4/x", "All rights reserved.\n" + gnu),
        (5, "https://a.org/5/x", "All rights reserved."),
        (5, "https://a.org/5/x", "All rights reserved."),
        (6, "https://a.org/6/x", "what an spdx-license-identifier: is"),
    ]
    got = collections.Counter((r.page_id, r.license) for r in licenses.scan_licenses(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == {(1, "Apache-2.0"): 1, (2, "MIT OR Apache-2.0"): 1, (3, "MIT"): 1, (4, "GPL-2.0"): 1, (5, "Proprietary"): 2, (6, None): 1}


def test_cosine_is_cosine(spark):
    units = ["Licensed under CC BY-NC 4.0.", "copyright of the license, license"]
    words = {k: licenses._python_terms(v) for k, v in licenses.TEMPLATES.items()}
    vocabulary = {w for x in words.values() for w in x}
    idf = {w: 1 + len(w) / 10 for w in vocabulary}
    for u in units:
        got = spark.createDataFrame([(u,)], "u string").select(licenses._best(F.col("u"), idf, 3.0, words).alias("b")).first().b
        c = collections.Counter(licenses._python_terms(u))
        norm = math.sqrt(sum((n * idf.get(w, 3.0)) ** 2 for w, n in c.items()))
        want = max((sum(c[w] * n * idf[w] ** 2 for w, n in collections.Counter(t).items()) / norm / math.sqrt(sum((n * idf[w]) ** 2 for w, n in collections.Counter(t).items())), k) for k, t in words.items())
        assert abs(got.score - want[0]) < 1e-9 and got.license == want[1]


# --- models


def test_language(spark, docs, nothing):
    known = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog and the bird with them", "en"), ("le chat et le chien dans la maison avec les enfants", "fr")] * 5)], "doc_id long, text string, lang string")
    profiles = language.learn_profiles(known)
    got = {(r.doc_id, r.lang_pred): r.score for r in language.identify(docs, profiles).collect()}
    by_id = {k[0]: k[1] for k in got}
    assert by_id[0] == "en" and by_id[6] == "und" and by_id[4] == "und" and by_id[11] == "und" and len(got) == docs.select("doc_id").distinct().count()
    assert all(0 <= s <= 1 for s in got.values())
    assert {r.lang_pred for r in language.identify(docs, language.learn_profiles(nothing)).collect()} == {"und"}
    assert language.identify(nothing, profiles).count() == 0


def grams_brute(text):
    s = [c.lower() if len(c.lower()) == 1 else c for c in text]
    s = ["\0" if not c.isalpha() else c for c in s]
    found = collections.Counter("".join(s[k : k + n]) for n in (1, 2, 3) for k in range(len(s) - n + 1))
    return {g: n for g, n in found.items() if g.strip("\0")}


def code_of(gram):
    code = len(gram)
    for c in ["\0"] * (3 - len(gram)) + list(gram):
        code = (code << 18) | ord(c)
    return code


def profile_brute(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code_of(x[0])))][:size]


def test_language_equals_brute_force(spark):
    """Profiles and predictions by plain counting, in four scripts, with odd rows."""
    samples = {
        "en": "The cat sat on the mat, and The Dog did not care at all about what it saw there.",
        "ru": "Быстрая коричневая лиса прыгает через ленивую собаку, и никто этого не видел ЗДЕСЬ.",
        "el": "Η γρήγορη καφετιά αλεπού πηδά πάνω από τον τεμπέλη σκύλο και κανείς δεν το είδε.",
        "zh": "敏捷的棕色狐狸跳过了懒狗,没有人看见它。今天天气很好,我们去公园散步吧。",
    }
    rows = [(k, t * 2, lang) for k, (lang, t) in enumerate(samples.items())] + [(9, None, "en"), (10, "x", None), (11, "", "ru"), (12, samples["en"][:30], "en"), (12, samples["en"][:30], "en")]
    profiles = language.learn_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=60)
    counts = {lang: collections.Counter() for lang in samples}
    for _, t, lang in rows:
        if t is not None and lang is not None:
            counts[lang].update(grams_brute(t))
    want = {lang: profile_brute(c, 60) for lang, c in counts.items()}
    got = collections.defaultdict(dict)
    for r in profiles.collect():
        got[r.lang][r.rank] = r.gram
    assert {lang: [g[k] for k in range(len(g))] for lang, g in got.items()} == {lang: [code_of(g) for g in w] for lang, w in want.items()}
    tests = ["on the mat", "собаку не видел", "του σκύλου η αλεπού", "公园里的狐狸", "THE мат 狐 mixed text", "İstanbul ǅ ﬁ 𐐀𐐨", "12", "", None, "e", "the " * 300]
    out = {r.doc_id: r for r in language.identify(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), profiles, top=40).collect()}
    for k, t in enumerate(tests):
        mine = profile_brute(grams_brute(t or ""), 40)
        if not mine:
            assert (out[k].lang_pred, out[k].score) == ("und", 0.0)
            continue
        far = {lang: sum(abs(w.index(g) - p) if g in w else 60 for p, g in enumerate(mine)) for lang, w in want.items()}
        best = min(sorted(far), key=far.get)
        rest = (sum(far.values()) - far[best]) / 3
        assert out[k].lang_pred == best and abs(out[k].score - (1 - far[best] / rest if rest else 0)) < 1e-9, t


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    m = quality.fit_trees(x[:1500], y[:1500])
    assert ((m.score(x[1500:]) > 0.5) == (y[1500:] > 0.5)).mean() > 0.95
    assert quality.fit_trees(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert quality.fit_trees(x, np.ones(2000)).score(x[:2]).min() > 0.99


def statistics_brute(text):
    b = (text or "").encode()
    share = [sum(c in set(chars) for c in b) / max(1, len(b)) for chars in quality.CLASSES.values()]
    words = re.findall(rb"[^\x20\x09-\x0d]+", b)
    lines = [x for x in b.split(b"\n") if x]
    low = lambda x: bytes(c + 32 if 65 <= c <= 90 else c for c in x)
    alnum = lambda c: 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128
    n, kinds = max(1, len(words)), collections.Counter(map(low, words))
    return share + [math.log1p(len(b)), math.log1p(len(words)), sum(map(len, words)) / n, len(kinds) / n, max(kinds.values(), default=0) / n, len(set(map(low, lines))) / max(1, len(lines)), sum(alnum(w[-1]) for w in words) / n]


def test_statistics_equal_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality.document_statistics(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert np.allclose(r.x, statistics_brute(texts[r.doc_id]), rtol=1e-5, atol=1e-6), r.doc_id


def test_traversal_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.random((300, len(quality.STATISTICS))), 2)
    model = quality.fit_trees(x[:200], (x[:200, 2] + x[:200, 7] > 1).astype(float), trees=15, depth=3)
    got = {r.doc_id: r.score for r in quality.score_quality(spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "doc_id long, x array<float>"), model).collect()}
    x = x.astype(np.float32).astype(float)
    for k, row in enumerate(x):
        total = model.base
        for f, th, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if row[f[node]] > th[node] else 1)
            total += leaf[node - 7]
        assert abs(got[k] - 1 / (1 + math.exp(-total))) < 1e-12


def toxicity_brute(text, model):
    """The noisy-or over sentences of summed word weights, and where sentences of 0.5 or more begin."""
    b, keep, bad = (text or "").encode(), 1.0, []
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    begin, sentences = 0, []
    for end in [m.end() for m in re.finditer(rb"[\n!.?]", b)] + [len(b)]:
        sentences.append((begin, b[begin:end]))
        begin = end
    low = lambda w: np.frombuffer(bytes(c + 32 if 65 <= c <= 90 else c for c in w), np.uint8)
    code = lambda w: int(toxicity.span_hashes(low(w), np.array([0]), np.array([len(w)]))[0])
    n = 0
    for at, s in sentences:
        found = list(word.finditer(s))
        if not found:
            continue
        n += 1
        buckets = {code(m[0]) % toxicity.BUCKETS for m in found}
        for size in toxicity.STEMS:
            buckets |= {(code(m[0][:size]) * (2 * size + 1) % 2**64 >> 20) % toxicity.BUCKETS for m in found if len(m[0]) > size}
        z = sum(float(model.weight[k]) for k in buckets) + model.bias
        keep *= 1 - 1 / (1 + math.exp(-z))
        if z >= 0:
            bad.append(at + found[0].start())
    return 1 - keep, n, bad


def test_toxicity_equals_brute_force(docs):
    rng = np.random.default_rng(6)
    model = toxicity.Words((rng.standard_normal(toxicity.BUCKETS) * 0.5).astype(np.float32), -2.0)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        score, n, bad = toxicity_brute(texts[r.doc_id], model)
        assert abs(r.score - score) < 1e-6 and r.n_sentences == n and r.offending == bad, r.doc_id


def test_toxicity_sample_is_bounded(spark):
    rows = [(k, f"good words {k}. " * 20 + ("zznasty thing." if k % 3 == 0 else "")) for k in range(120)]
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)] + [(None, 1), (999, 1), (5, None)], "doc_id long, toxic int")
    sizes = []
    whole = toxicity.fit_noisy_or
    toxicity.fit_noisy_or = lambda b, s, y: sizes.append(len(y)) or whole(b, s, y)
    try:
        for most, most_bytes in ((8_000, 32_000_000), (50, 32_000_000), (8_000, 10_000), (8_000, 1)):
            toxicity.fit_toxicity(d, y, most=most, most_bytes=most_bytes)
    finally:
        toxicity.fit_noisy_or = whole
    assert sizes[0] == 120 and sizes[1] <= 50 and 25 <= sizes[2] <= 35 and sizes[3] == 1


def test_quality_and_toxicity_on_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1), (4, 0, 0), (6, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    stats = quality.document_statistics(docs)
    for df in (quality.score_quality(stats, quality.fit_quality(stats, labels)), toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))):
        got = df.collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
    empty = quality.document_statistics(nothing)
    assert quality.score_quality(empty, quality.fit_quality(empty, labels)).count() == 0
    assert toxicity.score_toxicity(nothing, toxicity.fit_toxicity(nothing, labels)).count() == 0


def test_toxicity_locates_sentences(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 6, 3))
    rows, labels = [], []
    for k in range(400):
        s = [" ".join(word() for _ in range(6)) for _ in range(5)]
        if k % 4 == 0:
            s[k % 5] += " zznasty"
        rows.append((k, ". ".join(s) + "."))
        labels.append((k, int(k % 4 == 0)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, toxicity.fit_toxicity(d, y.where("doc_id < 300"))).collect()}
    for k, t in rows[300:]:
        assert (got[k].score >= 0.5) == (k % 4 == 0)
        if k % 4 == 0:
            assert [t.encode()[b:].split(b".")[0].endswith(b"zznasty") for b in got[k].offending] == [True]


# --- chat


def test_chat_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there my friend\nhow is it going today?"),
        (1, 1, "assistant", "> how is it  going today?\nquite fine, thanks a lot"),
        (1, 2, "user", "> > How is it going today?\n>quite fine, thanks a lot\nthat is good to hear"),
        (1, 3, "user", ">> > nobody ever said this line\nok"),
        (1, 4, "user", "> that is good to hear\nindeed"),
        (2, 0, "user", "> that is good to hear\nindeed"),
        (2, 1, None, None),
        (None, 1, "user", "> that is good to hear"),
        (3, None, "user", "x"),
        (1, 2, "user", "a second row of the same turn"),
    ]
    df = spark.createDataFrame([(*r, 1, "z", 5) for r in rows], "conv_id long, turn long, role string, text string, conv int, links string, thread int")
    got = chat.link_quotes(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got if r.clean_text != "a second row of the same turn"}
    assert by[1, 2].thread == 0 and by[1, 2].depth == 2 and by[1, 2].reply_to == 1 and by[1, 2].clean_text == "that is good to hear" and by[1, 2].variants == 2
    assert [(x.level, x.turn) for x in by[1, 2].links] == [(1, 1), (2, 0)]
    assert (by[1, 3].thread, by[1, 3].depth) == (3, 0) and (by[1, 4].thread, by[1, 4].depth) == (0, 3) and by[2, 0].thread == 0 and by[2, 1].clean_text == ""
    assert chat.link_quotes(df.limit(0)).count() == 0 and chat.build_conversations(chat.link_quotes(df.limit(0))).count() == 0
    built = {(r.conv_id, r.thread): r for r in chat.build_conversations(chat.link_quotes(df)).collect()}
    assert built[1, 0].n_messages == 5 and built[1, 0].replies == "1<0 2<1 2<1 4<2" and built[1, 3].n_messages == 1
    assert built[1, 0].formatted.startswith("<|user|>\nHello there my friend\nhow is it going today?\n<|end|>\n<|assistant|>\nquite fine") and ">" not in built[1, 0].formatted.replace("|>", "")
    assert {(None, None), (2, 0), (2, 1)} <= {(r, th if r else None) for r, th in built}


def test_quotes_link_however_their_lines_break(spark):
    said = "One thing that I said was long enough to be broken. Another was not. And a third one ended it."
    rows = [
        (1, 0, "user", said),
        (1, 1, "a", "> One thing that I said was long\n> enough to be broken. Another was\n> not. And a third one ended it.\nyes"),
        (1, 2, "a", "> long enough to be no sentence\n> And a third one\n> ended it.\nok then"),
        (1, 3, "b", "> yes\nshort and said once"),
        (1, 4, "b", "> Another was not.\nok then"),
        (1, 5, "b", "> ok then\nshort and said twice"),
        (1, 6, "b", "> it was never said\nx"),
    ]
    got = {r.turn: [(x.level, x.turn) for x in r.links] for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: [], 1: [(1, 0)], 2: [], 3: [(1, 1)], 4: [(1, 0)], 5: [], 6: []}


def test_long_threads_go_on_in_parts(spark):
    rows = [(1, 0, "u", "message number 0 of a long thread")] + [(1, k, "u", f"> message number {k - 1} of a long thread\nmessage number {k} of a long thread") for k in range(1, 150)]
    rows += [(1, 149, "u", f"> message number 148 of a long thread\nvariant {k} of the last one") for k in range(40)] + [(2, 0, "u", "twice")] * 2
    built = chat.build_conversations(chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    one = [r for r in built if r.conv_id == 1]
    assert {r.thread for r in one} == {0} and {r.part for r in one} == {0, 1, 2} and sum(r.n_messages for r in one) == 190 and max(r.n_messages for r in one) <= 64
    assert [r.n_messages for r in built if r.conv_id == 2] == [1]


@pytest.mark.parametrize("name", ["op6_license_scan", "op10_chat_format"])
def test_native_plans_have_no_python(spark, name):
    text = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", text)


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_minhash_near_dedup"])
def test_odd_tables(docs, nothing, name):
    f = {"op1_suffix_dedup": suffixes.repeated_spans, "op2_minhash_near_dedup": minhash.near_duplicates}[name]
    assert f(docs).count() == docs.count() and f(nothing).count() == 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0 or name == "op5_decontamination"


def test_pipeline(spark):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    final = {r.doc_id: r.ids for r in P.run(spark, SMALL).select("doc_id", "ids").collect()}
    near = {r.doc_id for r in minhash.near_duplicates(d).where("kept").collect()}
    assert set(final) <= near and len(final) > 0.6 * d.count()
    v = pieces.default_vocabulary()
    texts = {r.doc_id: r.text for r in d.collect()}
    some = sorted(final)[:20]
    for k in some:  # what is left of a text is a subsequence of it
        left = b"".join(bytes(v.bytes[v.begins[i] : v.begins[i] + v.lengths[i]]) for i in final[k]).decode()[1:]  # without the model's blank
        it = iter(texts[k])
        assert all(c in it for c in left)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    from compare import duck, rows_of

    df = registry.QUERIES[name](spark, SMALL)
    r = duck(SMALL).execute(registry.SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in r.description], r.fetchall())


def test_pipeline_keeps_rows_apart(spark, docs):
    """Repeated and missing ids neither multiply nor lose rows."""
    import corpus_pipeline as P

    few = docs.select(*P.COLUMNS).where("doc_id IS NULL OR doc_id IN (3, 4, 6, 7)")
    for name, stage in P.STAGES[1:4]:
        out = stage(spark, few, SMALL)
        assert out.columns == P.COLUMNS and out.count() == few.count(), name
    texts = {r.doc_id: r.text for r in P.repeats(spark, docs.select(*P.COLUMNS), SMALL).collect()}
    assert texts[1] == "" and texts[14] == "é" * 60 and texts[None] == ""


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages by plain Python on a small corpus with copies, near copies, repeated passages, leaks and odd rows."""
    import corpus_pipeline as P
    import sentencepiece

    rng = np.random.default_rng(21)
    lexicon = ["".join(rng.choice(list("abdegiklmnoprstu"), int(rng.integers(2, 8)))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(lexicon, n))
    items = [(k, prose(25)) for k in range(4)]
    passage = prose(60)
    texts = [prose(int(rng.integers(5, 120))) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5] + " more", texts[7].replace(" ", "  ", 1)] + [prose(20) + " " + passage + " " + prose(20) for _ in range(5)]
    texts += [prose(30) + " " + items[k % 4][1] + " " + prose(30) for k in range(6)] + [items[1][1].split(" ", 4)[4], "12 34 !!", "", "   ", "é" * 60, "Öl " * 30, "x"]
    rows = [(k, x, ("en", "fr", None)[k % 3], "s", len(x)) for k, x in enumerate(texts)] + [(900, None, "en", None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: list(r.ids) for r in P.run(spark, str(tmp_path)).collect()}
    # language: whatever has a letter has a language
    left = [(k, x) for k, x, *_ in rows if x and any(c.isalpha() for c in x)]
    _, component = near_brute(left)
    left = [(k, x) for k, x in left if component[k] == k]
    first, cut = {}, []
    for k, x in left:
        b = x.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], k)
    for k, x in left:
        b, gone = x.encode(), bytearray(len(x.encode()))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < k:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        cut.append((k, kept.decode(errors="ignore")))
    leaked = {d for d, _ in leaks_brute(cut, items)}
    want = {k: x for k, x in cut if k not in leaked}
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert sorted(got) == sorted(want) and len(leaked) >= 4 and len(left) <= len(rows) - 8 and any(x != dict(left)[k] for k, x in want.items())
    assert {k: model.decode(ids) for k, ids in got.items()} == want


def test_stages_on_odd_and_empty_tables(spark, docs, nothing):
    import corpus_pipeline as P

    few = docs.select(*P.COLUMNS)
    out = P.language(spark, few, SMALL)
    assert out.columns == P.COLUMNS and out.count() == sum(bool(r.text) and any(c.isalpha() for c in r.text) for r in few.collect())
    done = P.tokenize(spark, few, SMALL).collect()
    assert len(done) == few.count() and sum(r.ids is None for r in done) == 1
    for name, stage in P.STAGES:
        assert stage(spark, nothing.select(*P.COLUMNS), SMALL).count() == 0, name
