"""Whitening, line dedup and importance resampling against brute force, on the test tables and on odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from evenmark.llm import importance, licenses, lines, registry, whitening
from evenmark.llm.common import ranked
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


# --- whitening


def whitened_brute(vectors, most=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    centred = np.array((n * x - s), dtype=float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    return n, [int(((n * row - s) ** 2).sum()) for row in x], centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum(), axes[:, order].T


def check_whitening(out, vectors, ids, k):
    n, dev, want, share, _ = whitened_brute(vectors)
    got = collections.defaultdict(dict)
    for r in out:
        got[r.vec_id][r.component] = r
    assert set(got) == set(ids) and all(sorted(v) == list(range(1, k + 1)) for v in got.values())
    m = np.array([[got[i][c + 1].whitened for c in range(k)] for i in ids])
    sign = np.sign((m * want[:, :k]).sum(0))
    assert np.allclose(m, want[:, :k] * sign, atol=1e-7)
    assert [int(got[i][1].deviation) for i in ids] == dev and {r.n for r in out} == {n}
    assert np.allclose([got[ids[0]][c + 1].explained for c in range(k)], share[:k], rtol=1e-8)
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9


def test_op11_equals_brute_force(spark):
    out = registry.QUERIES["op11_embedding_whitening"](spark, SMALL)
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    check_whitening(out.collect(), [r.embedding for r in rows], [r.vec_id for r in rows], 32)


@pytest.mark.parametrize("scale", [1, 1e-3, 3e5])
def test_badly_conditioned_vectors(spark, scale):
    """Variances over nine orders of magnitude, each direction its own; one Cholesky factor alone would break or lose them."""
    rng = np.random.default_rng(5)
    spread = np.logspace(0, 4.5, 6)
    v = rng.normal(size=(400, 6)) * spread * scale @ np.linalg.qr(rng.normal(size=(6, 6)))[0] if scale != 1e-3 else rng.normal(size=(400, 6)) * np.logspace(0, 3, 6)
    table = spark.createDataFrame([(k, [float(c) for c in row]) for k, row in enumerate(v)], "vec_id long, embedding array<double>")
    check_whitening(whitening.whiten(table).collect(), v.tolist(), list(range(400)), 6)


def test_whitening_on_odd_tables(spark):
    rng = np.random.default_rng(6)
    good = [[float(c) for c in row] for row in rng.normal(size=(30, 3))]
    good = [[a, b, 7.0, a, c] for a, b, c in good]  # a constant and a repeated dimension: three directions
    rows = [(k, v, "x", 1) for k, v in enumerate(good)] + [(3, good[3], None, 2), (None, good[4], "y", 3)]
    odd = [(90, None), (91, []), (92, [1.0, None, 0.0, 0.0, 0.0]), (93, [float("nan")] * 5), (94, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (95, [1.0, 2.0])]
    table = spark.createDataFrame(rows + [(i, v, None, None) for i, v in odd], "vec_id long, embedding array<double>, whitened string, x int").repartition(3)
    out = whitening.whiten(table).collect()
    n, dev, want, share, _ = whitened_brute([r[1] for r in rows], 3)
    assert len(out) == 3 * len(rows) and {r.n for r in out} == {n} and out[0].identity_error < 1e-9
    assert sorted(int(r.deviation) for r in out if r.component == 1) == sorted(dev)
    got = sorted(abs(round(r.whitened, 6)) for r in out)
    assert np.allclose(got, sorted(abs(want).ravel()), atol=1e-5) and np.isclose(sum(r.explained for r in out) / n, 1)
    for few in (table.limit(0), table.where("vec_id = 5"), table.where("vec_id = 3"), table.where("vec_id = 90")):
        out = whitening.whiten(few)
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
    two = whitening.whiten(table.where("vec_id in (1, 2)")).collect()
    assert [(r.component, round(abs(r.whitened), 9)) for r in two] == [(1, 1.0)] * 2


def test_large_entries_and_other_widths(spark):
    table = spark.createDataFrame([(1, [1e15, 2.0]), (2, [-1e15, 3.0]), (3, [5.0, 1e9]), (4, [1.0]), (5, [2.0, 3.0, 4.0])], "vec_id long, embedding array<double>")
    _, dev, *_ = whitened_brute([[1e15, 2.0], [-1e15, 3.0], [5.0, 1e9]])
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(table).collect()} == dict(zip((1, 2, 3), dev, strict=True))


def test_passes_mend_what_one_factor_leaves(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(500, 4)) * [1e7, 1e3, 1, 1e-2]
    g = a.T @ a
    r = whitening.factor(g)
    q = whitening.solved(a, r)
    assert np.abs(q.T @ q - np.eye(4)).max() > 1e-3
    for _ in range(3):
        q = whitening.solved(q, whitening.factor(q.T @ q))
    assert np.abs(q.T @ q - np.eye(4)).max() < 1e-12


# --- repeated lines

BLANKS = " \t\n\v\f\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def lines_brute(rows, least_chars=40, least_docs=5):
    holders = collections.defaultdict(set)
    rank = lambda i: -math.inf if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key_of(line)].add(rank(i))
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        stay = [x for x in every if not (len(key_of(x)) >= least_chars and len(holders[key_of(x)]) >= least_docs and rank(i) != max(holders[key_of(x)]))]
        out.append((i, len(every), len(every) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def lines_found(df, **sizes):
    out = lines.keep_lines(df, lines.keep_bitmaps(df, **sizes)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))
    return sorted(map(tuple, out.collect()), key=str)


def test_line_dedup_on_odd_rows(spark, docs, nothing):
    rng = random.Random(4)
    common = [f"line {k} " + "é" * (30 + k) for k in range(8)] + ["THE SAME LINE OF FORTY LETTERS AND SOME MORE", "the same line of forty letters and some more\t ", "short one", ""]
    rows = [(k % 37 if k % 11 else None, "\n".join(rng.choice([*common, f"own {k} " + "z" * 60]) for _ in range(rng.randint(1, 9)))) for k in range(300)]
    rows += [rows[5], rows[5], (400, None), (401, ""), (402, "\n\n"), (403, "\n".join(common * 3000)), (404, "\v" + common[0] + "\r")]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, version string, pos int").repartition(5)
    assert lines_found(df) == lines_brute(rows)
    assert lines_found(df, least_chars=6, least_docs=2) == lines_brute(rows, 6, 2)
    assert lines_found(docs) == lines_brute([(r.doc_id, r.text) for r in docs.collect()])
    assert lines_found(nothing) == []
    named = spark.createDataFrame([(f"d{i}", t) for i, t in rows], "doc_id string, text string")
    assert sum(r[2] for r in lines_found(named)) > 300


def test_op12_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = registry.QUERIES["op12_line_dedup"](spark, SMALL)
    assert out.dtypes == [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")]
    assert sorted(map(tuple, out.collect()), key=str) == lines_brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_ranges_cut_anywhere(seed):
    """Lines of few keys in ranges and batches of any size: what goes at once and what the edges settle equals a count of all."""
    rng = random.Random(seed)
    rows = sorted({(rng.randint(0, 6), 0, -rng.randint(0, 12), rng.randint(0, 3), rng.randint(0, 40)) for _ in range(400)})
    want = set()
    for h in range(7):
        held = [r for r in rows if r[0] == h]
        if len({r[2] for r in held}) >= 5:
            want |= {(h, -r[2], r[3], r[4]) for r in held if r[2] != held[0][2]}
    got, edges, still, at, part = [], [], [], 0, 0
    while at < len(rows):
        size = rng.choice([1, 2, 30, 90])
        state = lines.Stream(part, 5, pa.int64())
        some, out, k = rows[at : at + size], [], 0
        while k < len(some):
            step = rng.choice([1, 3, 25])
            h1, h2, doc, version, pos = zip(*some[k : k + step], strict=True)
            cols = [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([-d for d in doc], pa.int64()), pa.array(version, pa.int64()), pa.array([50] * len(h1), pa.int32()), pa.array(pos, pa.int32())]
            out += list(state.take(pa.RecordBatch.from_arrays(cols, ["h1", "h2", "doc", "version", "n_lines", "pos"])))
            k += step
        out += list(state.ended(last=True))
        for r in (x for b in out for x in b.to_pylist()):
            [got, still, edges][r["kind"]].append(r)
        at, part = at + size, part + 1
    assert all(sum(e["part"] == p for e in edges) <= 2 for p in range(part))
    settled = {}
    for h in {e["h1"] for e in edges}:
        own = sorted((e for e in edges if e["h1"] == h), key=lambda e: e["part"])
        n = sum(e["docs"] for e in own) - sum(a["last"] == b["doc"] for a, b in zip(own, own[1:], strict=False))
        settled[h] = own[0]["doc"] if n >= 5 else None
    late = [r for r in still if settled[r["h1"]] is not None and r["doc"] != settled[r["h1"]]]
    assert sorted((r["h1"], r["doc"], r["version"], r["pos"]) for r in got + late) == sorted(want)


# --- importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def resample_brute(docs, target):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    def features(t):
        w = WORD.findall(lower(t))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t = collections.Counter(), collections.Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10_000)]
    out = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0], r[2], r[3]))
    rank = collections.defaultdict(list)
    for k, r in enumerate(able):
        rank[tuple(r)].append(k + 1 if k < 25 * len(able) // 100 else None)
    return sorted(((r[0], *r[2:], rank[tuple(r)].pop(0) if rank[tuple(r)] else None) for r in out), key=str)


COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def test_op13_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    out = registry.QUERIES["op13_importance_resampling"](spark, SMALL)
    assert out.dtypes == [(c, "bigint") for c in COLUMNS]
    assert sorted(map(tuple, out.collect()), key=str) == resample_brute(docs, target)


@pytest.mark.parametrize("most", [0, 3, 1 << 16])
def test_resampling_on_odd_rows(spark, docs, nothing, most):
    """Any size of the head gives the same results."""
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(50, "x" * 33 + " " + "é" * 40 + " a " * 30), (51, "Straße 7 " * 12), (52, "語" * 500 + " and b")]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, score int, rank string").repartition(3)
    target = [None, "", "the quick brown fox jumps", "语 straße 7 " * 3]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resample(df, aim, most=most).select(*COLUMNS)
    assert sorted(map(tuple, out.collect()), key=str) == resample_brute(rows, target)
    assert importance.resample(nothing, aim, most=most).count() == 0
    assert sorted(map(tuple, importance.resample(df, aim.limit(0), most=most).select(*COLUMNS).collect()), key=str) == resample_brute(rows, [])


def test_crc_of_words_and_pairs():
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in [*range(1, 70), 1, 32, 33, 5_000]]
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    crc = importance.crc_of(buf, starts, ends)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    short = [k for k, w in enumerate(words) if len(w) <= importance.SHORT]
    got = importance.crc_joined(importance.then_space(crc[short]), crc[short][::-1], (ends - starts)[short][::-1])
    assert got.tolist() == [zlib.crc32(words[a] + b" " + words[b]) for a, b in zip(short, short[::-1], strict=True)]


def test_ranked(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(9)]), rng.randint(0, 3), k) for k in range(500)]
    out = ranked(spark.createDataFrame(rows, "a long, b long, k long"), F.desc("a"), F.asc("b"), F.asc("k")).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (math.inf if r[0] is None else -r[0], r[1], r[2]))
    assert [(r.a, r.b, r.k, r.rank) for r in out] == [(*w, n + 1) for n, w in enumerate(want)]


# --- licences


def test_spdx_expressions(spark):
    """Whole expressions of known identifiers; a word that is none is no licence."""
    lines = {
        "MIT": "MIT", "mit */": "mit", "(MIT OR Apache-2.0) -->": "MIT OR Apache-2.0", "GPL-2.0-only WITH Linux-syscall-note": "GPL-2.0-only WITH Linux-syscall-note", "is what we put here": None,
        "(MIT AND (BSD-2-Clause OR ISC))": "(MIT AND (BSD-2-Clause OR ISC))", "LicenseRef-Ours": "LicenseRef-Ours", "MIT or so": "MIT", "Foo-1.0 OR MIT": None, "": None,
    }
    df = spark.createDataFrame([(k, f"https://a.org/{k}/x", f"// SPDX-License-Identifier: {x}\nint x;") for k, x in enumerate(lines)], "page_id long, url string, html string")
    assert {r.page_id: r.license for r in licenses.scan_licenses(df).collect()} == dict(enumerate(lines.values()))
    ours = licenses.scan_licenses(df, identifiers=["foo-1.0", "MIT"]).where("page_id = 8").first()
    assert (ours.license, ours.score) == ("Foo-1.0 OR MIT", 1.0)


def test_licence_texts_with_other_words(spark):
    """Texts of which words were changed, at the beginning too, inside other text; a text about something else is none. The words that choose what is read stay."""
    rng = random.Random(3)
    texts = [(name, licenses._python_terms(text)) for name, _, text in licenses.BODIES if len(licenses._python_terms(text)) >= 40]
    noise = [f"word{k}" for k in range(200)]
    rows = []
    for k, (_, terms) in enumerate(texts):
        kept = {w for opener in licenses.OPENERS for w in opener.split()}
        changed = [rng.choice(noise) if w not in kept and (rng.random() < 0.04 or i == 2) else w for i, w in enumerate(terms)]
        before = rng.choices(noise, k=rng.randint(0, 60))
        rows.append((k, f"https://a.org/{k}/x", " ".join([*before, *changed, *rng.choices(noise, k=30)])))
    rows.append((900, "https://a.org/900/x", " ".join(["granted", "warranty", "documentation", *rng.choices(noise, k=300)])))
    mit = next(text for name, opening, text in licenses.BODIES if name == "MIT")
    rows.append((901, "https://a.org/901/x", mit.replace("free of charge", "without charge")))
    found = {r.page_id: (r.license, r.score) for r in licenses.scan_licenses(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    right = sum(found[k][0] == name for k, (name, _) in enumerate(texts))
    assert right >= 0.9 * len(texts) and len(texts) >= 10
    assert found[900][0] is None and found[901][0] == "MIT" and all(s is None or 0 < s <= 1 for _, s in found.values())
