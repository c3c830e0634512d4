"""Slots of several words in templates, and long words in lattices."""

import re

import numpy as np
import pyarrow as pa
import pytest
from evenmark.llm import decontaminate, licenses


# --- text without blanks, and names of several words


def test_long_words_are_cut_where_no_piece_crosses():
    from evenmark.llm import pieces
    from evenmark.llm.common import packed

    vocabulary = pieces.default_vocabulary()
    rng = np.random.default_rng(5)
    letters = ["的", "一", "river", "ing", "é", "Ж", "ไ", "😀", "x", "the", "9", "\t"]
    texts = ["".join(rng.choice(letters, int(rng.integers(1, 120)))) for _ in range(60)] + ["x" * 300, "", " a b"]
    buf, at = packed(pa.array(texts))
    begins, ends, row = pieces.cut_words(buf, at)
    cut = pieces.cut_long(vocabulary, buf, at, begins, ends)
    assert len(cut[0]) > 3 * len(begins) and (cut[1][:-1] == cut[0][1:]).all()

    def best(begins, ends, row):
        lattice = pieces.Lattice(vocabulary, buf, begins, ends)
        edges, items, _ = lattice.walk(np.arange(len(begins)), lambda node, *_: lattice.via[node])
        weight = np.bincount(row[items], weights=vocabulary.weights[lattice.piece[edges]], minlength=len(texts))
        return weight, np.bincount(row[items], minlength=len(texts)), lattice

    (a, _, whole), (b, _, parts) = best(begins, ends, row), best(*cut)
    assert np.allclose(a, b) and len(whole.piece) == len(parts.piece)  # no edge is lost, so no segmentation


def test_text_without_blanks_costs_no_more(spark):
    import time

    from evenmark.llm import pieces

    vocabulary = pieces.default_vocabulary()
    rng = np.random.default_rng(6)
    han = "".join(rng.choice(["的", "一", "中", "国", "人", "river", "的一", "大"], 33_000))
    took = {}
    for name, text in {"warm": "a b", "blanks": " ".join(rng.choice(["the", "river", "engine", "of", "state"], 20_000)), "han": han, "long": "x" * 20_000}.items():
        d = spark.createDataFrame([(1, text)], "doc_id long, text string")
        t0 = time.monotonic()
        row = pieces.encode(d, vocabulary).first()
        took[name] = time.monotonic() - t0
        back = pieces.decode(spark.createDataFrame([(1, row.ids)], "doc_id long, ids array<int>"), vocabulary).first().text
        assert back == text and len(row.samples) == 2
    assert took["han"] < 2 * took["blanks"] + 1


def words_of(text):
    """(type, words) of each slot or literal word, told by regular expressions and single steps."""
    ones = "one two three four five six seven eight nine".split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()
    numbers = {"zero", *ones, *"ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion trillion".split(), *tens} | {f"{a}-{b}" for a in tens for b in ones}
    out, begins, last_end = [], True, None
    for found in re.finditer(r"\S+", text):
        raw = found.group()
        core = raw.strip("".join(c for c in raw if ord(c) < 128 and not c.isalnum()))
        if not core:
            begins, last_end = begins or bool(re.search("[.!?:]", raw)), None
            continue
        lead, trail = raw[: raw.index(core)], raw[raw.index(core) + len(core) :]
        begins = begins or bool(re.search("[.!?:]", lead))
        near = last_end is not None and not lead
        word = core.lower() if core.isascii() else "".join(c.lower() if c < "\x80" else c for c in core)
        before = out[-1]["type"] if out else None
        if core[0] in "0123456789" or word in numbers:
            kind = "number"
        elif before == "number" and word in decontaminate.UNITS:
            kind = "unit"
        elif core[0].isupper() and not begins:
            kind = "name"
        else:
            kind = "word"
        if kind == "name" and near and out[-1]["type"] == "word" and out[-1]["opens"] and out[-1]["words"][0] not in decontaminate.STARTERS:
            out[-1]["type"] = before = "name"
        if near and kind == before and (kind == "name" or kind == "number" and word in numbers):
            out[-1]["words"].append(word)
        else:
            out.append({"type": kind, "words": [word], "opens": begins and core[0].isupper()})
        begins, last_end = bool(re.search("[.!?:]", trail)), None if trail else True
    flat = []
    for x in out:
        flat += [("word", (w,)) for w in x["words"]] if x["type"] == "name" and len(x["words"]) > 5 else [(x["type"], tuple(x["words"]))]
    return flat


def test_slots_equal_a_tokenizer_of_its_own():
    from evenmark.llm.common import packed

    rng = np.random.default_rng(9)
    stock = ["Anna", "Mary", "Smith", "Иван", "Ångström", "Ế", "ỉ", "river", "the", "The", "When", "12", "3.5", "forty", "two", "hundred", "twenty-one", "kg", "miles", "(Bob)", "Lee,", "end.", "so:", "-", ".", "O'Brien", "漢字", "HEAD", "X"]
    texts = [" ".join(rng.choice(stock, int(rng.integers(0, 60)))) for _ in range(300)] + ["", "A B C D E F g", "The A B C D E"]
    fixed = [decontaminate._hashes_of(x) for x in (decontaminate.UNITS, decontaminate.NUMBERS, decontaminate.STARTERS)]
    row, kind, word, slot = decontaminate.template_words(*packed(pa.array(texts)), *fixed)
    names = ["word", "number", "unit", "name"]
    several = 0
    for k, text in enumerate(texts):
        mine = np.flatnonzero(row == k)
        got = [(names[kind[i[0]]], len(i)) for i in (mine[slot[mine] == s] for s in np.unique(slot[mine]))]
        want = words_of(text)
        assert got == [(t, len(w)) for t, w in want], text
        assert (word[mine] == decontaminate._hashes_of([w for _, x in want for w in x])).all() if len(mine) else not want
        several += sum(n > 1 for _, n in got)
    assert several > 300


@pytest.mark.parametrize("bound", [2_000_000, 1])
def test_names_of_any_length_and_script(spark, bound):
    item = "In spring the farmer called Anna had 12 kg of apples and gave a part of them to Bob before the long trip to town began."
    change = lambda a, n, b: item.replace("Anna", a).replace("12", n).replace("Bob", b)
    texts = [item, change("Mary Ann Smith", "forty", "Jo Lee Fox"), change("Иван", "two hundred", "Олег Петров"), change("Ếch", "twenty-one", "Anna"), "Some other text of the farmer with apples for Anna and Bob that was never in a test.", item.upper()]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.coverage, r.reparameterised) for r in decontaminate.leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string"), bound=bound).collect()}
    assert {k: v for k, v in got.items() if k < 5} == {0: (1.0, False), 1: (1.0, True), 2: (1.0, True), 3: (1.0, True)}


def test_changed_items_are_recalled(spark):
    """At least nine of ten items are found with other names, numbers and units, among texts that are no leaks."""
    rng = np.random.default_rng(21)
    plain = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re", "sol", "win") for b in ("na", "lo", "s", "ver", "dim", "qua", "tor")]
    names = ["Anna", "Bob", "Mary Ann", "Jo Lee Fox", "Иван", "Élodie Martin", "Zoë", "Олег Петров"]
    counts = ["7", "12", "forty", "two hundred", "3.5", "ninety-nine", "1,200"]
    items, docs = [], []
    for k in range(60):
        form = [str(rng.choice(["{name}", "{count} {unit}"])) if rng.random() < 0.2 and i else str(rng.choice(plain)) for i in range(int(rng.integers(14, 30)))]

        def filled(form=form):
            return " and ".join(" ".join(form[i : i + 6]) for i in range(0, len(form), 6)).format(name=rng.choice(names), count=rng.choice(counts), unit=rng.choice(["kg", "miles", "hours"]))

        items.append((k, filled()))
        docs.append((k, " ".join(rng.choice(plain, 20)) + " so " + filled() + " and " + " ".join(rng.choice(plain, 20))))
    docs += [(1000 + k, " ".join(rng.choice([*plain, *names, *counts], 80))) for k in range(60)]
    rows = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sum(r.doc_id == r.item_id for r in rows) >= 54 and all(r.doc_id == r.item_id for r in rows)


# --- short licence headers


def header_brute(line):
    """(score, licence) of the short name that a header gives, by plain Python."""
    low = re.sub(r"\b(agpl|apache|artistic|bsd|cc0|epl|gpl|lgpl|mpl)[ -]?(v\.?)?(?=[0-9])", r"\1 ", line.lower())
    low = re.sub(r"\b([0-9])-clause", r"\1 clause", low)
    terms = set()
    for x in re.split(r"[^a-z0-9.\-]+", low):
        x = x.rstrip(".-")
        number = re.fullmatch(r"v?(\d+)(\.\d+)*", x)
        if number:
            x = x.lstrip("v")
            x = x[:-2] if x.endswith(".0") else x
        if x and x not in licenses.FILLERS:
            terms.add(x)
    names = [(k, set(x.split())) for k, xs in licenses.NAMES.items() for x in xs]
    idf = lambda w: np.log((len(names) + 1) / (sum(w in x for _, x in names) + 1)) + 1
    size = lambda x: np.sqrt(sum(idf(w) ** 2 for w in x))
    scores = [(sum(idf(w) ** 2 for w in terms & x) / size(terms) / size(x), k) for k, x in names] if terms else []
    return max((x for x in scores if x[0] >= 0.75), default=None)


def test_short_headers_name_their_licence(spark):
    lines = {
        "The MIT License": "MIT",
        "MIT License": "MIT",
        "The MIT License (MIT)": "MIT",
        "Licensed under MIT": "MIT",
        "This project is licensed under the MIT License - see the LICENSE file for details": "MIT",
        "Distributed under the BSD license": "BSD",
        "License: GPLv3": "GPL-3.0",
        "License: GPL-2.0": "GPL-2.0",
        "Licensed under the GNU GPL, version 3.0": "GPL-3.0",
        "license = Apache 2.0": "Apache-2.0",
        "Licensed under LGPL v2.1": "LGPL-2.1",
        "BSD 3-Clause License": "BSD-3-Clause",
        "BSD-2-Clause licence": "BSD-2-Clause",
        "Mozilla Public License 2.0": "MPL-2.0",
        "Not licensed under MIT": None,
        "Students of MIT need no license plates": None,
        "The license of the house": None,
        "": None,
    }
    rows = [(k, f"https://a.org/{k}/x", x) for k, x in enumerate(lines)]
    rows.append((100, "https://a.org/100/x", "All rights reserved\nMIT License"))
    found = {r.page_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {x: found[k].license for k, x in enumerate(lines)} == lines and found[100].license == "MIT"
    for k, x in enumerate(lines):
        want = header_brute(x) if re.search(licenses.ANCHORS, x) else None
        named = found[k].license is not None and want is not None and want[1] == found[k].license
        assert named or want is None, x
