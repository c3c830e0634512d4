"""The batched similarity and the index of letters against one pair at a time."""

import random

import pytest
from evenmark.functions import names as N
from evenmark.operators import identity as I


def people(n, seed):
    rng = random.Random(seed)
    first, last = ["Ann", "Anna", "Ánna", "Jo", "J.", "John", "Jon", "Maria", "Mario", "X", "De'Andre", "Zoë"], ["Smith", "Smyth", "Smithson", "O'Neil", "Oneil Jr.", "Li", "Lee", "Fox", "Foxx III", "van der Berg"]
    out = [f"{rng.choice(first)} {rng.choice(last)}" for _ in range(n)]
    for k in range(0, n, 3):  # a slip: a letter lost, doubled or swapped
        x, i = out[k], rng.randrange(len(out[k]) - 1)
        out[k] = rng.choice([x[:i] + x[i + 1 :], x[:i] + x[i] + x[i:], x[:i] + x[i + 1] + x[i] + x[i + 2 :]])
    return out + ["", "a", "ab", "J Smith", "long " * 30 + "name", "long " * 30 + "nama"]


def test_similarities_of_a_batch():
    rng = random.Random(1)
    words = ["".join(N.tokens(x)) for x in people(150, 2)] + ["".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(150)]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(4000)]
    got = N.similarities(*(list(x) for x in zip(*pairs, strict=True)))
    assert all(abs(g - N.similarity(a, b)) < 1e-12 for g, (a, b) in zip(got, pairs, strict=True) if (a, b) != ("", ""))
    assert len(N.similarities([], [])) == 0


@pytest.mark.parametrize("least", [0.82, 0.9, 0.94, 0.97])
def test_index_finds_what_all_pairs_find(spark, least):
    left = [(k % 2, n) for k, n in enumerate(people(120, 3))] + [(None, "Ann Smith"), (0, None)]
    right = [(k % 2, f"id{k}", n) for k, n in enumerate(people(120, 4))] + [(0, "none", None)]
    names, candidates = spark.createDataFrame(left, "team int, name string"), spark.createDataFrame(right, "team int, identity string, alias string")
    form = lambda few: {(r.team, r.name, r.identity): round(r.score, 9) for r in I.scored_pairs(names, candidates, ["team"], least, few).collect()}
    want = {}
    for t, n in left:
        for u, i, a in right:
            if t is not None and t == u and None not in (n, a) and (N.tokens(n) or N.tokens(a)) and (s := N.alias_score(n, a)) >= least:
                want[t, n, i] = max(round(s, 9), want.get((t, n, i), 0))
    assert form(0) == form(10**9) == want and len(want) > 50


def test_index_makes_few_pairs(spark):
    """Of names of many letters in one block the index pairs less than one in twenty-five."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    rows = [f"{word()} {word()}" for _ in range(600)]
    left = spark.createDataFrame([(1, x, x) for x in rows], "team int, name string, _a string")
    right = spark.createDataFrame([(1, x, x, x[:-1]) for x in rows], "team int, identity string, alias string, _b string")
    assert 600 <= I.candidate_pairs(left, right, ["team"], 0.9).count() < 600 * 600 / 25
