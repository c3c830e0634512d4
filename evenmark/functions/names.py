"""Name normalisation and similarity; batches of text in Arrow, since Spark has neither accent folding nor Jaro-Winkler."""

from __future__ import annotations

import itertools
import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Endings that are no part of a surname.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def tokens(name: str | None) -> list[str]:
    """Lower-case ASCII words without accents, punctuation and endings."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c))
    words = re.sub(r"[^a-z0-9]+", " ", flat.lower()).split()
    while len(words) > 1 and words[-1] in SUFFIXES:
        words.pop()
    return words


@F.pandas_udf(StringType())
def normal_name(names: pd.Series) -> pd.Series:
    """The words of a name, joined by blanks."""
    return names.map(lambda x: None if x is None else " ".join(tokens(x)))


def similarity(a: str, b: str) -> float:
    """Jaro-Winkler with the prefix bonus at any score."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left, right_at = [True] * len(b), [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                right_at.append(j)
                break
    m = len(left)
    if not m:
        return 0.0
    moved = sum(c != b[j] for c, j in zip(left, sorted(right_at), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


#: Letters of a text that the batched kernel takes; longer pairs are compared one by one.
WIDE = 64


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """`similarity` of each pair, a batch at once: one step for each letter of the longest left text."""
    out = np.zeros(len(left))
    size_a, size_b = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    far = (size_a > WIDE) | (size_b > WIDE)
    for k in np.flatnonzero(far):
        out[k] = similarity(left[k], right[k])
    some = np.flatnonzero(~far & (size_a > 0) & (size_b > 0))
    if not len(some):
        return out
    n, la, lb = size_a[some], int(size_a[some].max()), int(size_b[some].max())
    a = np.array([left[k] for k in some], f"<U{la}").view(np.uint32).reshape(len(some), la)
    b = np.array([right[k] for k in some], f"<U{lb}").view(np.uint32).reshape(len(some), lb)
    nb, at_b = size_b[some], np.arange(lb)
    reach = np.maximum(0, np.maximum(n, nb) // 2 - 1)
    free, hit = at_b < nb[:, None], np.zeros(a.shape, bool)
    rows = np.arange(len(some))
    for i in range(la):
        can = free & (b == a[:, i : i + 1]) & (np.abs(at_b - i) <= reach[:, None]) & (i < n)[:, None]
        first = can.argmax(1)
        hit[:, i] = can[rows, first]
        free[rows, first] &= ~hit[:, i]
    taken = (at_b < nb[:, None]) & ~free
    m = hit.sum(1)
    width = min(la, lb)
    in_a = np.take_along_axis(a, np.argsort(~hit, 1, kind="stable"), 1)[:, :width]
    in_b = np.take_along_axis(b, np.argsort(~taken, 1, kind="stable"), 1)[:, :width]
    moved = ((in_a != in_b) & (np.arange(width) < m[:, None])).sum(1) / 2
    most = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / n + m / nb + (most - moved) / most) / 3, 0)
    head = min(4, la, lb)
    equal = (a[:, :head] == b[:, :head]) & (np.arange(head) < np.minimum(n, nb)[:, None])
    same = np.logical_and.accumulate(equal, 1).sum(1)
    out[some] = np.where(m > 0, jaro + same * 0.1 * (1 - jaro), 0)
    return out


def alias_score(name: str, alias: str) -> float:
    """1 for equal names, 0.96 for an initial and the surname, else their similarity."""
    return _score(tokens(name), tokens(alias))


def _score(x: list[str], y: list[str]) -> float:
    if "".join(x) == "".join(y):
        return 1.0
    return 0.96 if _initial(x, y) else similarity("".join(x), "".join(y))


def _initial(x: list[str], y: list[str]) -> bool:
    return len(x) == 2 and len(x[0]) == 1 and len(y) >= 2 and x[0] == y[0][0] and x[1] == y[-1]


def least_shared(least: float, prefix: int) -> float:
    """t of: a pair of similarity `least` whose first `prefix` letters at most agree shares m letters with m / size_a + m / size_b >= t."""
    jaro = (least - 0.1 * prefix) / (1 - 0.1 * prefix)
    return 3 * jaro - 1


def spelt(name: str) -> list[str]:
    """A normal name's letters, each with how many such there are up to it: equal texts of letters, as sets."""
    seen: dict[str, int] = {}
    out = []
    for c in name.replace(" ", ""):
        seen[c] = seen.get(c, 0) + 1
        out.append(f"{c}{seen[c]}")
    return out


@F.pandas_udf(ArrayType(StringType()))
def spelling(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else spelt(x))


def _width(a: int, b: int, shared: int, most: int = 60) -> int:
    """How many letters make a key for texts of sizes a and b: up to three, as long as a text has no more than `most` keys."""
    return max((w for w in range(1, min(3, shared) + 1) if max(math.comb(n - shared + w, w) for n in (a, b)) <= most), default=1)


def index_keys(order: dict[str, int], sizes: list[int], t: float, first: bool):
    """A column function: a normal name's keys in the index of letters, for every size that its partner may have.

    Two texts of sizes a and b that share o letters at least have, in one order of letters, the first w shared ones among
    the first a - o + w of one and the first b - o + w of the other. So each gives all choices of w of those letters.
    `first`: whether the name is the first of a pair.
    """

    def keys(name):
        if not name or not name.replace(" ", ""):
            return []
        mine = sorted(spelt(name), key=order.__getitem__)
        a, out = len(mine), []
        for b in sizes:
            shared = math.ceil(t * a * b / (a + b) - 1e-9)
            if shared <= min(a, b):
                w = _width(a, b, shared)
                out += [f"{a if first else b}.{b if first else a}." + "".join(c) for c in itertools.combinations(mine[: a - shared + w], w)]
        return out

    @F.pandas_udf(ArrayType(StringType()))
    def of(names: pd.Series) -> pd.Series:
        return names.map(keys)

    return of


def _letters(words: np.ndarray) -> np.ndarray:
    """How often each of a to z and 0 to 9 stands in each text."""
    out = np.zeros((len(words), 36), np.int16)
    for k, w in enumerate(words):
        raw = np.frombuffer(w.replace(" ", "").encode(), np.uint8)
        np.add.at(out[k], np.where(raw >= 97, raw - 97, raw - 22), 1)
    return out


def most_similar(left: pd.Series, right: pd.Series) -> np.ndarray:
    """A bound that no pair's similarity exceeds, from the letters that both texts have: as if all of them matched, in order, and the beginnings were equal."""
    a_of, a = pd.factorize(left)
    b_of, b = pd.factorize(right)
    x, y = _letters(np.asarray(a)), _letters(np.asarray(b))
    m = np.minimum(x[a_of], y[b_of]).sum(1)
    size = np.maximum(1, x.sum(1)[a_of]), np.maximum(1, y.sum(1)[b_of])
    jaro = np.where(m > 0, (m / size[0] + m / size[1] + 1) / 3, 0)
    return jaro + 0.4 * (1 - jaro)


def score_names(least: float):
    """A column function of two columns of normal names: the alias score, or null where it cannot reach `least`.

    Pairs are first bounded by their letters, a batch at a time; what is left is scored once for each different pair, all of a batch at once.
    """

    @F.pandas_udf(DoubleType())
    def score(names: pd.Series, aliases: pd.Series) -> pd.Series:
        out = np.full(len(names), np.nan)
        here = np.flatnonzero(names.notna() & aliases.notna())
        a, b = names.iloc[here], aliases.iloc[here]
        initial = a.str.len().gt(1) & a.str[1].eq(" ")
        some = here[(most_similar(a, b) >= least) | initial.to_numpy()]
        pairs = pd.MultiIndex.from_arrays([names.iloc[some], aliases.iloc[some]])
        code, each = pairs.factorize()
        x, y = ([v.split() for v in each.get_level_values(k)] for k in (0, 1))
        left, right = (["".join(v) for v in side] for side in (x, y))
        found = similarities(left, right)
        for k, (p, q) in enumerate(zip(x, y, strict=True)):
            found[k] = 1.0 if left[k] == right[k] else 0.96 if _initial(p, q) else found[k]
        out[some] = found[code]
        return pd.Series(np.where(out >= least, out, np.nan))

    return score
