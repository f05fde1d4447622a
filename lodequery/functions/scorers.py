"""String similarity and distance as plain functions of two strings (or sequences) and as Arrow column functions.

Similarities of the ``ratio`` family run from 0 to 100. Each takes an optional ``cutoff``: results below it are 0.
``column(name)`` gives a pandas function of two columns; null on either side gives null (0 for the ratio family). Distinct
pairs are scored once per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Sequence


def lcs(a: Text, b: Text) -> int:
    """Length of the longest common subsequence, by one integer of bits per row."""
    if not a or not b:
        return 0
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        hit = s & where.get(c, 0)
        s = (s + hit | s - hit) & full
    return len(a) - s.bit_count()


def indel(a: Text, b: Text) -> int:
    return len(a) + len(b) - 2 * lcs(a, b)


def levenshtein(a: Text, b: Text, weights: tuple[int, int, int] = (1, 1, 1)) -> int:
    """Edit distance with weights for insertion, deletion and substitution."""
    ins, dele, sub = weights
    row = [j * ins for j in range(len(b) + 1)]
    for x in a:
        diagonal, row[0] = row[0], row[0] + dele
        for j, y in enumerate(b, 1):
            best = diagonal if x == y else min(diagonal + sub, row[j] + dele, row[j - 1] + ins)
            diagonal, row[j] = row[j], best
    return row[-1]


def levenshtein_most(a: Text, b: Text, weights: tuple[int, int, int] = (1, 1, 1)) -> int:
    """The greatest distance two strings of these lengths can have."""
    ins, dele, sub = weights
    m, n = len(a), len(b)
    replaced = min(m, n) * sub + (m - n) * dele if m >= n else m * sub + (n - m) * ins
    return min(m * dele + n * ins, replaced)


def hamming(a: Text, b: Text, pad: bool = True) -> int:
    if not pad and len(a) != len(b):
        raise ValueError("sequences are not of the same length")
    return sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))


def osa(a: Text, b: Text) -> int:
    """Edit distance with swaps of neighbours, none of them edited again."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1)
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        before, row = row, new
    return row[-1]


def damerau_levenshtein(a: Text, b: Text) -> int:
    """Edit distance with swaps of letters that may be edited between."""
    seen: dict = {}
    far = len(a) + len(b)
    d = {(-1, j): far for j in range(-1, len(b) + 1)} | {(i, -1): far for i in range(-1, len(a) + 1)}
    for i in range(len(a) + 1):
        d[i, 0] = i
    for j in range(len(b) + 1):
        d[0, j] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            if x == y:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + (x != y), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        seen[x] = i
    return d[len(a), len(b)]


def jaro(a: Text, b: Text) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = set(), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in taken and b[j] == x:
                taken.add(j)
                left.append(x)
                break
    if not left:
        return 0.0
    swaps = sum(x != b[j] for x, j in zip(left, sorted(taken))) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: Text, b: Text, prefix_weight: float = 0.1) -> float:
    if not 0 <= prefix_weight <= 1:
        raise ValueError("prefix_weight must lie from 0 to 1")
    sim = jaro(a, b)
    return sim + min(prefix(a, b), 4) * prefix_weight * (1 - sim) if sim > 0.7 else sim


def prefix(a: Text, b: Text) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def postfix(a: Text, b: Text) -> int:
    return prefix(a[::-1], b[::-1])


def _share(part: float, whole: float, empty: float) -> float:
    return part / whole if whole else empty


def lcs_normalized_similarity(a: Text, b: Text) -> float:
    """1 where either side is empty, as their distance is taken as 0."""
    return 1 - (0.0 if not a or not b else 1 - lcs(a, b) / max(len(a), len(b)))


# --- the ratio family


def _cut(score: float, cutoff: float) -> float:
    return score if score >= cutoff else 0.0


def ratio(a: Text, b: Text, cutoff: float = 0) -> float:
    whole = len(a) + len(b)
    return _cut((1 - indel(a, b) / whole) * 100 if whole else 100.0, cutoff)


def _words(s: str) -> list[str]:
    return s.split()


def partial_ratio_alignment(a: str, b: str, cutoff: float = 0) -> tuple[float, int, int, int, int] | None:
    """(score, start and end in a, start and end in b) of the best window of the longer string, the first of the best;
    null below the cutoff. Strings of one length are tried both ways."""
    if not a and not b:
        return (100.0, 0, 0, 0, 0)
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _window(short, long)
    if len(a) == len(b) and best[0] < 100:
        other = _window(long, short)
        if other[0] > best[0]:
            best = (other[0], other[3], other[4], other[1], other[2])
    if best[0] < cutoff:
        return None
    s, i, j, k, m = best
    return (s, i, j, k, m) if short is a else (s, k, m, i, j)


def _window(short: str, long: str) -> tuple[float, int, int, int, int]:
    n, letters = len(short), set(short)
    best = (0.0, 0, n, 0, n)
    if not n:
        return best
    spans = [(0, i) for i in range(1, n) if long[i - 1] in letters]
    spans += [(i, i + n) for i in range(len(long) - n) if long[i + n - 1] in letters]
    spans += [(i, len(long)) for i in range(len(long) - n, len(long)) if long[i] in letters]
    for s, e in spans:
        score = ratio(short, long[s:e])
        if score > best[0]:
            best = (score, 0, n, s, e)
            if score == 100:
                break
    return best


def _partial_bound(a: str, b: str) -> float:
    """No partial ratio of two strings is greater: letters they share, at most that many in a row of the shorter one."""
    n = min(len(a), len(b))
    common = sum(min(a.count(c), b.count(c)) for c in set(a))
    return 200.0 * min(common, n) / (n + min(common, n)) if n and common else 0.0


def partial_ratio(a: str, b: str, cutoff: float = 0) -> float:
    if cutoff > 0 and a and b and _partial_bound(a, b) < cutoff:
        return 0.0
    found = partial_ratio_alignment(a, b, cutoff)
    return found[0] if found else 0.0


def token_sort_ratio(a: str, b: str, cutoff: float = 0) -> float:
    return ratio(" ".join(sorted(_words(a))), " ".join(sorted(_words(b))), cutoff)


def _sides(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(_words(a)), set(_words(b))
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set_ratio(a: str, b: str, cutoff: float = 0) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, only_a, only_b = _sides(a, b)
    if both and not (only_a and only_b):
        return 100.0
    n, x, y = len(both), len(only_a), len(only_b)
    with_a, with_b = n + bool(n) + x, n + bool(n) + y
    score = 100 - 100 * indel(only_a, only_b) / (with_a + with_b)
    if n:
        score = max(score, 100 - 100 * (1 + x) / (n + with_a), 100 - 100 * (1 + y) / (n + with_b))
    return _cut(score, cutoff)


def token_ratio(a: str, b: str, cutoff: float = 0) -> float:
    return _cut(max(token_sort_ratio(a, b), token_set_ratio(a, b)), cutoff)


def partial_token_sort_ratio(a: str, b: str, cutoff: float = 0) -> float:
    return partial_ratio(" ".join(sorted(_words(a))), " ".join(sorted(_words(b))), cutoff)


def partial_token_set_ratio(a: str, b: str, cutoff: float = 0) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, only_a, only_b = _sides(a, b)
    return 100.0 if both else partial_ratio(only_a, only_b, cutoff)


def partial_token_ratio(a: str, b: str, cutoff: float = 0) -> float:
    both, only_a, only_b = _sides(a, b)
    if both:
        return 100.0
    score = partial_token_sort_ratio(a, b, cutoff)
    if len(_words(a)) != len(set(_words(a))) or len(_words(b)) != len(set(_words(b))):
        score = max(score, partial_ratio(only_a, only_b, cutoff))
    return _cut(score, cutoff)


def weighted_ratio(a: str, b: str, cutoff: float = 0) -> float:
    """The best of the plain, token and partial ratios, the latter two weighted down."""
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    score = ratio(a, b)
    if apart < 1.5:
        return _cut(max(score, token_ratio(a, b) * 0.95), cutoff)
    scale = 0.9 if apart <= 8 else 0.6
    score = max(score, partial_ratio(a, b, max(score, cutoff) / scale - 1e-9) * scale)
    return _cut(max(score, partial_token_ratio(a, b, max(score, cutoff) / scale / 0.95 - 1e-9) * 0.95 * scale), cutoff)


def quick_ratio(a: str, b: str, cutoff: float = 0) -> float:
    return ratio(a, b, cutoff) if a and b else 0.0


# --- edit scripts


def editops(a: Text, b: Text, replace: bool = True) -> list[tuple[str, int, int]]:
    """(delete, insert or replace; place in a; place in b) steps of a least edit script. Without ``replace``, of the one with
    insertions and deletions only. From the end, a deletion is preferred to an insertion and that to a replacement."""
    lead = prefix(a, b)
    tail = postfix(a[lead:], b[lead:])
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            if not i or not j:
                d[i][j] = i + j
            elif x[i - 1] == y[j - 1]:
                d[i][j] = d[i - 1][j - 1]
            else:
                d[i][j] = 1 + min(d[i - 1][j], d[i][j - 1], *([d[i - 1][j - 1]] if replace else []))
    out, i, j = [], len(x), len(y)
    while i or j:
        if i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append(("delete", i + lead, j + lead))
        elif j and d[i][j] == d[i][j - 1] + 1:
            j -= 1
            out.append(("insert", i + lead, j + lead))
        else:
            i, j = i - 1, j - 1
            if x[i] != y[j]:
                out.append(("replace", i + lead, j + lead))
    return out[::-1]


def hamming_editops(a: Text, b: Text) -> list[tuple[str, int, int]]:
    n = min(len(a), len(b))
    out = [("replace", i, i) for i in range(n) if a[i] != b[i]]
    return out + [("delete", i, n) for i in range(n, len(a))] + [("insert", n, j) for j in range(n, len(b))]


def opcodes(ops: list[tuple[str, int, int]], len_a: int, len_b: int) -> list[tuple[str, int, int, int, int]]:
    """Runs (tag, a from, a to, b from, b to) covering both sequences, equal runs included."""
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for tag, at_a, at_b in ops:
        if at_a > i or at_b > j:
            out.append(("equal", i, at_a, j, at_b))
            i, j = at_a, at_b
        to_a, to_b = i + (tag != "insert"), j + (tag != "delete")
        if out and out[-1][0] == tag and out[-1][2] == i and out[-1][4] == j:
            out[-1] = (tag, out[-1][1], to_a, out[-1][3], to_b)
        else:
            out.append((tag, i, to_a, j, to_b))
        i, j = to_a, to_b
    if i < len_a or j < len_b:
        out.append(("equal", i, len_a, j, len_b))
    return out


def to_editops(codes: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int]]:
    """The single steps of runs; the inverse of :func:`opcodes`."""
    out = []
    for tag, a, a_to, b, b_to in codes:
        if tag == "delete":
            out += [(tag, i, b) for i in range(a, a_to)]
        elif tag == "insert":
            out += [(tag, a, j) for j in range(b, b_to)]
        elif tag == "replace":
            out += [(tag, a + k, b + k) for k in range(a_to - a)]
    return out


def matching_blocks(codes: list[tuple[str, int, int, int, int]], len_a: int, len_b: int) -> list[tuple[int, int, int]]:
    return [(a, b, a_to - a) for tag, a, a_to, b, _ in codes if tag == "equal"] + [(len_a, len_b, 0)]


def inverse(ops: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    other = {"insert": "delete", "delete": "insert"}
    return [(other.get(tag, tag), j, i) for tag, i, j in ops]


def apply(ops: list[tuple[str, int, int]], a: str, b: str) -> str:
    """What the script makes of ``a``, letters taken from ``b``."""
    out, i = [], 0
    for tag, at, to in ops:
        out.append(a[i:at])
        i = at
        if tag != "delete":
            out.append(b[to])
        if tag != "insert":
            i += 1
    return "".join(out) + a[i:]


def remove_subsequence(ops: list[tuple[str, int, int]], part: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The steps left once ``part`` has been applied, places moved accordingly; an error if it is no subsequence."""
    out, moved, k = [], 0, 0
    for op in ops:
        if k < len(part) and op == part[k]:
            moved += {"insert": 1, "delete": -1}.get(op[0], 0)
            k += 1
        else:
            out.append((op[0], op[1] + moved, op[2]))
    if k < len(part):
        raise ValueError("not a subsequence")
    return out


def validate(ops: list[tuple[str, int, int]], len_a: int, len_b: int) -> None:
    """An error unless the steps lie in order within both lengths."""
    last = (0, 0)
    for tag, i, j in ops:
        if tag not in ("insert", "delete", "replace"):
            raise ValueError(f"unknown step {tag}")
        if not (0 <= i <= len_a - (tag != "insert")) or not (0 <= j <= len_b - (tag != "delete")):
            raise ValueError("a step lies outside")
        if (i, j) < last or i < last[0] or j < last[1]:
            raise ValueError("steps are out of order")
        last = (i + (tag != "insert"), j + (tag != "delete"))


# --- column functions

RATIOS: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio, "token_ratio": token_ratio,
    "partial_token_sort_ratio": partial_token_sort_ratio, "partial_token_set_ratio": partial_token_set_ratio, "partial_token_ratio": partial_token_ratio,
    "weighted_ratio": weighted_ratio, "quick_ratio": quick_ratio,
}
_longest: Callable[[Text, Text], int] = lambda a, b: max(len(a), len(b))
#: name: (distance, greatest distance), from which similarity and both normalised forms follow.
DISTANCES: dict[str, tuple[Callable[[Text, Text], float], Callable[[Text, Text], float]]] = {
    "levenshtein": (levenshtein, levenshtein_most), "indel": (indel, lambda a, b: len(a) + len(b)), "lcs_seq": (lambda a, b: _longest(a, b) - lcs(a, b), _longest),
    "hamming": (hamming, _longest), "osa": (osa, _longest), "damerau_levenshtein": (damerau_levenshtein, _longest),
    "jaro": (lambda a, b: 1 - jaro(a, b), lambda a, b: 1.0), "jaro_winkler": (lambda a, b: 1 - jaro_winkler(a, b), lambda a, b: 1.0),
    "prefix": (lambda a, b: _longest(a, b) - prefix(a, b), _longest), "postfix": (lambda a, b: _longest(a, b) - postfix(a, b), _longest),
}
FORMS = ("distance", "similarity", "normalized_distance", "normalized_similarity")
SCRIPT = "array<struct<tag: string, a: int, b: int>>"


def function(name: str) -> Callable[[str, str], float]:
    """A scorer by name: one of the ratio family, or ``<metric>_<form>`` such as ``jaro_normalized_similarity``."""
    if name in RATIOS:
        return RATIOS[name]
    for form in sorted(FORMS, key=len, reverse=True):
        metric = name[: -len(form) - 1]
        if name.endswith("_" + form) and metric in DISTANCES:
            distance, most = DISTANCES[metric]
            if form == "distance":
                return distance
            if form == "similarity":
                return lambda a, b: most(a, b) - distance(a, b)
            empty = metric == "lcs_seq"
            share = lambda a, b: 0.0 if empty and not (a and b) else _share(distance(a, b), most(a, b), 0.0)
            return share if form == "normalized_distance" else lambda a, b: 1 - share(a, b)
    raise KeyError(name)


def best_is_high(name: str) -> bool:
    """Whether greater values of a scorer mean more alike."""
    return name in RATIOS or name.endswith("similarity")


def column(name: str, cutoff: float | None = None) -> Callable[[Column, Column], Column]:
    """The scorer as a function of two string columns, giving doubles."""
    score, family = function(name), name in RATIOS

    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(0.0 if family else None)
                continue
            if (x, y) not in known:
                known[x, y] = float(score(x, y, cutoff) if cutoff is not None and family else score(x, y))
            out.append(known[x, y])
        return pd.Series(out, dtype="float64")

    return scored


def _letters(texts: list[str]) -> np.ndarray:
    """How often each of 64 classes of characters occurs in each text; the first is that of spaces."""
    out = np.zeros((len(texts), 64), np.int16)
    for i, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        out[i] = np.bincount(np.where(codes == 32, 0, codes % 63 + 1), minlength=64)
    return out


def weighted_above(a: list[str], b: list[str], least: np.ndarray, words: np.ndarray, joined: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """:func:`weighted_ratio` of each pair of texts in normal form where it is at least ``least``, else 0. ``words`` and
    ``joined``: how many words the two share and how long these are, joined by spaces; ``repeats``: whether either repeats a
    word.

    Letters that only one of two texts has must be edited, which bounds all ratios from above; pairs that cannot reach
    ``least`` are not compared, nor are those whose score a shared word decides."""
    out = np.zeros(len(a))
    if not len(a):
        return out
    (x, i), (y, j) = (np.unique(np.array(t, object), return_inverse=True) for t in (a, b))
    counts_a, counts_b = _letters(list(x)), _letters(list(y))
    size_a, size_b = np.array([len(t) for t in x])[i], np.array([len(t) for t in y])[j]
    apart = np.abs(counts_a[i] - counts_b[j])
    edits, no_spaces = apart.sum(axis=1, dtype=np.int64), apart[:, 1:].sum(axis=1, dtype=np.int64)
    total, short = size_a + size_b, np.minimum(size_a, size_b)
    some = (size_a > 0) & (size_b > 0)
    total_1, short_1 = np.maximum(total, 1), np.maximum(short, 1)
    plain = 100 - 100 * edits / total_1
    rest_a, rest_b = size_a - joined - 1, size_b - joined - 1
    by_words = np.where(words > 0, 100 - 100 * (1 + np.maximum(np.minimum(rest_a, rest_b), 0)) / np.maximum(joined + np.where(rest_a <= rest_b, size_a, size_b), 1), 0)
    by_words = np.where((words > 0) & (np.minimum(rest_a, rest_b) < 0), 100, by_words)
    by_sets = np.where(repeats, 100, np.maximum(np.maximum(plain, 100 - 100 * no_spaces / total_1), by_words))
    far = np.maximum(size_a, size_b) / short_1
    same = (total - edits) / 2
    part = np.where(repeats, 100, 200 * same / (short_1 + same))
    scale = np.where(far <= 8, 0.9, 0.6)
    by_part = np.where(words > 0, 100, part) * 0.95 * scale
    most = np.where(far < 1.5, np.maximum(plain, by_sets * 0.95), np.maximum(np.maximum(plain, part * scale), by_part))
    # a shared word gives far texts a fixed score, and unless they hold nearly the same letters nothing else exceeds it
    given = (far >= 1.5) & (words > 0) & (np.maximum(plain, part * scale) <= 100 * 0.95 * scale - 1e-6)
    out[given & some] = (100 * 0.95 * scale)[given & some]
    for k in np.flatnonzero(some & ~given & (most >= least - 1e-6)):
        out[k] = weighted_ratio(a[k], b[k], float(least[k]))
    return np.where(out >= least, out, 0.0)


def weighted_column(a: Column, b: Column, least: Column) -> Column:
    """:func:`weighted_above` of two columns in normal form; null gives 0."""

    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series, least: pd.Series, words: pd.Series, joined: pd.Series, repeats: pd.Series) -> pd.Series:
        return pd.Series(weighted_above(a.tolist(), b.tolist(), least.to_numpy(), words.to_numpy(), joined.to_numpy(), repeats.to_numpy(bool)))

    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    x, y = (F.filter(F.split(t, " "), lambda w: w != "") for t in (a, b))
    both = F.array_intersect(x, y)
    repeats = (F.size(F.array_distinct(x)) < F.size(x)) | (F.size(F.array_distinct(y)) < F.size(y))
    return scored(a, b, least, F.size(both), F.length(F.array_join(both, " ")), repeats)


def script_column(kind: str = "levenshtein") -> Callable[[Column, Column], Column]:
    """Edit scripts as an array of steps (explode it for one row per step); null for null. Kinds: levenshtein, indel, hamming."""
    make = {"levenshtein": editops, "indel": lambda a, b: editops(a, b, replace=False), "hamming": hamming_editops}[kind]

    @F.pandas_udf(SCRIPT)
    def steps(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else [dict(zip(("tag", "a", "b"), s)) for s in make(x, y)] for x, y in zip(a, b)], dtype=object)

    return steps


