"""Queries brought to the words that were meant, whatever keyboard or alphabet they were typed with.

Words in Cyrillic letters only lose their ё. Where a query has Latin letters, each of its words is looked up in the
vocabulary of Cyrillic words: by its skeleton (Latin spelling), by what the same keys give on a Russian keyboard, or by
its look-alikes. The reading that explains most letters of the query wins; words that no reading explains stay Latin.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..text import words
from . import spelling as sp

#: Vocabulary keys that are broadcast at most (about 150 bytes each in a worker); a larger vocabulary is joined by shuffle.
BROADCAST_KEYS = 1_000_000
_HAS_LATIN = re.compile("[a-z]")
_CHUNK = re.compile(r"([a-z0-9\[\];',.`{}:\"<>~]+)")
_PUNCTUATION = re.compile(r"[\[\];',.`{}:\"<>~]")


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """(key, word, n): the Cyrillic words of all texts under the keys they are looked up by. Of the words that share a
    key the most frequent is kept, the least of those equally frequent."""
    counts = texts.select(F.explode(words(F.col(text))).alias("w")).filter(r"w rlike '[\\u0400-\\u04ff]' and not w rlike '[a-z]'").groupBy("w").agg(F.count(F.lit(1)).alias("n"))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = b["w"].str.replace("ё", "е")
            kinds = [("w:", w), ("s:", w.map(sp.skeleton)), *(("t:", w.map(lambda x, k=k: sp.transliterations(x)[k])) for k in range(3))]
            yield pd.concat([pd.DataFrame({"key": p + keys, "word": w, "n": b["n"]}) for p, keys in kinds]).drop_duplicates(["key", "word"])

    summed = counts.mapInPandas(keyed, "key string, word string, n bigint").groupBy("key", "word").agg(F.sum("n").alias("n"))
    return summed.groupBy("key").agg(F.max(F.struct("n", F.col("word"))).alias("best")).select("key", F.col("best.word").alias("word"), F.col("best.n").alias("n"))


def _pieces(chunk: str, longest: int | None) -> Iterator[tuple[int, int, list[str]]]:
    """(j, k, words): the words that the keys between two bounds of a chunk mean, marks between taken as letters. Bounds are its
    ends and punctuation marks. A part with marks inside and of more letters than the longest known word is no word."""
    bounds = [-1, *(m.start() for m in _PUNCTUATION.finditer(chunk)), len(chunk)]
    for k in range(1, len(bounds)):
        for j in range(k - 1, -1, -1):
            if longest is not None and j < k - 1 and bounds[k] - bounds[j] - 1 > longest:
                break
            yield j, k, sp._WORD.findall(sp.from_keys(chunk[bounds[j] + 1 : bounds[k]]).replace("ё", "е"))


def key_pieces(chunk: str, longest: int | None) -> Iterator[list[str]]:
    """The words of all parts of a chunk that :func:`key_reading` tries."""
    return (words for _, _, words in _pieces(chunk, longest))


def key_reading(chunk: str, cost: Callable[[str], int | None], longest: int | None = None) -> list[str] | None:
    """The words that the keys of a chunk mean, each punctuation mark a letter or a separator: the reading of least total cost,
    of several that with the fewest separators, then the first ones. A word of cost None is in no reading; None where no
    reading is left. Any number of marks is read, bound by bound: what is best up to a separator is best whatever follows.
    ``longest``: letters of the longest word that is known, so the work grows with the length of the chunk only."""
    # (cost, parts) of the best reading up to each bound, the bound before it and the words between
    best: dict[int, tuple[int, int, int, list[str]]] = {0: (0, 0, -1, [])}
    last = 0
    for j, k, words in _pieces(chunk, longest):
        last = k
        if j not in best or None in (costs := list(map(cost, words))):
            continue
        total, n = best[j][0] + sum(costs), best[j][1] + 1
        old = best.get(k)
        if old is None or (total, n) < old[:2] or (total, n) == old[:2] and _earlier(best, j, old[2]):
            best[k] = (total, n, j, words)
    if last not in best:
        return None
    out: list[list[str]] = []
    while last > 0:
        out.append(best[last][3])
        last = best[last][2]
    return [w for words in reversed(out) for w in words]


def _earlier(best: dict, i: int, j: int) -> bool:
    """Whether the bounds of the best reading up to ``i`` come before those up to ``j``, which are as many."""
    a, b = [], []
    while i > 0 or j > 0:
        a, b = [i, *a], [j, *b]
        i, j = best[i][2], best[j][2]
    return a < b


def lookups(text: str, longest: int | None = None) -> list[str]:
    """All vocabulary keys that :func:`meant` may ask for this text."""
    text = sp.clean(text)
    if not _HAS_LATIN.search(text):
        return []
    out = set()
    for w in map(sp.looked, sp._WORD.findall(text)):
        if _HAS_LATIN.search(w):
            out.update(("t:" + w, "s:" + sp.skeleton(w)))
            if (a := sp.all_looked(w)) is not None:
                out.add("w:" + a)
    for chunk in sp._KEYED.findall(text):
        if _HAS_LATIN.search(chunk):
            out.update("w:" + w for words in key_pieces(chunk, longest) for w in words)
    return sorted(out)


class Meaning:
    """The words meant by texts. ``get`` gives the Cyrillic word of a vocabulary key or None, ``longest`` is the length of the
    longest such word. What was found for a word or a part between spaces is remembered."""

    def __init__(self, get: Callable[[str], str | None], longest: int | None = None, remember: int = 300_000):
        self.get, self.longest, self.remember = get, longest, remember
        self.parts: dict[str, tuple] = {}

    def part(self, part: str) -> tuple[list[str], list[str], list[str], list[str], int, int, int]:
        """(typed, spelled, alike, keyed) words of a part without spaces, and the letters that each of the last three explains."""
        if (hit := self.parts.get(part)) is not None:
            return hit
        get = self.get
        typed = [sp.looked(w) for w in sp._WORD.findall(part)]
        if not any(map(_HAS_LATIN.search, typed)):
            out = (typed, typed, typed, typed, 0, 0, 0)
        else:
            spelled, looks, keyed, solved = [], [], [], 0
            for w in typed:
                latin = _HAS_LATIN.search(w)
                spelled.append((get("t:" + w) or get("s:" + sp.skeleton(w)) if latin and not w[0].isdigit() else None) or w)
                a = sp.all_looked(w) if latin else None
                looks.append((get("w:" + a) if a else None) or w)
            for chunk in _CHUNK.split(part):
                best = None
                if _HAS_LATIN.search(chunk) and sp._KEYED.fullmatch(chunk):
                    best = key_reading(chunk, lambda w: 0 if w.isdigit() or get("w:" + w) else None, self.longest) or None
                keyed += best if best is not None else [sp.looked(w) for w in sp._WORD.findall(chunk)]
                solved += sum(len(w) for w in best if not w.isdigit()) if best else 0
            differ = lambda words: sum(len(a) for a, b in zip(typed, words) if a != b)
            out = (typed, spelled, looks, keyed, differ(spelled), differ(looks), solved)
        if len(self.parts) < self.remember:
            self.parts[part] = out
        return out

    def words(self, text: str) -> list[str]:
        """The words meant, in order."""
        parts = [self.part(p) for p in sp.clean(text).split()]
        spelled, looks, keyed = (sum(p[k] for p in parts) for k in (4, 5, 6))
        if keyed > max(spelled, looks):
            return [w for p in parts for w in p[3]]
        first, second = (1, 2) if spelled > looks else (2, 1)
        return [a if a != w else b for p in parts for w, a, b in zip(p[0], p[first], p[second])]


def meant(text: str, get: Callable[[str], str | None], longest: int | None = None) -> list[str]:
    return Meaning(get, longest).words(text)


def canonical(df: DataFrame, text: str, vocab: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Adds ``meant``: the words meant, in order, as an array (empty for null). ``vocab`` is from :func:`vocabulary` and
    should be a written table. Only texts with Latin letters leave the JVM. A vocabulary of up to ``broadcast_keys`` keys
    is broadcast; a larger one is joined to the exploded keys of those texts."""
    spark = df.sparkSession
    latin = F.lower(F.col(text)).rlike("[a-z]")
    plain = words(F.translate(F.col(text), "ёЁ", "ее"))
    rest = df.filter(F.col(text).isNull() | ~latin).withColumn("meant", plain)
    hard = df.filter(latin)
    longest = vocab.agg(F.max(F.length("word"))).first()[0] or 0
    if vocab.count() <= broadcast_keys:
        table = spark.sparkContext.broadcast(dict(vocab.select("key", "word").toPandas().itertuples(index=False)))

        @F.pandas_udf("array<string>")
        def by_table(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            words = Meaning(table.value.get, longest).words
            for texts in batches:
                yield texts.map(words)

        return rest.unionByName(hard.withColumn("meant", by_table(text)))

    @F.pandas_udf("array<string>")
    def keys_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: lookups(t, longest))

    @F.pandas_udf("array<string>")
    def by_hits(texts: pd.Series, keys: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([meant(t, dict(zip(k, w)).get if k is not None else {}.get, longest) for t, k, w in zip(texts, keys, found)])

    distinct = hard.select(F.col(text).alias("_t")).distinct()
    hits = distinct.withColumn("key", F.explode(keys_of("_t"))).join(vocab.select("key", "word"), "key")
    hits = hits.groupBy("_t").agg(F.collect_list("key").alias("k"), F.collect_list("word").alias("w"))
    solved = distinct.join(hits, "_t", "left").select("_t", by_hits("_t", "k", "w").alias("meant"))
    return rest.unionByName(hard.join(solved, F.col(text) == F.col("_t")).drop("_t"))
