"""Passages of evaluation items inside a corpus, in one pass without a shuffle.

Texts are normalised (case, punctuation, spacing, invisible characters, decomposed and look-alike letters). The hashed
five-word windows of the items are broadcast; every window of every document is looked up; where enough windows of one
item fall on nearby diagonals, the words are aligned exactly. A passage of 24 or more words with at most one edit in
eight words always contains one of 24 to 47 words with that property (halve a longer one: one half has it), which keeps
at least five of its windows intact, so looking for five loses nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, LEAST, ONE_IN = 5, 24, 8
#: Words of evaluation text that are broadcast at once (about 100 bytes each); more items are taken in blocks.
BLOCK_WORDS = 1_000_000

# Letters that look alike in lower or upper case, each written as the Latin one.
LOOKALIKES = dict(zip("авсеніјкмоԛрѕтуԝхοαινρυ", "abcehijkmoqpstywxoaivpu"))
_WORD = re.compile(r"[^\W_]+")
_MARKED = re.compile(r"(?:[^\W_]|[\u200b\u200c\u200d\u2060\ufeff\u00ad\u0300-\u036f])+")
_NONE = 0


def _fold_table() -> np.ndarray:
    """For every code point below U+3000 that of the plain letter it stands for: lower case, without marks, look-alikes as
    Latin; 0 for what is dropped (marks and invisible characters)."""
    table = np.arange(0x3000, dtype=np.uint32)
    for code in range(1, 0x3000):
        c = chr(code)
        base = [x for x in unicodedata.normalize("NFKD", c.lower()) if unicodedata.category(x) != "Mn"]
        if unicodedata.category(c) == "Mn" or c in "\u200b\u200c\u200d\u2060\u00ad":
            table[code] = _NONE
        elif len(base) == 1 and ord(base[0]) < 0x3000:
            table[code] = ord(LOOKALIKES.get(base[0], base[0]))
    return table


_TABLE = _fold_table()


def folded(text: str) -> str:
    """Lower case, compatibility forms composed, look-alikes as Latin letters, marks and invisible characters dropped."""
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    codes = np.frombuffer(text.replace("\ufeff", "").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < 0x3000
    out = np.where(low, _TABLE[np.where(low, codes, 0)], codes)
    return out[out != _NONE].tobytes().decode("utf-32-le", "surrogatepass").lower()


def word_list(text: str) -> list[str]:
    return _WORD.findall(folded(text))


class ItemIndex:
    """Hashed windows of the items of one block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        texts = [word_list(t or "") for _, t in items]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t], np.int64) for t in texts]
        hashes, item, at = [], [], []
        for k, w in enumerate(self.words):
            h = windows(w)
            hashes.append(h)
            item.append(np.full(len(h), k))
            at.append(np.arange(len(h)))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, np.int64)

    def found(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(item id, first word, end word) of the document's words for every item that leaked; one span per place."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        h = windows(ids)
        if not len(h) or not len(self.hash):
            return []
        lo = np.searchsorted(self.hash, h, "left")
        hit = np.flatnonzero((lo < len(self.hash)) & (self.hash[np.minimum(lo, len(self.hash) - 1)] == h))
        if len(hit) < LEAST - WINDOW + 1 - WINDOW * (LEAST // ONE_IN):
            return []
        lo, hi = lo[hit], np.searchsorted(self.hash, h[hit], "right")
        times = hi - lo
        place = np.repeat(hit, times)
        post = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        item, diagonal = self.item[post], place - self.at[post]
        needed = LEAST - WINDOW + 1 - WINDOW * (LEAST // ONE_IN)
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for shift in (0, 8):
            band = (diagonal + shift) // 16
            key = item * (len(words) + 10_000_000) * 2 + band
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(order)]])
            for a, b in zip(starts[ends - starts >= needed], ends[ends - starts >= needed]):
                at = order[a:b]
                k = int(item[at[0]])
                if len(self.words[k]) < LEAST:
                    continue
                first, last = int(place[at].min()), int(place[at].max())
                if not dense(np.sort(self.at[post[at]])) or any(i == k and s <= first and last + WINDOW <= e for (i, s), (_, _, e) in out.items()):
                    continue
                if (span := aligned(self.words[k], ids, int(diagonal[at].min()), int(diagonal[at].max()))) is not None:
                    out[(k, span[0])] = (self.ids[k], *span)
        return list(out.values())


def windows(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``WINDOW`` consecutive word ids; id 0 (no item's word) gives a hash no item has."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    u = ids.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = (h ^ u[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    outside = np.convolve((ids == 0).astype(np.int64), np.ones(WINDOW, np.int64), "valid") > 0
    h[outside] = 0
    return h


def dense(at: np.ndarray) -> bool:
    """Whether sorted window positions of an item lie as close as in some passage: 24 words keep 5 windows, 32 keep 8, 40
    keep 11 (other lengths keep more than the next shorter of these)."""
    for words, kept in ((24, 5), (32, 8), (40, 11)):
        if len(at) >= kept and (at[kept - 1 :] - at[: len(at) - kept + 1] <= words - WINDOW).any():
            return True
    return False


def aligned(item: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
    """The widest (start, end) of ``doc`` that holds a passage of ``item``: 24 to 47 item words from any start, edits at
    most one in eight words, on the diagonals ``low`` to ``high`` and the five to each side that edits reach.

    Edit distances of all starts at once, in the band only. Before that, a passage is ruled out where too few of its
    words occur anywhere in the band."""
    reach = 2 * LEAST // ONE_IN
    width = high - low + 1 + 2 * reach
    offsets = np.arange(width) + low - reach
    n = len(item)
    at = np.arange(n)[:, None] + offsets[None, :]
    same = (at >= 0) & (at < len(doc))
    same &= doc[np.clip(at, 0, len(doc) - 1)] == item[:, None]
    some = np.concatenate([[0], np.cumsum(same.any(axis=1))])
    if not any(n >= w and (some[w:] - some[: n + 1 - w] >= w - w // ONE_IN).any() for w in (24, 32, 40)):
        return None
    starts = n - LEAST + 1
    d = np.zeros((starts, width), np.int16)
    differ = (~same).astype(np.int16)
    slope = np.arange(width, dtype=np.int16)
    lo = hi = None
    for k in range(1, 2 * LEAST):
        live = min(starts, n - k + 1)
        d = d[:live]
        new = d + differ[k - 1 : k - 1 + live]
        new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
        d = np.minimum.accumulate(new - slope, axis=1) + slope
        if k >= LEAST and (good := (d <= k // ONE_IN) & (d == d.min(axis=1, keepdims=True))).any():
            i, o = np.nonzero(good)
            ends = i + k + offsets[o]
            fits = (ends >= 0) & (ends <= len(doc) + k // ONE_IN)
            if fits.any():
                begins = np.maximum(0, ends[fits] - k)
                lo = int(begins.min()) if lo is None else min(lo, int(begins.min()))
                hi = int(ends[fits].max()) if hi is None else max(hi, int(ends[fits].max()))
    if lo is None:
        return None
    # edits at its ends may have carried the span a few words too far
    inner = np.flatnonzero(np.isin(doc[lo : min(hi, len(doc))], item))
    return lo + int(inner[0]), lo + int(inner[-1]) + 1


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, doc_id, first_word, end_word): the word span of every place where a document holds a passage of an item.

    Null, empty and short texts hold nothing. The items are read to the driver in blocks of about ``block_words`` words,
    each of which is one pass over the documents, so their number may grow without bound."""
    spark = documents.sparkSession
    out = None
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    for block in _blocks(items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")), block_words):
        index = spark.sparkContext.broadcast(ItemIndex(block))

        def scan(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(i, d, s, e) for d, t in zip(b["doc_id"], b["text"]) for i, s, e in index.value.found(word_list(t))]
                yield pd.DataFrame(rows, columns=["item_id", "doc_id", "first_word", "end_word"])

        part = docs.mapInPandas(scan, "item_id bigint, doc_id bigint, first_word int, end_word int")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id bigint, doc_id bigint, first_word int, end_word int")


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    block, n = [], 0
    for i, t in items.filter("t is not null").toLocalIterator():
        block.append((i, t))
        n += t.count(" ") + 1
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def without_spans(documents: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with the leaked words cut out of their texts; all else, punctuation outside included, stays."""
    spans = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("first_word", "end_word"))).alias("_spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, ss):
            if t is None or ss is None or not len(ss):
                return t
            places = [m.span() for m in _MARKED.finditer(t) if word_list(m.group())]
            for s in sorted(ss, key=lambda s: -s["first_word"]):
                a, b = int(s["first_word"]), min(int(s["end_word"]), len(places))
                if a < b:
                    t = t[: places[a][0]] + t[places[b - 1][1] :]
                    places = places[:a]
            return t

        return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype=object)

    joined = documents.join(spans.withColumnRenamed("doc_id", id_col), id_col, "left")
    return joined.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(cut(text, "_spans"))).drop("_spans")
