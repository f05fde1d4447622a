"""Languages of documents and paragraphs by multinomial naive Bayes over hashed character n-grams.

The model is fitted on a bounded sample of labelled documents, whose wrong labels are cleaned by fitting again on the
paragraphs where model and label agree. Its matrix of log-probabilities is broadcast, and paragraphs are scored in
batches by gathering and summing its rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spelling import transliterations

LANGUAGES = ("ru", "en", "uk", "be", "kk", "de", "es")
BITS, ORDERS = 17, (1, 2, 3, 4)
#: Documents of each label that the model is fitted on, at most.
SAMPLE = 250

_INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case letters in composed form, everything between them one space."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return " " + _NOT_LETTERS.sub(" ", _INVISIBLE.sub("", text).lower()).strip().ljust(max(ORDERS) - 2) + " "


Chunk = list[tuple[np.ndarray, np.ndarray]]


def features(texts: list[str]) -> Chunk:
    """For each order of n-grams: the hashed n-grams of all texts one after the other, and where each text begins. Every
    text has at least as many characters as the greatest order."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    out = []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            grams = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)
            inside = np.ones(len(grams), bool)
            for k in range(1, n):
                across = ends[:-1] - k
                inside[across] = False
            out.append((grams[inside], begins - np.arange(len(texts)) * (n - 1)))
    return out


class Model:
    """Classes may share a language, as Russian in Cyrillic and in Latin letters do."""

    def __init__(self, names: list[str], log_prob: np.ndarray, temperature: float = 1.0):
        self.names, self.temperature = names, temperature
        self.columns = np.ascontiguousarray(log_prob.T)
        self.languages = [n[:2] for n in names]
        self.order = sorted(set(self.languages))
        self.fold = np.array([self.order.index(x) for x in self.languages])

    @staticmethod
    def fit(chunks: list[Chunk], labels: np.ndarray, use: np.ndarray, alpha: float = 0.1) -> Model:
        """From the texts that ``use`` marks, given in chunks of features."""
        names, code = np.unique(labels, return_inverse=True)
        counts = np.zeros((1 << BITS) * len(names), np.int64)
        at = 0
        for chunk in chunks:
            n = len(chunk[0][1])
            for grams, starts in chunk:
                size = np.diff(np.append(starts, len(grams)))
                kept = np.repeat(use[at : at + n], size)
                counts += np.bincount((grams.astype(np.int64) * len(names) + np.repeat(code[at : at + n], size))[kept], minlength=len(counts))
            at += n
        smooth = counts.reshape(-1, len(names)) + alpha
        return Model(list(names), np.log(smooth / smooth.sum(axis=0)).astype(np.float32))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text in each language, and its number of n-grams."""
        return self.summed(features(texts))

    def summed(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        raw, n_grams = np.zeros((len(chunk[0][1]), len(self.names))), 0
        for grams, starts in chunk:
            for k, column in enumerate(self.columns):
                raw[:, k] += np.add.reduceat(column[grams], starts)
            n_grams = n_grams + np.diff(np.append(starts, len(grams)))
        starts = chunk[0][1]
        best = np.full((len(starts), len(self.order)), -np.inf)
        for k, to in enumerate(self.fold):
            best[:, to] = np.maximum(best[:, to], raw[:, k])
        return best, n_grams

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        z = (scores - scores.max(axis=1, keepdims=True)) / self.temperature
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def label_of(lang):
    """The first two letters of a delivered label in lower case; null where it is null, empty, ``und`` or no language
    known here."""
    two = F.lower(F.substring(F.trim(lang), 1, 2))
    return F.when(F.lower(F.trim(lang)) != "und", two)


def _least(batches: Iterator[pd.DataFrame], sample: int) -> Iterator[pd.DataFrame]:
    held = None
    for b in batches:
        both = b if held is None else pd.concat([held, b])
        held = both.sort_values(["h", "text"], kind="stable").groupby("label", sort=False).head(sample)
    if held is not None and len(held):
        yield held


def fitted(documents: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model:
    """The model, from at most ``sample`` documents per label, chosen by hash. Raises ``ValueError`` without any."""
    rows = documents.select(F.col("text"), label_of(F.col("lang")).alias("label"), F.xxhash64("doc_id", F.lit(seed)).alias("h")).filter(F.col("label").isin(*LANGUAGES) & (F.length(F.trim("text")) > 0))
    # one pass: every task keeps the documents of least hash of each label, of these the driver keeps the least again
    first = rows.select("label", "h", "text").mapInPandas(lambda batches: _least(batches, sample), "label string, h bigint, text string")
    kept = Window.partitionBy("label").orderBy("h", F.xxhash64("text"))
    chosen = first.withColumn("place", F.row_number().over(kept)).filter(F.col("place") <= sample).select("label", "h", "text").collect()  # ``sample`` rows a label
    texts: list[str] = []
    labels: list[str] = []
    for label, _, t in sorted(chosen):
        for p in t.split("\n\n"):
            p = plain(p)
            if p.strip():
                texts.append(p)
                labels.append(label)
    if not texts:
        raise ValueError("no labelled document to fit on")
    return train(texts, labels)


def train(texts: list[str], labels: list[str], rounds: int = 3, step: int = 256) -> Model:
    """Every fifth text is held out for the temperature; Russian is spelled in Latin letters for a class of its own."""
    held = [k % 5 == 0 for k in range(len(texts))]
    given, texts = list(labels), list(texts)
    for t, x, h in list(zip(texts, labels, held)):
        if x == "ru" and not h and re.search("[а-я]", t):
            spelled = transliterations(t)
            texts += spelled
            given += ["ru-latin"] * len(spelled)
    held_out = np.array(held + [False] * (len(texts) - len(held)))
    label = np.array(given)
    language = np.array([x[:2] for x in given])
    chunks = []
    for a in range(0, len(texts), step):
        chunks.append(features(texts[a : a + step]))
    keep = np.ones(len(texts), bool)
    for _ in range(rounds):
        model = Model.fit(chunks, label, keep & ~held_out)
        scores = np.concatenate([model.summed(c)[0] for c in chunks])
        keep = np.array(model.order)[scores.argmax(axis=1)] == language
    # temperature: least log loss on held-out texts whose label is most likely right
    test = np.flatnonzero(held_out & keep)
    if len(test):
        true = np.array([model.order.index(x) for x in language[test]])
        losses = []
        for t in (1, 2, 4, 8, 16, 32, 64):
            model.temperature = float(t)
            losses.append((-np.log(np.maximum(model.probabilities(scores[test])[np.arange(len(test)), true], 1e-12)).mean(), float(t)))
        model.temperature = min(losses)[1]
    final = Model.fit(chunks, label, keep)
    final.temperature = model.temperature
    return final


def segments(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, label, para_no, lang, confidence, n_grams, and ``scores``): one row per paragraph that has letters.

    Paragraphs are the parts of ``text`` at blank lines, numbered from 0, those without letters counted but not given.
    Null and empty texts give none."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = documents.select("doc_id", label_of(F.col("lang")).alias("label"), "text").filter("length(text) > 0")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            doc, label, no, texts = [], [], [], []
            for d, x, t in zip(b["doc_id"], b["label"], b["text"]):
                for k, p in enumerate(t.split("\n\n")):
                    p = plain(p)
                    if p.strip():
                        doc.append(d)
                        label.append(x)
                        no.append(k)
                        texts.append(p)
            step = 200
            for a in range(0, len(texts), step):
                s, n = m.scores(texts[a : a + step])
                p, best = m.probabilities(s), s.argmax(axis=1)
                yield pd.DataFrame({
                    "doc_id": doc[a : a + step], "label": label[a : a + step], "para_no": no[a : a + step], "lang": [m.order[k] for k in best],
                    "confidence": p[np.arange(len(best)), best], "n_grams": n, "scores": list(s - s.max(axis=1, keepdims=True)),
                })

    return rows.mapInPandas(score, "doc_id bigint, label string, para_no int, lang string, confidence double, n_grams bigint, scores array<double>")


def document_languages(paragraphs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, confidence, n_langs): the language with most n-grams in the document, its share of them weighted
    by the paragraphs' confidence, and the number of languages that its paragraphs have."""
    per = paragraphs.groupBy("doc_id", "lang").agg(F.sum("n_grams").alias("n"), F.sum(F.col("n_grams") * F.col("confidence")).alias("sure"))
    best = F.max(F.struct("n", "lang", "sure")).alias("best")
    return per.groupBy("doc_id").agg(best, F.sum("n").alias("all"), F.count(F.lit(1)).alias("n_langs")).select("doc_id", F.col("best.lang").alias("lang"), (F.col("best.sure") / F.col("all")).alias("confidence"), "n_langs")
