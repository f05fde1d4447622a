"""Freely entered values mapped to the entries of a reference list, over whole tables. See ``titles`` for the matching.

Every distinct token of the values is joined to the vocabulary of the reference list once, by keys that a token shares with
all words it may mean. A value then carries its tokens' repairs and meets, by their rarest words, the forms of entries that
its words can make up; what is left is ranked value by value. All statistics are of the whole list, so nothing depends
on how values or entries are spread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import lookup_join
from ..stage import written
from . import titles

#: Rows of a table of forms, repairs or listed values that are broadcast; larger ones are joined by shuffle, with the same result.
BROADCAST_ROWS = 200_000

_FORMS = "array<struct<words: array<string>, number: int>>"


def entry_forms(entries: DataFrame) -> DataFrame:
    """(ord, words, number) of all spellings of (ord, spellings), see ``titles.entry_forms``, and of Russian ones in English
    where an entry has no spelling in Latin letters, by word pairs of all other entries."""

    def formed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, spellings in zip(b["ord"], b["spellings"]):
                cyrillic, latin, joined = titles.entry_forms(spellings if spellings is not None else ())
                as_rows = lambda forms: [{"words": list(w), "number": n} for w, n in forms]
                rows.append((i, as_rows([*cyrillic, *latin, *joined]), [] if latin else as_rows(cyrillic), [{"ru": a, "en": e} for a, e in titles.word_pairs(cyrillic, latin)]))
            yield pd.DataFrame(rows, columns=["ord", "forms", "untold", "pairs"])

    schema = f"ord bigint, forms {_FORMS}, untold {_FORMS}, pairs array<struct<ru: string, en: string>>"
    parts = written(entries.select("ord", "spellings").mapInPandas(formed, schema), "entries")
    pairs = parts.select(F.explode("pairs").alias("p")).groupBy("p.ru", "p.en").agg(F.count(F.lit(1)).alias("n"))
    english = written(pairs.groupBy("ru").agg(F.min(F.struct((-F.col("n")).alias("n"), "en")).alias("x")).select("ru", F.col("x.en").alias("en")), "word-pairs")
    untold = parts.select("ord", F.posexplode("untold").alias("no", "f")).select("ord", "no", "f.number", F.posexplode("f.words").alias("at", "ru"))
    told = untold.join(_small(english), "ru", "left").groupBy("ord", "no", "number").agg(F.array_sort(F.collect_list(F.struct("at", "ru", "en"))).alias("x"))

    @F.pandas_udf("array<string>")
    def in_english(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: list(titles.translated_form(tuple(w["ru"] for w in ws), {w["ru"]: w["en"] for w in ws}.get)))

    own = parts.select("ord", F.explode("forms").alias("f")).select("ord", "f.words", "f.number")
    return own.unionByName(told.select("ord", in_english("x").alias("words"), "number")).distinct()


def _small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def vocabulary(forms: DataFrame) -> DataFrame:
    """(word, df): in how many forms (ord, words, number) each word stands."""
    return forms.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def repairs(tokens: DataFrame, vocab: DataFrame, n_forms: int) -> DataFrame:
    """(token, n_rows, repairs: array of (word, likeness, idf)) of the tokens (token, n_rows) that may mean a word of the
    vocabulary (word, df)."""

    def keyed(column: str, keys):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(key=b[column].map(lambda w: list(dict.fromkeys(keys(w))))).explode("key")

        return run

    @F.pandas_udf("double")
    def likeness(token: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series([titles.likeness(t, w) for t, w in zip(token, word)], dtype=float)

    of_words = vocab.select("word", F.log(1 + F.lit(n_forms) / F.col("df")).alias("idf")).mapInPandas(keyed("word", titles.word_keys), "word string, idf double, key string")
    of_tokens = tokens.mapInPandas(keyed("token", titles.token_keys), "token string, n_rows bigint, key string")
    met = of_tokens.join(of_words, "key").select("token", "n_rows", "word", "idf").distinct().withColumn("likeness", likeness("token", "word")).filter("likeness > 0")
    return met.groupBy("token", "n_rows").agg(F.collect_list(F.struct("word", "likeness", "idf")).alias("repairs"))


def matched(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(value, whole, ord, score): the best entry of each distinct value, for those that mean one.

    ``values``: (value, whole), where whole tells whether the value is a title by itself or a query that may name one
    among other words. ``entries``: (ord, spellings). Null and wordless values match nothing; of equally good entries the
    one with the least ord is taken. Values and entries may be any number."""
    spark = values.sparkSession
    schema = "value string, whole boolean, ord bigint, score double"
    forms = written(entry_forms(entries), "entry-forms")
    vocab = written(vocabulary(forms), "entry-words")
    n_forms, longest = forms.count(), vocab.agg(F.max(F.length("word"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], schema)
    # of forms with the same words and number the entry with the least ord is always taken, so only that is kept
    each = forms.groupBy("words", "number").agg(F.min("ord").alias("ord"))
    rarest = each.select("words", "number", F.explode("words").alias("word")).join(_small(vocab), "word").groupBy("words", "number").agg(F.min(F.struct("df", "word")).alias("x"))
    same = [F.col("e.words") == F.col("r.words"), F.col("e.number").eqNullSafe(F.col("r.number"))]
    keyed = written(each.alias("e").join(rarest.alias("r"), same).select(F.col("r.x.word").alias("word"), F.struct("e.ord", "e.words", "e.number").alias("form")), "keyed-forms")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(token=b["value"].map(lambda v: titles.tokens(v, longest))).explode("token").dropna(subset=["token"])

    asked = written(values.select("value", "whole").filter("value is not null").mapInPandas(split, "value string, whole boolean, token string"), "value-tokens")
    fixed = written(repairs(asked.groupBy("token").agg(F.count(F.lit(1)).alias("n_rows")), vocab, n_forms), "repairs")
    heavy = max(10_000, asked.count() // 1000)
    small = fixed.count() <= BROADCAST_ROWS
    told = asked.join(F.broadcast(fixed), "token") if small else lookup_join(asked, fixed, "token", heavy)
    known = written(told.groupBy("value", "whole").agg(F.collect_list(F.struct("token", "repairs")).alias("tokens")), "known-values")
    has = known.select("value", "whole", F.array_distinct(F.flatten(F.transform("tokens", lambda t: F.transform(t["repairs"], lambda r: r["word"])))).alias("has"))
    open_ = has.select("value", "whole", "has", F.explode("has").alias("word"))
    if keyed.count() <= BROADCAST_ROWS:
        met = open_.join(F.broadcast(keyed), "word")
    else:
        use = written(open_.groupBy("word").agg(F.count(F.lit(1)).alias("n_rows")), "word-use")
        met = lookup_join(open_, keyed.join(use, "word"), "word", heavy)
    trying = met.filter(F.size(F.array_except("form.words", "has")) == 0).groupBy("value", "whole").agg(F.collect_list("form").alias("forms"))
    unknown = math.log(1 + n_forms)

    @F.pandas_udf("struct<ord: bigint, score: double>")
    def ranked(value: pd.Series, whole: pd.Series, tokens: pd.Series, forms: pd.Series) -> pd.DataFrame:
        rows = []
        for v, w, ts, fs in zip(value, whole, tokens, forms):
            repaired = {t["token"]: {r["word"]: r["likeness"] for r in t["repairs"]} for t in ts}
            idf = {r["word"]: r["idf"] for t in ts for r in t["repairs"]}
            tried = [(f["ord"], tuple(f["words"]), f["number"], titles.is_latin(f["words"])) for f in fs]
            m = titles.Matcher(lambda t: repaired.get(t, {}), idf.__getitem__, unknown, longest, lambda _: tried)
            rows.append((m.title(v) if w else m.named(v)) or (None, None))
        return pd.DataFrame(rows, columns=["ord", "score"]).astype({"ord": "Int64", "score": "float64"})

    found = known.join(trying, ["value", "whole"]).select("value", "whole", ranked("value", "whole", "tokens", "forms").alias("x"))
    return found.select("value", "whole", "x.*").filter("ord is not null")


def mapped(rows: DataFrame, id_col: str, value: Column, whole: Column, entries: DataFrame, listed: Column | None = None) -> DataFrame:
    """(id, value, whole, ord, score) for every row with a value: ``ord`` is null where it means no entry.

    ``listed``: the entries' column with values that need no mapping; rows that hold one (as a whole) are left out."""
    typed = rows.select(F.col(id_col).alias("id"), value.alias("value"), whole.alias("whole")).filter("value is not null")
    if listed is not None:
        typed = typed.join(_small(written(entries.select(listed.alias("value"), F.lit(True).alias("whole")).distinct(), "listed")), ["value", "whole"], "left_anti")
    typed = written(typed, "typed")
    distinct = written(typed.groupBy("value", "whole").agg(F.count(F.lit(1)).alias("n_rows")), "values")
    spread = distinct.repartition(distinct.sparkSession.sparkContext.defaultParallelism * 2)
    found = distinct.join(matched(spread, entries), ["value", "whole"], "left").select(F.struct("value", "whole").alias("k"), "n_rows", "ord", "score")
    keyed = typed.select("id", F.struct("value", "whole").alias("k"))
    joined = lookup_join(keyed, written(found, "mapped-values"), "k", max(1000, typed.count() // 1000))
    return joined.select("id", "k.value", "k.whole", "ord", "score")
