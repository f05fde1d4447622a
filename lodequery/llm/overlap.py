"""Records of evaluation splits that occur in the training split, exactly or but for the way they were keyed in.

Records are canonicalised (case, punctuation, whitespace, word order, keyboard, alphabet) and joined by hash. Slips of
the hand are found without comparing records: words that are one slip apart are paired once, over distinct words, and
each pair points from its rarer word to its commoner one. A record then has the keys of its own words and of those with
one or two words replaced along such pairs, and two records differ by at most two slips exactly if they share a key at
no more than two replacements together. Keys of the training side are reduced to the fewest replacements before the
join, so groups of copies never multiply.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import lookup_join
from ..stage import written
from . import keyed
from . import spelling as sp

#: Words with slips that are broadcast at most; more are joined to the exploded words of the records.
BROADCAST_WORDS = 1_000_000
SLIPS = 2
_FIELDS = ("h", "level", "word", "twice")
KEYS = "array<struct<h: string, level: int, word: string, twice: boolean>>"


def slip_pairs(counts: DataFrame) -> DataFrame:
    """(word, ups): for each word the words one slip apart that are commoner (of equally common ones, the greater).
    ``counts``: (word, n). Pairs meet by the word with one letter left out; a key has no more words than an alphabet gives."""

    def dropped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(key=b["word"].map(sp.deletions)).explode("key")
            yield b[b["key"].notna()][["word", "n", "key"]]

    @F.pandas_udf("boolean")
    def slip(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sp.is_slip(x, y) for x, y in zip(a, b)])

    keys = written(counts.mapInPandas(dropped, "word string, n bigint, key string"), "word-keys")
    up = keys.select("key", F.col("word").alias("up"), F.col("n").alias("up_n"))
    pairs = keys.join(up, "key").filter("(up_n > n) or (up_n = n and up > word)").select("word", "up").distinct()
    return pairs.filter(slip("word", "up")).groupBy("word").agg(F.collect_set("up").alias("ups"))


def reachable(bag: list[str], ups: dict[str, list[str]], slips: int = SLIPS) -> list[tuple[str, int, str, bool]]:
    """(words, replacements, word put in if one, whether the result has it twice) for one to ``slips`` replacements."""
    if not any(w in ups for w in bag):
        return []
    own = " ".join(bag)
    best: dict[str, tuple[int, str, bool]] = {own: (0, "", False)}
    stack = [(bag, 0, 0)]
    while stack:
        now, at, level = stack.pop()
        for i in range(at, len(now)):
            for u in ups.get(now[i], ()):
                new = [*now[:i], u, *now[i + 1 :]]
                key = " ".join(sorted(new))
                if key not in best or best[key][0] > level + 1:
                    best[key] = (level + 1, u if level == 0 else "", new.count(u) > 1)
                if level + 1 < slips:
                    stack.append((new, i + 1, level + 1))
    return [(k, *v) for k, v in best.items() if k != own]


def with_keys(bags: DataFrame, pairs: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``bags`` (bag: sorted words joined by a space, and more) with ``keys``: what :func:`reachable` gives."""
    spark = bags.sparkSession
    if pairs.count() <= broadcast_words:
        table = spark.sparkContext.broadcast({w: sorted(u) for w, u in pairs.toPandas().itertuples(index=False)})

        @F.pandas_udf(KEYS)
        def by_table(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            ups = table.value
            for bags in batches:
                yield bags.map(lambda b: [dict(zip(_FIELDS, x)) for x in reachable(b.split(" "), ups)])

        return bags.withColumn("keys", by_table("bag"))

    @F.pandas_udf(KEYS)
    def by_hits(bag: pd.Series, words: pd.Series, ups: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(_FIELDS, x)) for x in reachable(b.split(" "), {} if w is None else {a: sorted(u) for a, u in zip(w, ups)})] for b, w, ups in zip(bag, words, ups)])

    hits = bags.select("bag", F.explode(F.array_distinct(F.split("bag", " "))).alias("word")).join(pairs, "word").groupBy("bag").agg(F.collect_list("word").alias("w"), F.collect_list("ups").alias("u"))
    return bags.join(hits, "bag", "left").withColumn("keys", by_hits("bag", "w", "u")).drop("w", "u")


def canonical_rows(df: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """The carried columns and ``bag``, the sorted words meant; records without words are left out."""
    vocab = written(keyed.vocabulary(df, text), "vocabulary")
    rows = keyed.canonical(df.select(text, *carry), text, vocab).filter(F.size("meant") > 0)
    return written(rows.select(*carry, F.array_join(F.array_sort("meant"), " ").alias("bag")), "canonical")


def overlapping(rows: DataFrame, is_eval: str = "is_eval") -> DataFrame:
    """(bag, kind, n_rows) of the evaluation bags found in training: ``same`` or, by slips only, ``slips``.

    ``rows``: (bag, is_eval) and more. ``n_rows`` counts the evaluation rows of the bag."""
    bags = rows.groupBy("bag").agg(F.count(F.when(F.col(is_eval), 1)).alias("n_rows"), F.count(F.when(~F.col(is_eval), 1)).alias("n_train"))
    bags = written(bags, "bags")
    counts = bags.select(F.explode(F.split("bag", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    pairs = written(slip_pairs(counts), "slips")
    same = bags.filter("n_rows > 0 and n_train > 0").select("bag", "n_rows", F.lit("same").alias("kind"))
    replaced = with_keys(bags, pairs).select("bag", "n_rows", "n_train", F.explode("keys").alias("k")).select("bag", "n_rows", "n_train", F.xxhash64("k.h").alias("hash"), "k.level", "k.word", "k.twice")
    own = bags.select("bag", "n_rows", "n_train", F.xxhash64("bag").alias("hash"), F.lit(0).alias("level"), F.lit("").alias("word"), F.lit(False).alias("twice"))
    each = written(replaced, "keys").unionByName(own)
    one = F.col("level") == 1
    train = each.filter("n_train > 0").groupBy("hash").agg(
        F.min("level").alias("fewest"), F.min(F.when(one, F.xxhash64("word"))).alias("low"), F.max(F.when(one, F.xxhash64("word"))).alias("high"))
    near = each.filter("n_rows > 0 and n_train = 0").join(train, "hash")
    ok = (
        ((F.col("level") == 0) & (F.col("fewest") <= 2))
        | ((F.col("level") <= 2) & (F.col("fewest") == 0))
        | (one & F.col("low").isNotNull() & (F.col("twice") | (F.col("low") != F.xxhash64("word")) | (F.col("high") != F.xxhash64("word"))))
    )
    slips = near.filter(ok).groupBy("bag").agg(F.first("n_rows").alias("n_rows")).select("bag", "n_rows", F.lit("slips").alias("kind"))
    return same.unionByName(slips)


def eval_rows(rows: DataFrame, found: DataFrame, is_eval: str = "is_eval") -> DataFrame:
    """The evaluation rows whose bag is in ``found``, with ``kind``."""
    found = written(found, "found")
    total = rows.count()
    return lookup_join(rows.filter(F.col(is_eval)), found, "bag", max(1000, total // 1000)).drop("n_rows", is_eval)
