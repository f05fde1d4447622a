"""Whole documents into sequences of fixed capacity: vector bin packing by the dot-product heuristic.

Every item has a demand in several dimensions (tokens, segments, loss-bearing tokens). Bins are filled one at a time;
the next item is the one that fits and whose demand, as shares of the capacities, has the greatest dot product with
what the bin has left. Items are dealt to shards of bounded size by hash, so one task never packs more than a few
thousand items; each shard leaves at most one poorly filled bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Expected items of one shard.
SHARD_ITEMS = 4000


def byte_tokens(text: Column) -> Column:
    """Tokens of a byte-level tokenizer without merges: the bytes of the UTF-8 text."""
    return F.octet_length(text).cast("long")


def tokenizer_tokens(df: DataFrame, text: str, path: str, name: str = "tokens") -> DataFrame:
    """Adds the number of tokens by the tokenizer file (JSON of the tokenizers library) at ``path``, which every executor
    must be able to read. Null texts have no number."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for b in batches:
            there = b[text].notna()
            n = iter(len(e.ids) for e in tok.encode_batch(b.loc[there, text].tolist(), add_special_tokens=False))
            yield b.assign(**{name: pd.Series([next(n) if x else None for x in there], index=b.index, dtype="Int64")})

    from pyspark.sql.types import LongType, StructType

    return df.mapInPandas(counted, StructType([f for f in df.schema.fields if f.name != name]).add(name, LongType()))


def pieces(df: DataFrame, id_col: str, tokens: Column, loss: Column | None = None, capacity: int = 8192) -> DataFrame:
    """(id, piece, n_pieces, start, tokens, loss): each item whole, or, where longer than ``capacity``, cut into full
    pieces and a rest. ``loss`` is the number of loss-bearing tokens, by default all; a cut spreads them evenly, rounded
    up. Items of null or no tokens have no piece."""
    rows = df.select(F.col(id_col).alias("id"), tokens.cast("long").alias("all"), (tokens if loss is None else loss).cast("long").alias("bearing")).filter("all > 0")
    rows = rows.withColumn("n_pieces", F.ceil(F.col("all") / capacity).cast("int"))
    cut = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    size = F.least(F.lit(capacity).cast("long"), F.col("all") - start)
    share = F.when(F.col("n_pieces") == 1, F.coalesce("bearing", F.lit(0))).otherwise(F.ceil(F.coalesce("bearing", F.lit(0)) * size / F.col("all")))
    return cut.select("id", "piece", "n_pieces", start.alias("start"), size.alias("tokens"), share.cast("long").alias("loss"))


def fill(demand: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The bin of each item. ``demand``: items by dimensions; an item that exceeds a capacity gets a bin of its own."""
    share = demand / capacity
    bins = np.full(len(demand), -1, np.int64)
    alone = (share > 1).any(axis=1)
    bins[alone] = np.arange(alone.sum())
    number = int(alone.sum())
    open_ = np.flatnonzero(~alone)
    open_ = open_[np.argsort(-share[open_].max(axis=1), kind="stable")]
    weight = share[open_].mean(axis=0) if len(open_) else np.ones(len(capacity))
    while len(open_):
        left = np.ones(len(capacity))
        rest, taken = share[open_], np.zeros(len(open_), bool)
        can = ~taken
        while can.any():
            score = np.where(can, rest @ (weight * left), -1.0)
            k = int(score.argmax())
            bins[open_[k]] = number
            taken[k] = True
            left = left - rest[k]
            can &= (rest <= left + 1e-12).all(axis=1)
            can[k] = False
        open_ = open_[~taken]
        number += 1
    return bins


def packed(items: DataFrame, capacity: int = 8192, max_segments: int = 128, max_loss: int = 8192, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``items`` (from :func:`pieces`) with ``shard`` and ``bin``, which together name a sequence.

    Pieces that fill a sequence are sequences by themselves (shard -1, bin numbered by id and piece hash) and are not
    shuffled. No sequence exceeds ``capacity`` tokens, ``max_segments`` pieces or, unless a single piece does, ``max_loss``
    loss-bearing tokens."""
    full = items.filter(F.col("tokens") >= capacity).withColumn("shard", F.lit(-1).cast("long")).withColumn("bin", F.xxhash64("id", "piece"))
    rest = items.filter(F.col("tokens") < capacity)
    shards = max(1, -(-rest.count() // shard_items))
    limits = np.array([capacity, max_segments, max_loss], float)

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["id", "piece"])
        demand = np.column_stack([shard["tokens"], np.ones(len(shard)), shard["loss"]]).astype(float)
        return shard.assign(bin=fill(demand, limits))

    # shards are heavy for their bytes: a fixed number of partitions keeps them from being merged into one task
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).repartition(min(shards, 20_000), "shard")
    schema = dealt.withColumn("bin", F.lit(0).cast("long")).schema
    return full.unionByName(dealt.groupBy("shard").applyInPandas(pack, schema))
