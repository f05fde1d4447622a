"""Per-key results and joins that stay even when a few keys hold most rows.

*Value-frequency compression*: rows are first grouped by (key, value), which spreads even the largest key over all
tasks; per-key figures are then derived from the weighted values with aggregates that combine before they shuffle, so
the last shuffle carries at most one row per key and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import written


def compressed(df: DataFrame, key: Column, value: Column, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """(key, value, n, first, last): one row for each distinct pair. Rows with a null key are left out; null is a value
    of its own. ``first`` and ``last`` are the least and greatest of the given columns, nulls ignored."""
    nothing = F.lit(None).cast("timestamp")
    rows = df.select(key.alias("key"), value.alias("value"), (first if first is not None else nothing).alias("a"), (last if last is not None else nothing).alias("b"))
    return rows.filter("key is not null").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("first"), F.max("b").alias("last"))


def distinct_counts(weighted: DataFrame) -> DataFrame:
    """(key, n_rows, n_distinct, first, last) from :func:`compressed`; a null value is no distinct value."""
    return weighted.groupBy("key").agg(F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct"), F.min("first").alias("first"), F.max("last").alias("last"))


def modes(weighted: DataFrame) -> DataFrame:
    """(key, mode): the most frequent value that is not null, the least value where several tie; null where all are."""
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))))
    return weighted.groupBy("key").agg(best.alias("best")).select("key", F.col("best.v").alias("mode"))


def running_weights(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: str) -> DataFrame:
    """Adds ``before``: the weight of all rows of the same ``by`` values that sort earlier by ``order``.

    The rows are range-partitioned by (by, order), summed per partition, and the sums carried across partitions, so a
    single huge group is spread over tasks. The carried table has one row per group and partition it touches. Make
    ``order`` unique within ``by``; rows equal in both are counted in an unspecified order among themselves."""
    by, order = list(by), list(order)
    ranged = written(df.repartitionByRange(*[F.col(c) for c in [*by, *order]]).withColumn("_part", F.spark_partition_id()), "ranged")
    over = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy(*by, "_part").agg(F.sum(weight).alias("_sum")).select(*by, "_part", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = ranged.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "_part"]]
    return here.alias("r").join(carried.alias("c"), same).select("r.*", (F.col("_inside") + F.col("_carried")).alias("before")).drop("_part", "_inside")


def percentiles(weighted: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(key, one column per share): the exact discrete percentile, that is the least value at or below which at least
    that share of the key's non-null rows lies (``percentile_disc``)."""
    values = weighted.filter("value is not null").select("key", "value", "n")
    totals = values.groupBy("key").agg(F.sum("n").alias("total"))
    placed = running_weights(values, ["key"], ["value"], "n")
    reached = F.col("before") + F.col("n")
    return placed.join(totals, "key").groupBy("key").agg(*[F.min(F.when(reached >= F.col("total") * F.lit(p), F.col("value"))).alias(name) for name, p in shares.items()])


def lookup_join(rows: DataFrame, table: DataFrame, key: str, heavy: int) -> DataFrame:
    """Inner join of ``rows`` to ``table``, in which ``key`` is unique and ``n_rows`` tells how many rows have it.

    Keys with at least ``heavy`` rows are joined by broadcast: with ``heavy`` a share of all rows, their number is at
    most the inverse of that share. All others are joined by a shuffle in which no key is large."""
    hot, cold = table.filter(F.col("n_rows") >= heavy), table.filter(F.col("n_rows") < heavy)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))
