"""Per-title figures of a query log whose few largest titles hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import skew
from ..text import title_key


def title_profiles(train: DataFrame) -> DataFrame:
    """(title, n_rows, n_queries, content_type, first_log, last_log), one row for each title key.

    Distinct QueryTexts are counted as written. The main content type is compared trimmed and in lower case; where types
    tie, the least string wins; it is null where every row's is. Null titles are left out, a blank title is a key."""
    key = title_key(F.col("Title"))
    queries = skew.compressed(train, key, F.col("QueryText"), F.col("log_ts"), F.col("log_ts"))
    kinds = skew.compressed(train, key, F.lower(F.trim(F.col("ContentType"))))
    return (
        skew.distinct_counts(queries)
        .join(skew.modes(kinds), "key")
        .select(F.col("key").alias("title"), "n_rows", F.col("n_distinct").alias("n_queries"), F.col("mode").alias("content_type"), F.col("first").alias("first_log"), F.col("last").alias("last_log"))
    )


def title_length_percentiles(train: DataFrame) -> DataFrame:
    """(title, p50, p90): exact percentiles of the QueryText length in characters over the rows of each title key."""
    lengths = skew.compressed(train, title_key(F.col("Title")), F.length("QueryText"))
    return skew.percentiles(lengths, {"p50": 0.5, "p90": 0.9}).withColumnRenamed("key", "title")


def heavy_titles(train: DataFrame, share: float = 0.02) -> DataFrame:
    """(title): title keys holding at least ``share`` of all rows, rows without a title included in the whole."""
    weighted = skew.compressed(train, title_key(F.col("Title")), F.col("QueryText"))
    total = train.count()
    return skew.distinct_counts(weighted).filter(F.col("n_rows") >= F.lit(total * share)).select(F.col("key").alias("title"))
