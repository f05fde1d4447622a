"""Scoring and counting of query streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as feat
from ..functions import query_text as qt
from ..operators import catalog as cat


def read_queries(spark: SparkSession, path: str, schema, files_per_batch: int = 4) -> DataFrame:
    """Parquet files that arrive below ``path``, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scored(stream: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each query with its TypeQuery by rule, hinted ContentType and, where its normal form is a spelling, Title. Works on
    streams and tables alike: rows need no others, and the catalog is joined as a table."""
    forms = cat.variant_map(catalog, qt.normalize).select("form", "title")
    rows = stream.withColumn("form", qt.normalize(F.col("QueryText"))).join(forms, "form", "left")
    hint = feat.type_hint(F.col("QueryText"))["label"]
    return rows.select("qid", "QueryText", feat.heuristic_type(F.col("QueryText")).alias("TypeQuery"), F.coalesce("title", F.lit("")).alias("Title"), qt.content_type(hint).alias("ContentType"))


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(start, by, n, n_video) per tumbling window of event time; rows later than ``late`` are left out of a stream, nulls
    in the time always."""
    timed = stream.filter(F.col(time).isNotNull()).withWatermark(time, late) if stream.isStreaming else stream.filter(F.col(time).isNotNull())
    counted = timed.groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(feat.heuristic_type(F.col("QueryText"))).alias("n_video"))
    return counted.select(F.col("w.start").alias("start"), by, "n", "n_video")


def distinct_queries(stream: DataFrame, time: str, key: str, late: str = "2 days") -> DataFrame:
    """A stream without repeats of a key that arrive within ``late`` of each other."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that has arrived and stop; a later call goes on from there."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
