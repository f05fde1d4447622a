"""Reading and writing of the tables the operators use. Schemas are stated, never guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES = T.StructType([T.StructField("QueryText", T.StringType())])
LABELLED = T.StructType([T.StructField("QueryText", T.StringType()), T.StructField("TypeQuery", T.IntegerType()), T.StructField("Title", T.StringType()), T.StructField("ContentType", T.StringType())])
TOP_LIST = T.StructType([T.StructField(c, T.StringType()) for c in ("movie", "year", "description")])
FILMS = T.StructType([T.StructField(c, T.StringType()) for c in ("title_ru", "title_en", "Genres", "Description Kinopoisk", "Year")])
PREDICTIONS = T.StructType([T.StructField("QueryText", T.StringType()), T.StructField("TypeQuery", T.IntegerType(), False), T.StructField("Title", T.StringType(), False), T.StructField("ContentType", T.StringType(), False)])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, null: str = "") -> DataFrame:
    """A CSV file with a header in UTF-8, with or without a byte order mark, by column name: columns may stand in any order,
    further ones are ignored, and a missing one is an error. Quoted fields may hold line breaks. ``null`` is how null is written;
    by default, empty fields are null."""
    raw = spark.read.options(header=True, multiLine=True, lineSep="\n", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue=null, emptyValue="").csv(path)
    names = {c.lstrip("﻿"): c for c in raw.columns}
    if missing := [f.name for f in schema.fields if f.name not in names]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return raw.select(*[F.col(f"`{names[f.name]}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def write_csv(df: DataFrame, path: str, null: str = "") -> None:
    """A header and rows in UTF-8. With a ``null`` of its own, null and empty strings stay apart."""
    df.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue=null).csv(path)


def first_existing(spark: SparkSession, paths: list[str], schema: T.StructType, rows: int = 10, otherwise: list[tuple] | None = None) -> DataFrame:
    """The first ``rows`` rows of the first path there is, else the given rows, else an empty table."""
    jvm = spark._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return read_csv(spark, p, schema).limit(rows)
    return spark.createDataFrame(otherwise or [], schema)


def save_map(df: DataFrame, path: str) -> None:
    """A lookup table (key, value) as Parquet."""
    df.select("key", "value").write.mode("overwrite").parquet(path)


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """A lookup table; empty where none was saved."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = "key string, value string"
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def save_parts(parts: dict[str, DataFrame], path: str, about: dict[str, object]) -> None:
    """Several tables below ``path`` and one JSON row about them, written last."""
    spark = next(iter(parts.values())).sparkSession
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    import json

    spark.createDataFrame([(json.dumps(about | {"parts": sorted(parts)}, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_parts(spark: SparkSession, path: str, required: list[str]) -> tuple[dict[str, DataFrame], dict]:
    """What :func:`save_parts` wrote; an error names required parts that are missing."""
    import json

    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    have = spark.createDataFrame([(p,) for p in about["parts"]], "part string")
    need = spark.createDataFrame([(p,) for p in required], "part string")
    if missing := [r[0] for r in need.join(have, "part", "left_anti").collect()]:
        raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
    return {p: spark.read.parquet(f"{path}/{p}") for p in about["parts"]}, about


def with_translations(df: DataFrame, title: str, names: DataFrame, into: str = "EnglishTitle") -> DataFrame:
    """``df`` with a column looked up in (key, value); empty where there is no entry. Keys must be unique."""
    table = names.select(F.col("key").alias("_k"), F.col("value").alias("_v"))
    return df.join(table, F.col(title) == F.col("_k"), "left").withColumn(into, F.coalesce("_v", F.lit(""))).drop("_k", "_v")
