"""Records that are the same but for formatting, found by hashing them bottom-up.

Leaves are normalised (case, punctuation, whitespace, invisible characters); each node's digest is that of its
children's digests, sorted first where the order of children means nothing: struct fields, map entries, and the nodes
named as unordered. Records are grouped by root digest together with the normalised structure itself, so equal digests
of different records never merge.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stage import written
from ..text import words


def _leaf(c: Column, kind: T.DataType) -> Column:
    return F.array_join(words(c), " ") if isinstance(kind, T.StringType) else c.cast("string")


def normalised(c: Column, kind: T.DataType, unordered: Iterable[str] = (), path: str = "") -> Column:
    """The normalised structure as a string, the same for records that differ only in formatting or in the order of
    unordered nodes. Fields stand in the order of their names, which are left out, as all records have the same. A null node differs from an empty one. ``unordered``: dotted paths of arrays, or of strings whose
    words count in any order."""
    loose = path in set(unordered)
    if isinstance(kind, T.StructType):
        parts = [normalised(c[f.name], f.dataType, unordered, f"{path}.{f.name}".strip(".")) for f in sorted(kind.fields, key=lambda f: f.name.lower())]
        text = F.concat(F.lit("{"), F.concat_ws(";", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.concat(normalised(e["key"], kind.keyType), F.lit("="), normalised(e["value"], kind.valueType)))
        text = F.concat(F.lit("("), F.array_join(F.array_sort(entries), ";"), F.lit(")"))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: normalised(x, kind.elementType, unordered, f"{path}[]"))
        text = F.concat(F.lit("["), F.array_join(F.array_sort(items) if loose else items, ";"), F.lit("]"))
    elif loose:
        text = F.array_join(F.array_sort(words(c)), " ")
    else:
        text = _leaf(c, kind)
    return F.when(c.isNull(), "~").otherwise(text)


def digest(c: Column, kind: T.DataType, unordered: Iterable[str] = (), path: str = "") -> Column:
    """The 64-bit digest of a node; see :func:`normalised` for what counts as the same."""
    loose = path in set(unordered)
    if isinstance(kind, T.StructType):
        parts = [F.xxhash64(F.lit(f.name.lower()), digest(c[f.name], f.dataType, unordered, f"{path}.{f.name}".strip("."))) for f in kind.fields]
        value = F.xxhash64(F.lit("struct"), F.array_sort(F.array(*parts)))
    elif isinstance(kind, T.MapType):
        value = F.xxhash64(F.lit("map"), F.array_sort(F.transform(F.map_entries(c), lambda e: F.xxhash64(digest(e["key"], kind.keyType), digest(e["value"], kind.valueType)))))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: digest(x, kind.elementType, unordered, f"{path}[]"))
        value = F.xxhash64(F.lit("array"), F.array_sort(items) if loose else items)
    elif loose:
        value = F.xxhash64(F.lit("bag"), F.array_sort(F.transform(words(c), lambda w: F.xxhash64(w))))
    else:
        value = F.xxhash64(_leaf(c, kind))
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(value)


def rooted(df: DataFrame, record: Column, unordered: Iterable[str] = ()) -> DataFrame:
    """Adds ``digest`` and ``form``, the root digest and normalised structure of the struct ``record``."""
    kind = df.select(record.alias("r")).schema["r"].dataType
    return df.withColumn("digest", digest(record, kind, unordered)).withColumn("form", normalised(record, kind, unordered))


def collapsed(rooted_rows: DataFrame, id_col: str) -> DataFrame:
    """(digest, form, keep, n_rows): one row per distinct record, the least id, and how many rows it had."""
    return rooted_rows.groupBy("digest", "form").agg(F.min(id_col).alias("keep"), F.count(F.lit(1)).alias("n_rows"))


def copies(rooted_rows: DataFrame, id_col: str, coarse: int = 4096) -> DataFrame:
    """(keep, copy) for every row that is not the kept one of its record; the ids must be unique.

    Rows are shuffled once, by their record, and each gets the least id of its record. Records that hold a large share of
    all rows are left out of that: rows are first counted in ``coarse`` ranges of digests, records of ranges that may hold
    such a one are counted exactly, and the large ones are joined by broadcast."""
    rows = written(rooted_rows.select(F.col(id_col).alias("copy"), "digest", "form"), "digests")
    range_ = F.pmod("digest", F.lit(coarse)).cast("int").alias("range")
    ranges = rows.groupBy(range_).agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``coarse`` rows
    heavy = max(1000, sum(r["n"] for r in ranges) // 1000)
    full = [r["range"] for r in ranges if r["n"] >= heavy]
    each = Window.partitionBy("digest", "form")
    if not full:
        cold, hot = rows, None
    else:
        hot = written(collapsed(rows.filter(range_.isin(full)), "copy").filter(F.col("n_rows") >= heavy), "large-records")
        cold = rows.join(F.broadcast(hot.select("digest", "form")), ["digest", "form"], "left_anti")
    found = cold.select(F.min("copy").over(each).alias("keep"), "copy")
    if hot is not None:
        found = found.unionByName(rows.join(F.broadcast(hot), ["digest", "form"]).select("keep", "copy"))
    return found.filter("copy <> keep")
