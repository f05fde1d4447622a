"""Occurrence and record counts of every term, kept up to date by signed deltas.

A change is a record with a sign: +1 added, -1 deleted; a changed record is both. Only changed records are tokenised;
their per-term sums are merged into a table of counts that is partitioned by term hash. A merge writes new versions of
the partitions it touches, the others stay as they are, and a version counts only once its job has committed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import written
from ..text import words

#: Terms of one bucket.
TERMS = 1_000_000
STATE = "term string, occurrences bigint, records bigint, bucket int"


def signed_changes(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(text, sign) rows that turn the snapshot ``old`` into ``new``; ``key`` is unique in each.

    Records whose text is the same (null equal to null) in both give no row."""
    a, b = old.select(F.col(key).alias("k"), F.col(text).alias("text"), F.lit(-1).alias("sign")), new.select(F.col(key).alias("k"), F.col(text).alias("text"), F.lit(1).alias("sign"))
    both = a.alias("a").join(b.alias("b"), "k", "full_outer").filter("a.sign is null or b.sign is null or not (a.text <=> b.text)")
    sides = both.select(F.explode(F.array(F.struct("a.text", "a.sign"), F.struct("b.text", "b.sign"))).alias("x"))
    return sides.filter("x.sign is not null").select("x.text", "x.sign")


def term_deltas(changes: DataFrame, text: str, sign: Column | None = None) -> DataFrame:
    """(term, occurrences, records) changes. The row with a null term carries the change in the number of records."""
    sign = F.lit(1) if sign is None else sign
    rows = changes.select(F.sort_array(words(F.col(text))).alias("w"), sign.cast("long").alias("s"))
    # in order, a term's first occurrence in a record is the one that differs from its neighbour
    seen = F.transform("w", lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get(F.col("w"), i - 1) != t)).alias("first")))
    each = rows.select("s", F.explode(seen).alias("x")).select("s", "x.*")
    terms = each.groupBy("term").agg(F.sum("s").alias("occurrences"), F.coalesce(F.sum(F.when(F.col("first"), F.col("s"))), F.lit(0)).alias("records"))
    whole = rows.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("records")).select(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("occurrences"), "records")
    return terms.unionByName(whole)


class TermCounts:
    """Counts under ``path``: ``v=NofB/bucket=K`` holds bucket K of B as of merge N; the highest committed N holds. There are at
    least ``buckets`` of them, and one for every ``TERMS`` terms: a table that has outgrown its buckets twice over is
    written anew with more."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, terms: int = TERMS):
        self.spark, self.path, self.buckets, self.terms = spark, path.rstrip("/"), buckets, terms

    def _listing(self, path: str) -> list[str]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _newest(self) -> tuple[int, int, dict[int, str]]:
        """(last version, number of buckets, path of each bucket)."""
        newest, last, parts = {}, -1, 0
        for v, of in sorted(tuple(map(int, x[2:].split("of"))) for x in self._listing(self.path) if x.startswith("v=")):
            found = self._listing(f"{self.path}/v={v}of{of}")
            last = v
            if "_SUCCESS" in found:
                newest = (newest if of == parts else {}) | {int(x[7:]): f"{self.path}/v={v}of{of}/{x}" for x in found if x.startswith("bucket=")}
                parts = of
        return last, parts, newest

    def _read(self, paths: dict[int, str]) -> DataFrame:
        schema = STATE.rpartition(",")[0]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths.values())

    def merge(self, deltas: DataFrame) -> None:
        """Add :func:`term_deltas` to the stored counts. Terms that fall to zero keep a zero row until they return."""
        last, parts, newest = self._newest()
        deltas = written(deltas, "term-deltas")
        n_terms = max(deltas.count(), self._read(newest).count())
        if not newest or n_terms > 2 * parts * self.terms:
            parts = max(self.buckets, -(-n_terms // self.terms))
        bucket = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
        deltas = deltas.withColumn("bucket", bucket)
        if newest:
            if f"of{parts}/" in next(iter(newest.values())):
                touched = {r[0] for r in deltas.select("bucket").distinct().toLocalIterator()}  # at most one number per bucket
                newest = {b: path for b, path in newest.items() if b in touched}
            deltas = deltas.unionByName(self._read(newest).withColumn("bucket", bucket))
        merged = deltas.groupBy("bucket", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        merged.repartition(parts, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/v={last + 1}of{parts}")

    def counts(self) -> DataFrame:
        """(term, occurrences, records) of all terms that occur."""
        return self._read(self._newest()[2]).filter("term is not null and records > 0")

    def total(self) -> int:
        """The number of records, those without any word included."""
        row = self._read(self._newest()[2]).filter("term is null").agg(F.sum("records")).first()
        return row[0] or 0


def marked(counts: DataFrame, total: int, rare_records: int = 1, common_share: float = 0.05) -> DataFrame:
    """Adds ``mark``: ``rare`` in at most ``rare_records`` records, ``common`` in more than ``common_share`` of all
    records, else null. A term that is both is ``rare``."""
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.lit(total * common_share), "common")
    return counts.withColumn("mark", mark)
