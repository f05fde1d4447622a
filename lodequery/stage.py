"""Written intermediate tables.

Lineage is cut with tables in the shared folder named by ``spark.checkpoint.dir``, so a lost executor only costs a
re-read. Where the setting is missing (tests, a laptop) and the master is local, a folder of our own is used and removed at the end.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables, without a trailing slash."""
    conf = spark.sparkContext.getConf()
    if found := (conf.get(_KEY, None) or spark.conf.get(_KEY, None)):
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lodequery-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own[app] = "file://" + own
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan above it is not run again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
