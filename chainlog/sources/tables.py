"""Tables in the folder that driver and executors share, for results that several jobs use or that cut a long plan."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, on one machine, below the session's warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, what was written to the shared folder within. Results that read from it must be stored by then."""
    first = len(_made)
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        while len(_made) > first:
            path = jvm.org.apache.hadoop.fs.Path(_made.pop())
            path.getFileSystem(conf).delete(path, True)
