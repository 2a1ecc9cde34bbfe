"""Tables written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_STAGED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, in local mode, as in tests, a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset; it has to name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="seqlume-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    _STAGED[read] = path
    return read


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_STAGED.pop(df))
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
