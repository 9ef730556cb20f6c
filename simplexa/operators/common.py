"""Cutting lineage where a result is read more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: later reads neither recompute it nor need an executor that is gone."""
    folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``settle``, but as a table whose size the planner knows, so that small ones are broadcast; computed once."""
    path = f"{folder(df).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    atexit.register(_delete, out.sparkSession, path)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` from which nothing is still to be read; others go when the driver ends."""
    for x in tables:
        _delete(x.sparkSession, x.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session may be gone by then; the folder is the cluster's to clean
        return


def folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of this machine stands in on local masters only."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="simplexa-"))
    return spark.sparkContext.getCheckpointDir()
