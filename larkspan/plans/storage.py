"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); what is written there goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larkspan-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    path = f"{base.rstrip('/')}/larkspan-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def cut(df: DataFrame, **options: str) -> DataFrame:
    """df written to the shared folder, with options of the writer, and read again."""
    spark = df.sparkSession
    path = scratch(spark) + "/table"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
