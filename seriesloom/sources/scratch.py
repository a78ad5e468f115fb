"""Small tables that a later step needs as they are: written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="series-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/series-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The table, computed once and read from files from here on: it survives lost executors and its rows can be counted."""
    path = _folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
