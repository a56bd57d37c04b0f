"""Tables of a run that several plans read: written once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, deleted when the driver ends. A local session (tests) may leave that setting unset; a cluster may not."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/millrace-{spark.sparkContext.applicationId}"
    path = f"{folder.rstrip('/')}/run-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(place)
    store.deleteOnExit(place)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a folder of its own, deleted when the driver ends."""
    spark, path = df.sparkSession, f"{scratch(df.sparkSession)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
