"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and everything runs in one process, as in tests, a fresh folder of this machine."""
    sc = spark.sparkContext
    if not (found := sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: driver and executors need a folder that they share")
        sc.setCheckpointDir(found := tempfile.mkdtemp(prefix="millrace-"))
    return f"{found.rstrip('/')}/millrace-{sc.applicationId}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read back: the plan is cut, and later reads survive the loss of executors. Deleted with the session, or by forget()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table that keep() wrote and that nothing will read again."""
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
