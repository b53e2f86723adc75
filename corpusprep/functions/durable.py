"""Intermediate tables that several consumers read."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; without one, a folder in the
    warehouse, which driver and executors share as well.  On a cluster a warehouse on the driver's
    own disk is no such folder: that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    one_machine = spark.sparkContext.master.split("[")[0] == "local"
    if not one_machine and urlsplit(warehouse).scheme in ("", "file"):
        raise RuntimeError(f"{warehouse} is a local folder: name a shared one in spark.checkpoint.dir")
    return f"{warehouse}/_shared"


def stored(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    This runs a job.  What follows starts from the files: nothing is computed again when several
    branches read the frame or an executor is lost, and each branch reads only its columns.
    The files of a session stand in one folder of its own, which goes when the session's JVM ends.
    A writer and a reader hold a file's row group, which ends at ``group_bytes`` (or a hundred rows
    more): name it where rows are large.
    """
    spark = df.sparkSession
    own = f"{shared_folder(spark)}/stored-{spark.sparkContext.applicationId}"
    path = f"{own}/{uuid.uuid4().hex}"
    sized = {"parquet.block.size": group_bytes} if group_bytes else {}
    df.write.options(compression="zstd", **sized).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(own)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
