"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What one task reads of a shuffle whose size is known.
PARTITION_BYTES = 64 << 20
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session in local mode may go without that setting (tests); it gets a
    temporary folder, since driver and executors are then one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="voxloom-"))


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/voxloom/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application. Results that haven't been written yet are lost."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def partitions_for(spark: SparkSession, size: int) -> int:
    """Partitions for a shuffle of so many bytes: those of the session, or more where they would exceed PARTITION_BYTES."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def stash(df: DataFrame, name: str, codec: str = "zstd", **options: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its lineage is
    cut, and a lost executor costs a read instead of a recomputation."""
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", codec).options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
