"""Lineage cuts that survive the loss of executors.

A cut is a Parquet table in the shared folder named by ``spark.checkpoint.dir``. Unlike cached blocks
or local checkpoints it has no owner among the executors, it is columnar (later stages read only the
columns they need) and its size is known to the planner.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SET = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session may do without that setting."""
    sc = spark.sparkContext
    folder = spark.conf.get(_SET, None) or sc.getConf().get(_SET, None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError(f"{_SET} must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="maskloom-")
    spark.conf.set(_SET, folder)
    return folder


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Nothing needs the shuffle files behind it any more, so Spark deletes them when the write ends. The
    tables of an application lie in a folder of its name, which can go when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/maskloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a cut; nothing may read it afterwards."""
    path = getattr(df, "_cut_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
