"""Tables written to the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Spark's setting that deletes a job's shuffle files when the job has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that have been written and not deleted.
_PATHS: dict[str, None] = {}


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in a local session without it, a temporary one."""
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="llm-"))
    return f"file://{_LOCAL[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once and read them again, so that no lost executor repeats the work.

    The table stands for what was shuffled to make it, so those files go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[path] = None
    table._written_path = path
    return table


def read_from(table: DataFrame, df: DataFrame) -> DataFrame:
    """The rows ``df``, which are made of a written table alone, so that dropping them deletes it."""
    df._written_path = table._written_path
    return df


def _deleted(spark: SparkSession, path: str) -> None:
    if _PATHS.pop(path, path) is None:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for df in tables:
        _deleted(df.sparkSession, df._written_path)


def release(spark: SparkSession) -> None:
    """Delete all tables that the operators wrote in this process; their results cannot be read afterwards."""
    for path in list(_PATHS):
        _deleted(spark, path)
