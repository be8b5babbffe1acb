"""Intermediate tables in the shared folder, and size checks for broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTING = "spark.checkpoint.dir"
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


_local: list[str] = []
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary
    folder of its own, and the setting stays as it is. On a cluster a machine-local
    folder would lose data with the machine, so a missing setting is an error there.
    """
    folder = spark.conf.get(SETTING, None)
    master = spark.conf.get("spark.master", "")
    if folder:
        if folder.startswith("file:") and not master.startswith("local"):
            raise RuntimeError(f"{SETTING} names a folder of one machine: {folder}")
        return folder.rstrip("/")
    if not master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors can reach")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tallyframe-"))
    return _local[0]


def new_path(spark: SparkSession) -> str:
    path = f"{shared_folder(spark)}/tallyframe-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    Cuts the lineage and fixes the rows, so a lost executor cannot change them. A
    ``path`` that an earlier table had, which nothing reads any more, is used again.
    """
    path = path or new_path(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that operators of this process have written, and return their number.

    Results that have not been computed or written yet read them, so call it after that.
    """
    count = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        count += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return count


def written_and_measured(
    df: DataFrame, path: str | None = None, limit: int | None = None
) -> tuple[DataFrame, bool]:
    """As :func:`written`; also whether the rows are few enough to broadcast.

    Beyond the limit a join is left to Spark, which shuffles both sides and splits
    skewed partitions. ``limit`` may lower it.
    """
    most = BROADCAST_LIMIT_BYTES if limit is None else min(limit, BROADCAST_LIMIT_BYTES)
    seen = Observation()
    table = written(df.observe(seen, _total_bytes(df).alias("bytes")), path)
    return table, (seen.get["bytes"] or 0) <= most


def _total_bytes(df: DataFrame) -> Column:
    fixed = 16 * (1 + len(df.columns))
    texts = [
        F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0))
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType))
    ]
    return F.sum(reduce(lambda a, b: a + b, texts, F.lit(fixed)).cast("bigint"))
