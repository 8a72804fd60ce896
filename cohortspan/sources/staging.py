"""Intermediate tables written to the folder all executors share.

A written table survives the loss of executors and cuts lineage. It also has a size on disk, which
Catalyst compares with ``spark.sql.autoBroadcastJoinThreshold`` when it picks a join: staged concept
sets are broadcast as long as they are small and shuffled once they are not, without a hint.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

# Folders of local sessions that name none.
_local: dict[str, str] = {}
# Bucketed tables of each application, by their names in the catalog.
_catalogued: dict[str, list[str]] = {}
_TABLES = "cohortspan_staged_"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else by the context's checkpoint directory.

    Only a local session may fall back to a temporary folder; on a cluster other machines could not
    read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="cohortspan-"))


def session_dir(spark: SparkSession) -> str:
    """Where this session stages its tables."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str, by: Sequence[Column] = ()) -> DataFrame:
    """Write ``df`` under the shared folder and return the table read back.

    ``by`` are named columns of few values that are added; each of their values has a folder of its own.
    """
    df = df.select("*", *by)
    path = f"{session_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*df.columns[len(df.columns) - len(by) :]).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, label: str, key: str, buckets: int | None = None) -> DataFrame:
    """``stage`` as a table bucketed by ``key``: tables staged with one number of buckets meet and are grouped without a shuffle.

    ``buckets`` is ``spark.sql.shuffle.partitions`` if not given. Each is one file, so rows must have been reduced to
    what one task can take of a key; a null key is one bucket's. The table is known to the session's catalog by a
    name of its own until ``drop_staged``, as buckets are a property of catalog tables.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{_TABLES}{label.replace('-', '_')}_{uuid.uuid4().hex}"
    # Rows that are already shuffled by the key to as many partitions stay where they are.
    rows = df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{session_dir(spark)}/{name}").saveAsTable(name)
    _catalogued.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


def drop_staged(spark: SparkSession) -> bool:
    """Delete all tables that this session has staged; whether there were any. None of them can be read afterwards."""
    for name in _catalogued.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
