"""Tables that cut lineage: written once in the folder the cluster names, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset a local folder stands in for it, but only if all tasks run in this machine's one JVM."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a new table in the shared folder. Lost executors cost nothing that was written."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the scratch tables of this application, and says how many; to be called once the results are read or written."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    return len(paths)
