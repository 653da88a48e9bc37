"""Written-down intermediate results in the cluster's shared folder.

The folder is the one named by ``spark.checkpoint.dir``; the library never
picks a machine-local one.  Written tables live under one folder per
application, which is removed when the application ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_kept: dict[tuple[str, str], str] = {}
_owned: set[tuple[str, str]] = set()


def named_folder(spark: SparkSession) -> str | None:
    """The folder of the setting or of the running context, if there is one."""
    return (spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
            or spark.sparkContext.getCheckpointDir())


def shared_folder(spark: SparkSession) -> str:
    folder = named_folder(spark)
    if not folder:
        raise RuntimeError(f"set {_SETTING} to a folder all executors share")
    return folder


def freeze(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed at once, survives the loss of executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, in Spark's own client on the driver."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _own_folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    root = f"{shared_folder(spark).rstrip('/')}/lanewise-{app}"
    if (app, root) not in _owned:
        files, there = hadoop(spark, root)
        files.mkdirs(there)
        files.deleteOnExit(there)  # with the driver's JVM
        _owned.add((app, root))
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table, removed when the application ends."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    files, there = hadoop(spark, path)
    files.delete(there, True)


def renewed_path(spark: SparkSession, name: str) -> str:
    """A new path that replaces the one given out for this name before.

    The earlier table is removed, so repeating a job adds no folders; frames
    that still read the earlier table fail.
    """
    key = (spark.sparkContext.applicationId, name)
    if key in _kept:
        remove(spark, _kept[key])
    _kept[key] = fresh_path(spark, name)
    return _kept[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
