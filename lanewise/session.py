"""Session settings the analyses rely on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

from lanewise.plans.frozen import named_folder

# Adaptive execution splits skewed join partitions and coalesces small ones.
# ANSI mode turns an overflow into an error instead of a wrong figure.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # size of the files that rebalanced writes aim at; shuffles of queries are
    # still cut for parallelism first
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def builder(name: str = "lanewise") -> SparkSession.Builder:
    made = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        made = made.config(key, value)
    return made


def local(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and measurements."""
    return (
        builder().master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def with_folder(spark: SparkSession) -> SparkSession:
    """A session that has a folder for intermediate tables.

    Only a single-process session (``local``, ``local[n]``) without one gets a
    temporary folder of this machine; any cluster has to name its own.
    """
    if not named_folder(spark) and re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lanewise-"))
    return spark
