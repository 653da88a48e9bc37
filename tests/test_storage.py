"""Stored shipments with a hot month, and the folder for intermediate results."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lanewise.plans.frozen import fresh_path, shared_folder
from lanewise.session import with_folder
from lanewise.sources.star import read_table, write_table


def test_hot_month_becomes_several_files(spark, stars, tmp_path):
    day = F.when(F.col("shipment_key") % 3 == 0, F.lit("1997-05-09").cast("date"))
    facts = stars.clean.table("fact_shipments").withColumn(
        "order_date", F.coalesce(day, "order_date")).repartition(16)
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "64KB")
    try:
        write_table(facts, "fact_shipments", str(tmp_path))
    finally:
        spark.conf.unset(key)
    files = {p.name: len(list(p.glob("*.parquet")))
             for p in (tmp_path / "fact_shipments").iterdir() if p.is_dir()}
    assert files["order_month=1997-05-01"] > 4
    assert "order_month=__HIVE_DEFAULT_PARTITION__" in files
    again = read_table(spark, "fact_shipments", str(tmp_path)).drop("order_month")
    assert again.count() == facts.count()
    assert again.exceptAll(facts.select(*again.columns)).count() == 0


def cluster(setting):
    conf = SimpleNamespace(get=lambda key, default=None: setting)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="yarn")
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_cluster_has_to_name_the_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(cluster(None))
    assert shared_folder(cluster("hdfs:///shared/")) == "hdfs:///shared/"


def test_paths_are_fresh(spark):
    first, second = fresh_path(spark, "star"), fresh_path(spark, "star")
    assert first != second and first.startswith(shared_folder(spark))


def test_repeated_stores_add_no_folders(spark, stars, sf_dir):
    queries = entry.queries()
    parent = Path(fresh_path(spark, "x").removeprefix("file:")).parent
    counts = []
    for _ in range(2):
        for name in ("load_shipments", "load_rejects", "publish_reports"):
            queries[name](spark, sf_dir).count()
        counts.append(len(list(parent.iterdir())))
    assert counts[0] == counts[1]


def test_only_one_process_sessions_get_a_folder_of_their_own():
    named = []
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077", "local[2]", "local"):
        made = cluster(None)
        made.sparkContext.master = master
        made.sparkContext.setCheckpointDir = lambda folder, master=master: named.append(master)
        with_folder(made)
    assert named == ["local[2]", "local"]
