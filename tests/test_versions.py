"""Tables that change in one step: loads that fail, readers that go on, months made anew alone."""

import shutil
from datetime import date

import pytest
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.operators import reports
from lanewise.operators.clean import clean_star, clean_stored
from lanewise.plans import versions
from lanewise.sources import delimited
from lanewise.sources.star import MONTH, from_tables, read_star, read_table, write_star

HEADER = ",".join(schema.REF_CARRIERS.fieldNames())
GOOD = "{0},C-{0},A,Sea,90,1,EU,Active"


def text(path, *lines):
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


def load(spark, root, path):
    return delimited.load_star(spark, {"ref_carriers": path}, root)["ref_carriers"]


def pair(spark, root):
    return (sorted(r[0] for r in read_table(spark, "ref_carriers", root).select("carrier_key").collect()),
            sorted(r[0] for r in delimited.read_rejects(spark, "ref_carriers", root).select("line").collect()))


@pytest.mark.parametrize("step", ["write_rows", "load", "commit"])
def test_a_load_that_fails_leaves_the_old_pair(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "t")
    assert load(spark, root, text(tmp_path / "a.csv", GOOD.format(1), "2,bad")) == "loaded"
    old = pair(spark, root)
    assert old == ([1], ["2,bad"])

    def fail(*_, **__):
        raise OSError("gone")

    with monkeypatch.context() as broken:
        broken.setattr(versions if step == "commit" else delimited, step, fail)
        again = text(tmp_path / "b.csv", GOOD.format(3), GOOD.format(4), "5,worse")
        assert load(spark, root, again).startswith("failed: gone")
    assert pair(spark, root) == old
    assert len(list((tmp_path / "t/ref_carriers/data").iterdir())) == 1  # nothing left behind
    assert load(spark, root, again) == "loaded"
    assert pair(spark, root) == ([3, 4], ["5,worse"])


def test_a_version_that_is_being_written_does_not_count(spark, tmp_path):
    root = str(tmp_path / "t")
    load(spark, root, text(tmp_path / "a.csv", GOOD.format(1)))
    folder = tmp_path / "t/ref_carriers/_versions"
    (folder / "000000000007.json").write_text('{"folders": {"ro')
    assert pair(spark, root) == ([1], [])
    load(spark, root, text(tmp_path / "b.csv", GOOD.format(2)))
    assert pair(spark, root) == ([2], [])
    assert versions.current(spark, f"{root}/ref_carriers").number == 8


def test_the_slower_of_two_writers_fails(spark, tmp_path):
    root = str(tmp_path / "t")
    seen = versions.current(spark, root)
    versions.commit(spark, root, seen, {"rows": "data/run=r1/rows"})
    with pytest.raises(versions.ConcurrentChange):
        versions.commit(spark, root, seen, {"rows": "data/run=r2/rows"})
    assert versions.current(spark, root).folders == {"rows": "data/run=r1/rows"}


def test_readers_keep_their_version(spark, tmp_path):
    root = str(tmp_path / "t")
    load(spark, root, text(tmp_path / "a.csv", GOOD.format(1)))
    reader = read_table(spark, "ref_carriers", root)
    load(spark, root, text(tmp_path / "b.csv", GOOD.format(2), GOOD.format(3)))
    assert reader.count() == 1 and read_table(spark, "ref_carriers", root).count() == 2
    load(spark, root, text(tmp_path / "c.csv"))
    assert len(list((tmp_path / "t/ref_carriers/data").glob("*/rows"))) == 2  # the present one and the one before


@pytest.fixture
def raw(spark, stars, tmp_path):
    """A stored raw star of a tenth of the shipments."""
    root = str(tmp_path / "raw")
    tables = {n: stars.raw.table(n) for n in schema.TABLES}
    tables["fact_shipments"] = tables["fact_shipments"].where("shipment_key % 10 = 1")
    write_star(from_tables(tables), root)
    return root


def rewrite_month(spark, root, place, rows):
    """Write one month of the shipments anew; its folder name."""
    facts = read_table(spark, "fact_shipments", root)
    month = sorted(r[0] for r in facts.select(MONTH).distinct().collect() if r[0])[place]
    new = rows(facts.where(F.col(MONTH) == F.lit(month)).drop(MONTH))
    kept, layout = new.collect(), new.schema
    folder = f"{root}/fact_shipments/{MONTH}={month}"
    shutil.rmtree(folder)
    spark.createDataFrame(kept, layout).write.parquet(folder)
    return f"{MONTH}={month}"


def same(a, b, columns):
    a, b = a.select(*columns), b.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def agree(spark, raw, clean):
    expected = clean_star(read_star(spark, raw))
    got = read_star(spark, clean)
    return all(same(got.table(n), expected.table(n), schema.TABLES[n].fieldNames()) for n in schema.TABLES)


def test_only_changed_months_are_cleaned(spark, raw, tmp_path):
    clean = str(tmp_path / "clean")
    first = clean_stored(spark, raw, clean)
    assert len(first["fact_shipments"]) > 50 and all(first.values())
    assert agree(spark, raw, clean)
    assert not any(clean_stored(spark, raw, clean).values())
    before = read_table(spark, "fact_shipments", clean)
    rows = before.count()
    month = rewrite_month(spark, raw, 7, lambda df: df.withColumn("status", F.lit(" ")).limit(5))
    made = clean_stored(spark, raw, clean)
    assert {n: p for n, p in made.items() if p} == {"fact_shipments": [month]}
    assert agree(spark, raw, clean)
    assert before.count() == rows  # the reader of the version before
    now = read_table(spark, "fact_shipments", clean)
    assert now.where(F.col(MONTH) == month.split("=")[1]).count() == 5
    products = read_table(spark, "ref_products", raw).limit(10)
    kept, layout = products.collect(), products.schema
    spark.createDataFrame(kept, layout).write.mode("overwrite").parquet(f"{raw}/ref_products")
    assert {n: p for n, p in clean_stored(spark, raw, clean).items() if p} == {"ref_products": ["rows"]}
    assert agree(spark, raw, clean)


def test_a_month_that_is_gone_is_gone_from_the_clean_table(spark, raw, tmp_path):
    clean = str(tmp_path / "clean")
    clean_stored(spark, raw, clean)
    month = next(iter(sorted((tmp_path / "raw/fact_shipments").glob(f"{MONTH}=19*"))))
    shutil.rmtree(month)
    assert clean_stored(spark, raw, clean)["fact_shipments"] == []
    assert read_table(spark, "fact_shipments", clean).where(F.col(MONTH) == month.name.split("=")[1]).isEmpty()


def test_only_changed_months_are_published(spark, raw, tmp_path):
    clean, root, day = str(tmp_path / "clean"), str(tmp_path / "reports"), date(2001, 1, 1)
    clean_stored(spark, raw, clean)

    def publish():
        star = read_star(spark, clean)
        made = reports.publish(star, day, root, database="default")
        full = reports.shipments(star)
        assert same(spark.table("report_shipments"), full, full.columns)
        assert same(spark.table("default.report_shipments"), full, full.columns)
        assert spark.table("report_suppliers").count() == reports.suppliers(star, day).count()
        return made

    try:
        first = publish()
        assert len(first["report_shipments"]) > 50 and first["report_suppliers"] == ["rows"]
        assert publish() == {"report_suppliers": [], "report_shipments": []}
        reader, rows = spark.table("report_shipments"), spark.table("report_shipments").count()
        month = rewrite_month(spark, raw, 9, lambda df: df.limit(3))
        clean_stored(spark, raw, clean)
        assert publish() == {"report_suppliers": ["rows"], "report_shipments": [month]}
        assert reader.count() == rows > spark.table("report_shipments").count()
        carriers = read_table(spark, "ref_carriers", raw).withColumn("carrier_name", F.lit("one"))
        kept, layout = carriers.collect(), carriers.schema
        spark.createDataFrame(kept, layout).write.mode("overwrite").parquet(f"{raw}/ref_carriers")
        clean_stored(spark, raw, clean)
        assert len(publish()["report_shipments"]) == len(first["report_shipments"])  # a dimension is in all months
    finally:
        spark.sql("drop view if exists default.report_shipments")
        spark.sql("drop view if exists default.report_suppliers")


def test_a_star_without_files_is_published_whole(spark, stars, tmp_path):
    star = from_tables({n: stars.clean.table(n).limit(200) for n in schema.TABLES})
    for _ in range(2):
        made = reports.publish(star, date(2001, 1, 1), str(tmp_path))
        assert made["report_shipments"] and made["report_suppliers"]
