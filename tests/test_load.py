"""Text load: blanks, rejects, reload, failures, and the published files."""

import os
from pathlib import Path


from lanewise import schema
from lanewise.operators import audit
from lanewise.operators.clean import clean_carriers, clean_products, clean_routes, clean_suppliers
from lanewise.sources import delimited
from lanewise.sources.star import from_tables, read_table

HEADER = ",".join(schema.REF_CARRIERS.fieldNames())


def write(path, *lines):
    path.write_text("\r\n".join([HEADER, *lines]) + "\r\n")
    return str(path)


def test_blank_fields(spark, tmp_path):
    path = write(tmp_path / "c.csv", "1,C-1, ,SEA, ,,EU, ", "2,C-2,,road,91.5,0.4109,,Active")
    got = [tuple(r) for r in delimited.load(spark, "ref_carriers", path).rows.collect()]
    assert [(r[2], r[3], r[6], r[7]) for r in got] == [
        (" ", "SEA", "EU", " "), (None, "road", None, "Active")]
    assert [str(r[4]) for r in got] == ["None", "91.50"]
    assert [str(r[5]) for r in got] == ["None", "0.4109"]


def test_rejects(spark, tmp_path):
    path = write(tmp_path / "c.csv", "1,C-1,A,Sea,90,1,EU,Active", "2,C-2,B,Sea,high,1,EU,Active",
                 "3,C-3,too,few", "4,C-4,B,Sea,90,1,EU,Active,more", "x,C-5,B,Sea, ,1,EU,Active")
    load = delimited.load(spark, "ref_carriers", path)
    assert [r["carrier_key"] for r in load.rows.collect()] == [1]
    assert load.rows.count() == 1 and load.rejects.count() == 4
    assert {r["line"].split(",")[1]: r["reason"] for r in load.rejects.collect()} == {
        "C-2": "bad value in on_time_rate", "C-3": "wrong number of fields",
        "C-4": "wrong number of fields", "C-5": "bad value in carrier_key"}


def test_quotes_are_plain_text(spark, tmp_path):
    path = write(tmp_path / "c.csv", '1,C-1,"A,Sea,90,1,EU,Active')
    assert delimited.load(spark, "ref_carriers", path).rows.collect()[0]["carrier_name"] == '"A'


def test_reload_replaces_and_failures_stay_apart(spark, tmp_path):
    root = str(tmp_path / "tables")
    path = write(tmp_path / "c.csv", "1,C-1,A,Sea,90,1,EU,Active", "2,C-2,B,Sea,bad,1,EU,Active")
    for _ in range(2):
        outcome = delimited.load_star(
            spark, {"ref_routes": str(tmp_path / "missing.csv"), "ref_carriers": path}, root)
    assert outcome["ref_routes"].startswith("failed") and outcome["ref_carriers"] == "loaded"
    assert read_table(spark, "ref_carriers", root).count() == 1
    assert delimited.read_rejects(spark, "ref_carriers", root).count() == 1


# Counts documented for the published dimension files.
ROWS = {"ref_suppliers": 250, "ref_carriers": 60, "ref_routes": 200, "ref_warehouses": 40,
        "ref_products": 250}
MISSING = {"suppliers_missing_name": 16, "suppliers_missing_country": 21,
           "suppliers_missing_tier": 19, "suppliers_missing_rating": 17,
           "suppliers_missing_status": 8, "carriers_missing_mode": 2, "carriers_missing_otd_rate": 6}


def test_dimension_files_with_blanks(spark, stars, tmp_path):
    """Text with empty and blank fields gives the counts of the tables it was written from."""
    tables = {}
    for name in ROWS:
        delimited.export(stars.raw.table(name), str(tmp_path / name))
        load = delimited.load(spark, name, str(tmp_path / name), declared=True)
        assert load.rejects.count() == 0 and load.rows.count() == stars.raw.table(name).count()
        tables[name] = load.rows
    tables["fact_shipments"] = stars.raw.table("fact_shipments").limit(0)
    found = {r["check_name"]: r["issues"] for r in audit.before(from_tables(tables)).collect()}
    known = {r["check_name"]: r["issues"] for r in audit.before(stars.raw).collect()}
    assert {k: found[k] for k in MISSING} == {k: known[k] for k in MISSING}
    assert all(found[k] > 0 for k in MISSING)


def published_dimension_files(spark):
    folder = Path(os.environ["LANEWISE_CSV_DIR"])
    tables = {}
    for name, count in ROWS.items():
        load = delimited.load(spark, name, str(next(folder.glob(f"*{name}.csv"))))
        assert load.rejects.count() == 0 and load.rows.count() == count
        tables[name] = load.rows
    tables["fact_shipments"] = spark.createDataFrame([], schema.FACT_SHIPMENTS)
    raw = from_tables(tables)
    found = {r["check_name"]: r["issues"] for r in audit.before(raw).collect()}
    assert {k: found[k] for k in MISSING} == MISSING
    clean = raw.transformed({"ref_suppliers": clean_suppliers, "ref_carriers": clean_carriers,
                             "ref_routes": clean_routes, "ref_products": clean_products})
    assert all(r["remaining_issues"] == 0 for r in audit.after(clean).collect())
    assert clean.suppliers.select("country").distinct().count() == 27  # 26 and Unknown
    assert clean.carriers.select("transport_mode").distinct().count() == 5


if "LANEWISE_CSV_DIR" in os.environ:  # the published files are not at hand everywhere
    test_published_dimension_files = published_dimension_files


def test_text_is_parsed_once(spark, tmp_path):
    """The text is read again for rejected lines only if there are some."""
    plans = []
    real = delimited.load

    def counted(*args, **kwargs):
        plans.append(args)
        return real(*args, **kwargs)

    delimited.load = counted
    try:
        good = write(tmp_path / "good.csv", "1,C-1,A,Sea,90,1,EU,Active")
        bad = write(tmp_path / "bad.csv", "1,C-1,A,Sea,90,1,EU,Active", "2,C-2,B")
        assert delimited.load_star(spark, {"ref_carriers": good}, str(tmp_path / "a")) == {"ref_carriers": "loaded"}
        assert not plans  # no second read
        delimited.load_star(spark, {"ref_carriers": bad}, str(tmp_path / "b"))
        assert len(plans) == 1
    finally:
        delimited.load = real
    assert delimited.read_rejects(spark, "ref_carriers", str(tmp_path / "a")).count() == 0
    assert delimited.read_rejects(spark, "ref_carriers", str(tmp_path / "b")).count() == 1
    assert not (tmp_path / "a/_staged").exists()


def test_declared_widths_and_ranges(spark, tmp_path):
    long = "x" * 60
    path = write(tmp_path / "c.csv", f"1,{long},A,Sea,90,1,EU,Active", "2,C-2,A,Sea,90,1,EU,Active")
    assert delimited.load(spark, "ref_carriers", path).rows.count() == 2
    load = delimited.load(spark, "ref_carriers", path, declared=True)
    assert [r["carrier_key"] for r in load.rows.collect()] == [2]
    assert load.rejects.first()["reason"] == "too long for carrier_id"
    routes = tmp_path / "r.csv"
    routes.write_text(",".join(schema.REF_ROUTES.fieldNames()) + "\n1,R,A,B,C,10,300\n2,R,A,B,C,10,255\n")
    load = delimited.load(spark, "ref_routes", str(routes), declared=True)
    assert [r["route_key"] for r in load.rows.collect()] == [2]
    assert load.rejects.first()["reason"] == "out of range for avg_transit_days"
