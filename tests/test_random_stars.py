"""All analyses on random dirty stars against the SQL twins."""

import os
from functools import partial

import duckdb
import pytest

import __spark_entry__ as entry
from lanewise import catalog
from lanewise.operators import reports
from lanewise.operators.clean import clean_star
from lanewise.sources.star import read_star, write_star
from parity import sql
from parity.compare import difference
from random_star import star, store_for_sql, tables

CLEAN = {
    **catalog.CLEANING, **catalog.CLEAN,
    "report_suppliers": partial(reports.suppliers, as_of=entry.AS_OF),
}


SEEDS = [int(seed) for seed in os.environ.get("TEST_SEEDS", "7").split(",")]


@pytest.fixture(scope="module", params=SEEDS)
def made(spark, request, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("random"))
    raw = star(spark, tables(request.param))
    twins = sql.twins(store_for_sql(raw, f"{root}/sql"))
    write_star(raw, f"{root}/raw")
    raw = read_star(spark, f"{root}/raw")
    return raw, clean_star(raw), twins, duckdb.connect()


@pytest.mark.parametrize("name", [n for n in catalog.RAW])
def test_raw(made, name):
    raw, _, twins, duck = made
    assert difference(entry.published(catalog.RAW[name](raw)), duck, twins[name]) == ""


@pytest.mark.parametrize("name", list(CLEAN))
def test_clean(made, name):
    _, clean, twins, duck = made
    assert difference(entry.published(CLEAN[name](clean)), duck, twins[name]) == ""
