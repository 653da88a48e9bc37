import pytest

import __spark_entry__ as entry
from lanewise.llm import registry
from parity.compare import connect, difference


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in registry.QUERIES] == list(range(1, 14))
    assert {*registry.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_equals_twin(spark, sf_dir, name):
    assert difference(registry.QUERIES[name](spark, sf_dir), connect(sf_dir), registry.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n[:4] in ("op1_", "op2_", "op5_", "op8_", "op12")])
def test_runs_on_whole_tables(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
