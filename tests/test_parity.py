"""Every registered query against its SQL twin, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from parity import sql
from parity.compare import connect, difference
from plans import executed, largest_method

TWINS = sql.twins()
QUERIES = {name: q for name, q in entry.queries().items()
           if name != "pipeline" and not name.startswith("op")}

# HotSpot leaves methods above this size in its interpreter
JIT_LIMIT = 8000


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_twin(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    assert difference(df, duck, TWINS[name]) == ""
    plan = executed(df)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan
    assert largest_method(df) < JIT_LIMIT


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 24
    assert df.count() > 0
