"""The profile of columns with many values."""

import pytest
from pyspark.sql import functions as F

from lanewise.functions import distinct
from lanewise.operators import explore


def looks(df):
    return df.agg(*[F.struct(
        F.count_if(F.col(c).isNull()).alias("n_null"), F.lit(0).alias("n_blank"),
        F.approx_count_distinct(c).alias("about"),
        (F.min(c) if c != "text" else F.lit(None)).cast("bigint").alias("least"),
        (F.max(c) if c != "text" else F.lit(None)).cast("bigint").alias("most")).alias(c) for c in df.columns]).first()


@pytest.fixture(scope="module")
def many(spark):
    """Values that repeat around 0 with nulls, one that is alone, ones far apart, texts."""
    i = F.col("id")
    return spark.range(0, 20000, 1, 4).select(
        F.when(i % 13 != 0, i % 901 - 450).alias("near"), F.when(i > 0, F.lit(5)).cast("int").alias("one"),
        (i % 700 * 1000003 - (1 << 40)).alias("far"), i.alias("own"), F.concat(F.lit("t"), i % 800).alias("text"))


def test_columns_are_counted_exactly_however_they_are_shuffled(many, monkeypatch):
    monkeypatch.setattr(explore, "TUPLES", 500)
    look = looks(many)
    counted = explore._counted(many, 20000, list(look))
    got = {many.columns[r["ordinal_position"] - 1]: (r["n_null"], r["n_distinct"]) for r in counted.collect()}
    assert got == {"near": (1539, 901), "one": (1, 1), "far": (0, 700), "own": (0, 20000), "text": (0, 800)}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bit_or") == 1 and explore._as_bits(look["near"], 20000)
    assert not any(explore._as_bits(look[c], 20000) for c in ("far", "own", "text"))
    assert plan.count("count(1)") <= 1  # columns on their own are shuffled without counts


def test_words_hold_every_value_once(spark):
    values = [None, -1, -64, -65, 0, 63, 64, 63, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(v,) for v in values], "k bigint")
    got = distinct.words(df, "k").agg(F.sum(F.bit_count(distinct.BITS)), F.count(F.lit(1))).first()
    assert tuple(got) == (8, 6)
