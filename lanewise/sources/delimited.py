"""Bulk load of the tables from delimited text, with a reject table.

The text has one header line, commas, no quoting.  An empty field is NULL.  A
blank text field stays blank; a blank number or date is NULL.  A line with the
wrong number of fields, or with text where a number or date belongs, is set
aside with its reason instead of failing the load.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import (
    Column, DataFrame, Observation, SparkSession, functions as F, types as T,
)

from lanewise import schema
from lanewise.plans import versions
from lanewise.plans.frozen import remove
from lanewise.sources.star import write_rows

_LINE = "_line"  # filled by the reader for lines it could not convert in full
_WHY = "_why"  # the reason of a rejected line
REJECT_LAYOUT = T.StructType([T.StructField(c, T.StringType()) for c in ("table_name", "line", "reason")])


@dataclass(frozen=True)
class Load:
    """Both parts of one load.  Each is read lazily from the text."""

    rows: DataFrame
    rejects: DataFrame


def load(spark: SparkSession, table: str, path: str | list[str], header: bool = True,
         declared: bool = False) -> Load:
    """The good lines of a table's text and the rejected ones.

    With ``declared``, texts longer than their declared width and numbers out of
    their declared range are rejected as well.
    """
    lines, reason = _lines(spark, table, path, header, declared)
    return _parted(table, lines.withColumn(_WHY, reason))


def _lines(spark: SparkSession, table: str, path, header: bool, declared: bool):
    layout = schema.TABLES[table]
    lines = (
        spark.read.schema(T.StructType([*layout, T.StructField(_LINE, T.StringType())]))
        .option("header", header)
        .option("sep", ",")
        .option("quote", "")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _LINE)
        .option("columnPruning", False)  # with it, surplus fields go unnoticed
        .csv(path)
    )
    reason = _reason(layout)
    return lines, F.coalesce(reason, _out_of_bounds(layout)) if declared else reason


def _parted(table: str, marked: DataFrame) -> Load:
    reason = F.col(_WHY)
    # a line rejected for its width or range was converted in full
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in schema.TABLES[table].fieldNames()]
    line = F.coalesce(_LINE, F.concat_ws(",", *fields))
    return Load(
        rows=marked.where(reason.isNull()).select(*schema.TABLES[table].fieldNames()),
        rejects=marked.where(reason.isNotNull()).select(
            F.lit(table).alias("table_name"), line.alias("line"), reason.alias("reason")),
    )


def _out_of_bounds(layout: T.StructType) -> Column:
    """The first column that breaks its declared width or range."""
    tests = []
    for f in layout:
        width, span = f.metadata.get("max_length"), f.metadata.get("range")
        if width:
            tests.append(F.when(F.char_length(f.name) > width, F.lit(f"too long for {f.name}")))
        if span:
            tests.append(F.when(~F.col(f.name).between(*span), F.lit(f"out of range for {f.name}")))
    return F.coalesce(*tests)


def _reason(layout: T.StructType) -> Column:
    """Why a line is rejected; NULL for a good line.

    The reader keeps the text of a line it could not convert in full and leaves
    the failed fields NULL.  Only such lines are looked at again: they are good
    if every failed field is blank.
    """
    failed = F.array(*[
        F.lit(False) if isinstance(f.dataType, T.StringType) else F.col(f.name).isNull()
        for f in layout
    ])
    fields = F.split(_LINE, ",")
    wrong = F.zip_with(fields, failed, lambda text, null: null & (F.trim(text) != ""))
    first = F.array_position(wrong, F.lit(True)).cast("int")
    name = F.element_at(F.array(*[F.lit(n) for n in layout.fieldNames()]), first)
    return (
        F.when(F.col(_LINE).isNull(), F.lit(None))
        .when(F.size(fields) != len(layout), F.lit("wrong number of fields"))
        .when(first > 0, F.concat(F.lit("bad value in "), name))
    )


REJECTS = "rejects"


def load_star(spark: SparkSession, paths: dict[str, str], root: str,
              declared: bool = False) -> dict[str, str]:
    """Load the named files into stored tables; one outcome per table.

    The text is parsed once: the rejected lines are counted while the rows are
    written, and only if there are some it is read again for them.  Rows and
    rejects are two parts of one version, so both take the place of earlier ones
    in the same step, after both are written.  A table that cannot be loaded is
    reported, keeps what it had and does not stop the others; who reads the
    earlier rows goes on reading them.
    """
    outcome = {}
    for table, path in paths.items():
        there, run = f"{root}/{table}", versions.new_run()
        parts = {versions.ROWS: f"{run}/{versions.ROWS}", REJECTS: f"{run}/{REJECTS}"}
        try:
            before = versions.current(spark, there)
            lines, reason = _lines(spark, table, path, True, declared)
            seen = Observation()
            marked = lines.withColumn(_WHY, reason).observe(
                seen, F.count_if(F.col(_WHY).isNotNull()).alias("rejected"))
            found = _parted(table, marked)
            write_rows(found.rows, table, f"{there}/{parts[versions.ROWS]}")
            rejected = seen.get["rejected"]
            if rejected:
                found = load(spark, table, path, declared=declared)
            rejects = found.rejects if rejected else spark.createDataFrame([], REJECT_LAYOUT)
            rejects.write.parquet(f"{there}/{parts[REJECTS]}")
            versions.commit(spark, there, before, parts)
            outcome[table] = "loaded"
        except Exception as error:  # reported per table, the next one is still tried
            outcome[table] = f"failed: {error}"
            remove(spark, f"{there}/{run}")
    return outcome


def read_rejects(spark: SparkSession, table: str, root: str) -> DataFrame:
    """The rejected lines of the load that the stored table comes from."""
    return spark.read.schema(REJECT_LAYOUT).parquet(versions.folder(spark, f"{root}/{table}", REJECTS))


def export(df: DataFrame, path: str) -> None:
    """Write a table in the text form that :func:`load` reads, as gzip files of a task's rows each."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", "")
        .option("compression", "gzip")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
