"""The star: five dimension tables around one shipment table."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lanewise import schema
from lanewise.plans import versions

MONTH = "order_month"
MONTH_FIELD = T.StructField(MONTH, T.DateType())
SALT = "key_salt"  # spreads frequent keys of a bucketed dimension


class Star:
    """Lazily built tables.

    ``facts(*keys)`` gives the shipments with the named foreign keys.  A source
    that has to join for a key builds that join only when the key is asked for.
    """

    def __init__(self, dimensions: dict[str, Callable[[], DataFrame]],
                 shipments: Callable[[tuple[str, ...]], DataFrame], states=None,
                 late: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
                 root: str | None = None, by_month: Callable[[], DataFrame] | None = None):
        self._dimensions = dimensions
        self._shipments = shipments
        self.late = late or {}  # dimensions that are made from the stored shipments
        self.root = root  # where the tables are stored as they are
        self.by_month = by_month  # the whole shipments, dealt to tasks by order month already
        self.salted: str | None = None  # dimension that is joined by key and salt
        self.states = states  # measure states of these shipments, where they are stored

    def with_states(self, states) -> Star:
        return Star(self._dimensions, self._shipments, states, self.late, self.root, self.by_month)

    def dimension(self, name: str) -> DataFrame:
        """The rows of a dimension, each once."""
        rows = self._dimensions[name]()
        return rows.where(F.col(SALT) == 0).drop(SALT) if name == self.salted else rows

    def copies(self, name: str) -> DataFrame:
        """The rows of the salted dimension, once for each salt."""
        return self._dimensions[name]()

    @property
    def suppliers(self) -> DataFrame:
        return self.dimension("ref_suppliers")

    @property
    def carriers(self) -> DataFrame:
        return self.dimension("ref_carriers")

    @property
    def routes(self) -> DataFrame:
        return self.dimension("ref_routes")

    @property
    def warehouses(self) -> DataFrame:
        return self.dimension("ref_warehouses")

    @property
    def products(self) -> DataFrame:
        return self.dimension("ref_products")

    def facts(self, *keys: str) -> DataFrame:
        unknown = set(keys) - set(schema.FOREIGN_KEYS)
        if unknown:
            raise ValueError(f"not a foreign key: {sorted(unknown)}")
        return self._shipments(keys)

    def table(self, name: str) -> DataFrame:
        """A whole table by name, columns in schema order."""
        if name == "fact_shipments":
            df = self.facts(*schema.FOREIGN_KEYS)
        else:
            df = self.dimension(name)
        return df.select(*schema.TABLES[name].fieldNames())

    def replaced(self, dimensions: dict[str, DataFrame], shipments: DataFrame, salted: str) -> Star:
        """A star that reads these tables, with copies of ``salted`` rows for each salt."""
        own = {n: (lambda df=df: df) for n, df in dimensions.items()}
        star = Star({**self._dimensions, **own}, lambda keys: shipments)
        star.salted = salted
        return star

    def transformed(self, steps: dict[str, Callable[[DataFrame], DataFrame]]) -> Star:
        """A star whose named tables pass through a function."""
        def apply(name: str, build):
            step = steps.get(name)
            return (lambda: step(build())) if step else build

        facts = steps.get("fact_shipments", lambda df: df)
        star = Star({n: apply(n, b) for n, b in self._dimensions.items()},
                    lambda keys: facts(self._shipments(keys)),
                    by_month=self.by_month and (lambda: facts(self.by_month())))
        star.salted = self.salted
        return star


def from_tables(tables: dict[str, DataFrame], root: str | None = None) -> Star:
    """A star over six ready DataFrames, stored below ``root`` if that is given."""
    names = [n for n in schema.TABLES if n != "fact_shipments"]
    return Star({n: (lambda df=tables[n]: df) for n in names},
                lambda keys: tables["fact_shipments"], root=root,
                by_month=(lambda: tables["fact_shipments"]) if root else None)


def collated(star: Star, collation: str = "UTF8_LCASE_RTRIM") -> Star:
    """The same star with texts that compare, join and group by a collation.

    The default ignores case and trailing spaces, as many database servers do;
    without this function texts compare byte by byte.  A group shows one of its
    spellings, which one is not defined.
    """
    def step(df: DataFrame) -> DataFrame:
        return df.withColumns({
            f.name: F.collate(f.name, collation) for f in df.schema if isinstance(f.dataType, T.StringType)})

    return star.transformed(dict.fromkeys(schema.TABLES, step))


def write_star(star: Star, root: str) -> None:
    """Store all six tables as Parquet, replacing earlier content.

    The tables are independent, so their jobs share the cluster.  A dimension that
    only lists what the shipments hold waits for them.  Shipments that lie by month
    already are not shuffled for it.
    """
    def one(name: str) -> None:
        if name == "fact_shipments" and star.by_month:
            rows = star.by_month().select(*schema.TABLES[name].fieldNames())
            write_by_month(rows, f"{root}/{name}", dealt=True)
        else:
            write_table(star.table(name), name, root)

    with ThreadPoolExecutor(len(schema.TABLES)) as pool:
        list(pool.map(one, [n for n in schema.TABLES if n not in star.late]))
    for name, made in star.late.items():
        facts = read_table(star.dimension(name).sparkSession, "fact_shipments", root)
        write_table(made(facts).select(*schema.TABLES[name].fieldNames()), name, root)


def write_table(df: DataFrame, name: str, root: str) -> None:
    """Store one table as Parquet; shipments are partitioned by order month."""
    write_rows(df, name, f"{root}/{name}")


def write_rows(df: DataFrame, name: str, path: str) -> None:
    if name != "fact_shipments":
        df.write.mode("overwrite").parquet(path, compression=versions.COMPRESSION)
    else:
        write_by_month(df, path)


def write_by_month(df: DataFrame, path: str, dealt: bool = False) -> None:
    """Store rows by the month of their order_date.

    The rebalance hint lets AQE cut a month with very many shipments into
    several even files and put small months together in one task.  ``dealt`` rows
    lie in their tasks by month already and stay there.
    """
    monthly = df.withColumn(MONTH, F.trunc("order_date", "MM"))
    if dealt:
        versions.write_dealt(monthly, MONTH, path, "overwrite")
    else:
        monthly.hint("rebalance", MONTH).write.mode("overwrite").partitionBy(MONTH).parquet(
            path, compression=versions.COMPRESSION)


def read_table(spark: SparkSession, name: str, root: str) -> DataFrame:
    """Read one stored table, the current version where it has versions.

    The declared schema avoids a footer scan.
    """
    layout, path = schema.TABLES[name], f"{root}/{name}"
    if name == "fact_shipments":
        version = versions.current(spark, path)
        if version.number and versions.ROWS not in version.folders:
            return versions.read(spark, path, layout, MONTH_FIELD)
        layout = T.StructType([*layout, MONTH_FIELD])
    return spark.read.schema(layout).parquet(versions.folder(spark, path))


def read_star(spark: SparkSession, root: str) -> Star:
    return from_tables({name: read_table(spark, name, root) for name in schema.TABLES}, root)


def months_of(spark: SparkSession, root: str) -> dict[str, str]:
    """The months of the shipments stored below ``root``, each with a mark of its files."""
    path = f"{root}/fact_shipments"
    kept_whole = versions.ROWS in versions.current(spark, path).folders
    return versions.months(spark, versions.folder(spark, path) if kept_whole else path)


def marks_of(spark: SparkSession, root: str, names: list[str]) -> str:
    """A text that changes with the files of the named stored tables."""
    return " ".join(versions.fingerprint(spark, versions.folder(spark, f"{root}/{n}")) for n in names)
