"""Stored tables whose content changes in one step.

A table folder holds written folders and numbered version files.  A version names
the parts that make up the table: for each part its folder and, for a derived
table, what of its source the part was made from.  Writers put new parts beside
the old ones and then add the next version file; readers resolve the highest
version once and go on reading its folders, whatever is written meanwhile.  A
writer that fails leaves no version, so the table stays as it was.  Two writers
cannot add the same number: the slower one gets an error.  The folders of the
last version but one are kept for those who still read them.

Listings and version files go through Spark's own file system client on the
driver; no job runs for them.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lanewise.plans.frozen import hadoop, remove

_FOLDER = "_versions"
COMPRESSION = "zstd"  # of stored tables
RUN = "run"


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_MONTHS = 32  # files a task keeps open; rows of further months are sorted
_one_at_a_time = threading.Lock()


class ConcurrentChange(RuntimeError):
    """Another writer has added the version meanwhile."""


@dataclass(frozen=True)
class Entry:
    """A file or folder as listed."""

    path: str
    folder: bool
    size: int
    time: int

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]


@dataclass(frozen=True)
class Version:
    number: int = 0  # 0: nothing is stored yet
    folders: dict[str, str] = field(default_factory=dict)  # part -> folder below the table's
    covers: dict[str, str] = field(default_factory=dict)  # part -> what it was made from


def children(spark: SparkSession, path: str) -> list[Entry]:
    """What a folder holds, or a file itself; empty where there is nothing."""
    files, there = hadoop(spark, path)
    if not files.exists(there):
        return []
    return [Entry(s.getPath().toString(), s.isDirectory(), s.getLen(), s.getModificationTime())
            for s in files.listStatus(there)]


def listing(spark: SparkSession, path: str) -> list[Entry]:
    """All data files below a path, hidden ones left out; one call for each folder."""
    found, waiting = [], [path]
    while waiting:
        for entry in children(spark, waiting.pop()):
            if entry.folder and not entry.name.startswith(("_", ".")):
                waiting.append(entry.path)
            elif not entry.folder and not entry.name.startswith(("_", ".")):
                found.append(entry)
    return sorted(found, key=lambda e: e.path)


def changed_at(spark: SparkSession, path: str) -> int:
    """When the file or the folder's own entries were last changed; 0 where there is nothing."""
    files, there = hadoop(spark, path)
    return files.getFileStatus(there).getModificationTime() if files.exists(there) else 0


def fingerprint(spark: SparkSession, path: str) -> str:
    """A text that changes when a data file below the path is added, removed or rewritten."""
    files = "\n".join(f"{e.path} {e.size} {e.time}" for e in listing(spark, path))
    return hashlib.sha256(files.encode()).hexdigest()


def current(spark: SparkSession, root: str) -> Version:
    """The highest whole version; a version file that is being written does not count yet."""
    for entry in sorted(children(spark, f"{root}/{_FOLDER}"), key=lambda e: e.name, reverse=True):
        made = _read(spark, entry)
        if made:
            return made
    return Version()


def _read(spark: SparkSession, entry: Entry) -> Version | None:
    files, there = hadoop(spark, entry.path)
    stream = files.open(there)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        return Version(int(entry.name.split(".")[0]), **json.loads(text))
    except json.JSONDecodeError:
        return None
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, seen: Version, folders: dict[str, str],
           covers: dict[str, str] | None = None) -> Version:
    """Add the version after ``seen`` and remove folders that no kept version names."""
    entries = children(spark, f"{root}/{_FOLDER}")
    numbers = [int(e.name.split(".")[0]) for e in entries]
    if any(n > seen.number and _read(spark, e) for n, e in zip(numbers, entries)):
        raise ConcurrentChange(root)
    made = Version(max([seen.number, *numbers]) + 1, folders, covers or {})
    files, there = hadoop(spark, f"{root}/{_FOLDER}/{made.number:012d}.json")
    try:
        out = files.create(there, False)
    except Exception as error:
        raise ConcurrentChange(root) from error
    out.write(bytearray(json.dumps({"folders": made.folders, "covers": made.covers}).encode()))
    out.close()
    _sweep(spark, root, entries, [made, seen])
    return made


def _sweep(spark: SparkSession, root: str, entries: list[Entry], kept: list[Version]) -> None:
    """Remove the version files before the kept ones and the folders only they name."""
    numbers = {v.number for v in kept}
    named = {f for v in kept for f in v.folders.values()}
    for entry in entries:
        if int(entry.name.split(".")[0]) in numbers:
            continue
        old = _read(spark, entry)
        for folder in {*(old.folders.values() if old else [])} - named:
            remove(spark, f"{root}/{folder}")
        remove(spark, entry.path)


def new_run() -> str:
    """The name of a folder that no other writer uses."""
    return f"data/{RUN}=r{uuid.uuid4().hex}"


# --- tables kept as a whole ---------------------------------------------------

ROWS = "rows"


def folder(spark: SparkSession, root: str, part: str = ROWS) -> str:
    """Where a part of the current version lies; the table's own folder if it has no versions."""
    version = current(spark, root)
    if not version.number and part != ROWS:
        raise FileNotFoundError(f"{root} has no stored {part}")
    return f"{root}/{version.folders[part]}" if version.number else root


def refresh_whole(spark: SparkSession, root: str, covers: str, build: Callable[[], DataFrame]) -> bool:
    """Write a derived table anew unless it was made from what ``covers`` tells; whether it was."""
    seen = current(spark, root)
    if seen.covers.get(ROWS) == covers:
        return False
    run = new_run()
    build().write.parquet(f"{root}/{run}/{ROWS}", compression=COMPRESSION)
    commit(spark, root, seen, {ROWS: f"{run}/{ROWS}"}, {ROWS: covers})
    return True


# --- tables kept by month -----------------------------------------------------


def read(spark: SparkSession, root: str, layout: T.StructType, month: T.StructField) -> DataFrame:
    """The table of the current version, with the month as its last column."""
    version = current(spark, root)
    if not version.folders:
        return spark.createDataFrame([], T.StructType([*layout, month]))
    run = T.StructField(RUN, T.StringType())
    reader = spark.read.option("basePath", f"{root}/data")
    if not _split(version):
        runs: dict[str, list[str]] = {}
        for part, folder in version.folders.items():
            runs.setdefault(folder, []).append(part)
        rows = reader.schema(T.StructType([*layout, month, run])).parquet(*[f"{root}/{r}" for r in runs])
        if len(runs) > 1:  # a run counts for the months that no later one has made anew
            rows = rows.where(reduce(Column.__or__, [
                (F.col(RUN) == folder.split("=", 1)[1]) & _in_months(month.name, parts)
                for folder, parts in runs.items()]))
        return rows.drop(RUN)
    paths = [f"{root}/{f}" for f in version.folders.values()]
    runs = {f.rsplit("/", 1)[0] for f in version.folders.values()}
    if len(runs) == 1:
        whole = f"{root}/{runs.pop()}"
        if sum("=" in e.name for e in children(spark, whole)) == len(paths):
            paths = [whole]  # one folder to list instead of one for each month
    return reader.schema(T.StructType([*layout, run, month])).parquet(*paths).drop(RUN)


def as_sql(spark: SparkSession, root: str, columns: list[str]) -> str:
    """A query for the current version of a table with a folder for each month.

    It goes on giving that version's rows while later ones are written.
    """
    runs: dict[str, list[str]] = {}
    for part, there in current(spark, root).folders.items():
        runs.setdefault(there.split("/")[1].split("=", 1)[1], []).append(part)
    tests = []
    for run, parts in sorted(runs.items()):
        month = parts[0].split("=", 1)[0]
        days = [p.split("=", 1)[1] for p in parts]
        known = ", ".join(f"date'{d}'" for d in sorted(days) if not d.startswith("__"))
        either = [f"`{month}` in ({known})"] if known else []
        if any(d.startswith("__") for d in days):
            either.append(f"`{month}` is null")
        tests.append(f"({RUN} = '{run}' and ({' or '.join(either)}))")
    names = ", ".join(f"`{c}`" for c in columns)
    return f"select {names} from parquet.`{root}/data` where {' or '.join(tests) or 'false'}"


def _split(version: Version) -> bool:
    """Whether each month has a folder of its own."""
    return all(f.endswith(f"/{part}") for part, f in version.folders.items())


def write_dealt(df: DataFrame, month: str, path: str, mode: str = "error") -> None:
    """Store rows that lie in their tasks by month already: without a shuffle and without
    sorting a task's rows, which keeps the files of its few months open instead.
    """
    conf = df.sparkSession.conf
    with _one_at_a_time:
        before = conf.get(_WRITERS)
        conf.set(_WRITERS, OPEN_MONTHS)
        try:
            df.write.mode(mode).partitionBy(month).parquet(path, compression=COMPRESSION)
        finally:
            conf.set(_WRITERS, before)


def months(spark: SparkSession, root: str) -> dict[str, str]:
    """Per month folder of a stored table, by its name, a text that changes with its files.

    The table is a versioned one or a plain folder of month folders.  One job lists
    the files, whose contents are not read.
    """
    version = current(spark, root)
    folders = [f"{root}/{f}" for f in version.folders.values()] if version.number else [root]
    if not folders or not children(spark, folders[0]):
        return {}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders).select(
        F.regexp_extract("path", "/([^/=]+=[^/]+)/[^/]+$", 1).alias("part"),
        F.xxhash64("path", "modificationTime", "length").alias("mark"), "length")
    found = files.groupBy("part").agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor("mark")).collect()
    return {row[0]: " ".join(map(str, row[1:])) for row in found}


def refresh(spark: SparkSession, root: str, held: dict[str, str], month: str,
            build: Callable[[list[str]], DataFrame], salt: str = "", split: bool = True,
            dealt: bool = False) -> list[str]:
    """Bring a derived table up to its source, which is stored by month; the months made anew.

    ``held`` is what :func:`months` has found in the source.  A month is made anew
    when its files are not those it was made from, or when ``salt`` (what else its
    rows depend on) has changed.  ``build`` gets the names of these months' folders
    and gives their rows with the month as a column.  With ``split`` each month gets
    a folder; small tables of groups do without.  ``dealt`` rows lie in their tasks by
    month already and stay there.  The source is listed before it is read, so
    what changes in between is found next time.
    """
    seen = current(spark, root)
    covers = {part: f"{salt} {mark}" for part, mark in held.items()}
    stale = sorted(part for part in covers if seen.covers.get(part) != covers[part])
    if not stale and set(covers) == set(seen.covers) and seen.number:
        return []
    folders = {part: f for part, f in seen.folders.items() if part in covers and part not in stale}
    if stale:
        run = new_run()
        if split:
            # AQE cuts a large month into several even files and puts small ones together
            if dealt:
                write_dealt(build(stale), month, f"{root}/{run}")
            else:
                build(stale).hint("rebalance", month).write.partitionBy(month).parquet(
                    f"{root}/{run}", compression=COMPRESSION)
            folders |= {e.name: f"{run}/{e.name}" for e in children(spark, f"{root}/{run}") if "=" in e.name}
        else:
            # groups come from a shuffle that AQE has cut to size
            build(stale).write.parquet(f"{root}/{run}", compression=COMPRESSION)
            folders |= dict.fromkeys(stale, run)
    commit(spark, root, seen, folders, covers)
    return stale


def _in_months(month: str, parts: list[str]) -> Column:
    days = [p.split("=", 1)[1] for p in parts]
    known = [F.lit(d).cast("date") for d in days if not d.startswith("__")]
    inside = F.col(month).isin(*known) if known else F.lit(False)
    return inside | F.col(month).isNull() if len(known) < len(days) else inside


def of_months(df: DataFrame, month: str, parts: list[str]) -> DataFrame:
    """The rows of the named month folders; the filter prunes all others."""
    return df.where(_in_months(month, parts))
