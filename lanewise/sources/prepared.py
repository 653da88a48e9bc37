"""Load once, clean once, analyse many times.

The raw and the clean star and the clean star's measure states are written as
Parquet tables to the cluster's shared folder when a session first needs them;
later analyses of the session read these tables, with column pruning, pushed
filters and no repeated joins.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from lanewise.operators.clean import clean_star
from lanewise.plans import versions
from lanewise.plans.frozen import renewed_path
from lanewise.schema import TABLES
from lanewise.sources import states
from lanewise.sources.derived import SOURCE_TABLES
from lanewise.sources.star import Star, read_star, write_star


@dataclass(frozen=True)
class Prepared:
    raw: Star
    clean: Star
    summed: Star  # the clean star with measure states by month and key


_made: dict[tuple[str, str], tuple[tuple, str, tuple, Prepared]] = {}
_lock = threading.Lock()


def prepared(spark: SparkSession, source: str, build: Callable[[], Star]) -> Prepared:
    """The stored stars of a source, written on first use in this session.

    They are written anew when a file of the source has changed, or when a stored
    table or one of its months is missing.
    """
    key = (spark.sparkContext.applicationId, source)
    with _lock:
        now = _fingerprint(spark, source)
        if key in _made:
            seen, root, times, stars = _made[key]
            if seen == now and _stored(spark, root) == times:
                return stars
        root = renewed_path(spark, "star" + re.sub(r"\W+", "-", source))
        write_star(build(), f"{root}/raw")
        raw = read_star(spark, f"{root}/raw")
        write_star(clean_star(raw), f"{root}/clean")
        clean = read_star(spark, f"{root}/clean")
        held, _ = states.refresh(spark, clean, f"{root}/states")
        stars = Prepared(raw, clean, clean.with_states(held))
        _made[key] = (now, root, _stored(spark, root), stars)
        return stars


def _fingerprint(spark: SparkSession, source: str) -> tuple:
    """A text for each source table that changes with its files; listed by the driver, no job."""
    return tuple(versions.fingerprint(spark, f"{source}/{table}.parquet") for table in SOURCE_TABLES)


def _stored(spark: SparkSession, root: str) -> tuple[int, ...]:
    """When the folders of the stored tables were changed, which losing a month does too."""
    return tuple(versions.changed_at(spark, f"{root}/{stage}/{table}")
                 for stage in ("raw", "clean") for table in TABLES)
