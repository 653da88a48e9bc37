"""Even shards by histogram sort.

Rows are ordered by a hash of their text, then by doc_id, so equal texts stand
together.  Exact byte counts below candidate boundaries are taken for all
partitions at once; only the intervals that hold a splitter are cut finer in
the next round, until every splitter is within the tolerance of its target or
down to a single key.  Then the rows move once, into place.

A row's size is the UTF-8 bytes of its text plus 1; a null text has none.  A
group of equal texts is cut by doc_id only where it is larger than the
tolerance.  Rows without doc_id come first in their group.  Equal rows (same
text and doc_id) are not told apart and stay in one shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lanewise.llm.arrays import utf8
from lanewise.plans.frozen import written
from lanewise.plans.ranking import number_rows

STEP_BITS = 12  # probes of one round cut an interval into 4,096
_LEAST = -(1 << 63)


def _keys(df: DataFrame) -> DataFrame:
    text = utf8(F.coalesce("text", F.lit("")))
    return df.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST)).alias("_id"),
    )


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The smallest (hash, id) of each shard but the first.

    Each round is one aggregation; what reaches the driver is at most 4,096
    counts for each splitter still open.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = [total * (i + 1) / shards for i in range(shards - 1)]
    slack = tolerance * total / shards
    found: dict[int, tuple[int, int]] = {}
    # open interval of each splitter: bytes below it, hash or None, lowest key, width in bits
    open_: dict[int, tuple[int, int | None, int, int]] = {
        i: (0, None, _LEAST, 64) for i in range(shards - 1)}
    while open_:
        wanted = sorted({x[1:] for x in open_.values()}, key=str)
        counts = {w: dict(_histogram(keys, *w)) for w in wanted}
        for i, (below, hash_, low, bits) in list(open_.items()):
            step = max(0, bits - STEP_BITS)
            target, at = targets[i], below
            best, inside = (abs(below - target), low), (below, low)
            for slot, size in sorted(counts[(hash_, low, bits)].items()):
                edge = low + (slot << step)
                best = min(best, (abs(at - target), edge))
                if at <= target:
                    inside = (at, edge)
                at += size
                end = edge + (1 << step)
                if end < low + (1 << bits):
                    best = min(best, (abs(at - target), end))
            if best[0] <= slack or step == 0 and hash_ is not None:
                found[i] = (best[1], _LEAST) if hash_ is None else (hash_, best[1])
                del open_[i]
            elif step:
                open_[i] = (inside[0], hash_, inside[1], step)
            else:  # a single hash with more bytes than the tolerance: cut by id
                open_[i] = (inside[0], inside[1], _LEAST, 64)
    return [found[i] for i in range(shards - 1)]


def _histogram(keys: DataFrame, hash_: int | None, low: int, bits: int) -> list[tuple[int, int]]:
    column = "_hash" if hash_ is None else "_id"
    rows = keys if hash_ is None else keys.where(F.col("_hash") == hash_)
    if bits < 64:
        rows = rows.where(F.col(column).between(low, low + (1 << bits) - 1))
    # offset from the lowest key as an unsigned number: wraps like the hash itself
    offset = F.col(column).bitwiseXOR(F.lit(low)) if bits == 64 else F.col(column) - F.lit(low)
    slot = F.shiftrightunsigned(offset, max(0, bits - STEP_BITS))
    got = rows.groupBy(slot.alias("slot")).agg(F.sum("size").alias("size")).collect()
    return [(r["slot"], r["size"]) for r in got]


def _shard(cuts: list[tuple[int, int]]) -> Column:
    out = F.lit(0)
    for hash_, id_ in cuts:
        past = (F.col("_hash") > hash_) | ((F.col("_hash") == hash_) & (F.col("_id") >= id_))
        out = out + past.cast("int")
    return out


def assign(df: DataFrame, shards: int = 16, tolerance: float = 0.001) -> DataFrame:
    """Per document its shard and its place in it, numbered without gaps from 0."""
    keys = written(_keys(df), "shard-keys")
    cuts = sorted(splitters(keys, shards, tolerance))
    placed = number_rows(
        keys.withColumn("shard", _shard(cuts)),
        [F.col(c) for c in ("shard", "_hash", "_id")], "_position")
    starts = keys.groupBy(_shard(cuts).alias("shard")).agg(F.count(F.lit(1)).alias("rows"))
    ahead = starts.select(  # one row per shard
        "shard", (F.sum("rows").over(Window.orderBy("shard")) - F.col("rows")).alias("_ahead"))
    return placed.join(F.broadcast(ahead), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_position") - 1 - F.col("_ahead")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, shards: int = 16, tolerance: float = 0.001) -> None:
    """Store all rows, one folder per shard; the order in a file is the shard's order."""
    keys = written(_keys(df), "shard-keys")
    cuts = sorted(splitters(keys, shards, tolerance))
    text = utf8(F.coalesce("text", F.lit("")))
    placed = (
        df.withColumn("_hash", F.xxhash64(text))
        .withColumn("_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST)))
        .withColumn("shard", _shard(cuts))
        .repartitionByRange("shard", "_hash", "_id")
        .sortWithinPartitions("shard", "_hash", "_id")
        .drop("_hash", "_id")
    )
    placed.write.partitionBy("shard").parquet(path)
