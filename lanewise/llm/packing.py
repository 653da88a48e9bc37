"""Token ids in packed rows of fixed length.

A document becomes token ids and one end id.  Ids are cut losslessly into
pieces of the row length; a whole piece fills a row, the rests of up to WINDOW
documents are packed best-fit decreasing: longest first, each into the fullest
row that still takes it.  The rows' free places are counted in a segment tree
over capacities, which finds the least sufficient one in a few steps.

Rows are padded with the end id.  Next to the ids stand the cumulative lengths
of the segments and, as a reset at each segment, positions from 0 on.  Tasks
pack what they read; nothing is moved between them.

Null texts count as empty; an empty text has the end id only.  Repeated rows
are packed each.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

LENGTH = 2_048
WINDOW = 20_000  # rests packed together
END = 50_256


class Capacities:
    """Open rows by free places; the least sufficient capacity is found in log steps."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._count(free, 1)

    def _count(self, free: int, by: int) -> None:
        at = self.size + free
        while at:
            self.tree[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove a row with the fewest free places from ``need`` on: (free, row)."""
        at = self.size + need
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        free = at - self.size
        self._count(free, -1)
        return free, self.rows[free].pop()


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers: longest first, each into the fullest row that takes it."""
    open_, rows = Capacities(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = open_.take(sizes[i])
        free, row = got if got else (capacity, len(rows))
        if not got:
            rows.append([])
        rows[row].append(i)
        if free - sizes[i]:
            open_.add(free - sizes[i], row)
    return rows


@lru_cache(maxsize=2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packed", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_SCHEMA = ("shard int, row bigint, n_tokens int, ids binary, cu_seqlens array<int>,"
           " positions binary, doc_ids array<bigint>, pieces array<int>")


def _matrix(shard: int, number: int, rows, pieces, length: int) -> pa.RecordBatch:
    """Rows of pieces as one id matrix with its segment ends and positions."""
    ids = np.full((len(rows), length), END, np.uint16)
    positions = np.zeros((len(rows), length), np.int32)
    ends, docs, parts = [], [], []
    for i, row in enumerate(rows):
        at, cuts = 0, [0]
        for piece in row:
            tokens = pieces[piece][2]
            ids[i, at: at + len(tokens)] = tokens
            positions[i, at: at + len(tokens)] = np.arange(len(tokens))
            at += len(tokens)
            cuts.append(at)
        positions[i, at:] = np.arange(length - at)
        ends.append(cuts)
        docs.append([pieces[p][0] for p in row])
        parts.append([pieces[p][1] for p in row])
    return pa.RecordBatch.from_arrays([
        pa.array([shard] * len(rows), pa.int32()),
        pa.array(range(number, number + len(rows)), pa.int64()),
        pa.array([e[-1] for e in ends], pa.int32()),
        pa.array([r.tobytes() for r in ids], pa.binary()), pa.array(ends, pa.list_(pa.int32())),
        pa.array([r.astype(np.uint16).tobytes() for r in positions], pa.binary()),
        pa.array(docs, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32())),
    ], ["shard", "row", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "pieces"])


def packed(df: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Packed rows: ids and positions as little-endian 16-bit numbers, segment ends, doc_ids."""
    path = path or vocabulary_path()
    if not 2 <= length <= 1 << 16:
        raise ValueError("rows of 2 to 65536 ids")

    def run(batches):
        encode, shard, number = encoder(path).encode_ordinary, TaskContext.get().partitionId(), 0
        rests: list = []
        whole: list = []

        def flush(pieces, rows):
            nonlocal number
            for i in range(0, len(rows), 256):
                yield _matrix(shard, number, rows[i: i + 256], pieces, length)
                number += len(rows[i: i + 256])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tokens = np.array([*encode(text or ""), END], np.uint16)
                for part, start in enumerate(range(0, len(tokens), length)):
                    piece = (doc, part, tokens[start: start + length])
                    (whole if len(piece[2]) == length else rests).append(piece)
                if len(whole) >= 256:
                    yield from flush(whole, [[i] for i in range(len(whole))])
                    whole = []
                if len(rests) >= WINDOW:
                    yield from flush(rests, best_fit([len(p[2]) for p in rests], length))
                    rests = []
        yield from flush(whole, [[i] for i in range(len(whole))])
        yield from flush(rests, best_fit([len(p[2]) for p in rests], length))

    narrow = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, _SCHEMA)


def digests(rows: DataFrame) -> DataFrame:
    """Packed rows with digests in place of the long values."""
    return rows.select("shard", "row", "n_tokens", "cu_seqlens", "doc_ids", "pieces",
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("positions", 256).alias("positions_sha256"))
