"""Work on chunks of documents that need facts about keys of the whole corpus.

A chunk is one row: ids, lengths and texts of some documents, or what was made
of them.  Questions about keys go to key buckets as one binary value per chunk
and bucket, answers come back the same way; only numpy looks inside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lanewise.llm.arrays import give_back

PARTS = "chunk bigint, bucket bigint, a binary, b binary, c binary"
Part = tuple[int, int, bytes | None, bytes | None, bytes | None]


def batch_of(rows: list[Part]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk", "bucket", "a", "b", "c"])


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[Part]:
    for batch in batches:
        columns = [batch.column(n) for n in ("chunk", "bucket", "a", "b", "c")]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)
        del batch, columns
        give_back()


def numbered(make: Callable[[pa.RecordBatch], tuple[bytes, bytes, bytes] | None], cut):
    """A mapInArrow function that turns slices of documents into numbered chunk rows."""
    def run(batches):
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(cut(batches)):
            made = make(batch)
            if made is not None:
                yield batch_of([(task << 32 | number, 0, *made)])

    return run


def mapped(parts: DataFrame, work: Callable[[Part], Iterable], schema: str = PARTS,
           pack: Callable[[list], pa.RecordBatch] = batch_of) -> DataFrame:
    """Each part by itself."""
    def run(batches):
        for part in rows_of(batches):
            yield pack(list(work(part)))

    return parts.mapInArrow(run, schema)


def grouped(parts: DataFrame, key: str, count: int, work: Callable[[Iterator[Part]], Iterable],
            schema: str = PARTS, pack: Callable[[list], pa.RecordBatch] = batch_of) -> DataFrame:
    """All parts of a key one after another, in the order of the other column.

    ``work`` takes the parts of one key as an iterator and gives rows.
    """
    other = {"chunk": "bucket", "bucket": "chunk"}[key]
    place = {"chunk": 0, "bucket": 1}[key]

    def run(batches):
        stream = rows_of(batches)
        ahead = next(stream, None)
        while ahead is not None:
            now = ahead[place]

            def own():
                nonlocal ahead
                while ahead is not None and ahead[place] == now:
                    held = ahead
                    ahead = next(stream, None)
                    yield held

            mine, out = own(), []
            for row in work(mine):
                out.append(row)
                if len(out) >= 256:
                    yield pack(out)
                    out = []
            for _ in mine:  # what the work left unread
                pass
            if out:
                yield pack(out)

    return (parts.repartition(count, F.xxhash64(key)).sortWithinPartitions(key, other)
            .mapInArrow(run, schema))
