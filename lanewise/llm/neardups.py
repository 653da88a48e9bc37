"""Near duplicates by SetSketch registers.

A document is its set of distinct word shingles.  Every shingle sends points at
exponential distances to random registers; a register keeps the smallest one,
as a number on a logarithmic scale, truncated at both ends.  Registers of two
documents agree about as often as their sets overlap, and merge by maximum.

1. Documents with one set form a class (known by a 64-bit hash); classes go on.
2. Bands of register values put classes into buckets.  Each member of a bucket
   is compared with the bucket's first member and components are built: a pair
   is dropped if the likelihood of its registers (which are larger in one, in
   the other, equal; the set sizes are known) rules the wanted overlap out; the
   others are verified on the full sets.
3. Where a bucket still has several components, members that have too few
   shingles in common with all other components together are left out.  The
   others, chained by their buckets to groups, are dealt by size and hash into
   blocks; a tile is two blocks of one group, and one task compares the members
   of a tile that share a bucket in the same two steps.  Only links leave it.

With 64 bands of 8 registers a pair at the threshold of 0.8 shares no bucket
with a probability of 8e-6, one at 0.9 of 2e-16.

Words are runs of non-space characters, A-Z lower-cased.  A text with fewer
words than a shingle is one shingle; null, empty and blank texts have none and
are linked with nothing.  Rows that share a doc_id are one document.  Rows
without doc_id are linked with nothing: their component is null and they stay.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lanewise.llm.arrays import chunks, documents, mix, pack, unpack
from lanewise.llm.components import components
from lanewise.llm.exchange import PARTS, batch_of, grouped, rows_of
from lanewise.plans.frozen import written

REGISTERS, BAND = 512, 8
BUCKET_TEXT = 16 << 20  # bytes of text for a task that gathers bands, about
BUCKET_SHINGLES = 4 << 20  # shingles for a task that compares components
BASE = 1.001  # of the logarithmic scale
_OFFSET = 4_000  # scale value of a point at distance 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MARGIN = 20.0  # log likelihood by which the threshold may fall behind
TILE_MEMBERS, TILE_SHINGLES = 512, 1 << 20  # of a block, about


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    total = np.full(len(found) - width + 1, np.uint64(width))
    for i in range(width):
        total = mix(total * _GOLD + hashes[i: len(found) - width + 1 + i])
    return np.unique(total)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set that is not empty."""
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), REGISTERS), np.inf)
    horizon = (math.log(REGISTERS) + 9) / np.maximum(sizes, 1)
    todo = np.flatnonzero(sizes)
    while len(todo):
        _spread(sets, todo, horizon, out)
        todo = todo[np.isinf(out[todo]).any(1)]  # rarely: some register got no point
        horizon = horizon * 2
    scale = np.floor(-np.log(out, where=np.isfinite(out), out=np.zeros_like(out)) / math.log(BASE))
    return np.clip(scale + _OFFSET, 0, 65535).astype(np.uint16)


def _spread(sets, todo, horizon, out) -> None:
    element = np.concatenate([sets[i] for i in todo])
    row = np.repeat(todo, [len(sets[i]) for i in todo])
    end, at, level = horizon[row], np.zeros(len(element)), 0
    flat = out.reshape(-1)
    while len(element):
        many = max(1, min(512, 200_000 // len(element)))
        levels = np.arange(level, level + many, dtype=np.uint64) * _GOLD
        drawn = mix(element[:, None] + levels[None, :])
        step = -np.log(((drawn >> np.uint64(12)).astype(float) + 0.5) * 2.0 ** -52) / REGISTERS
        points = at[:, None] + np.cumsum(step, 1)
        near = points < end[:, None]
        place = row[:, None] * REGISTERS + (drawn & np.uint64(REGISTERS - 1)).astype(np.int64)
        np.minimum.at(flat, place[near], points[near])
        going = near[:, -1]
        element, row, end, at = element[going], row[going], end[going], points[going, -1]
        level += many


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row."""
    parts = np.ascontiguousarray(values).view(np.uint64).reshape(len(values), -1, BAND // 4)
    total = np.broadcast_to(np.arange(REGISTERS // BAND, dtype=np.uint64), parts.shape[:2])
    for i in range(BAND // 4):
        total = mix(total * _GOLD + parts[:, :, i])
    return total


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Pairs of register rows whose overlap may reach ``least``."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - up - down
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * top

    def log_likelihood(j):
        def p(x):
            return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)

        more, less = p(u - v * j), p(v - u * j)
        return up * np.log(more) + down * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-12))

    best = log_likelihood(grid)
    estimate = np.take_along_axis(grid, best.argmax(1)[:, None], 1)[:, 0]
    wanted = log_likelihood(np.full_like(u, least))[:, 0]
    return (top[:, 0] >= least - 1e-9) & ((estimate >= least) | (wanted >= best.max(1) - _MARGIN))


def _sets(texts: list[bytes | None], words: int):
    """Of each text the shingles and the class, a number for its set."""
    sets = [shingles(t, words) for t in texts]
    return sets, np.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets], np.int64)


def _first_of(values: np.ndarray) -> np.ndarray:
    return np.sort(np.unique(values, return_index=True)[1])


def _sketched(words: int, buckets: int):
    """Chunk rows: documents with size and class; band keys and classes for each key bucket."""
    def run(batches):
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(chunks(batches)):
            sets, classes_ = _sets(batch.column("text").to_pylist(), words)
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            facts = (pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)),
                     pack(known.astype(np.uint8)), pack(np.array([len(s) for s in sets], np.int64)),
                     pack(classes_))
            rows = [(task << 32 | number, -1, pickle.dumps(facts), None, None)]
            own = np.flatnonzero(known & np.array([len(s) > 0 for s in sets]))
            own = own[_first_of(classes_[own])]  # copies once
            if len(own):
                keys = bands(registers([sets[i] for i in own]))
                owner = np.repeat(classes_[own], keys.shape[1])
                keys = keys.ravel()
                order = np.argsort(keys)
                keys, owner = keys[order], owner[order]
                edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
                at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                rows += [(task << 32 | number, i, pack(np.diff(keys[x:y], prepend=np.uint64(0))),
                          pack(owner[x:y]), None) for i, (x, y) in enumerate(zip(at, at[1:])) if y > x]
            yield batch_of(rows)

    return run


def _documents(batches):
    for part in rows_of(batches):
        ids, known, sizes, classes_ = (unpack(x, d) for x, d in zip(
            pickle.loads(part[2]), (np.int64, np.uint8, np.int64, np.int64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=known == 0), pa.array(sizes), pa.array(classes_)], ["doc_id", "n", "v"])


def _shared(parts):
    """Members of the bands of a key bucket that more than one class has, with the first member."""
    held = [(np.cumsum(unpack(a, np.uint64), dtype=np.uint64), unpack(b, np.int64)) for _, _, a, b, _ in parts]
    keys, owner = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(keys)))
    several = np.repeat(size > 1, size)
    pivot = np.repeat(owner[start], size)
    yield from zip(keys.view(np.int64)[several].tolist(), owner[several].tolist(), pivot[several].tolist())


def _members(rows):
    columns = list(zip(*rows)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["band", "v", "pivot"])


def _full(words: int):
    """Class, size, registers and set of each text, classes of a slice once."""
    def run(batches):
        for batch in chunks(batches):
            sets, classes_ = _sets(batch.column("text").to_pylist(), words)
            own = [i for i in _first_of(classes_) if len(sets[i])]
            values = registers([sets[i] for i in own]) if own else []
            yield pa.RecordBatch.from_arrays([
                pa.array(classes_[own], pa.int64()), pa.array([len(sets[i]) for i in own], pa.int64()),
                pa.array([r.tobytes() for r in values], pa.binary()),
                pa.array([pack(sets[i]) for i in own], pa.binary()),
            ], ["v", "n", "regs", "set"])

    return run


def _able(numerator: int):
    """Pairs whose registers leave the wanted overlap possible."""
    def run(batches):
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                    for c in ("regs_a", "regs_b"))
            keep = np.flatnonzero(likely(a, b, n_a, n_b, numerator / 100)) if len(a) else []
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return run


def _overlap(x: np.ndarray, y: np.ndarray, numerator: int) -> bool:
    """Of two sorted sets: 100 * intersection >= numerator * union."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x))
    return 100 * both >= numerator * (len(x) + len(y) - both)


def _linked(numerator: int):
    """Pairs with 100 * intersection >= numerator * union."""
    def run(batches):
        for batch in batches:
            good = [i for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b")))
                    if _overlap(unpack(x.as_py(), np.uint64), unpack(y.as_py(), np.uint64), numerator)]
            kept = batch.take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return run


def _least_same(least: float) -> int:
    """Equal registers below which the likelihood rules the overlap out, with twice its margin."""
    x = np.arange(1, int(REGISTERS * least)) / REGISTERS
    away = REGISTERS * (x * np.log(x / least) + (1 - x) * np.log((1 - x) / max(1 - least, 1e-3)))
    return int((away > 2 * _MARGIN).sum())


def _tile(numerator: int):
    """Links between the two blocks of a tile; a block against itself has one side only."""
    fewest = _least_same(numerator / 100)

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        v, root, n = (table.column(c).to_numpy() for c in ("v", "root", "n"))
        values = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keys, packed, sets = bands(values), table.column("set"), {}

        def own(i):
            if i not in sets:
                sets[i] = unpack(packed[i].as_py(), np.uint64)
            return sets[i]

        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        itself, found = not len(right), []
        for k, i in enumerate(left.tolist()):
            with_ = left[k + 1:] if itself else right
            small, large = np.minimum(n[with_], n[i]), np.maximum(n[with_], n[i])
            with_ = with_[(root[with_] != root[i]) & (100 * small >= numerator * large)]
            with_ = with_[(keys[with_] == keys[i]).any(1)]
            with_ = with_[(values[with_] == values[i]).sum(1) >= fewest]
            if not len(with_):
                continue
            able = likely(np.broadcast_to(values[i], (len(with_), REGISTERS)), values[with_],
                          np.full(len(with_), float(n[i])), n[with_].astype(float), numerator / 100)
            found += [(max(v[i], v[j]), min(v[i], v[j])) for j in with_[able].tolist()
                      if _overlap(own(i), own(j), numerator)]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _tiled(open_: DataFrame, sets: DataFrame, numerator: int) -> DataFrame:
    """Links between members of different components that share a bucket, as (a, b).

    Sizes of linked classes are at most one level apart, so a block meets the
    blocks of its own level and of the next one.
    """
    first = open_.groupBy("band").agg(F.min("v").alias("b")).withColumnRenamed("band", "_band")
    chain = components(open_.join(first, F.col("band") == F.col("_band")).select(F.col("v").alias("a"), "b"))
    step = 1.001 * math.log(max(100 / numerator, 1.05))
    members = (open_.select("v", "root").distinct()
               .join(chain.select(F.col("a").alias("_a"), F.col("b").alias("_b")), F.col("v") == F.col("_a"), "left")
               .select("v", "root", F.coalesce("_b", "v").alias("chain"))
               .join(sets.select(F.col("v").alias("_v"), "n"), F.col("v") == F.col("_v"))
               .select("v", "root", "chain", F.floor(F.log("n") / step).cast("int").alias("level"), "n"))
    members = written(members, "members")
    blocks = members.groupBy("chain", "level").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / TILE_MEMBERS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("blocks"))
    # number of blocks on the level itself, below and above; null where a group has none
    for name, shift in (("own", 0), ("below", 1), ("above", -1)):
        other = blocks.select(F.col("chain").alias("_c"), (F.col("level") + shift).alias("_l"),
                              F.col("blocks").alias(name))
        members = members.join(other, (F.col("chain") == F.col("_c")) & (F.col("level") == F.col("_l")),
                               "left").drop("_c", "_l")
    block = F.pmod(F.xxhash64("v"), F.col("own")).cast("int")

    def dealt(count: str, tile) -> F.Column:
        every = F.sequence(F.lit(0), F.greatest(F.col(count) - 1, F.lit(0)))
        return F.when(F.col(count).isNotNull(), F.transform(every, lambda j: F.struct(
            *(c.cast("int").alias(name) for name, c in zip(("at", "kind", "x", "y", "side"), tile(j)))))
        ).otherwise(F.array())

    level = F.col("level")
    tiles = members.select("v", "root", "chain", F.explode(F.concat(
        dealt("own", lambda j: (level, F.lit(0), F.least(block, j), F.greatest(block, j),
                                (block > j).cast("int"))),
        dealt("above", lambda j: (level, F.lit(1), block, j, F.lit(0))),
        dealt("below", lambda j: (level - 1, F.lit(1), j, block, F.lit(1))))).alias("t")
    ).select("v", "root", "chain", "t.*")
    tiles = tiles.join(sets.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v")).drop("_v")
    return tiles.groupBy("chain", "at", "kind", "x", "y").applyInArrow(
        _tile(numerator), "a bigint, b bigint")


def _asked(buckets: int):
    """The shingles of each class by key bucket, with its component."""
    def run(batches):
        edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
        for batch in batches:
            for v, root, blob in zip(*(batch.column(c).to_pylist() for c in ("v", "root", "set"))):
                keys = unpack(blob, np.uint64)
                at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                yield batch_of([(v, i, pack(keys[x:y]), pickle.dumps(root), None)
                                for i, (x, y) in enumerate(zip(at, at[1:])) if y > x])

    return run


def _elsewhere(parts):
    """Per class its shingles of a bucket that a class of another component has too."""
    held = [(v, pickle.loads(b), unpack(a, np.uint64)) for v, _, a, b, _ in parts]
    keys, inside = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
    root = np.repeat([h[1] for h in held], [len(h[2]) for h in held])
    low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low, inside, root)
    np.maximum.at(high, inside, root)
    both, at = (low != high)[inside], 0
    for v, _, own in held:
        yield v, int(both[at: at + len(own)].sum())
        at += len(own)


def _counted(rows):
    columns = list(zip(*rows)) if rows else [[]] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_v", "both"])


def _open(entries: DataFrame, roots: DataFrame, sets: DataFrame, numerator: int) -> DataFrame:
    """(band, v, root): members of buckets that may still be linked to another component.

    A class linked to another has at least ``numerator`` hundredths of its
    shingles in common with it.  Classes that have fewer in common with all
    classes of other components together are left out, and once more without those.
    """
    at = roots.select(F.col("a").alias("_v"), F.col("b").alias("root"))
    placed = entries.join(at, F.col("v") == F.col("_v"), "left").select(
        "band", "v", F.coalesce("root", "v").alias("root"))
    for _ in range(2):
        apart = (placed.groupBy("band").agg(F.min("root").alias("_low"), F.max("root").alias("_high"))
                 .where("_low <> _high").select(F.col("band").alias("_band")))
        placed = written(placed.join(apart, F.col("band") == F.col("_band"), "left_semi"), "buckets")
        nodes = placed.select("v", "root").distinct().join(
            sets.select(F.col("v").alias("_v"), "n", "set"), F.col("v") == F.col("_v")).drop("_v")
        nodes = written(nodes, "open-sets")
        total = nodes.agg(F.sum("n")).first()[0] or 0
        buckets = int(total // BUCKET_SHINGLES + 1)
        counted = grouped(nodes.select("v", "root", "set").mapInArrow(_asked(buckets), PARTS), "bucket",
                          buckets, _elsewhere, "_v bigint, both bigint", _counted)
        counted = counted.groupBy("_v").agg(F.sum("both").alias("both"))
        able = nodes.join(counted, F.col("v") == F.col("_v")).where(
            F.col("both") * 100 >= F.col("n") * numerator).select(F.col("v").alias("_w"))
        placed = placed.join(able, F.col("v") == F.col("_w"), "left_semi")
    return placed


def classes(df: DataFrame, words: int = 5, numerator: int = 80) -> DataFrame:
    """Per row its doc_id, number of shingles and the smallest doc_id it is linked to.

    Two documents are linked with 100 * intersection >= numerator * union.
    """
    docs = documents(df)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size // BUCKET_TEXT + 1)
    parts = written(docs.mapInArrow(_sketched(words, buckets), PARTS), "sketches")
    named = parts.where("bucket < 0").mapInArrow(_documents, "doc_id bigint, n bigint, v bigint")
    linkable = named.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    one = written(linkable.groupBy("v").agg(F.min("doc_id").alias("doc")), "classes")
    entries = written(
        grouped(parts.where("bucket >= 0"), "bucket", buckets, _shared,
                "band bigint, v bigint, pivot bigint", _members), "buckets")
    wanted = written(entries.select(F.col("v").alias("_v")).distinct()
                     .join(one, F.col("v") == F.col("_v")).select("v", "doc"), "wanted")
    texts = docs.join(wanted.select(F.col("doc").alias("_doc")).distinct(),
                      F.col("doc_id") == F.col("_doc"), "left_semi").select("text")
    sets = texts.mapInArrow(_full(words), "v bigint, n bigint, regs binary, set binary")
    sets = written(sets.join(wanted.select(F.col("v").alias("_w")), F.col("v") == F.col("_w"), "left_semi")
                   .dropDuplicates(["v"]), "class-sets")

    def beside(pairs: DataFrame, *held: str) -> DataFrame:
        for side in ("a", "b"):
            own = sets.select(*[F.col(c).alias(f"{c}_{side}") for c in ("v", *held)])
            pairs = pairs.join(own, F.col(side) == F.col(f"v_{side}"))
        return pairs.drop("v_a", "v_b")

    pairs = entries.where("v <> pivot").select(
        F.greatest("v", "pivot").alias("a"), F.least("v", "pivot").alias("b")).distinct()
    able = written(beside(pairs, "n", "regs").mapInArrow(_able(numerator), "a bigint, b bigint"), "pairs")
    links = written(beside(able, "set").mapInArrow(_linked(numerator), "a bigint, b bigint"), "links")
    # rows that share a doc_id are one document
    twice = (linkable.groupBy("doc_id").agg(F.min("v").alias("b"), F.max("v").alias("_a"))
             .where("b <> _a").select(F.col("doc_id").alias("_doc"), "b"))
    twice = (linkable.join(twice, F.col("doc_id") == F.col("_doc")).where("v <> b")
             .select(F.col("v").alias("a"), "b").distinct())
    links = links.unionByName(twice)
    roots = components(links)
    open_ = written(_open(entries, roots, sets, numerator), "open-buckets")
    more = written(_tiled(open_, sets, numerator), "links")
    if not more.isEmpty():
        # links between classes, so components of components
        roots = components(roots.unionByName(more))
    root = one.join(roots.withColumnRenamed("a", "_v"), F.col("v") == F.col("_v"), "left").select(
        "v", "doc", F.coalesce("b", "v").alias("root"))
    smallest = root.groupBy("root").agg(F.min("doc").alias("component_id")).withColumnRenamed("root", "_root")
    component = root.join(smallest, F.col("root") == F.col("_root")).select(
        F.col("v").alias("_v"), "component_id")
    # a text without shingles is a class of its own, which links nothing
    return named.join(component, (F.col("v") == F.col("_v")) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(df: DataFrame, words: int = 5, numerator: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; columns as they were."""
    gone = classes(df, words, numerator).where("doc_id <> component_id").select(
        F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone, df["doc_id"].cast("bigint") == gone["_gone"], "left_anti")
