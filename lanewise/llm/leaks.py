"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are compared as lower-cased words with one space between them,
before the first and after the last.  A region of a text holds an item of m
bytes if it can be edited into the item, these rims included, with at most
k = edit_rate * m byte edits: one rule for all lengths, by which a short item
counts only as whole words.  Such a region and the item of then L = m + 2 bytes
share at least L + 1 - (k + 1) * q of their q-grams, on diagonals (place in the
text minus place in the item) that lie within k of each other.  q is 12, or as
much less as the item needs for that bound to be at least one.  Shared q-grams
are counted in diagonal bands of width 2(k + 1) that overlap by half; bands below
the bound are dropped, overlapping bands of an item become one region, and each
region is verified once by a bit-parallel alignment.

Long texts are searched in overlapping windows and, where very many q-grams
meet, one half of the items after the other, so memory is bounded for texts of
any length and items that share wording; the result is the same.

Null and empty texts hold nothing; null and empty items and items without id are
never found; repeated items or documents give a row each, rows without doc_id
one without doc_id.  Of places of an item with equally few edits the first to end
is given, then the shortest.  Items are sent to the tasks in blocks of at most
``block_bytes``; a larger benchmark takes several passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lanewise.llm.arrays import chunks, documents, flat, mix, spans_of, utf8
from lanewise.plans.frozen import fresh_path, written

Q = 12
EDIT_RATE = 0.05
_BITS = 22
_WINDOW = 1 << 18  # bytes of a text searched at once
_HITS = 1 << 20  # shared q-grams looked at together
_P = np.uint64(0x9E3779B97F4A7C15)
# ASCII letters to lower case, other ASCII but digits to a space
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def folded(text: bytes | None) -> bytes:
    return b" ".join((text or b"").translate(_FOLD).split())


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q bytes in a row."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, width, done = data.astype(np.uint64) + np.uint64(1), 1, {}
    done[1] = out
    while width * 2 <= q:  # hashes of 2, 4, 8 ... bytes
        power = np.uint64(pow(int(_P), width, 1 << 64))
        out = out[: len(out) - width] * power + out[width:]
        width *= 2
        done[width] = out
    total, at = None, 0
    for width in sorted(done, reverse=True):
        if q & width:
            part = done[width][at: at + n]
            total = part if total is None else total * np.uint64(pow(int(_P), width, 1 << 64)) + part
            at += width
    return mix(total)


@dataclass
class Block:
    """Items of one q with their q-grams sorted by hash."""

    q: int
    numbers: np.ndarray  # places of the items among those given
    texts: list[bytes]
    budgets: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray

    def __post_init__(self):
        sizes = np.array([len(t) for t in self.texts])
        self.longest = int(sizes.max())
        self.reach = int((sizes + self.budgets).max())  # the longest region that holds an item
        self.needed = sizes + 1 - (self.budgets + 1) * self.q
        self._halves: list[Block] | None = None

    def halves(self) -> list[Block]:
        if self._halves is None:
            middle = len(self.texts) // 2
            self._halves = []
            for low, high in ((0, middle), (middle, len(self.texts))):
                own = (self.item >= low) & (self.item < high)
                self._halves.append(Block(
                    self.q, self.numbers[low:high], self.texts[low:high], self.budgets[low:high],
                    self.hashes[own], self.item[own] - low, self.place[own], self.filter))
        return self._halves


def blocks(items: list[tuple[int | None, bytes]], q: int, rate: float) -> list[Block]:
    """The items that can be found, one block for each q they need."""
    by_q: dict[int, list[tuple[int, bytes, int]]] = {}
    for number, (id_, text) in enumerate(items):
        own = folded(text)
        if id_ is not None and own:
            budget = int(rate * len(own))
            needs = max(1, min(q, (len(own) + 2) // (budget + 1)))
            by_q.setdefault(needs, []).append((number, b" " + own + b" ", budget))
    return [_block(own, own_q) for own_q, own in sorted(by_q.items())]


def _block(kept: list[tuple[int, bytes, int]], q: int) -> Block:
    parts = [grams(np.frombuffer(t, np.uint8), q) for _, t, _ in kept]
    hashes = np.concatenate(parts)
    item = np.repeat(np.arange(len(kept)), [len(p) for p in parts])
    place = np.concatenate([np.arange(len(p)) for p in parts])
    order = np.argsort(hashes, kind="stable")
    marked = np.zeros(1 << _BITS, bool)
    marked[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Block(q, np.array([i for i, _, _ in kept]), [t for _, t, _ in kept],
                 np.array([k for _, _, k in kept]), hashes[order], item[order], place[order], marked)


def distances(pattern: bytes, text: bytes, anchored: bool) -> list[int]:
    """Fewest edits from a pattern to a part of the text up to each place.

    The part starts anywhere or, anchored, with the text.  A column of the
    alignment is two whole numbers: the bits where it rises and where it falls.
    """
    bits: dict[int, int] = {}
    for i, letter in enumerate(pattern):
        bits[letter] = bits.get(letter, 0) | 1 << i
    full, last = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    rises, falls, cost = full, 0, len(pattern)
    out = [cost]
    for letter in text:
        same = bits.get(letter, 0)
        diagonal = ((same & rises) + rises ^ rises | same | falls) & full
        up = falls | full & ~(diagonal | rises)
        down = rises & diagonal
        if up & last:
            cost += 1
        elif down & last:
            cost -= 1
        up = up << 1 | anchored
        same |= falls
        rises = (down << 1 | ~(same | up)) & full
        falls = up & same & full
        out.append(cost)
    return out


def align(item: bytes, text: bytes, budget: int) -> tuple[int, int, int] | None:
    """Fewest edits from an item to any part of a text: (edits, start, end).

    Of equally good parts the first to end, then the shortest.
    """
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    if not budget:
        return None
    costs = distances(item, text, False)
    least = min(costs)
    if least > budget:
        return None
    end = costs.index(least)
    before = text[max(0, end - len(item) - budget): end][::-1]
    return least, end - distances(item[::-1], before, True).index(least), end


def _matches(text: bytes, held: Block) -> Iterator[tuple[int, int, int, int]]:
    """(item number, edits, start, end) for the regions of a text that hold an item."""
    data = np.frombuffer(text, np.uint8)
    hashes = grams(data, held.q)
    places = np.flatnonzero(held.filter[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
    hashes = hashes[places]
    first = np.searchsorted(held.hashes, hashes, "left")
    count = np.searchsorted(held.hashes, hashes, "right") - first
    total = int(count.sum())
    if not total:
        return
    if total > _HITS and len(held.texts) > 1:
        for half in held.halves():
            yield from _matches(text, half)
        return
    if total > _HITS:  # one item all over the text: align the whole of it
        regions = [(0, 0, len(text))]
    else:
        hit = spans_of(first, count)
        regions = _regions(np.repeat(places, count), held.item[hit], held.place[hit], held, len(text))
    for number, start, end in regions:
        got = align(held.texts[number], text[start:end], int(held.budgets[number]))
        if got:
            yield int(held.numbers[number]), got[0], got[1] + start, got[2] + start


def _regions(at, item, place, held: Block, size: int) -> list[tuple[int, int, int]]:
    """(item number, start, end) of the united bands with enough shared q-grams."""
    step = held.budgets[item] + 1
    band = (at - place + held.longest) // step  # a band spans two steps: its own and the next
    item, band, at = np.concatenate([item, item]), np.concatenate([band, band - 1]), np.concatenate([at, at])
    order = np.lexsort((at, band, item))
    item, band, at = item[order], band[order], at[order]
    other = np.ones(len(at), bool)
    other[1:] = (item[1:] != item[:-1]) | (band[1:] != band[:-1])
    new = other.copy()  # a q-gram of the text counts once in a band
    new[1:] |= at[1:] != at[:-1]
    firsts = np.flatnonzero(other)
    enough = np.add.reduceat(new.astype(np.int64), firsts) >= held.needed[item[firsts]]
    out: list[tuple[int, int, int]] = []
    for number, own in zip(item[firsts[enough]].tolist(), band[firsts[enough]].tolist()):
        budget = int(held.budgets[number])
        low = own * (budget + 1) - held.longest
        start = max(0, low - budget)
        end = min(size, low + 2 * (budget + 1) + len(held.texts[number]) + budget)
        if out and out[-1][0] == number and start <= out[-1][2]:
            out[-1] = (number, out[-1][1], max(end, out[-1][2]))
        else:
            out.append((number, start, end))
    return out


def matches(text: bytes, held: list[Block]) -> Iterator[tuple[int, int, int, int]]:
    """(item number, edits, start, end) of regions with an item, places in the folded text."""
    rimmed = b" " + text + b" "
    for own in held if text else ():
        size = max(_WINDOW, 2 * own.reach)
        for low in range(0, max(1, len(rimmed) - own.reach), size - own.reach):
            for number, edits, start, end in _matches(rimmed[low: low + size], own):
                start, end = low + start, low + end
                start += rimmed[start] == 0x20
                end -= rimmed[end - 1] == 0x20
                yield number, edits, start - 1, end - 1


def search(text: bytes, held: list[Block]) -> list[tuple[int, int, int, int]]:
    """(item number, edits, start, end) of every item found in a folded text, at its best place."""
    found: dict[int, tuple[int, int, int]] = {}
    for number, edits, start, end in matches(text, held):
        got = (edits, end, -start)
        found[number] = min(found.get(number, got), got)
    return [(n, edits, -start, end) for n, (edits, end, start) in sorted(found.items())]


def find(docs: DataFrame, items: DataFrame, q: int = Q, rate: float = EDIT_RATE,
         block_bytes: int = 4 << 20) -> DataFrame:
    """Per document and item found in it: edits and place (bytes of the folded document).

    Of several places of an item the one with fewest edits is given.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col("item_id").cast("bigint"), utf8(F.col("text")).alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = size // block_bytes + 1
    narrow, path = documents(docs), None
    for number in range(passes):
        one = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number)
        # about block_bytes of items
        sent = spark.sparkContext.broadcast([(r[0], bytes(r[1] or b"")) for r in one.collect()])
        found = narrow.mapInArrow(_searcher(sent, q, rate), _SCHEMA)
        if passes == 1:
            return found
        path = path or fresh_path(spark, "leaks")
        found.write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(_SCHEMA).parquet(path)


_SCHEMA = "doc_id bigint, item_id bigint, edits int, start_byte bigint, end_byte bigint"


def _searcher(sent, q: int, rate: float):
    def run(batches):
        held = blocks(sent.value, q, rate)
        for batch in chunks(batches):
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc, text in zip(ids, batch.column("text").to_pylist()):
                rows += [(doc, sent.value[n][0], *found) for n, *found in search(folded(text), held)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "item_id", "edits", "start_byte", "end_byte"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, q: int = Q, rate: float = EDIT_RATE,
                  block_bytes: int = 4 << 20) -> DataFrame:
    """The rows without a benchmark item, all columns as they were.

    Each row is judged by its own text, whatever its doc_id; several blocks of
    items are one filter after another on written results.
    """
    wanted = items.select(F.col("item_id").cast("bigint"), utf8(F.col("text")).alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = size // block_bytes + 1
    for number in range(passes):
        one = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number)
        # about block_bytes of items
        sent = docs.sparkSession.sparkContext.broadcast([(r[0], bytes(r[1] or b"")) for r in one.collect()])
        kept = docs.mapInArrow(_clean(sent, docs.columns.index("text"), q, rate), docs.schema)
        if passes == 1:
            return kept
        docs = written(kept, "without-leaks")
        sent.destroy()
    return docs


def _clean(sent, place: int, q: int, rate: float):
    def run(batches):
        held = blocks(sent.value, q, rate)
        for batch in chunks(batches):
            keep = [next(matches(folded((t or "").encode()), held), None) is None
                    for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
