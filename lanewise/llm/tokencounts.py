"""Token counts of documents without their ids.

Documents are taken in slices.  A slice is reduced to its distinct pre-tokens and,
for each document, how often each of them occurs.  The distinct pre-tokens of all
slices are brought together by text, each is split into pieces once, and the
number of pieces goes back to the slices, where frequencies times pieces are
summed.  A pre-token that every document has travels once for each slice.

Pre-tokens are the tokenizer's own: a text is cut at its special strings, which
stand for one token each, as the library does by default, then before spaces that
follow something else than white space, where no pre-token of this kind reaches
across; a part seen before is looked up, a new one is split by the library unless
it has Latin letters, digits and ASCII signs only, for which a pattern does the same.

Null texts count as empty; an empty text has no tokens.  Rows without doc_id and
repeated rows are counted like all others.  A very long text's words are held in
memory together.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lanewise.llm.arrays import chunks, documents, flat, pack, spans_of, unpack
from lanewise.plans.frozen import fresh_path

SLICE_BYTES = 24 << 20
BLOCK_BYTES = 2 << 20  # of a slice, cut into words together
KEPT_PARTS = 300_000  # remembered by a worker; then it starts anew
BATCH = 4096  # pre-tokens given to the library together

# all that any version of Unicode takes for white space, and a few signs more: no cut after them
_WHITE = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_CUT = re.compile(f"(?<=[^{_WHITE}])(?= )")
_LATIN = re.compile(" ?(?:[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9]+)")
# Fixed value: the byte-level pre-tokenizer's pattern, for ASCII.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)

_SLICES = """slice bigint, ids binary, known binary, sizes binary, kinds binary, at binary, n binary,
    pretokens array<string>"""
_ROW = pa.schema([("slice", pa.int64()), *[(n, pa.binary()) for n in (
    "ids", "known", "sizes", "kinds", "at", "n")], ("pretokens", pa.list_(pa.string()))])
_FOUND = "doc_id bigint, n_bytes bigint, n_tokens bigint"


class PreTokens:
    """Pre-tokens and pieces of one tokenizer file with byte-level pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        if lib.normalizer is not None:
            raise ValueError("this tokenizer normalises its input")
        if [p[0] for p in lib.pre_tokenizer.pre_tokenize_str("a b's")] != ["a", "Ġb", "'s"]:
            raise ValueError("not a byte-level pre-tokenizer without a space put first")
        added = lib.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("special strings of this tokenizer take in their surroundings")
        # of several that start at one place the longest counts
        special = sorted((t.content for t in added), key=len, reverse=True)
        self.special = set(special)
        self._special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self._seen: dict[str, list[str]] = {}

    def parts(self, text: str) -> list[str]:
        """The text in parts that can be pre-tokenized one by one."""
        if self._special is None or not self._special.search(text):
            return _CUT.split(text) if text else []
        cut = []
        for i, piece in enumerate(self._special.split(text)):
            cut += [piece] if i % 2 else _CUT.split(piece) if piece else []
        return cut

    def split(self, part: str) -> list[str]:
        """The pre-tokens of a part; a special string is one."""
        if _LATIN.fullmatch(part) or part in self.special:
            return [part]
        if part.isascii():
            return _ASCII.findall(part)
        return [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]

    def of(self, part: str) -> list[str]:
        known = self._seen.get(part)
        if known is None:
            if len(self._seen) >= KEPT_PARTS:
                self._seen.clear()
            known = self._seen[part] = self.split(part)
        return known

    def pieces(self, pretokens: list[str]) -> np.ndarray:
        """How many pieces each has."""
        found = []
        for i in range(0, len(pretokens), BATCH):
            found += map(len, self.library.encode_batch_fast(pretokens[i: i + BATCH], add_special_tokens=False))
        return np.array(found, np.int64)


@lru_cache(maxsize=2)
def pretokens(path: str) -> PreTokens:
    return PreTokens(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Slice:
    """Documents and their pre-token frequencies, numbered by first occurrence."""

    def __init__(self):
        self.bytes = 0
        self.number: dict[str, int] = {}
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, own: PreTokens, batch: pa.RecordBatch) -> None:
        texts = [(t or b"").decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
        ids, sizes = batch.column("doc_id"), np.diff(flat(batch.column("text"))[1])
        self.held.append((
            ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8),
            sizes, *self._frequencies(own, texts)))
        self.bytes += int(sizes.sum())

    def _frequencies(self, own: PreTokens, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's number of kinds; the kinds and how often they occur, text by text."""
        cut = [own.parts(t) for t in texts]
        owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        coded = pa.array([p for parts in cut for p in parts], pa.string()).dictionary_encode()
        del cut
        kinds, lengths, number = [], [], self.number
        for part in coded.dictionary.to_pylist():
            held = own.of(part)
            kinds += [number.setdefault(p, len(number)) for p in held]
            lengths.append(len(held))
        kinds, lengths = np.array(kinds, np.int64), np.array(lengths, np.int64)
        starts = np.cumsum(lengths) - lengths

        # each part once for each text, then its pre-tokens
        width = max(len(lengths), 1)
        pairs, often = np.unique(owner * width + coded.indices.to_numpy(), return_counts=True)
        owner, part = pairs // width, pairs % width
        width = max(len(number), 1)
        places = np.repeat(owner, lengths[part]) * width + kinds[spans_of(starts[part], lengths[part])]
        pairs, group = np.unique(places, return_inverse=True)
        often = np.bincount(group, np.repeat(often, lengths[part]), len(pairs)).astype(np.int64)
        return np.bincount(pairs // width, minlength=len(texts)), pairs % width, often

    def row(self, number: int) -> pa.RecordBatch:
        ids, known, sizes, kinds, at, often = (np.concatenate(c) for c in zip(*self.held))
        return pa.RecordBatch.from_pylist([{
            "slice": number, "ids": pack(ids), "known": pack(known), "sizes": pack(sizes),
            "kinds": pack(kinds), "n": pack(often.astype(np.int32)),
            # rising within a document, so the steps are small
            "at": pack(np.diff(at, prepend=0).astype(np.int32)),
            "pretokens": list(self.number),
        }], _ROW)


def _sliced(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        own, number = pretokens(path), TaskContext.get().partitionId() << 32
        now = Slice()
        for batch in chunks(batches, BLOCK_BYTES):
            now.add(own, batch)
            if now.bytes >= SLICE_BYTES:
                yield now.row(number)
                now, number = Slice(), number + 1
        if now.held:
            yield now.row(number)

    stored = fresh_path(docs.sparkSession, "pretokens")
    made = docs.mapInArrow(run, _SLICES)
    made.write.option("compression", "zstd").parquet(stored)
    return docs.sparkSession.read.schema(made.schema).parquet(stored)


def _counted(places: DataFrame, path: str) -> DataFrame:
    """(slice, at, pieces): equal pre-tokens meet in order, so each is split once."""
    def run(batches: Iterator[pa.RecordBatch]):
        own, last, last_pieces = pretokens(path), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("pretoken").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            ahead = distinct[0] == last
            pieces = own.pieces(distinct[ahead:])
            if ahead:
                pieces = np.concatenate([[last_pieces], pieces])
            last, last_pieces = distinct[-1], int(pieces[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("slice"), batch.column("at"), pa.array(pieces[coded.indices.to_numpy()], pa.int64())],
                ["slice", "at", "pieces"])

    met = places.repartition("pretoken").sortWithinPartitions("pretoken")
    return met.mapInArrow(run, "slice bigint, at int, pieces bigint")


def _summed(slices: pa.Table, counts: pa.Table) -> pa.Table:
    """One slice: its documents with the sums over their pre-tokens."""
    held = slices.to_pylist()[0]
    pieces = np.zeros(counts.num_rows, np.int64)
    pieces[counts["at"].to_numpy()] = counts["pieces"].to_numpy()
    kinds = unpack(held["kinds"], np.int64)
    owner = np.repeat(np.arange(len(kinds)), kinds)
    tokens = np.zeros(len(kinds), np.int64)
    at = np.cumsum(unpack(held["at"], np.int32).astype(np.int64))
    np.add.at(tokens, owner, pieces[at] * unpack(held["n"], np.int32))
    missing = unpack(held["known"], np.uint8) == 0
    return pa.table([
        pa.array(unpack(held["ids"], np.int64), pa.int64(), mask=missing),
        pa.array(unpack(held["sizes"], np.int64)), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])


def count(df: DataFrame, path: str | None = None, limit: int = 1024, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each document."""
    path = path or vocabulary_path()
    slices = _sliced(documents(df, doc_id, text), path)
    places = slices.select("slice", F.posexplode("pretokens").alias("at", "pretoken"))
    return (
        slices.drop("pretokens").groupBy("slice").cogroup(_counted(places, path).groupBy("slice"))
        .applyInArrow(_summed, _FOUND).withColumn("over_limit", F.col("n_tokens") > limit))
