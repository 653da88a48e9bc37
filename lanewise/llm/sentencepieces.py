"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut before every run of spaces that follows another character; no
piece of such a vocabulary reaches across that place, so the parts are encoded
one by one and a part met before is looked up.  A new part goes through the
agenda (first cut again between characters that no piece has side by side): all adjacent symbol pairs that form a piece wait in a heap, best score
first and leftmost among equals; taking one joins its symbols and puts up the
new neighbouring pairs; pairs whose symbols have changed are passed over.  The
new parts of an Arrow batch are encoded and decoded by the sentencepiece library
as well, and a difference is an error.  Since parts are whole characters and
begin with a space sign, a text decodes to what its parts decode to.

Null texts count as empty; an empty text has the end id only.  Rows count one by
one: doc_id may be null or repeated.  A text is held whole, with its ids; a word
part of any length goes through the agenda in time n log n.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lanewise.llm.arrays import chunks, unused

SPACE = "▁"
KEPT_PARTS = 400_000  # remembered by a worker before a new generation begins
SLICE_BYTES = 1 << 20  # of text encoded together
SHORT = 48
_NONE = float("-inf")
_PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Parts:
    """What a worker remembers of parts, in two generations.

    A full generation is kept until the next one is full; what is met meanwhile
    moves on, so frequent parts are not learnt again.
    """

    def __init__(self):
        self.young, self.old = {}, {}

    def missing(self, parts: set[str]) -> set[str]:
        """The parts to be learnt; all others are in the young generation then."""
        if len(self.young) > KEPT_PARTS:
            self.young, self.old = {}, self.young
        new = parts - self.young.keys()
        met = new & self.old.keys()
        for part in met:
            self.young[part] = self.old[part]
        return new - met


class Codec:
    """Encoder and decoder for one model file with byte fallback and no normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.end = lib.eos_id()
        self.seen = Parts()  # ids of parts
        self.told = Parts()  # the same as decimal text, each id followed by a space
        self.pieces: dict[str, tuple[int, ...]] = {}  # ids of what parts are cut into
        for i in range(lib.vocab_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, lib.get_score(i)
        self.joined = {p[i: i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.ids):
            raise ValueError("pieces of this vocabulary reach across the start of a word")
        if lib.encode("A  b ", out_type=str) != lib.encode(" ".join(["A", "", "b", ""]), out_type=str):
            raise ValueError("this model normalises its input")
        if len(self.bytes) != 256:
            raise ValueError("this model has no byte fallback")

    def agenda(self, part: str) -> tuple[int, ...]:
        """The ids of a part by joining the best pair first."""
        symbols = list(part)
        symbols = self._by_list(symbols) if len(symbols) <= SHORT else self._by_heap(symbols)
        ids, out = self.ids, []
        for symbol in symbols:
            known = ids.get(symbol)
            if known is None:
                out += [self.bytes[b] for b in symbol.encode()]
            else:
                out.append(known)
        return tuple(out)

    def _by_list(self, symbols: list[str]) -> list[str]:
        """The agenda as a list in text order: for a few pairs quicker than a heap."""
        score = self.scores.get
        waiting = [score(a + b, _NONE) for a, b in zip(symbols, symbols[1:])]
        while waiting:
            best = max(waiting)
            if best == _NONE:
                break
            i = waiting.index(best)
            symbols[i: i + 2] = [symbols[i] + symbols[i + 1]]
            del waiting[i]
            if i:
                waiting[i - 1] = score(symbols[i - 1] + symbols[i], _NONE)
            if i < len(waiting):
                waiting[i] = score(symbols[i] + symbols[i + 1], _NONE)
        return symbols

    def _by_heap(self, symbols: list[str]) -> list[str]:
        scores, n = self.scores, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = (a + b for a, b in zip(symbols, symbols[1:]))
        heap = [(-scores[p], i, p) for i, p in enumerate(pairs) if p in scores]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != pair:
                continue  # one of its symbols was joined before
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                longer = pair + symbols[k]
                if longer in scores:
                    heappush(heap, (-scores[longer], i, longer))
            h = before[i]
            if h >= 0:
                longer = symbols[h] + pair
                if longer in scores:
                    heappush(heap, (-scores[longer], h, longer))
        return [s for s in symbols if s]

    def cut(self, part: str) -> list[str]:
        """The part cut between characters that stand side by side in no piece."""
        joined = self.joined
        at = [i for i in range(1, len(part)) if part[i - 1: i + 1] not in joined]
        return [part[a:b] for a, b in zip([0, *at], [*at, len(part)])] if at else [part]

    def _known(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = self.agenda(piece)
        return ids

    def learn(self, parts: set[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Ids of new parts, checked against the library both ways."""
        new = list(parts)
        if len(self.pieces) > KEPT_PARTS:
            self.pieces.clear()
        made = []
        for part in new:
            cut = self.cut(part)
            made.append(self.agenda(part) if len(cut) == 1 else sum((self._known(c) for c in cut), ()))
        # the library puts a space before a text by itself and takes it off again
        theirs = self.library.encode([p[1:] for p in new], num_threads=1)
        back = self.library.decode([list(ids) for ids in made], num_threads=1)
        for part, ids, other, text in zip(new, made, theirs, back):
            if (list(ids) != other and part != SPACE) or text != part[1:].replace(SPACE, " "):
                raise ValueError(f"not as the library encodes it: {part!r}")
            yield part, ids

    def _cut(self, texts: list[str], known: Parts) -> tuple[list[list[str]], set[str]]:
        """The parts of each text, and those not known."""
        cut = [_PART.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        return cut, known.missing(set().union(*cut))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with the end id last."""
        cut, new = self._cut(texts, self.seen)
        seen, end = self.seen.young, [self.end]
        seen.update(self.learn(new))
        return [[i for p in parts for i in seen[p]] + end for parts in cut]

    def spelled(self, texts: list[str]) -> list[str]:
        """The ids of each text, the end id last, as decimal text with a space between."""
        cut, new = self._cut(texts, self.told)
        told, end = self.told.young, str(self.end)
        for part, ids in self.learn(new):
            told[part] = "".join([f"{i} " for i in ids])
        return ["".join([told[p] for p in parts]) + end for parts in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _slices(batches: Iterator[pa.RecordBatch], text: str):
    """Slices of whole rows with their texts; null counts as empty."""
    for batch in chunks(batches, SLICE_BYTES, text):
        yield batch, [r or "" for r in batch.column(text).to_pylist()]


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """All columns and the ids of ``text``; with ``decoded`` also what the ids give back.

    Columns that had these names before are replaced.
    """
    path = path or model_path()
    kept = df.drop(ids, *([decoded] if decoded else []))
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if decoded:
        added.append(T.StructField(decoded, T.StringType()))

    def run(batches):
        own = codec(path)
        for batch, rows in _slices(batches, text):
            made = own.encode(rows)
            columns = [*batch.columns, pa.array(made, pa.list_(pa.int32()))]
            if decoded:
                columns.append(pa.array(own.decode(made), pa.string()))
            names = [*batch.schema.names, ids, *([decoded] if decoded else [])]
            yield pa.RecordBatch.from_arrays(columns, names)

    return kept.mapInArrow(run, T.StructType([*kept.schema, *added]))


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """Per document the number of ids and digests of the ids and of the decoded text."""
    path = path or model_path()

    def run(batches):
        own = codec(path)
        for batch, rows in _slices(batches, "text"):
            ids = own.spelled(rows)
            texts = [t.replace(SPACE, " ") for t in rows]  # what the checked parts decode to
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([x.count(" ") + 1 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    return narrow.mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def round_trip(df: DataFrame, path: str | None = None) -> DataFrame:
    """All rows with their ids; the text is what the ids decode to (null stays null)."""
    back = unused(df.columns, "_back")
    return encode(df, path, decoded=back).withColumn(
        "text", F.when(F.col("text").isNotNull(), F.col(back))).drop(back)
