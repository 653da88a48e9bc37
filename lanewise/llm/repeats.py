"""Removal of repeated passages with suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts in a
document with a smaller doc_id is removed.

1. Documents are stored in chunks.  Each start of such a string names the least
   24-gram hash inside it as its anchor; equal strings have equal anchors.
2. Anchors are counted over the corpus; only those in two documents matter.
3. Around these anchors a chunk cuts out contexts (the string starts that share
   an anchor, with their text), equal contexts once with their smallest doc_id,
   and sends them to the shard of the anchor.
4. A shard sorts its suffixes: the first 8 bytes, then Larsson-Sadakane
   refinement, which doubles the sorted depth and looks again only at groups
   still tied.  Kasai's lemma gives common prefixes; neighbours with ``length``
   bytes in common are one string, whose smallest doc_id is kept.  Equal contexts
   are one, and an anchor with a single context needs no comparison.  A shard
   goes piece by piece (PIECE_BYTES); the sorted strings of each piece are merged
   with those before by binary search.
5. The answers return to the chunks, which cut.

Null and empty texts have no bytes and lose none.  Rows with one doc_id do not
touch each other, repeated or not.  Rows without doc_id lose nothing and take
nothing.  Very long texts are a chunk of their own (up to 2 GB).
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from lanewise.llm.arrays import chunks, documents, flat, pack, spans_of, unpack, unused, utf8
from lanewise.llm.exchange import PARTS, grouped, mapped, numbered
from lanewise.llm.leaks import grams
from lanewise.plans.frozen import written

LENGTH = 50
GRAM = 24
CHUNK_BYTES = 2 << 20
SHARD_BYTES = 8 << 20  # of text for a shard, about
PIECE_BYTES = 1 << 20  # of contexts for one suffix array
WINDOW = 256 << 10  # starts looked at together
SPAN = 16 << 10  # contexts cut together
_PLACE = np.uint64((1 << 31) - 1)


# --- suffix arrays


def words_at(data: np.ndarray) -> np.ndarray:
    """At each place the next 8 bytes as a number that orders like them."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i: i + len(data)]
    return out


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ordered by the next ``depth`` bytes at least, and each place's group number.

    The end of the data is smaller than any byte.
    """
    n = len(data)
    key, room = words_at(data), np.full(n, 8, np.uint8)
    room[max(0, n - 8):] = np.arange(min(n, 8), 0, -1)
    order = np.lexsort((room, key))
    heads = np.ones(n, bool)
    heads[1:] = (key[order[1:]] != key[order[:-1]]) | (room[order[1:]] != room[order[:-1]])
    group = np.empty(n, np.int64)
    group[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    h = 8
    while h < depth:
        single = heads & np.append(heads[1:], True)
        tied = np.flatnonzero(~single)
        if not len(tied):
            break
        places = order[tied]
        first = group[places]
        beyond = places + h
        second = np.where(beyond < n, group[np.minimum(beyond, n - 1)], -1)
        by = np.lexsort((second, first))
        places, first, second = places[by], first[by], second[by]
        order[tied] = places
        new = np.ones(len(tied), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        heads[tied] = new
        group[places] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        h *= 2
    return order, group


def common_prefixes(data: np.ndarray, order: np.ndarray, group: np.ndarray, cap: int) -> np.ndarray:
    """Bytes that each suffix has in common with the one before it in order, up to ``cap``.

    Kasai's lemma: a suffix has at least as many as the suffix one place to its
    left, less one.  Eight interleaved runs of places use it side by side.  It
    needs the full order: in a group still tied, which has ``cap`` bytes in
    common, the first suffix and the right neighbours of the others start from 0.
    """
    n = len(data)
    first = group[order] == np.arange(n)
    tied = np.zeros(n, bool)
    tied[order[~first]] = True
    anew = np.zeros(n, bool)
    anew[order[first & np.append(~first[1:], False)]] = True
    anew[1:] |= tied[:-1]
    words, before = words_at(data), np.full(n, -1)
    before[order[1:]] = order[:-1]
    out, known = np.zeros(n, np.int64), None
    for shift in range(8):
        here = np.arange(shift, n, 8)
        least = np.zeros(len(here), np.int64) if known is None else np.maximum(known[: len(here)] - 1, 0)
        live = np.flatnonzero(before[here] >= 0)
        least[(before[here] < 0) | anew[here]] = 0
        least[tied[here]] = cap
        while len(live):
            a, b, l = here[live], before[here[live]], least[live]
            room = np.minimum(n - np.maximum(a, b) - l, cap - l)
            open_ = room > 0
            live, a, b, l, room = live[open_], a[open_], b[open_], l[open_], room[open_]
            differ = words[a + l] ^ words[b + l]
            same = np.zeros(len(live), np.int64)
            for byte in range(1, 9):
                same += differ < (np.uint64(1) << np.uint64(64 - 8 * byte)) if byte < 8 else differ == 0
            least[live] = l + np.minimum(same, room)
            live = live[(same == 8) & (room > 8)]
        out[here] = least
        known = least
    return out[order]


# --- anchors and contexts


def _anchors_of(hashes: np.ndarray) -> np.ndarray:
    """The place of the least gram hash in each string, from the hashes of all its grams."""
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width, window = 1, LENGTH - GRAM + 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        gap = window - width
        least = np.minimum(least[:-gap], least[gap:])
    return (least & _PLACE).astype(np.int64)


class Runs:
    """Starts of strings in a chunk, grouped by neighbouring starts with one anchor.

    The chunk is gone through in windows of starts, each with the bytes its last
    strings reach into, so what is held for every byte is held for a window only.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        ends = np.cumsum(lengths)
        empty = np.empty(0, np.int64)
        self.low, self.count, self.doc, self.gram = empty, empty, empty, np.empty(0, np.uint64)
        if len(data) < LENGTH or not (lengths >= LENGTH).any():
            return
        found, total, last = [], 0, (-2, -1, -1)  # start, anchor and document before
        for begin in range(0, len(data) - LENGTH + 1, WINDOW):
            hashes = grams(data[begin: begin + WINDOW + LENGTH - 1], GRAM)
            anchor = _anchors_of(hashes)
            starts = np.arange(len(anchor))
            doc = np.searchsorted(ends, begin + starts, "right")
            inside = np.flatnonzero(begin + starts + LENGTH <= ends[doc])
            starts, anchor, doc = starts[inside], anchor[inside], doc[inside]
            if not len(starts):
                continue
            new = np.ones(len(starts), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1])
            # a run may go on from the window before
            new[0] = (begin + int(starts[0]) - 1, begin + int(anchor[0]), int(doc[0])) != last
            last = begin + int(starts[-1]), begin + int(anchor[-1]), int(doc[-1])
            first = np.flatnonzero(new)
            found.append((begin + starts[first], total + first, doc[first], hashes[anchor[first]]))
            total += len(starts)
        if found:
            self.low, first, self.doc, self.gram = (np.concatenate(c) for c in zip(*found))
            self.count = np.diff(np.append(first, total))

    def keys(self, ids: np.ndarray, buckets: int):
        """Bucket, hash and 'in two documents' of each different anchor, by bucket."""
        gram, doc = self.gram, ids[self.doc]
        by = np.lexsort((doc, gram))
        gram, doc = gram[by], doc[by]
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        first = np.flatnonzero(new)
        several = doc[first] != doc[np.append(first[1:], len(gram)) - 1] if len(gram) else first > 0
        gram = gram[first]
        bucket = (gram % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        return bucket[by], gram[by], several[by]


def _open(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, _, a, b, c = part
    text = zstandard.ZstdDecompressor().decompress(c)
    return unpack(pickle.loads(a)[0], np.int64), unpack(b, np.int64), np.frombuffer(text, np.uint8)


def _by_bucket(bucket: np.ndarray):
    """(bucket, from, to) of each run of a sorted array."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.append(0, edges), np.append(edges, len(bucket))):
        if b > a:
            yield int(bucket[a]), int(a), int(b)


def _bits(parts: dict[int, bytes], bucket: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bucket), bool)
    for number, a, b in _by_bucket(bucket):
        if number in parts:
            out[a:b] = np.unpackbits(np.frombuffer(parts[number], np.uint8), count=b - a).astype(bool)
    return out


class Contexts:
    """The different contexts of a chunk at anchors of two documents, by bucket."""

    def __init__(self, chunk, marks: dict[int, bytes], buckets: int):
        self.ids, self.lengths, self.data = _open(chunk)
        runs = Runs(self.data, self.lengths)
        bucket, gram, _ = runs.keys(self.ids, buckets)
        known = np.sort(gram[_bits(marks, bucket)])
        at = np.searchsorted(known, runs.gram)
        hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == runs.gram) if len(known) else at[:0]
        self.low, self.count, self.doc = runs.low[hit], runs.count[hit], runs.doc[hit]
        self.gram, raw = runs.gram[hit], memoryview(self.data)
        digests = np.frombuffer(b"".join([
            xxhash.xxh3_128_digest(raw[l: l + c + LENGTH - 1])
            for l, c in zip(self.low.tolist(), self.count.tolist())]), np.uint64).reshape(-1, 2)
        by = np.lexsort((digests[:, 1], digests[:, 0]))
        other = np.ones(len(by), bool)
        other[1:] = (digests[by[1:]] != digests[by[:-1]]).any(1)
        self.same = np.empty(len(by), np.int64)
        self.same[by] = np.cumsum(other) - 1
        _, first = np.unique(self.same, return_index=True)
        bucket = (self.gram[first] % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((self.gram[first], bucket))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.same = place[self.same]
        self.first, self.bucket = first[by], bucket[by]
        self.least = np.full(len(by), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.same, self.ids[self.doc])

    def sent(self, number: int):
        for bucket, a, b in _by_bucket(self.bucket):
            own = self.first[a:b]
            text = self.data[spans_of(self.low[own], self.count[own] + LENGTH - 1)]
            facts = (pack(self.count[own].astype(np.uint8)),
                     pack((self.gram[own] >> np.uint64(32)).astype(np.uint32)))
            yield (number, bucket, zstandard.compress(text.tobytes(), 1), pickle.dumps(facts),
                   pack(self.least[a:b]))

    def cut(self, answers: dict[int, bytes]):
        """Per document the mask of removed bytes."""
        counts = self.count[self.first]
        begins = np.cumsum(counts) - counts
        least = np.full(int(counts.sum()), np.iinfo(np.int64).max)
        for bucket, a, b in _by_bucket(self.bucket):
            least[begins[a]: begins[b - 1] + counts[b - 1]] = unpack(answers[bucket], np.int64)
        step = np.zeros(len(self.data) + 1, np.int32)
        for a in range(0, len(self.low), SPAN):
            count, part = self.count[a: a + SPAN], self.same[a: a + SPAN]
            owner = np.repeat(self.ids[self.doc[a: a + SPAN]], count)
            gone = spans_of(self.low[a: a + SPAN], count)[least[spans_of(begins[part], count)] < owner]
            np.add.at(step, gone, 1)
            np.add.at(step, gone + LENGTH, -1)
        np.cumsum(step, out=step)
        mask = step[:-1] > 0
        at = 0
        for doc, size in zip(self.ids.tolist(), self.lengths.tolist()):
            yield doc, self.data[at: at + size], mask[at: at + size]
            at += size


# --- shards


class Strings:
    """Different strings of a shard in order, with their smallest doc_id."""

    def __init__(self):
        self.keys, self.numbers = np.empty(0, f"S{LENGTH}"), np.empty(0, np.int64)
        self.least = np.empty(0, np.int64)

    def merge(self, text: np.ndarray, starts: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Take in the strings of a piece; gives the number of the string at each start."""
        order, group = suffix_array(text, LENGTH)
        edge = common_prefixes(text, order, group, LENGTH) < LENGTH
        class_ = np.empty(len(text), np.int64)
        class_[order] = np.cumsum(edge) - 1
        used, inside = np.unique(class_[starts], return_inverse=True)
        first = np.full(len(used), len(text), np.int64)
        np.minimum.at(first, inside, starts)
        smallest = np.full(len(used), np.iinfo(np.int64).max)
        np.minimum.at(smallest, inside, least)
        keys = np.ascontiguousarray(text[first[:, None] + np.arange(LENGTH)]).view(f"S{LENGTH}").ravel()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        numbers = np.empty(len(keys), np.int64)
        numbers[known] = self.numbers[at[known]]
        numbers[~known] = len(self.least) + np.arange(int((~known).sum()))
        np.minimum.at(self.least, numbers[known], smallest[known])
        self.least = np.append(self.least, smallest[~known])
        self.keys = np.insert(self.keys, at[~known], keys[~known])
        self.numbers = np.insert(self.numbers, at[~known], numbers[~known])
        return numbers[inside]


def _answer(parts):
    """The smallest doc_id of every string of a bucket, back to the chunks.

    A context that came several times is kept once.  Only anchors with several
    contexts need their strings compared; they go through the suffix arrays in
    pieces, neighbours by anchor.
    """
    number: dict[bytes, int] = {}
    texts, sizes, grams_, held, bucket = [], [], [], [], 0
    for chunk, bucket, a, b, c in parts:
        raw = zstandard.ZstdDecompressor().decompress(a)
        counts, gram = (unpack(x, d) for x, d in zip(pickle.loads(b), (np.uint8, np.uint32)))
        own, at = np.empty(len(counts), np.int64), 0
        for i, (count, g) in enumerate(zip(counts.tolist(), gram.tolist())):
            text = raw[at: at + count + LENGTH - 1]
            at += len(text)
            j = own[i] = number.setdefault(xxhash.xxh3_128_digest(text), len(texts))
            if j == len(texts):
                texts.append(text)
                sizes.append(count)
                grams_.append(g)
        held.append((chunk, own, unpack(c, np.int64)))
    counts, gram = np.array(sizes, np.int64), np.array(grams_, np.int64)
    least = np.full(len(texts), np.iinfo(np.int64).max)
    for _, own, smallest in held:
        np.minimum.at(least, own, smallest)
    begins = np.cumsum(counts) - counts
    found = np.repeat(least, counts)
    order = np.argsort(gram, kind="stable")
    new = np.append(True, gram[order[1:]] != gram[order[:-1]])
    alone = new & np.append(new[1:], True)
    strings, pieces, piece, size = Strings(), [], [], 0
    for i in [*order[~alone].tolist(), None]:
        if piece and (i is None or size >= PIECE_BYTES):
            own = np.array(piece)
            text = np.frombuffer(b"".join(texts[j] for j in piece), np.uint8)
            spans = counts[own] + LENGTH - 1
            starts = spans_of(np.cumsum(spans) - spans, counts[own])
            numbers = strings.merge(text, starts, np.repeat(least[own], counts[own]))
            pieces.append((own, numbers.astype(np.int32)))
            piece, size = [], 0
        if i is not None:
            piece.append(i)
            size += len(texts[i])
    for own, numbers in pieces:
        found[spans_of(begins[own], counts[own])] = strings.least[numbers]
    for chunk, own, _ in held:
        yield chunk, bucket, pack(found[spans_of(begins[own], counts[own])]), None, None


def _shared(parts):
    """Which anchors of each chunk are in two documents, as bits in the order they came."""
    held = [(chunk, bucket, unpack(a, np.uint64), unpack(b, np.uint8)) for chunk, bucket, a, b, _ in parts]
    keys = np.concatenate([h[2] for h in held])
    _, inside = np.unique(keys, return_inverse=True)
    weight = np.bincount(inside, 1 + np.concatenate([h[3] for h in held]))
    marked, at = weight[inside] > 1, 0
    for chunk, bucket, own, _ in held:
        yield chunk, bucket, np.packbits(marked[at: at + len(own)]).tobytes(), None, None
        at += len(own)


def _stored(batch: pa.RecordBatch, doc_id: str = "doc_id", text: str = "text", other=None):
    """Ids (with other columns and which texts are null), lengths and texts of a chunk."""
    data, offsets = flat(batch.column(text))
    ids = np.asarray(batch.column(doc_id).to_numpy(zero_copy_only=False), np.int64)
    more, null = None, None
    if other is not None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, other.schema) as out:
            out.write_batch(other)
        more = sink.getvalue().to_pybytes()
        null = pack(batch.column(text).is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
    return (pickle.dumps((pack(ids), more, null)), pack(np.diff(offsets)),
            zstandard.compress(data.tobytes(), 3))


def _gathered(parts):
    """The chunk row, the marks and the answers among the parts of a chunk."""
    chunk, marks, answers = None, {}, {}
    for part in parts:
        if part[4] is not None:
            chunk = part
        elif part[3] is not None:
            marks[part[1]] = part[2]
        else:
            answers[part[1]] = part[2]
    return chunk, marks, answers


def _anchors(buckets: int):
    def work(part):
        ids, lengths, data = _open(part)
        bucket, gram, several = Runs(data, lengths).keys(ids, buckets)
        for number, a, b in _by_bucket(bucket):
            yield part[0], number, pack(gram[a:b]), pack(several[a:b].astype(np.uint8)), None

    return work


def _send(buckets: int):
    def work(parts):
        chunk, marks = None, {}
        for part in parts:
            if part[4] is not None:
                chunk = part
            else:
                marks[part[1]] = part[2]
        yield from Contexts(chunk, marks, buckets).sent(chunk[0])

    return work


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
_KINDS = [pa.int64()] * 4 + [pa.string()]
_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _rows(rows):
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)


def _finish(buckets: int):
    def work(parts):
        chunk, marks, answers = _gathered(parts)
        for doc, data, gone in Contexts(chunk, marks, buckets).cut(answers):
            kept = data[~gone].tobytes()
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            yield doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()

    return work


def _answered(docs: DataFrame, cut_up, store, text: str):
    """Stored chunks, marks of shared anchors and smallest doc_ids, with buckets and tasks to use."""
    parts = written(docs.mapInArrow(numbered(store, cut_up), PARTS), "repeat-chunks")
    # a shard or bucket for every SHARD_BYTES of text
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, tasks = int(total // SHARD_BYTES + 1), int(total // (2 * SHARD_BYTES) + 12)
    marks = written(
        grouped(mapped(parts, _anchors(buckets)), "bucket", buckets, _shared), "repeat-marks")
    sent = grouped(parts.unionByName(marks), "chunk", tasks, _send(buckets))
    answers = written(grouped(sent, "bucket", buckets, _answer), "repeat-answers")
    return parts, marks.withColumn("b", F.lit(b"")), answers, buckets, tasks


def remove(df: DataFrame) -> DataFrame:
    """Per document its bytes, the removed ones, their runs and a digest of the rest."""
    docs = documents(df)
    parts, marks, answers, buckets, tasks = _answered(
        docs.where(F.col("doc_id").isNotNull()), lambda b: chunks(b, CHUNK_BYTES), _stored, "text")
    out = grouped(parts.unionByName(marks).unionByName(answers), "chunk", tasks,
                  _finish(buckets), _RESULT, _rows)

    def plain(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            yield _rows([(None, len(t), 0, 0, hashlib.sha256(t).hexdigest()) for t in texts])

    loose = docs.where(F.col("doc_id").isNull()).mapInArrow(plain, _RESULT)
    return out.unionByName(loose)


def cut(df: DataFrame) -> DataFrame:
    """The documents without repeated passages, other columns as they were.

    A character that loses some of its bytes goes as a whole.  ``n_chars``, where
    there is one, is counted anew for texts that lose something.  The other
    columns travel with the texts in the chunks, so no join is needed.
    """
    names = df.columns
    names_other = [n for n in names if n != "text"]
    inside, raw = unused(names, "doc_number"), unused(names, "text_bytes")
    docs = df.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias(inside), utf8(F.col("text")).alias(raw),
        *[df[n] for n in names_other])

    def store(batch: pa.RecordBatch):
        return _stored(batch, inside, raw, batch.select(names_other))

    parts, marks, answers, buckets, tasks = _answered(
        docs, lambda b: chunks(b, CHUNK_BYTES, raw), store, raw)
    counted = df.schema["n_chars"].dataType if "n_chars" in names else None

    def work(rows):
        chunk, mark, answer = _gathered(rows)
        _, more, null = pickle.loads(chunk[2])
        other, was_null = pa.ipc.open_stream(more).read_all(), unpack(null, np.uint8).astype(bool)
        texts, changed = [], []
        for (_, data, gone), null in zip(Contexts(chunk, mark, buckets).cut(answer), was_null):
            texts.append(None if null else data[~gone].tobytes().decode("utf-8", "ignore"))
            changed.append(bool(gone.any()))
        columns = dict(zip(names_other, other.to_batches()[0].columns))
        columns["text"] = pa.array(texts, pa.string())
        if counted is not None:
            old = columns["n_chars"].to_pylist()
            new = [len(t) if c else o for t, c, o in zip(texts, changed, old)]
            columns["n_chars"] = pa.array(new, columns["n_chars"].type)
        yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    # a chunk gives one batch
    out = grouped(parts.unionByName(marks).unionByName(answers), "chunk", tasks, work, df.schema,
                  lambda made: made[0])
    return out.unionByName(df.where(F.col("doc_id").isNull()))
