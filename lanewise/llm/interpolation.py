"""Language-model scoring by deleted interpolation.

The model mixes word-pair and single-word estimates:

    P(w | u) = l * c(u, w) / c(u) + (1 - l) * (c(w) + 0.5) / (N + 0.5 * (V + 1))

The weight l depends on how often the context u was seen (a bucket for each
doubling) and is learned by expectation-maximisation on held-out counts: each
training document is in turn taken out of all counts and predicted by the rest.

Tokens are words (runs of non-space characters, A-Z lower-cased) and one end
per document; the end is also the context of a document's first word.  Counts
are exact and over all training documents; a word is known by a 64-bit hash.

Null and empty texts are the end alone.  Repeated rows count and are scored
each.  Rows without doc_id are scored and teach nothing.  Without training
rows nothing is known and every token has probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lanewise.llm.arrays import chunks, mix, pack, unpack, utf8
from lanewise.llm.exchange import PARTS, grouped, mapped, numbered
from lanewise.plans.frozen import written

CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 1 << 20  # keys for a task that counts, about
STEPS = 16  # bins of a doubling of the ratio of the two estimates
_END = np.uint64(0x5BD1E9955BD1E995)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SHIFT = 64 * STEPS


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def _store(batch: pa.RecordBatch):
    hashes, sizes = [], []
    for text in batch.column("text").to_pylist():
        words = words_of(text)
        hashes += [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)),
                   np.array([_END])]
        sizes.append(len(words) + 1)
    known, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
    ids = batch.column("doc_id")
    meta = (pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)),
            pack(ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)),
            pack(batch.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)),
            pack(np.array(sizes, np.int64)))
    return pickle.dumps(meta), pack(np.diff(known, prepend=np.uint64(0))), pack(tokens.astype(np.int32))


class Chunk:
    """Tokens of some documents as numbers of the chunk's own words and word pairs."""

    def __init__(self, part):
        ids, valid, train, sizes = pickle.loads(part[2])
        self.number = part[0]
        self.ids, self.valid = unpack(ids, np.int64), unpack(valid, np.uint8).astype(bool)
        self.train, self.sizes = unpack(train, np.uint8).astype(bool), unpack(sizes, np.int64)
        self.hashes = np.cumsum(unpack(part[3], np.uint64), dtype=np.uint64)
        self.word = unpack(part[4], np.int32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]  # a document's first word follows an end
        self.context[0] = np.searchsorted(self.hashes, _END)
        pairs, self.pair = np.unique(self.context * len(self.hashes) + self.word, return_inverse=True)
        left, right = self.hashes[pairs // len(self.hashes)], self.hashes[pairs % len(self.hashes)]
        keys = [mix(self.hashes), mix(left * np.uint64(0x9E3779B97F4A7C15) + mix(right) + np.uint64(1))]
        self.single = np.repeat([True, False], [len(self.hashes), len(pairs)])
        keys = np.concatenate(keys)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def cuts(self, buckets: int):
        """(bucket, from, to) of the sorted keys; a bucket is a range of keys."""
        edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
        at = [0, *np.searchsorted(self.keys, edges).tolist(), len(self.keys)]
        return [(i, a, b) for i, (a, b) in enumerate(zip(at, at[1:])) if b > a]

    def questions(self, buckets: int):
        weight = self.train[self.doc].astype(float)
        own = np.concatenate([np.bincount(self.word, weight, len(self.hashes)),
                              np.bincount(self.pair, weight)]).astype(np.int64)[self.order]
        single = self.single[self.order]
        for bucket, a, b in self.cuts(buckets):
            yield (self.number, bucket, pack(np.diff(self.keys[a:b], prepend=np.uint64(0))),
                   pack(own[a:b]), np.packbits(single[a:b]).tobytes())

    def counts(self, answers: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the chunk's words and of its pairs."""
        got = np.concatenate([unpack(answers[i], np.int64) for i, _, _ in self.cuts(buckets)])
        out = np.empty_like(got)
        out[self.order] = got
        return out[: len(self.hashes)], out[len(self.hashes):]


def _count(parts):
    """Sums of the training counts of every key of a bucket, back to the chunks."""
    held = []
    bucket = 0
    for chunk, bucket, a, b, c in parts:
        keys = np.cumsum(unpack(a, np.uint64), dtype=np.uint64)
        single = np.unpackbits(np.frombuffer(c, np.uint8), count=len(keys)).astype(bool)
        held.append((chunk, keys, unpack(b, np.int64), single))
    keys, first, inside = np.unique(
        np.concatenate([h[1] for h in held]), return_index=True, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, inside, np.concatenate([h[2] for h in held]))
    single = np.concatenate([h[3] for h in held])[first]
    at = 0
    for chunk, own, _, _ in held:
        yield chunk, bucket, pack(total[inside[at: at + len(own)]]), None, None
        at += len(own)
    yield -1, bucket, pickle.dumps((int(total[single].sum()), int((total[single] > 0).sum()))), None, None


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the whole part of the binary logarithm."""
    return np.where(count > 0, np.frexp(count.astype(float))[1], 0)


def _together(parts, buckets: int):
    chunk, answers = None, {}
    for part in parts:
        if part[4] is not None:
            chunk = Chunk(part)
        else:
            answers[part[1]] = part[2]
    return chunk, *chunk.counts(answers, buckets)


def _heldout(n: int, v: int, buckets: int):
    """Held-out tokens by context bucket and ratio of the two estimates."""
    def work(parts):
        c, words, pairs = _together(parts, buckets)
        use = c.train[c.doc]
        doc, word, context, pair = c.doc[use], c.word[use], c.context[use], c.pair[use]
        if not len(doc):
            return

        def without_own(totals, what):
            _, inside, own = np.unique(doc * len(totals) + what, return_inverse=True, return_counts=True)
            return totals[what] - own[inside]

        left = n - c.sizes[doc]
        one = (without_own(words, word) + 0.5) / (left + 0.5 * (v + 1))
        seen, both = without_own(words, context), without_own(pairs, pair)
        ratio = np.where(seen > 0, both / np.maximum(seen, 1), 0) / one
        step = np.zeros(len(ratio), np.int64)
        some = ratio > 0
        step[some] = np.round(np.log2(ratio[some]) * STEPS).astype(np.int64) + _SHIFT
        kinds, times = np.unique(_bucket(seen) * (4 * _SHIFT) + step, return_counts=True)
        for kind, count in zip(kinds.tolist(), times.tolist()):
            yield kind // (4 * _SHIFT), kind % (4 * _SHIFT), count

    return work


def weights(points: list[tuple[int, int, int]], rounds: int = 200) -> np.ndarray:
    """The mixture weight of each context bucket, by expectation-maximisation."""
    out = np.full(66, -1.0)
    out[0] = 0.0
    by = np.array(points, float).reshape(-1, 3)
    for bucket in range(1, 66):
        own = by[by[:, 0] == bucket]
        if not len(own):
            continue
        ratio = np.where(own[:, 1] > 0, 2.0 ** ((own[:, 1] - _SHIFT) / STEPS), 0.0)
        part, times = 0.5, own[:, 2]
        for _ in range(rounds):
            share = part * ratio / (part * ratio + 1 - part)
            new = float((times * share).sum() / times.sum())
            done = abs(new - part) < 1e-9
            part = min(max(new, 1e-9), 1 - 1e-9)
            if done:
                break
        out[bucket] = part
    for bucket in range(1, 66):  # a bucket without held-out tokens takes the one below
        if out[bucket] < 0:
            out[bucket] = out[bucket - 1]
    return out


def _scores(n: int, v: int, mixture: np.ndarray, buckets: int):
    def work(parts):
        c, words, pairs = _together(parts, buckets)
        one = (words[c.word] + 0.5) / (n + 0.5 * (v + 1))
        seen = words[c.context]
        part = mixture[_bucket(seen)]
        mixed = part * np.where(seen > 0, pairs[c.pair] / np.maximum(seen, 1), 0) + (1 - part) * one
        size = len(c.sizes)
        base = np.bincount(c.doc, np.log10(one), size)
        score = np.bincount(c.doc, np.log10(mixed), size)
        known = np.bincount(c.doc, words[c.word] > 0, size)
        for i in range(size):
            yield (int(c.ids[i]) if c.valid[i] else None, int(c.sizes[i]), int(known[i]), n,
                   float(base[i]), float(score[i]))

    return work


def _packer(names: list[str], kinds: list):
    def to_batch(rows):
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return to_batch


def remainder(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def score(df: DataFrame) -> DataFrame:
    """Per document its tokens, known tokens, and log10 probability under both models."""
    docs = df.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text"),
        F.coalesce(remainder(F.col("doc_id").cast("bigint")) != 1, F.lit(False)).alias("train"))
    store = written(docs.mapInArrow(numbered(_store, lambda b: chunks(b, CHUNK_BYTES)), PARTS),
                    "lm-chunks")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size // (8 * BUCKET_KEYS) + 1)  # a key for 8 bytes of text, about
    tasks = int(size // (2 * CHUNK_BYTES) + 12)
    asked = mapped(store, lambda part: Chunk(part).questions(buckets))
    answers = written(grouped(asked, "bucket", buckets, _count), "lm-counts")
    sums = answers.where(F.col("chunk") < 0).mapInArrow(_totals, "n bigint, v bigint").agg(
        F.sum("n"), F.sum("v")).first()
    n, v = sums[0] or 0, sums[1] or 0
    both = store.unionByName(answers.where(F.col("chunk") >= 0))
    points = (
        grouped(both, "chunk", tasks, _heldout(n, v, buckets), "bucket int, step int, n bigint",
                _packer(["bucket", "step", "n"], [pa.int32(), pa.int32(), pa.int64()]))
        .groupBy("bucket", "step").agg(F.sum("n").alias("n")).collect())  # a bounded grid
    mixture = weights([tuple(p) for p in points])
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = grouped(
        both, "chunk", tasks, _scores(n, v, mixture, buckets),
        "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint,"
        " base_score double, score double",
        _packer(names, [pa.int64()] * 4 + [pa.float64()] * 2))
    return out.withColumn(
        "held_out", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)))


def _totals(batches):
    for batch in batches:
        sums = [pickle.loads(a) for a in batch.column("a").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64())],
            ["n", "v"])
