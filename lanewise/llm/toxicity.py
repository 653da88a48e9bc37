"""Toxicity by noisy-channel deobfuscation.

A text is taken as words that went through a channel: letters may be written as
look-alike digits and signs, letters may be repeated, words may be spread out
letter by letter or cut by separators.  What the channel may have done to a
token is a lattice of characters; the best path under a character language
model (trigrams counted over all training texts) is the restored text.  The
model sees an accented letter as its base letter and all letters without a
Latin base as one; restored words keep the letters as written.  A token of
letters alone has a one-path lattice and is passed on as it is.  A token with
separators between letters may be several words or one, so both readings are
given.

The score comes from the restored words: words that occur in clearly more toxic
than clean training documents (a sample of LABELLED ones) carry their log odds, and a logistic curve turns
a document's sum into a probability.  Near copies count once in training.
Words count as evidence if their likelihood ratio exceeds what the best of all
words would reach by chance (2 ln V for V words).

Null and empty texts have no evidence and get the score of such texts; without
any labelled rows every score is 0.  Repeated rows are scored alike.  Labels
that are null, or of documents that do not exist, teach nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lanewise.llm.arrays import chunks, documents, flat
from lanewise.plans.frozen import written

LABELLED = 20_000  # labelled documents there are to learn from, by a hash of their doc_id; all, if fewer
EVIDENCE_WORDS = 100_000  # the most a model holds, strongest first
KEPT_TOKENS = 200_000  # remembered by a worker; then it starts anew

# Look-alikes of letters.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
_SIGNS = "".join(LOOKALIKES)
_SEPARATORS = ".-_*~ "
_END = ".,;:!?()[]{}\"'`*%&#$@~^<>|/\\=+-_…»«“”‘’"
_MARKS = "".join(c for c in _END if c not in _SIGNS)
_START = _MARKS + "("
_TRIPLE = re.compile(r"(.)\1\1")
_LETTERS = re.compile(r"[^\W\d_]+")
_INNER = re.compile(r"[0-9@$!|+(€£]|(?<=[^\W\d_])[.\-_*~](?=[^\W_][.\-_*~])")
_JOINT = re.compile(r"(?<=[^\W_]|[@$!|+(€£])[.\-_*~]+(?=[^\W_]|[@$!|+(€£])")
_BASE = 28
_SUBSTITUTE, _DROP, _REPEAT, _BREAK = math.log(0.2), math.log(0.3), math.log(0.3), math.log(1e-5)

# Letters whose base letter is not part of their decomposition.
_BASES = {"ß": "s", "æ": "a", "œ": "o", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "t", "ı": "i"}


@lru_cache(maxsize=1 << 16)
def letter_code(c: str) -> int:
    """1 to 26 by the base letter, 27 for letters without one, 0 (the boundary) for all else."""
    if not c.isalpha():
        return 0
    low = c.lower()[0]
    base = unicodedata.normalize("NFKD", _BASES.get(low, low))[0].lower()
    return ord(base) - 96 if "a" <= base <= "z" else _BASE - 1


_CODES = np.array([letter_code(chr(i)) for i in range(0x2000)], np.int32)


def letter_codes(data: np.ndarray) -> np.ndarray:
    """The code of each character of UTF-8 bytes."""
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = _CODES[np.minimum(points, len(_CODES) - 1)]
    far = points >= len(_CODES)
    if far.any():
        kinds, where = np.unique(points[far], return_inverse=True)
        codes[far] = np.array([letter_code(chr(p)) for p in kinds], np.int32)[where]
    return codes


def trigram_counts(data: np.ndarray) -> np.ndarray:
    codes = letter_codes(data)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
    codes = np.pad(codes[keep], 1)
    if len(codes) < 3:
        return np.zeros(_BASE ** 3, np.int64)
    return np.bincount(codes[:-2] * _BASE ** 2 + codes[1:-1] * _BASE + codes[2:], minlength=_BASE ** 3)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a character after two others, smoothed by the shorter contexts."""
    three = counts.reshape(_BASE, _BASE, _BASE).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + _BASE)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
    return np.log(p3)


def runs_of(text: str) -> list[int]:
    """At each place how often its character follows there in a row, itself included."""
    out = [1] * len(text)
    for i in range(len(text) - 2, -1, -1):
        if text[i] == text[i + 1]:
            out[i] = out[i + 1] + 1
    return out


def arcs(text: str):
    """The lattice: per place, (next place, letter or ' ', how often, log probability).

    A run of three and more equal letters is left as it is, or is one letter or
    two; each of these is one arc, whatever its length.
    """
    runs, skip = runs_of(text), 0
    for i, c in enumerate(text):
        here, run = [], runs[i]
        start = i == 0 or text[i - 1] != c
        if i < skip:
            pass  # inside a run of letters: no path stops here
        elif c.isalpha():
            here.append((i + run, c, run, 0.0) if run >= 3 else (i + 1, c, 1, 0.0))
            if run >= 3:
                here += [(i + run, c, 1, _REPEAT), (i + run, c, 2, _REPEAT + _DROP)]
                skip = i + run
        else:
            for letter in LOOKALIKES.get(c, ""):
                here.append((i + 1, letter, 1, _SUBSTITUTE))
                if run >= 2 and start:
                    here.append((i + run, letter, 1, _SUBSTITUTE + _REPEAT))
            if c in _SEPARATORS:
                here.append((i + 1, "", 1, _DROP))
            here.append((i + 1, " ", 1, 0.0 if c in _SEPARATORS else _BREAK if c in LOOKALIKES else _DROP))
        yield here


def decode(text: str, model: np.ndarray) -> str:
    """The best path through the lattice of a text of one or a few words.

    Paths are kept as links to what was written before, so the time grows with the
    length of the text and not with its square.
    """
    # by place: state (two last codes) -> (log probability, last link)
    at: dict[int, dict[tuple[int, int], tuple[float, tuple | None]]] = {0: {(0, 0): (0.0, None)}}
    for i, here in enumerate(arcs(text)):
        for (a, b), (score, done) in at.pop(i, {}).items():
            for j, letter, often, cost in here:
                s, x, y, link = score + cost, a, b, done
                code = letter_code(letter) if letter else 0
                if letter and not (code == 0 and y == 0):
                    for _ in range(min(often, 3)):
                        s += model[x, y, code]
                        x, y = y, code
                    if often > 3:
                        s += (often - 3) * model[code, code, code]
                    link = (link, letter, often)
                states = at.setdefault(j, {})
                if (x, y) not in states or states[x, y][0] < s:
                    states[x, y] = (s, link)
    best = max(at[len(text)].items(), key=lambda e: e[1][0] + model[e[0][0], e[0][1], 0])
    link, out = best[1][1], []
    while link:
        link, letter, often = link
        out.append(letter * often)
    return "".join(reversed(out))


class Restorer:
    """Words of texts as they were before the channel."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.seen: dict[str, tuple[str, ...]] = {}

    def token(self, token: str) -> tuple[str, ...]:
        core = token.rstrip(_END).lstrip(_START)
        if core.isalpha() and not _TRIPLE.search(core):
            return (core,)
        tail = token.lstrip(_START)[len(core):]
        if not any(map(str.isalpha, core)):
            return ()
        if _TRIPLE.search(core) or _INNER.search(core):
            words = decode(core, self.model).split()
            # a look-alike at the end may be a letter as well as a mark
            if tail[:1] in LOOKALIKES and tail[:1]:
                words += decode(core + tail[0], self.model).split()
        else:
            words = _LETTERS.findall(core)
        joined = _JOINT.sub("", core)
        if joined != core:
            words += self.token(joined + tail)
        return tuple(dict.fromkeys(words))

    def words(self, text: str) -> set[str]:
        tokens = text.lower().split()
        if len(self.seen) > KEPT_TOKENS:
            self.seen.clear()
        seen, out = self.seen, set()
        for token in set(tokens):
            known = seen.get(token)
            if known is None:
                known = seen[token] = self.token(token)
            out.update(known)
        for spread in self._spread(tokens):
            out.update(decode(spread, self.model).split())
        return out

    @staticmethod
    def _single(token: str) -> str:
        """The one letter or sign of a token without its outer punctuation, or nothing."""
        if len(token) > 1:
            token = token.rstrip(_END).lstrip(_START) or token.strip(_MARKS)
        return token if len(token) == 1 and (token in _SIGNS or token.isalpha()) else ""

    @classmethod
    def _spread(cls, tokens: list[str]) -> list[str]:
        """Runs of three and more single characters, at least one a letter."""
        out, run = [], []
        for token in [*tokens, "  "]:
            if one := cls._single(token):
                run.append(one)
                continue
            if len(run) >= 3 and any(map(str.isalpha, run)):
                out.append(" ".join(run))
            run = []
        return out


@lru_cache(maxsize=2)
def restorer(counts: bytes) -> Restorer:
    return Restorer(language_model(np.frombuffer(counts, np.int64)))


def near_key(tokens: list[str]) -> int:
    """One value for most near copies: the least hash of four words in a row."""
    grams = zip(tokens, tokens[1:], tokens[2:], tokens[3:]) if len(tokens) > 3 else [tokens]
    return min(xxhash.xxh3_64_intdigest(" ".join(g)) for g in grams) - (1 << 63)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    trigrams: bytes
    weights: dict[int, float]
    slope: float
    offset: float

    def score(self, words: set[str]) -> float:
        held = self.weights
        total = sum(sorted(
            held[h] for h in map(xxhash.xxh3_64_intdigest, words) if h in held)) if held else 0.0
        x = self.offset + self.slope * total
        return float(x > 0) if math.isinf(x) else 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _trigrams(texts: DataFrame) -> bytes:
    def run(batches):
        total = np.zeros(_BASE ** 3, np.int64)
        for batch in chunks(batches):
            data, offsets = flat(batch.column("text"))
            total += trigram_counts(data)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["gram", "n"])

    rows = texts.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(_BASE ** 3, np.int64)
    for row in rows.collect():  # at most 27 * 27 * 27
        counts[row["gram"]] = row["n"]
    return counts.tobytes()


def _fit(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (value, clean, toxic), by Newton steps."""
    x = np.array([p[0] for p in points], float)
    clean, toxic = (np.array([p[i] for p in points], float) for i in (1, 2))
    total, slope, offset = clean + toxic, 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(offset + slope * x, -50, 50)))
        w = total * p * (1 - p) + 1e-9
        gap = toxic - total * p
        hess = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        step = np.linalg.solve(hess, [gap.sum() - 1e-2 * offset, (gap * x).sum() - 1e-2 * slope])
        offset, slope = offset + step[0], slope + step[1]
        if abs(step).max() < 1e-9:
            break
    return float(max(slope, 0.0)), float(offset)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled documents that are not held out."""
    texts = documents(docs.where(~held_out(F.col("doc_id"))))
    trigrams = _trigrams(texts)
    present = docs.select(F.col("doc_id").cast("bigint").alias("doc")).where(F.col("doc").isNotNull()).distinct()
    marks = dict(tuple(r) for r in (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id").cast("bigint")))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .join(present, "doc", "left_semi")
        .orderBy(F.xxhash64("doc"), "doc").limit(LABELLED).collect()))

    def picked(batches):
        for batch in batches:
            known = [marks.get(d) for d in batch.column("doc_id").to_pylist()]
            some = pa.array([i for i, k in enumerate(known) if k is not None], pa.int64())
            toxic = pa.array([k for k in known if k is not None], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("text").take(some), toxic], ["text", "toxic"])

    def run(batches):
        own = restorer(trigrams)
        for batch in chunks(picked(batches)):
            texts_ = [(t or b"").decode() for t in batch.column("text").to_pylist()]
            found = [sorted(map(xxhash.xxh3_64_intdigest, own.words(t))) for t in texts_]
            yield pa.RecordBatch.from_arrays([
                pa.array([near_key(t.lower().split()) for t in texts_], pa.int64()),
                batch.column("toxic"),
                pa.array([[h - (1 << 63) for h in f] for f in found], pa.list_(pa.int64())),
            ], ["near", "toxic", "words"])

    read = texts.mapInArrow(run, "near bigint, toxic int, words array<bigint>")
    # of near copies with one label the one with most words is kept
    once = written(read.groupBy("near", "toxic").agg(F.max_by("words", F.size("words")).alias("words")),
                   "toxic-words")
    sums = once.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    rows, toxic = sums[0], sums[1] or 0
    if not toxic or toxic == rows:
        return Model(trigrams, {}, 0.0, -math.inf if not toxic else math.inf)
    counted = written(
        once.select("toxic", F.explode("words").alias("word")).groupBy("word")
        .agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")), "toxic-counts")
    kinds = counted.count()
    rate = toxic / rows
    c = F.col("n") - F.col("t")
    gain = 2 * (F.col("t") * F.log(F.col("t") / (F.col("n") * rate))
                + F.when(c > 0, c * F.log(c / (F.col("n") * (1 - rate)))).otherwise(0.0))
    weight = F.log(((F.col("t") + 0.5) / (toxic + 1.0)) / ((c + 0.5) / (rows - toxic + 1.0)))
    strong = (
        counted.where((F.col("t") > F.col("n") * rate) & (gain >= 2 * math.log(max(kinds, 2))))
        .select("word", weight.alias("weight"), gain.alias("gain"))
        .orderBy(F.desc("gain"), "word").limit(EVIDENCE_WORDS).collect()
    )
    weights = {r["word"] + (1 << 63): r["weight"] for r in strong}
    if not weights:
        return Model(trigrams, {}, 0.0, math.log(rate / (1 - rate)))
    held = {k - (1 << 63): v for k, v in weights.items()}

    def sums_of(batches):
        for batch in batches:
            totals = [round(sum(held.get(w, 0.0) for w in words), 1)
                      for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(totals, pa.float64()), batch.column("toxic")], ["x", "toxic"])

    points = (  # sums in steps of 0.1, at most a few thousand
        once.mapInArrow(sums_of, "x double, toxic int")
        .groupBy(F.least("x", F.lit(100.0)).alias("x"))
        .agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).collect())
    return Model(trigrams, weights, *_fit([tuple(p) for p in points]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document whether it is held out, its score and the predicted label."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # EVIDENCE_WORDS weights at most

    def run(batches):
        own = restorer(sent.value.trigrams)
        for batch in chunks(batches):
            scores = np.array([sent.value.score(own.words((t or b"").decode()))
                               for t in batch.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
            ], ["doc_id", "score", "predicted"])

    out = documents(docs).mapInArrow(run, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted as toxic, all columns as they were."""
    model = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        own = restorer(sent.value.trigrams)
        for batch in chunks(batches):
            keep = [sent.value.score(own.words(t or "")) < 0.5
                    for t in batch.column(names.index("text")).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
        own.seen.clear()  # the worker may live on with other work

    return docs.mapInArrow(run, docs.schema)
