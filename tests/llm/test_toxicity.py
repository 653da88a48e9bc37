import random
import time
import zlib

import numpy as np
import pytest

from lanewise.llm import toxicity


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def test_held_out_accuracy(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    own = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    clean = [p for t, p in own if not t]
    assert sum(clean) <= 0.02 * len(clean)
    assert sum(t == p for t, p in own) >= 0.9 * len(own)


@pytest.mark.parametrize("written, word", [
    ("id!ot", "idiot"), ("idiooooot", "idiot"), ("m0r0n", "moron"), ("i d i o t", "idiot"),
    ("tr@sh", "trash"), ("$tupid", "stupid"), ("i.d.i.o.t", "idiot"), ("d1sgust1ng", "disgusting"),
    ("s-c-u-m!!", "scum"), ("TRASH$$$", "trash"), ("(clown)", "clown"),
])
def test_restored(model, written, word):
    words = toxicity.restorer(model.trigrams).words(f"the {written} and")
    assert word in words


@pytest.mark.parametrize("written, word", [
    ("ré3ux", "réeux"), ("réeuuuux", "réeux"), ("r.é.e.u.x", "réeux"), ("r é e u x", "réeux"), ("Ré3ux!", "réeux"),
    ("i d i o t.", "idiot"), ('"i d i o t"', "idiot"), ("i d 1 o t!", "idiot"),
    ("id-iot", "idiot"), ("mor.on", "moron"), ("st-up_id", "stupid"), ("m0r.on", "moron"), ("(id-iot)", "idiot"),
])
def test_restored_with_accents_marks_and_separators(model, written, word):
    words = toxicity.restorer(model.trigrams).words(f"the {written} and")
    assert word in words


def test_codes_of_letters():
    text = "aÉßz 9łи日\U0001d41a-"
    assert toxicity.letter_codes(np.frombuffer(text.encode(), np.uint8)).tolist() == [
        1, 5, 19, 26, 0, 0, 12, 27, 27, 1, 0]


def test_plain_words_stay(model):
    words = toxicity.restorer(model.trigrams).words("Der Größe, foo-bar! don't 1234 $$$ the the")
    assert {"der", "größe", "foo", "bar", "the"} <= words
    assert "1234" not in words


def test_decode_takes_the_likeliest_path():
    counts = toxicity.trigram_counts(np.frombuffer(b"idiot idiot idiot lot lot", np.uint8))
    assert toxicity.decode("1d10t", toxicity.language_model(counts)) == "idiot"


def test_awkward_rows(wide, model, awkward):
    rows = toxicity.score(wide, model).collect()
    assert len(rows) == len(awkward) and all(0 <= r.score <= 1 for r in rows)


def test_reject_keeps_columns(spark, wide, awkward):
    labels = spark.createDataFrame(
        [(d, 0, int("idiot" in (t or ""))) for d, t in awkward if d is not None] + [(None, 0, 1), (5, 0, None)],
        "doc_id bigint, quality int, toxic int")
    kept = toxicity.reject(wide, labels)
    assert kept.columns == wide.columns
    assert {400, 401, 402} <= {r.doc_id for r in kept.collect()}


def test_labels_of_absent_documents_take_no_places(spark, monkeypatch):
    r = random.Random(3)
    words = ["the", "river", "house", "green", "walks", "slow", "under", "light"]
    rows = [(i, " ".join(r.choice(words) for _ in range(12)) + (" idiot" if i % 2 else "")) for i in range(300)]
    docs = spark.createDataFrame([*rows, (None, "idiot")], "doc_id bigint, text string")
    labels = spark.range(20_000).selectExpr("id as doc_id", "0 as quality", "cast(id % 2 as int) as toxic")
    monkeypatch.setattr(toxicity, "LABELLED", 60)
    marked = toxicity.score(docs.where("doc_id is not null"), toxicity.train(docs, labels)).collect()
    assert all(m.predicted == m.doc_id % 2 for m in marked) and len(marked) == 300


def test_empty_tables(spark, nothing, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()} == {0.0}


def all_paths(text, i=0):
    """Every way to read a token: (written text, log probability of the channel)."""
    if i == len(text):
        yield "", 0.0
        return
    c, run = text[i], 1
    while i + run < len(text) and text[i + run] == c:
        run += 1
    first = i == 0 or text[i - 1] != c
    ways = []
    if c.isalpha():
        ways.append((1, c, 0.0))
        if first and run >= 3:
            ways += [(run, c, toxicity._REPEAT), (run, c + c, toxicity._REPEAT + toxicity._DROP)]
    else:
        for letter in toxicity.LOOKALIKES.get(c, ""):
            ways.append((1, letter, toxicity._SUBSTITUTE))
            if first and run >= 2:
                ways.append((run, letter, toxicity._SUBSTITUTE + toxicity._REPEAT))
        separator, known = c in toxicity._SEPARATORS, c in toxicity.LOOKALIKES
        if separator:
            ways.append((1, "", toxicity._DROP))
        ways.append((1, " ", 0.0 if separator else toxicity._BREAK if known else toxicity._DROP))
    for step, letters, cost in ways:
        for rest, more in all_paths(text, i + step):
            yield letters + rest, cost + more


def test_decoding_is_the_best_of_all_paths(model):
    lm = toxicity.restorer(model.trigrams).model

    def value(path):
        letters, cost = path
        x = y = 0
        for c in letters:
            code = toxicity.letter_code(c)
            if code or y:
                cost, x, y = cost + lm[x, y, code], y, code
        return cost + lm[x, y, 0]

    def squeezed(text):  # spaces at the start and beside one another are not written
        return " ".join(text.split())

    r = random.Random(9)
    for _ in range(400):
        token = "".join(r.choice("aeiost013!$|.-é") * r.choice([1, 1, 1, 2, 3, 4]) for _ in range(r.randrange(1, 5)))[:8]
        best = max(map(value, all_paths(token)))
        allowed = {squeezed(p[0]) for p in all_paths(token) if value(p) > best - 1e-9}
        assert squeezed(toxicity.decode(token, lm)) in allowed, token


@pytest.mark.parametrize("text", [
    "a" * 1_000_000, "".join(random.Random(1).choice("ab01x9") for _ in range(100_000)), "i " * 50_000 + "d", "!" * 100_000])
def test_long_runs_take_seconds(model, text):
    start = time.perf_counter()
    toxicity.restorer(model.trigrams).words(text)
    assert time.perf_counter() - start < 30
