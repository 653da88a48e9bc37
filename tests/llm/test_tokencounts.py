import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lanewise.llm import tokencounts


@pytest.fixture(scope="module")
def own():
    return tokencounts.pretokens(tokencounts.vocabulary_path())


def theirs(own, text):
    return len(own.library.encode(text, add_special_tokens=False).ids)


def ours(own, text):
    return int(own.pieces([p for part in own.parts(text) for p in own.of(part)]).sum())


LETTERS = list("aabcdeinorst  ,.'s't\n\t\r\x0b\x1c\x1f\x85\xa0éß日本🎉0123٣½²_\x00᠎ ​ 　﻿́") + [
    "<|endoftext|>", "<|endoftext|", " the", "'ll", "   ", "\r\n"]


def test_as_the_library_counts(own):
    r = random.Random(4)
    texts = ["".join(r.choice(LETTERS) for _ in range(r.choice([0, 1, 2, 5, 20, 90]))) for _ in range(4000)]
    texts += ["x" * 5000, " " * 4000, "日本" * 500, "a \n b", "a\n b ", "1 2  3   4", "<|endoftext|>" * 3, ""]
    assert [ours(own, t) for t in texts] == [theirs(own, t) for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40))
def test_any_text(own, text):
    text = text.encode("utf-8", "ignore").decode()
    pretokens = [p for part in own.parts(text) for p in own.of(part)]
    assert pretokens == [text[a:b] for _, (a, b) in own.library.pre_tokenizer.pre_tokenize_str(text)]
    assert ours(own, text) == theirs(own, text)


def test_a_full_memory_starts_anew(own, monkeypatch):
    monkeypatch.setattr(tokencounts, "KEPT_PARTS", 3)
    for text in ["one two three four five six"] * 3 + ["seven eight, nine's"]:
        assert ours(own, text) == theirs(own, text)


def counted(df, **options):
    return sorted((tuple(r) for r in tokencounts.count(df, **options).collect()), key=str)


def want(own, rows, limit=1024):
    made = []
    for doc, text in rows:
        n = theirs(own, text or "")
        made.append((doc, len((text or "").encode()), n, n > limit))
    return sorted(made, key=str)


@pytest.mark.parametrize("slice_, block", [(300, 100), (9000, 700), (24 << 20, 2 << 20)])
def test_counts(own, wide, awkward, monkeypatch, slice_, block):
    monkeypatch.setattr(tokencounts, "SLICE_BYTES", slice_)
    monkeypatch.setattr(tokencounts, "BLOCK_BYTES", block)
    assert counted(wide) == want(own, awkward)
    assert counted(wide, limit=60) == want(own, awkward, 60)


def test_limit_itself_is_within(own, spark):
    df = spark.createDataFrame([(1, "a " * 3), (2, "a " * 4)], "doc_id bigint, text string")
    n = theirs(own, "a " * 3)
    assert [r.over_limit for r in tokencounts.count(df, limit=n).orderBy("doc_id").collect()] == [False, True]


def test_empty_table(nothing):
    assert tokencounts.count(nothing).count() == 0


def test_a_pretoken_is_split_once(spark, own, monkeypatch):
    """Equal pre-tokens of all slices meet in one place, in order."""
    monkeypatch.setattr(tokencounts, "SLICE_BYTES", 50)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("the same words again and again").alias("text"))
    assert {r.n_tokens for r in tokencounts.count(df.repartition(6)).collect()} == {
        theirs(own, "the same words again and again")}
