import hashlib
import random

import pytest

from lanewise.llm import sentencepieces


@pytest.fixture(scope="module")
def codec():
    return sentencepieces.codec(sentencepieces.model_path())


def test_as_the_library_encodes(codec):
    r = random.Random(1)
    letters = list("aabcdeeinorst  ,.▁\n\té日本\u0000🎉ß0123​") + ["<s>", "</s>", "<0x0A>", "<unk>", " the"]
    texts = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 5, 20, 90]))) for _ in range(3000)]
    texts += ["x" * 5000, "thes" * 3000, " " * 4000, "日本" * 500, "▁ ▁" * 40, "", " ", "a ", " a"]
    want = [i + [codec.end] for i in codec.library.encode(texts)]
    assert codec.encode(texts) == want
    assert codec.spelled(texts) == [" ".join(map(str, i)) for i in want]
    assert codec.library.decode(want) == [t.replace("▁", " ") for t in texts]


def test_list_and_heap_agree(codec):
    r = random.Random(2)
    for _ in range(500):
        symbols = [r.choice("▁abcdeinorst") for _ in range(r.randrange(1, 60))]
        assert codec._by_list(list(symbols)) == codec._by_heap(list(symbols))


def test_a_full_memory_starts_anew(codec, monkeypatch):
    monkeypatch.setattr(sentencepieces, "KEPT_PARTS", 3)
    texts = ["one two three four five six"] * 3 + ["seven eight, nine"]
    for _ in range(3):
        assert codec.spelled(texts) == [" ".join(map(str, i + [codec.end])) for i in codec.library.encode(texts)]
        assert codec.encode(texts) == [i + [codec.end] for i in codec.library.encode(texts)]


def test_digests(wide, awkward, codec):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for doc, text in awkward:
        ids = codec.library.encode(text or "") + [codec.end]
        want.append((doc, len(ids), digest(" ".join(map(str, ids))), digest(codec.library.decode(ids))))
    got = [tuple(r) for r in sentencepieces.digests(wide).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_difference_to_the_library_is_an_error(codec, monkeypatch):
    monkeypatch.setattr(codec, "agenda", lambda part: (codec.ids["▁"],))
    monkeypatch.setattr(codec, "pieces", {})
    with pytest.raises(ValueError):
        list(codec.learn({"▁quite"}))


def test_round_trip_keeps_rows(wide, awkward, nothing):
    out = sentencepieces.round_trip(wide)
    assert out.columns == [*wide.columns, "ids"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(awkward, key=str)
    assert sentencepieces.round_trip(nothing).count() == 0


def test_frequent_parts_are_not_learnt_again(monkeypatch):
    monkeypatch.setattr(sentencepieces, "KEPT_PARTS", 40)
    own, learnt = sentencepieces.Codec(sentencepieces.model_path()), []
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda parts: learnt.extend(parts) or learn(parts))
    for i in range(30):
        text = "often met " + " ".join(f"once{i}x{j}" for j in range(9))
        ids = own.library.encode(text) + [own.end]
        assert own.spelled([text]) == [" ".join(map(str, ids))]
    assert learnt.count(f"{sentencepieces.SPACE}often") == learnt.count(f"{sentencepieces.SPACE}met") == 1
    assert len(own.told.young) + len(own.told.old) < 3 * 40
