import zlib
from collections import Counter, defaultdict

import pytest

from lanewise.llm import sharding


def check(rows, awkward, shards):
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in awkward)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in awkward)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for own in places.values():
        assert sorted(own) == list(range(len(own)))


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_even_and_whole(wide, awkward, shards):
    rows = sharding.assign(wide, shards).collect()
    check(rows, awkward, shards)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r["size"]
    largest = max(r["size"] for r in rows)
    mean = sum(sizes.values()) / shards
    assert all(abs(sizes[s] - mean) <= 2 * largest for s in range(shards))


def test_a_group_is_cut_only_by_need(spark):
    rows = [(i, "same text " * 5) for i in range(900)] + [(1000 + i, f"text {i} " * 5) for i in range(900)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
    check(got, rows, 8)
    counts = Counter()
    for r in got:
        counts[r.shard] += r["size"]
    assert max(counts.values()) - min(counts.values()) <= 110
    # the copies stand in neighbouring shards, in order of doc_id
    copies = sorted((r.shard, r.slot, r.doc_id) for r in got if r.doc_id < 1000)
    assert [c[2] for c in copies] == list(range(900))
    assert len({c[0] for c in copies}) <= 6


def test_empty_table(nothing):
    assert sharding.assign(nothing).count() == 0


def test_written_shards(spark, docs, tmp_path, awkward):
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(awkward)
    assert {p.name for p in (tmp_path / "out").glob("shard=*")} == {f"shard={i}" for i in range(4)}
