import zlib

from sievework.llm import sharding


def check(out, rows, shards):
    assert len(out) == len(rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    for s in range(shards):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    return [sum(r.size for r in out if r.shard == s) for s in range(shards)]


def test_bytes_are_near_equal_and_groups_stay(spark, documents):
    rows = [(i, f"text {i % 400} " * (i % 37 + 1)) for i in range(2000)] + [(9000, None), (9001, ""), (None, "é"), (5, "text 5 " * 6), (5, "text 5 " * 6)]
    out = sharding.shard_documents(documents(rows), shards=8).collect()
    loads = check(out, rows, 8)
    assert max(loads) - min(loads) < 0.03 * sum(loads) / 8
    place = {}
    for r in out:
        place.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for s in place.values())


def test_a_huge_group_is_cut(spark, documents):
    rows = [(i, "the same text for all of them") for i in range(3000)] + [(10_000 + i, f"another {i}") for i in range(1000)]
    loads = check(sharding.shard_documents(documents(rows), shards=4, ranges=64, sample=1024).collect(), rows, 4)
    assert max(loads) - min(loads) < 0.05 * sum(loads) / 4


def test_few_rows(spark, documents):
    rows = [(1, "a"), (2, "a" * 100_000)]
    check(sharding.shard_documents(documents(rows)).collect(), rows, 8)
    assert sharding.shard_documents(documents(rows).limit(0)).count() == 0


def test_a_group_that_fits_a_shard_stays_whole(spark, documents):
    rows = [(i, "the same text for these rows") for i in range(700)] + [(10_000 + i, f"another text {i} with so many words") for i in range(7000)]
    out = sharding.shard_documents(documents(rows), shards=8, ranges=256, sample=4096).collect()
    loads = check(out, rows, 8)
    assert len({r.shard for r in out if r.doc_id < 700}) == 1 and max(loads) - min(loads) < 0.05 * sum(loads) / 8
