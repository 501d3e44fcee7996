import zlib

import numpy as np

from cuelight.llm import sharding as S


def brute(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 3000)
    for n in (1, 2, 16, 17, 1000):
        assert S.jump_shard(keys, n).tolist() == [brute(int(k) % (1 << 64), n) for k in keys]
    a, b = S.jump_shard(keys, 16), S.jump_shard(keys, 17)
    assert set(b[a != b]) == {16} and 100 < (a != b).sum() < 250


def check(rows, got):
    assert sorted((r.doc_id or -1, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows) == sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})


def test_rows(spark, documents, small):
    check(documents.collect(), S.shard_documents(documents).collect())
    assert S.shard_documents(documents.limit(0)).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(docs.collect(), S.shard_documents(docs, buckets=3).collect())


def test_write(spark, documents, tmp_path):
    S.write_shards(documents.drop("bucket"), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == documents.count() and "jump_shard" in back.columns
