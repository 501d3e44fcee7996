"""The prefix trie against one that is built a conversation at a time."""

import hashlib
import random
import zlib

import pytest

from cuelight.llm import trie as T


def brute(seqs):
    """Rows by (depth, prefix) of ``{conv: [(key, bytes)]}``."""
    members, ends = {}, {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        inner = {m[:-1] for m in members if m}
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(1 for m in members if m and m[:-1] == node),
            sum(1 for m in below if m not in inner), sum((len(members[m]) - 1) * m[-1][1] for m in below if m),
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rebuilt(rows):
    by = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).digest(), text or ""))
    said = {c: [((r, t), len(t.encode())) for _, _, r, _, t in sorted(v)] for c, v in by.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in said}
    return {c: said.get(c - c % 5, [])[: h[c]] + said[c][h[c] :] for c in said}


def trie_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int, n string, depth int")
    return sorted((tuple(r) for r in T.prefix_trie(T.with_shared_heads(T.turn_lists(df))).collect()), key=str)


@pytest.mark.parametrize("partitions", ["1", "3", "16"])
def test_like_a_trie_built_one_by_one(spark, partitions):
    rng = random.Random(int(partitions))
    rows = []
    for c in range(0, 240):
        if rng.random() < 0.1:
            continue
        long = 60 if c == 77 else rng.randint(1, 14)
        for t in range(long):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["é", "b", "cc", "", None]) if t > 1 else "first", 1, "x", 2))
    copy = [r for r in rows if r[0] == 77]
    rows += [(c, *r[1:]) for c in range(5000, 45000, 250) for r in copy]
    rows += [(None, 1, "user", "no conversation", 1, "x", 2)] + copy[:3]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie_of(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rebuilt(rows))


def test_odd_tables(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, None, None, None, 1, "", 1)]) == []
    for rows in ([(3, None, None, None, 1, "", 1)], [(c, 0, "", "", 1, "", 1) for c in (0, 1, 2, 3, 4, 9)], [(7, 0, "user", "x" * 100_000, 1, "", 1)] * 12):
        assert trie_of(spark, rows) == brute(rebuilt(rows))
