import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelight.llm import simhash as S
from cuelight.llm.graph import connected_components


def brute(text):
    """The fingerprint bit by bit."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAÉß \t\n\x1c\x85", max_size=60))
def test_fingerprint(text):
    assert S.simhash(text) == brute(text)


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(len(prints))]


def test_links_keep_components(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(25)]
    for p in list(prints):
        for _ in range(6):
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
            prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = S.linked_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long"))
    at = {p: k for k, p in enumerate(signed)}
    edges = [(at[r.a], at[r.b]) for r in links.collect()]
    assert all(bin(prints[a] ^ prints[b]).count("1") <= 2 for a, b in edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [got.get(k, k) for k in range(len(prints))] == brute_components(prints)


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (201, None), (300, 299), (299, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)} | {299: 299, 300: 299}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    got = S.simhash_components(documents).collect()
    assert len(got) == len(rows)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert all(prints[r.doc_id] == f"{brute(r.text or ''):016x}" for r in rows)
    part = {r.doc_id: r.component_id for r in got}
    assert part[1] == part[2] == part[3] == 1 and part[5] == part[6] == part[7] == 5 and part[10] == 10 and part[None] is None
    assert S.simhash_components(documents.limit(0)).count() == 0
    kept = S.drop_near_duplicates(documents)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 8, 9, 10, 10] and kept.columns == documents.columns


def test_query_is_brute_force(spark, small):
    from cuelight.llm.queries import op1_simhash

    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    prints = [brute(t) for _, t in docs]
    want = [(i, f"{p:016x}", docs[c][0]) for (i, _), p, c in zip(docs, prints, brute_components(prints))]
    assert sorted(map(tuple, op1_simhash(spark, small).collect())) == want
