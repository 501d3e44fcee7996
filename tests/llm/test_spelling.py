"""Spelling variants against the edit distance of all pairs."""

import random
import re
import zlib
from collections import Counter

from cuelight.llm import spelling as P


def distance_is_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    near = {w: [v for v in counts if distance_is_one(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def words_of(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_all_pairs_of_words(spark):
    """Few letters, so that words have equal bigrams, short sides and many near words; chains of forms."""
    rng = random.Random(11)
    counts = {}
    for letters in ("ab", "abc", "aé", "abcdefgh", "÷abc"):
        for _ in range(220):
            w = "".join(rng.choices(letters, k=rng.randint(7, 11)))
            for v in (w, w[:3] + rng.choice(letters) + w[3:], w[:-1], w[1:], w[:5] + "z" + w[6:], "a" + w):
                if len(v) >= 7:
                    counts[v] = rng.choice((2, 3, 25, 30, 400, 400, 5000))
    counts |= {"aaaaaaa": 10**17, "aaaaaaaa": 10**16, "aaaaaaaaa": 10**15, "aaaaaaaaaa": 10**14, "w w w w": 2, "w w w  w": 20}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").selectExpr("*", "1 as key", "2 as a")
    got = sorted((tuple(r) for r in P.spelling_variants(df).collect()), key=str)
    assert got == brute(counts)
    assert P.spelling_variants(df.limit(0)).count() == 0


def test_words_of_odd_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(20, "ÀÉÎÕÜ-Çédille×÷ÿ straßenbahnen STRASSENBAHNEN " * 40), (21, "x" * 30_000), (21, "x" * 30_000)]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows[-3:], "doc_id long, text string"))
    assert {r.word: r.n for r in P.noisy_words(df).collect()} == words_of(rows)


def test_query_on_a_small_table(spark, small):
    from cuelight.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_spelling(spark, small).collect()), key=str)
    assert got == brute(words_of(rows))
    assert any(r[1] for r in got)
