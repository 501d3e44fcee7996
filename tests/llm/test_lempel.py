"""Duplicate passages against all windows of all texts."""

import hashlib
import random
import time
from collections import Counter
from pathlib import Path

import pytest

from cuelight.llm import lempel as L


def brute(rows, window):
    said = [(k, (t or "").encode().split()) for k, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in said for i in range(len(w) - window + 1))
    out = []
    for k, w in said:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((k, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def passages(rng, words, size, n):
    """Texts with passages of all lengths about ``size`` copied between them, at their ends also, edited copies and runs of one word."""
    shared = [rng.choices(words, k=rng.randint(size - 3, 3 * size)) for _ in range(6)]
    out = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choices(words, k=rng.randint(0, 2 * size))
            part = list(rng.choice(shared))
            if rng.random() < 0.5:
                part = part[rng.randint(0, len(part)) :]
            if rng.random() < 0.3 and part:
                part[rng.randrange(len(part))] = "edited"
            text += part
        out.append(rng.choice([" ", "\n", " \t", "\x0b"]).join(text))
    out += [" ".join([w] * k) for w, k in (("a", 4 * size), ("b", size), ("b", size - 1), ("c", size + 1))]
    out.append(" ".join(["x", "y"] * (2 * size)))
    return out


@pytest.mark.parametrize("window,anchor,letters", [(5, 2, 4), (6, 1, 3), (35, 12, 300), (7, 7, 5)])
def test_like_all_windows(spark, window, anchor, letters):
    rng = random.Random(window)
    words = [f"w{k}" for k in range(letters)]
    texts = passages(rng, words, window, 60)
    rows = list(enumerate(texts)) + [(900, texts[0]), (901, texts[5]), (901, texts[5]), (902, None), (903, ""), (904, " \t\n"), (None, texts[7]), (None, "é b   c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key_a", "'x' as body", "2 as spans", "3 as mark")
    want = brute(rows, window)
    got = L.without_duplicates(df, window=window, anchor=anchor)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    covered = {(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans)) for r in L.duplicate_spans(df, window=window, anchor=anchor).collect()}
    assert covered == {r[:3] for r in want}


def test_query_on_a_small_table(spark, small):
    from cuelight.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = [(k, n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in brute(rows, 35)]
    assert sorted((tuple(r) for r in queries.op12_substrings(spark, small).collect()), key=str) == want
    assert sum(r[2] for r in want) > 0


def test_odd_documents(spark, documents):
    want = brute([(r.doc_id, r.text) for r in documents.collect()], 35)
    assert sorted((tuple(r) for r in L.without_duplicates(documents).collect()), key=str) == want
    assert L.without_duplicates(documents.limit(0)).count() == 0


def disk(spark):
    """Files of shuffles and checkpoints, and their sizes."""
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    folders = [*env.blockManager().diskBlockManager().localDirsString(), spark.conf.get("spark.checkpoint.dir").removeprefix("file:")]
    return {p: p.stat().st_size for f in folders for p in Path(f).rglob("*") if p.name.startswith(("shuffle_", "part-")) and p.is_file()}


def test_texts_without_repeats_are_not_shuffled(spark, monkeypatch):
    """What is written for them is their blocks, twice, and not their texts; bitmaps leave none out that has a passage."""
    rng = random.Random(12)

    def some(n):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20)) for _ in range(n))

    shared = some(50)
    # all anchors of the passage are in other surroundings, so that windows are asked
    texts = [some(600) for _ in range(300)] + [f"{some(30)} {shared} {some(30)}" for _ in range(9)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    monkeypatch.setattr(L, "_written", L.stable, raising=False)  # so that all stays that was written
    before = disk(spark)
    got = sorted((tuple(r) for r in L.without_duplicates(df).collect()), key=str)
    written = sum(n for p, n in disk(spark).items() if p not in before)
    assert got == brute(rows, 35)
    assert written < 0.6 * sum(map(len, texts)), written / sum(map(len, texts))


def test_spent_shuffles_go(spark):
    rng = random.Random(13)
    words = [f"w{k}" for k in range(300)]
    df = spark.createDataFrame(list(enumerate(passages(rng, words, 35, 60))), "doc_id long, text string")
    before = disk(spark)
    rows = L.without_duplicates(df)
    for _ in range(50):
        left = [p for p in disk(spark) if p not in before and p.name.startswith("shuffle_")]
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert rows.count() == rows.distinct().count() == df.count()
