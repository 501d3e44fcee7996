import hashlib
import itertools
import re

from pyspark.sql import functions as F

from cuelight.llm import spotsigs as S


def marks(text):
    words = [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]
    content = [k for k, w in enumerate(words) if w not in S.ANCHORS]
    spots = {
        " ".join([words[i - 1], *[words[j] for j in content[k : k + S.CHAIN]]])
        for k, i in enumerate(content)
        if i and words[i - 1] in S.ANCHORS
    }
    spots = spots or {"all " + " ".join(words)}
    return sorted(hashlib.md5(s.encode()).hexdigest()[: S.DIGITS] for s in spots)


def near(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


def order(rows):
    return sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))


def check(rows, got):
    rows = order(rows)
    want = []
    for k, r in enumerate(rows):
        text, following = r.text or "", rows[(k + 1) % len(rows)].text or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        a, e, n = marks(text), marks(edited), marks(following)
        want.append((r.doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(e), round(near(a, e), 9), round(near(a, n), 9)))
    key = lambda t: (t[0] is not None, t[0] or 0, t[1:])
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=key) == sorted(want, key=key)


def test_rows(spark, documents, small):
    rows = documents.where("doc_id is not null")
    check(rows.collect(), S.fingerprint_with_edits(rows).collect())
    check(documents.collect(), S.fingerprint_with_edits(documents).collect())
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(docs.collect(), S.fingerprint_with_edits(docs).collect())
    assert S.fingerprint_with_edits(documents.limit(0)).count() == 0
    one = documents.where("doc_id = 4")
    check(one.collect(), S.fingerprint_with_edits(one).collect())


def test_near_duplicates_are_all_found(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    cut = docs.withColumn("text", F.expr("substring(text, 1, cast(length(text) * 0.93 as int))")).withColumn("doc_id", F.col("doc_id") + 100_000)
    both = docs.unionByName(cut)
    pairs, members = S.near_duplicates(both, 0.8)
    sets = {r.doc_id: marks(r.text or "") for r in both.collect()}
    classes = {}
    for i, m in sets.items():
        classes.setdefault(tuple(m), []).append(i)
    ids = {m: min(v) for m, v in classes.items()}
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: ids[tuple(m)] for i, m in sets.items()}
    want = {tuple(sorted((ids[a], ids[b]))) for a, b in itertools.combinations(classes, 2) if near(a, b) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 20
    parts = S.components(both, 0.8).collect()
    assert len(parts) == both.count() and all(r.component_id <= r.doc_id for r in parts)
