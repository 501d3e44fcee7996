import pytest

from cuelight.functions.porter import stem
from cuelight.operators import retrieval as R


@pytest.mark.parametrize(
    "word, want",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
        ("sing", "sing"), ("conflated", "conflat"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"),
        ("sky", "sky"), ("relational", "relat"), ("rational", "ration"), ("triplicate", "triplic"), ("formative", "form"), ("goodness", "good"),
        ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("at", "at"),
    ],
)
def test_published_examples(word, want):
    assert stem(word) == want


def test_phrases_and_stems(spark):
    lines = spark.createDataFrame(
        [(1, "He’s running; he's run."), (2, "s he runs"), (3, "nothing here"), (4, ""), (5, "he is, s")], "line_id long, text string"
    )
    terms = spark.createDataFrame([("he's",), ("runs",), ("absent",)], "term string")
    got = sorted(map(tuple, R.phrase_hits(lines, terms).select("term", "line_id", "tf").collect()))
    assert got == [("he's", 1, 2), ("runs", 1, 2), ("runs", 2, 1)]


def test_query_by_stems_is_the_loop(spark, small):
    """The ten best lines of every request, scored one by one with stems and phrases."""
    import re
    from collections import Counter, defaultdict
    from math import log

    from cuelight.functions import text as T
    from cuelight.plans import scene_queries, views

    tokens = lambda t: [stem(T.without_accents(w)) for w in re.findall(r"[^\W_]+", t.lower())]
    lines = {r.line_id: tokens(r.text) for r in views.lines(spark, small).collect()}
    mean = sum(map(len, lines.values())) / len(lines)
    at = defaultdict(list)
    for i, words in lines.items():
        for k, w in enumerate(words):
            at[w].append((i, k))

    def hits(term):
        parts = tokens(term)
        return Counter(i for i, k in at[parts[0]] if lines[i][k : k + len(parts)] == parts)

    want = set()
    for q in views.requests(spark, small).collect():
        asked = Counter(t for t in re.findall(r"(?:[^\W_]|')+", q.text.lower()) if len(t) > 1 and t not in T.STOP_WORDS)
        scores = Counter()
        for term, times in asked.items():
            found = hits(term)
            if found and log(len(lines) / len(found)) >= 3.0:
                idf = max(log((len(lines) - len(found) + 0.5) / (len(found) + 0.5)), 1e-6)
                for i, tf in found.items():
                    scores[i] += times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(lines[i]) / mean))
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:10]
        want |= {(q.query_id, i, round(scores[i], 5), k + 1) for k, i in enumerate(best)}
    got = {(r.query_id, r.line_id, round(r.bm25, 5), r["rank"]) for r in scene_queries.stemmed_bm25(spark, small).collect()}
    assert len(want) > 40 and {w[:2] for w in want} == {g[:2] for g in got}
    assert {w[:2] + w[3:] for w in want} == {g[:2] + g[3:] for g in got}


def test_postings_are_gathered_without_a_shuffle(spark, monkeypatch):
    """Places, lengths and stems are those of a loop, in batches of a few tokens too, and no token is shuffled."""
    import re

    from cuelight.operators import postings as P

    texts = {1: "The dîner, the dinners: the end", 2: "", 3: None, 4: "to be or not to be " * 40, 5: "...", 6: "ends"}
    lines = spark.createDataFrame([(f"v{k % 2}" if k != 6 else None, k, t) for k, t in texts.items()], "video_id string, line_id long, text string").coalesce(1)
    monkeypatch.setattr(P, "GATHERED", 5)
    made = P.build_postings(lines)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = []
    for k, t in texts.items():
        words = re.findall(r"[^\W_]+", (t or "").lower())
        want += [(f"v{k % 2}" if k != 6 else None, k, len(words), w, stem(P.T.without_accents(w)), [i for i, x in enumerate(words) if x == w]) for w in set(words)]
    rows = sorted((tuple(r) for r in made.collect()), key=str)
    assert rows == sorted(want, key=str)
    assert sorted((r[:4] + r[5:] for r in rows), key=str) == sorted((tuple(r) for r in P.build_postings(lines, stemmed=False).collect()), key=str)


def test_lines_without_vectors_are_as_many_and_not_shuffled(spark, small, tmp_path):
    """A vector that is there three times makes three lines, as the join with vectors does."""
    from cuelight.plans import views

    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 30")
    docs.unionByName(docs.where("doc_id = 7").selectExpr("cast(null as long) as doc_id", *docs.columns[1:])).write.parquet(str(tmp_path / "documents.parquet"))
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 9")
    vectors.unionByName(vectors.where("vec_id = 3")).unionByName(vectors.where("vec_id = 3")).write.parquet(str(tmp_path / "embeddings.parquet"))
    got, want = views.spoken(spark, str(tmp_path)), views.lines(spark, str(tmp_path)).drop("embedding")
    rows = lambda df: sorted(str(tuple(r)) for r in df.select(want.columns).collect())
    assert rows(got) == rows(want) and got.where("line_id = 3").count() == 3


def test_postings_of_common_terms_are_not_gathered(spark, monkeypatch):
    """What can't be rare is known from counts; a stem whose tokens are each rare enough, and a phrase, are counted whole."""
    lines = spark.createDataFrame([(k, "v", "the common " + ("cat" if k < 12 else "cats" if k < 24 else f"dog's w{k}")) for k in range(40)], "line_id long, video_id string, text string")
    queries = spark.createDataFrame([(1, "common cats dog's w30")], "query_id long, text string")
    asked, whole = [], R.hits_of

    def hits(postings, terms, stemmed=True):
        asked.append(sorted(r.term for r in terms.select("term").distinct().collect()))
        return whole(postings, terms, stemmed)

    monkeypatch.setattr(R, "hits_of", hits)
    got = {r.line_id for r in R.bm25(lines, queries, None, 1.0).collect()}
    assert asked == [["cats", "dog's", "w30"]]
    # 24 of 40 lines have the stem of cats and 16 the phrase, so only w30 is rare
    assert got == {30}


def test_tokens_meet_stems_before_any_shuffle(spark):
    """Hits alone are shuffled where few terms are asked for, not the tokens of the lines."""
    lines = spark.createDataFrame([(1, "it runs")], "line_id long, text string")
    found = R.phrase_hits(lines, spark.createDataFrame([("run",)], "term string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(token" not in plan and "hashpartitioning(stem" not in plan and "BroadcastHashJoin" in plan
    assert [r.line_id for r in found.collect()] == [1]


def test_words_meet_terms_before_any_shuffle(spark):
    """Without stems too: what is shuffled are hits."""
    lines = spark.createDataFrame([(1, "it runs, it runs")], "line_id long, text string")
    found = R.postings_of(lines, spark.createDataFrame([("runs",)], "term string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [(r.line_id, r.tf) for r in found.collect()] == [(1, 2)]
