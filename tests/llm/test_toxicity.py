import re
import zlib

import numpy as np
import pytest

from cuelight.llm import toxicity as T


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    calm = [f"{a}{b}" for a in ("ran", "the", "sol", "mir", "pel", "tun") for b in ("ta", "ren", "wick", "os", "ling")]
    rude = ["blorgface", "snarkfool", "grubwit"]
    rows, labels = [], []
    for i in range(1200):
        words = list(rng.choice(calm, rng.integers(15, 120)))
        toxic = i % 6 == 0
        if toxic:
            for k in rng.choice(len(words), max(2, len(words) // 15), replace=False):
                words[k] = str(rng.choice(rude))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out(spark, corpus):
    docs, labels = corpus
    model = T.fit(docs, labels)
    got = T.score_documents(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)
    calm = "rantan therren solwick miros pelling tunta " * 5
    unseen = T.Scorer(model)
    assert unseen.score(calm + "blorgfaces blorgfacce snarkfoool") > 0.5 > unseen.score(calm + "brightly window")


def test_catch_on_a_given_table(spark):
    """Rows of fold 0 of sf0.1: most toxic ones are caught, others left alone."""
    from cuelight.llm.queries import op8_toxicity

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = op8_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    caught = [r.predicted for r in held if r.toxic == 1]
    others = [r.predicted for r in held if r.toxic == 0]
    assert sum(caught) >= 0.78 * len(caught) and sum(others) <= 0.04 * len(others)


def test_the_cut_is_the_best():
    rng = np.random.default_rng(1)
    for _ in range(20):
        odds, labels = rng.normal(size=60).round(1), (rng.random(60) < 0.4).astype(int)
        if 0 < labels.sum() < 60:
            f1 = lambda c: (lambda tp, fp: 2 * tp / (tp + fp + 0.2))(0.2 * (odds[labels == 1] >= c).mean(), 0.8 * (odds[labels == 0] >= c).mean())
            assert f1(T.best_cut(odds, labels, 0.2)) >= max(map(f1, [*odds, odds.max() + 1])) - T.SLACK - 1e-9


def test_held_out_labels_are_not_used(spark, corpus):
    docs, labels = corpus
    twisted = labels.selectExpr("doc_id", "if(pmod(crc32(cast(doc_id as string)), 5) = 0, 1 - toxic, toxic) as toxic")
    a, b = T.fit(docs, labels), T.fit(docs, twisted)
    assert np.array_equal(a.buckets, b.buckets) and a.bias == b.bias


def test_rows(spark, documents, corpus):
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    assert T.fit(documents, labels) is None
    got = T.score_documents(documents, None).collect()
    assert len(got) == documents.count() and all(r.score == 0.0 and r.predicted == 0 for r in got)
    model = T.fit(*corpus)
    got = T.score_documents(documents, model).collect()
    assert len(got) == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert T.score_documents(documents.limit(0), model).count() == 0
    assert T.drop_toxic(documents, model).columns == documents.columns


def brute_score(model, text):
    """A text's log-odds from the definition: the mean over words, weighted by log counts, of the means over n-grams."""
    found = re.findall(r"\w+(?:['’*@$!-]\w+)*", text.lower())
    total, whole = 0.0, T.PADDING
    for w in sorted(set(found)):
        marked, weight = f"<{w}>", np.log1p(found.count(w))
        grams = {marked} | {marked[a : a + n] for n in T.GRAMS for a in range(len(marked)) if a + n <= len(marked)}
        own = {zlib.crc32(g.encode()) % T.BUCKETS for g in grams}
        total += weight * np.mean([model.buckets[b] for b in own])
        whole += weight
    return 1 / (1 + np.exp(-(model.bias + total / whole)))


def test_scores_by_brute_force(spark, corpus):
    docs, labels = corpus
    model = T.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.limit(60).collect()} | {5000: "", 5001: "Blorg-face! blorgface; née", 5002: "a b " * 50}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in T.score_documents(df, model).collect():
        assert abs(r.score - brute_score(model, texts[r.doc_id])) < 1e-6


def test_training_is_gradient_descent_on_the_bags():
    """The trained log-odds of two classes with a bucket each, and of a bucket of neither."""
    bags = [(np.array([k % 2], np.uint16), np.array([1.0], np.float32)) for k in range(400)]
    model = T.train(bags, np.array([k % 2 for k in range(400)]), 0.5)
    assert model.buckets[1] + model.bias > 2 and model.buckets[0] + model.bias < -2 and abs(model.buckets[7]) < 1.0


def test_long_words_and_the_bound_of_the_sample(spark, corpus, monkeypatch):
    docs, labels = corpus
    model = T.fit(docs, labels)
    scorer = T.Scorer(model)
    assert 0 <= scorer.score("x" * 300_000 + " " + "".join(map(chr, range(0x4E00, 0x4E00 + 20_000)))) <= 1 and not scorer.known
    assert len(T.subwords("".join(map(chr, range(0x4E00, 0x9000))) * 4)) <= T.BUCKETS
    assert T.fit(docs.unionByName(docs), labels).bias == model.bias  # rows that repeat count once
    monkeypatch.setattr(T, "SAMPLE_BUCKETS", 40_000)
    assert T.fit(docs, labels) is not None
    monkeypatch.setattr(T, "SAMPLE_BUCKETS", 2)
    assert T.fit(docs, labels) is None


def test_the_driver_gets_the_model_alone(spark, corpus, monkeypatch):
    """A task trains on the bags of the sample; none of them come to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    def never(*_):
        raise AssertionError("in the driver")

    monkeypatch.setattr(DataFrame, "toPandas", never)
    model = T.fit(*corpus)
    assert model.buckets.shape == (T.BUCKETS,) and model.buckets.dtype == np.float32
