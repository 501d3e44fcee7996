"""Toxicity by subword-bag embeddings (after Joulin et al. and Bojanowski et al., 2017).

A word is the mean of the vectors of its character n-grams and of itself, a text
the weighted mean of its words, and a linear softmax on top tells the classes.
The vectors and the softmax are trained jointly in numpy, on a bounded sample of
the labelled rows of the training folds (``SAMPLE``). A misspelling that was
never seen shares most n-grams with the word it stands for, and so its vector.

Training text becomes sparse bags on the executors, and one task trains on those
of the sample; the driver gets the model. Scoring needs one number per bucket, the difference of its class
scores, so the model that is sent out is one array of fixed size, and a text's
score is the weighted mean of the scores of its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import log1p
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelight.llm.common import small_text_batches, stable, text_of

WORD = re.compile(r"\w+(?:['’*@$!-]\w+)*")
BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
#: Labelled documents that a class gives to the training sample, and buckets of all their bags, at most (under 100 MB).
SAMPLE, SAMPLE_BUCKETS = {1: 1500, 0: 2500}, 8_000_000
FOLDS = 5
BATCH = 64
#: What a bucket's squared gradients start from: more keeps rarely seen buckets nearer to zero.
SMOOTH = 1e-4
#: Words without a vector that every text has besides its own: few words decide less than many.
PADDING = 20
#: Rows of a class that setting the bias takes at least, and what a cut may lose of the best F1.
HELD, SLACK = 40, 0.02


class Model(NamedTuple):
    buckets: np.ndarray  #: what a bucket adds to the log-odds of a text of that bucket alone
    bias: float


def subwords(word: str) -> list[int]:
    """Buckets of the n-grams of a word between its borders, and of the word itself: at most ``BUCKETS`` numbers."""
    marked = f"<{word}>"
    found = {zlib.crc32(marked.encode("utf-8")) % BUCKETS}
    for n in GRAMS:
        found.update(zlib.crc32(marked[k : k + n].encode("utf-8")) % BUCKETS for k in range(len(marked) - n + 1))
    return sorted(found)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def weighted(text: str) -> tuple[dict[str, float], float]:
    """Words of a text with their weights, and the sum of all weights.

    A word weighs the logarithm of one more than its count, so a text that
    repeats an ordinary word is no more than a text that has it.
    """
    weights = {w: log1p(n) for w, n in Counter(words(text)).items()}
    return weights, sum(weights.values()) + PADDING


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights, which sum to nearly one for a long text."""
    found, total = weighted(text)
    weights: dict[int, float] = {}
    for w, own_weight in found.items():
        own = subwords(w)
        for b in own:
            weights[b] = weights.get(b, 0.0) + own_weight / (len(own) * total)
    return np.fromiter(weights, np.uint16, len(weights)), np.fromiter(weights.values(), np.float32, len(weights))


def train(
    bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, dim: int = 4, updates: int = 720, rate: float = 0.5, seed: int = 7
) -> Model:
    """Vectors and softmax by Adagrad on shuffled batches.

    Vectors start near zero, so a bucket that was hardly seen hardly counts. The
    bias is moved from the sample's class shares to ``prior`` at the end.
    """
    rng = np.random.default_rng(seed)
    epochs = max(1, -(-updates * BATCH // len(bags)))
    scale = np.float32(100.0)  # a text is the mean of many words; the scale lets few of them count at small vectors
    table = rng.normal(0, 1e-3, (BUCKETS, dim)).astype(np.float32)
    soft = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares = [np.full((BUCKETS, 1), SMOOTH, np.float32), np.full_like(soft, 0.1), np.full_like(bias, 0.1)]
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        lr = np.float32(rate * (1 - epoch / epochs))
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            ids = np.concatenate([bags[i][0] for i in at])
            w = np.concatenate([bags[i][1] for i in at]) * scale
            own = np.repeat(np.arange(len(at)), [len(bags[i][0]) for i in at])
            texts = np.stack([np.bincount(own, w * table[ids, d], len(at)) for d in range(dim)], 1).astype(np.float32)
            logits = texts @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), labels[at]] -= 1
            p /= len(at)
            into = (p @ soft.T).astype(np.float32)
            g = np.stack([np.bincount(ids, w * into[own, d], BUCKETS) for d in range(dim)], 1).astype(np.float32)
            squares[0] += (g * g).mean(1, keepdims=True)
            table -= lr * g / np.sqrt(squares[0])
            for j, (q, h) in enumerate(((soft, texts.T @ p), (bias, p.sum(0))), 1):
                squares[j] += h * h
                q -= lr * h / np.sqrt(squares[j])
    shift = np.log(prior / (1 - prior)) - np.log(labels.mean() / (1 - labels.mean()))
    return Model((table @ (soft[:, 1] - soft[:, 0])) * scale, float(bias[1] - bias[0] + shift))


def best_cut(odds: np.ndarray, labels: np.ndarray, prior: float) -> float:
    """Where to cut log-odds so that precision and recall of label 1 are best, by their F1 at class shares of ``prior``.

    Of cuts that are as good but for :data:`SLACK` it is the one that most rows stay under.
    """
    order = np.argsort(-odds, kind="stable")
    hit = np.where(labels[order] == 1, prior / max((labels == 1).sum(), 1), 0.0).cumsum()
    miss = np.where(labels[order] == 0, (1 - prior) / max((labels == 0).sum(), 1), 0.0).cumsum()
    last = np.append(odds[order[1:]] != odds[order[:-1]], True)  # of equal ones; they are on one side of a cut
    score = np.where(last, 2 * hit / (hit + miss + prior), -1.0)
    k = int(np.argmax(score >= score.max() - SLACK))
    below = odds[order[k + 1]] if k + 1 < len(order) else odds[order[k]]
    return float(odds[order[k]] + below) / 2


def train_and_cut(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float) -> Model:
    """A model of all bags; its bias is set by one of four fifths of them, at whose best cut of the other fifth a score is one half.

    With fewer than :data:`HELD` of a class in that fifth the bias stays as it was trained.
    """
    held = np.arange(len(bags)) % 5 == 0
    model = train(bags, labels, prior)
    if min((labels[held] == 1).sum(), (labels[held] == 0).sum()) < HELD:
        return model
    part = train([b for b, h in zip(bags, held) if not h], labels[~held], prior)
    odds = np.array([part.bias + float(part.buckets[i] @ w) for (i, w), h in zip(bags, held) if h])
    return model._replace(bias=model.bias - best_cut(odds, labels[held], prior))


class Scorer:
    """Scores of texts under a model, with the scores of the words seen so far; long words aren't kept."""

    KEPT, LONG = 500_000, 40

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def word(self, word: str) -> float:
        own = subwords(word)
        return float(self.model.buckets[own].sum()) / len(own)

    def score(self, text: str) -> float:
        (found, whole), known = weighted(text), self.known
        total = 0.0
        for w, weight in found.items():
            s = known.get(w)
            if s is None:
                s = self.word(w)
                if len(w) <= self.LONG:
                    if len(known) >= self.KEPT:
                        known.clear()
                    known[w] = s
            total += weight * s
        odds = self.model.bias + total / whole
        return 1.0 / (1.0 + float(np.exp(-min(max(odds, -60.0), 60.0))))


def fold(key: str):
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """A model from the labelled rows outside fold 0; None where a class has none.

    Of each class, the rows with the smallest hash of the key are taken, at most
    ``SAMPLE``, as long as the bags of those before them have at most
    ``SAMPLE_BUCKETS`` entries between them; their whole texts count. Of rows that
    repeat a key one counts, whichever is least.
    """
    small_text_batches(docs.sparkSession)
    known = (
        labels.where(fold(key) != 0)
        .groupBy(F.col(key).alias("doc_id"))
        .agg(F.max(F.col(label)).alias("label"))
        .where("label in (0, 1) and doc_id is not null")
    )
    shares = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return None
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in SAMPLE.items()]
    chosen = parts[0].unionByName(parts[1])

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [bag(t) for t in b["text"]]
            yield pd.DataFrame(
                {"doc_id": b["doc_id"], "label": b["label"], "n": [len(i) for i, _ in made], "ids": [i.tobytes() for i, _ in made], "weights": [w.tobytes() for _, w in made]}
            )

    rows = stable(
        docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # SAMPLE rows at most
        .dropDuplicates(["doc_id", "text"])
        .mapInPandas(bags, f"doc_id {dict(docs.dtypes)[key]}, label int, n int, ids binary, weights binary")
    )
    told = rows.select("doc_id", "label", "n", F.md5(F.concat("ids", "weights")).alias("print"))
    told = told.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(F.struct("print", "n")).alias("m"))
    upto = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("upto", F.sum("m.n").over(upto)).where(F.col("upto") <= SAMPLE_BUCKETS // 2).select("doc_id", F.col("m.print").alias("print"))
    rows = (
        rows.withColumn("print", F.md5(F.concat("ids", "weights")))
        .join(told, ["doc_id", "print"], "left_semi")
        .dropDuplicates(["doc_id"])
        .select("doc_id", "label", "ids", "weights")
    )
    prior = shares[1] / (shares[0] + shares[1])

    def trained(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [p for p in parts if len(p)]
        if not found:
            return
        sample = pd.concat(found).sort_values("doc_id", ignore_index=True)
        found.clear()
        if sample["label"].nunique() < 2:
            return
        made = [(np.frombuffer(i, np.uint16), np.frombuffer(w, np.float32)) for i, w in zip(sample.pop("ids"), sample.pop("weights"))]
        model = train_and_cut(made, sample["label"].to_numpy(), prior)
        yield pd.DataFrame({"kind": [model.buckets.dtype.str], "buckets": [model.buckets.tobytes()], "bias": [model.bias]})

    # the sample is bounded, and trained on where one task is; the driver gets the model
    told = rows.repartition(1).mapInPandas(trained, "kind string, buckets binary, bias double").collect()
    return Model(np.frombuffer(told[0].buckets, told[0].kind), told[0].bias) if told else None


def score_column(spark: SparkSession, model: Model | None, text: str) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for batch in texts:
            yield pd.Series([scorer.score(t) if scorer else 0.0 for t in batch], dtype=float)

    small_text_batches(spark)
    return score(text_of(text))


def score_documents(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    A null text is empty; a text without words gets the score of the bias. Without
    a model every score is 0. Repeated rows give repeated rows; other columns are
    not read, and nothing is shuffled.
    """
    score = score_column(docs.sparkSession, model, text)
    return docs.select(F.col(key).alias("doc_id"), (fold(key) == 0).alias("held_out"), score.alias("score")).select(
        "*", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with a score under 0.5, all columns."""
    return docs.where(score_column(docs.sparkSession, model, text) < 0.5)
