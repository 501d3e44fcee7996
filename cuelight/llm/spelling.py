"""Spelling variants by a rare-first prefix filter on positional bigrams.

One edit destroys at most two bigrams of a word. In one order of all bigrams, rare
ones first, two words at distance one therefore share one of the three rarest of
each, at places that differ by one at most. An edit also leaves one side
of the shared bigram as it is: the word up to it, at the same place, or
the word from it on. So words meet by the bigram together with that side, which is the
limit on places made exact. Where the side is short, one half of the
other side is the same too, as one edit can't be in both, and joins the key. What
meets is verified by its edit distance; keys decide what meets, never what is
found.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import stable, text_of

#: Letters of words, as a character class; with upper case in, 116 characters, and 90 once A-Z is lowered.
LETTERS = "A-Za-zÀ-ÿ"
LEAST, TIMES, RATIO, NOISE = 7, 2, 10, 31
#: Rarest bigrams that a word meets others by: one edit destroys two.
RAREST = 3
#: A side of so many code points is a key alone.
STRONG = 6


def noisy_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, noise: int = NOISE) -> DataFrame:
    """``word, n``: runs of letters of all texts, with A-Z lowered, that occur ``times`` or more.

    Let h be the CRC-32 of ``<key>:<run>``. Where ``noise`` divides h, the run
    loses its code point h modulo its length. Shorter words than ``least`` are
    left out. A null text has no run, and a null key is written as nothing;
    repeated rows count again. Other columns are not read.
    """
    found = F.regexp_extract_all(text_of(text), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    runs = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    told = runs.select("run", h.alias("h"), F.char_length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    words = told.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """In how many places of ``words`` each bigram of two letters stands: at most 116 * 116 of them."""
    gram = F.substring("word", F.col("at"), F.lit(2))
    places = words.where("char_length(word) > 1").select("word", F.explode(F.expr("sequence(1, char_length(word) - 1)")).alias("at"))
    return {r.gram: r.n for r in places.select(gram.alias("gram")).where(F.col("gram").rlike(f"\\A[{LETTERS}]{{2}}\\z")).groupBy("gram").agg(F.count("*").alias("n")).collect()}


def keys_of(word: str, counts: dict[str, int]) -> set[tuple[str, int]]:
    """What a word meets others by, and whether its edited side is the longer one (1) of those that may meet there.

    Bigrams with other characters than letters aren't counted and are the rarest.
    """
    grams = sorted((counts.get(word[i : i + 2], 0), word[i : i + 2], i) for i in range(len(word) - 1))
    out = set()
    for _, _, p in grams[:RAREST]:
        for side, kept, rest in (("<", word[: p + 2], word[p + 2 :]), (">", word[p:], word[:p])):
            if len(kept) >= STRONG:
                out.add((f"{side}{kept}", 0))
                continue
            n = len(rest)
            for m in {n, max(n - 1, 0)}:  # of the shorter of two words that meet
                head = rest[: m // 2]
                tail = rest[n - (m - m // 2) :]
                out.add((f"{side}{m}{side}{kept}[{head}", n - m))
                out.add((f"{side}{m}{side}{kept}]{tail}", n - m))
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b, a_n, b_n`` of all words ``a < b`` of ``words(word, n)`` at an edit distance of one.

    Words are distinct and have two or more code points.
    """
    counts = bigram_counts(words)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (xxhash.xxh64_intdigest(key.encode()) - (1 << 63), longer, word, n)
                for word, n in zip(batch["word"], batch["n"].tolist())
                for key, longer in keys_of(word, counts)
            ]
            yield pd.DataFrame(out, columns=["key", "longer", "word", "n"]).astype({"key": "int64", "longer": "int32", "n": "int64"})

    keys = words.mapInPandas(rows, "key long, longer int, word string, n long")
    a, b = keys.toDF("key", "a_longer", "a", "a_n"), keys.toDF("key", "b_longer", "b", "b_n")
    met = a.join(b, "key").where("a < b and a_longer + b_longer < 2 and abs(char_length(a) - char_length(b)) < 2 and levenshtein(a, b, 1) = 1")
    return met.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def follow(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``, a forest: the last form on the way from each word.

    Ways are halved in each round, and end as a form has several times the
    occurrences of its word.
    """
    now = stable(forms.select("word", F.col("form").alias("root")))
    while not now.join(forms.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stable(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return now


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words(word, n)``, distinct words and their counts.

    The form is the near word of largest count, of equal ones the first by code
    points, if it has at least ``ratio`` times the word's count, and null otherwise. An
    empty table gives no rows.
    """
    words = stable(words.select("word", "n"))
    pairs = stable(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    told = stable(
        words.join(near, "word", "left")
        .withColumn("takes", -F.col("best.less") >= ratio * F.col("n"))
        .select("word", F.expr("if(takes, best.other, null)").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.expr("if(takes, -best.less, null)").alias("form_n"))
    )
    roots = follow(told.where("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
