"""Secret scans: known forms, and windows of high Shannon entropy.

Candidates of the entropy scan are runs of 20 or more characters of the
base64 alphabets that hold a letter and a digit. A window of 20 characters
slides over a candidate. What it carries are the counts c of its characters and
the sum of c * log2(c) over them: when a character leaves and one enters, only
those two counts change, and the sum by two table steps. The entropy follows from the
sum; whether a window is hot depends on the character class of its candidate
(hexadecimal, one letter case, or mixed), whose alphabets bound the entropy
differently. Hot windows that touch are one span. Candidates that the allow-list
covers whole are suppressed: UUIDs, paths and names of words, placeholders. A
candidate that holds a placeholder beside a run of 20 other characters is scanned.

All of it is native expressions in the scan's own tasks; nothing is shuffled.
Entropies are sums of whole numbers (c * log2(c) in millionths), so any engine
gets the same spans.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import text_of

#: The base forms: kind, pattern, group whose length counts, least length. Where a
#: form is one run of characters, its least length stands in the pattern: a shorter
#: run has no part that is long enough, so the matches are those of ``+``.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ENTROPY = "entropy"
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The characters of a candidate.
ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_=-"
#: Matches whose places are summed in one fold.
BLOCK = 64
#: c * log2(c) in millionths for c = 0 to WINDOW.
TERMS = [0] + [round(c * math.log2(c) * 1_000_000) for c in range(1, WINDOW + 1)]
#: Least entropy of a hot window, in bits a character, for each character class.
THRESHOLDS = {"hex": 2.9, "single": 3.6, "mixed": 3.7}
#: Letters of a syllable: a word of a path or name has a vowel in every five letters, or is of three at most.
_C, _V = "[b-df-hj-np-tv-xz]", "[aeiouy]"
_LOWER = f"(?:(?:{_C}{{0,4}}{_V}{{1,3}}){{1,6}}{_C}{{0,4}}|{_C}{{1,3}})"
#: A word of a path or name: such letters of one case or in humps, few digits after them; or a short number.
WORD = f"(?:[A-Z]?{_LOWER}(?:[A-Z]{_LOWER}){{0,3}}[0-9]{{0,4}}|[A-Z]{{1,12}}[0-9]{{0,4}}|[0-9]{{1,8}})"
#: Letters alone: each part between separators of one case, or in humps of three letters and more.
PART = "(?:[A-Z]?[a-z]+|[A-Z]+|[a-z]*(?:[A-Z][a-z]{2,}){1,8})"
#: Candidates that are no secrets although their entropy is high: UUIDs; those of
#: which every window overlaps a placeholder (what lies before, between and after is
#: shorter than a window); those without a letter, or of letters as words have them;
#: paths and names of words.
ALLOWED = (
    r"\A[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z",
    r"(?i)\A.{0,19}(?:(?:example|placeholder|changeme|sample|dummy).{0,19}|x{6,}(?:[^x].{0,18})?){1,3}\z",
    rf"\A[0-9=+/_-]*\z|\A[=+/_-]*{PART}(?:[=+/_-]+{PART})*[=+/_-]*\z",
    rf"\A(?:/+{WORD}(?:[/_-]+{WORD})+|{WORD}(?:[/_-]+{WORD}){{2,}})[/_-]*\z",
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: what a lambda names as an expression is computed at each of its steps."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(items: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """``array<array<struct<at, item>>>``: each item with what ``join`` makes of the values before it, from 0 on, in blocks.

    In two levels, in each block of ``BLOCK`` items and over blocks, as an array
    that grows is copied at each step.
    """

    def walk(of: Column, each: Callable[[Column], Column], start: Column) -> Column:
        return F.aggregate(
            of,
            F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: F.struct(join(acc["at"], each(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, x: join(acc, value(x))))
        return F.zip_with(
            blocks,
            walk(sums, lambda x: x, F.lit(0)),
            lambda block, base: F.zip_with(block, walk(block, value, base), lambda x, at: F.struct(at.alias("at"), x.alias("item"))),
        )

    cut = lambda every: F.transform(F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), F.lit(BLOCK)), lambda k: F.slice(every, k, BLOCK))
    return _let(items, lambda every: _let(cut(every), placed))


def _found(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Matches as structs; a match starts after the texts between the earlier ones and those themselves."""
    wholes, sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    matches = F.arrays_zip(wholes.alias("w"), sizes.alias("s"), between.alias("b"))
    length = lambda m: F.char_length(m["b"]) + F.char_length(m["w"])
    # the last text between has no match after it
    placed = F.flatten(_before(_let(matches, lambda m: F.filter(m, lambda x: x["w"].isNotNull())), length, lambda a, x: a + x))
    spans = F.transform(
        placed,
        lambda p: F.struct(
            (p["at"] + F.char_length(p["item"]["b"])).alias("start"),
            F.lit(rank).alias("rank"),
            (p["at"] + length(p["item"])).alias("end"),
            F.lit(kind).alias("kind"),
            F.char_length(p["item"]["s"]).alias("size"),
            p["item"]["w"].alias("match"),
        ),
    )
    return F.when(text.rlike(pattern), F.filter(spans, lambda m: m["size"] >= least))


EMPTY = "array<struct<start:int,rank:int,end:int,kind:string,size:int,match:string>>"


def _or_none(found: Column) -> Column:
    return F.coalesce(found, F.array().cast(EMPTY))


def _term(count: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TERMS)), count + 1)


def hot_ranges(candidate: Column, threshold: Column) -> Column:
    """``array<struct<lo, hi>>``: offsets of hot windows that touch, within one candidate.

    ``threshold`` is the greatest sum of c * log2(c) of a hot window. The fold
    carries the counts of the window's characters, by their place in ``ALPHABET``,
    the sum, and the range that is open; a range joins the others when it ends.
    """
    ranges = "array<struct<lo:int,hi:int>>"
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    # each character with the one that leaves when it enters, 0 for none
    steps = F.zip_with(codes, F.concat(F.array_repeat(F.lit(0), WINDOW), codes), lambda comes, goes: F.struct(comes.alias("comes"), goes.alias("goes")))
    steps = F.filter(steps, lambda x: x["comes"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        comes, goes = x["comes"], x["goes"]
        gone = F.when(goes > 0, F.get(acc["counts"], goes)).otherwise(0)
        there = F.get(acc["counts"], comes) - F.when(comes == goes, 1).otherwise(0)
        counts = F.transform(acc["counts"], lambda n, i: n + F.when(i == comes, 1).otherwise(0) - F.when((i == goes) & (goes > 0), 1).otherwise(0))
        total = acc["sum"] - F.when(goes > 0, _term(gone) - _term(gone - 1)).otherwise(0) + _term(there + 1) - _term(there)
        at = acc["at"] + 1
        hot = (at >= WINDOW) & (total <= threshold)
        touches = acc["hi"] >= at - WINDOW
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            at.alias("at"),
            F.when(hot & ~touches, at - WINDOW).otherwise(acc["lo"]).alias("lo"),
            F.when(hot, at).otherwise(acc["hi"]).alias("hi"),
            F.when(hot & ~touches & (acc["hi"] >= 0), F.concat(acc["done"], F.array(F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi"))))).otherwise(acc["done"]).alias("done"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
        F.lit(0).alias("sum"),
        F.lit(0).alias("at"),
        F.lit(-1).alias("lo"),
        F.lit(-1).alias("hi"),
        F.array().cast(ranges).alias("done"),
    )
    last = lambda acc: F.when(acc["hi"] >= 0, F.concat(acc["done"], F.array(F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi"))))).otherwise(acc["done"])
    return F.aggregate(steps, start, step, last)


def _limit(candidate: Column) -> Column:
    """The greatest sum of a hot window, by the candidate's character class."""
    most = {k: math.floor((math.log2(WINDOW) - bits) * WINDOW * 1_000_000) for k, bits in THRESHOLDS.items()}
    return (
        F.when(candidate.rlike(r"\A([0-9a-f]+|[0-9A-F]+)\z"), most["hex"])
        .when(candidate.rlike(r"\A([^A-Z]+|[^a-z]+)\z"), most["single"])
        .otherwise(most["mixed"])
    )


def _hot(text: Column) -> Column:
    """Hot spans of a text, before those inside base spans are taken out."""
    candidates = _or_none(_found(text, CANDIDATE, 0, WINDOW, ENTROPY, len(KINDS)))
    open_ones = F.filter(candidates, lambda m: ~m["match"].rlike("|".join(f"(?:{p})" for p in ALLOWED)))
    return F.flatten(
        F.transform(
            open_ones,
            lambda m: F.transform(
                hot_ranges(m["match"], _limit(m["match"])),
                lambda r: F.struct(
                    (m["start"] + r["lo"]).alias("start"),
                    m["rank"].alias("rank"),
                    (m["start"] + r["hi"]).alias("end"),
                    m["kind"].alias("kind"),
                    (r["hi"] - r["lo"]).alias("size"),
                    F.substring(m["match"], r["lo"] + 1, r["hi"] - r["lo"]).alias("match"),
                ),
            ),
        )
    )


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ","
    )


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, hot`` for every row: arrays of spans in code points, end exclusive.

    A null text is empty and has no span. Base spans of different kinds may
    overlap and all stay; an entropy span inside a base span is left out.
    Repeated rows give repeated rows; other columns are not read.
    """
    body = F.col("body")
    read = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("body"))
    found = read.select(
        "doc_id",
        *[_or_none(_found(body, p, g, n, k, i)).alias(f"in_{k}") for i, (k, p, g, n) in enumerate(KINDS)],
        F.when(body.rlike(CANDIDATE), _hot(body)).otherwise(F.array().cast(EMPTY)).alias("windows"),
    )
    base = F.array_sort(F.concat(*[F.col(f"in_{k}") for k, *_ in KINDS]))
    # by start, base spans first of equals: a window is inside one if those before it reach as far
    reached = F.flatten(_before(F.array_sort(F.concat("base", "windows")), lambda m: F.when(m["rank"] < len(KINDS), m["end"]).otherwise(0), lambda a, x: F.greatest(a, x)))
    outside = F.transform(F.filter(reached, lambda p: (p["item"]["rank"] == len(KINDS)) & (p["at"] < p["item"]["end"])), lambda p: p["item"])
    return found.select(
        "doc_id", *[F.size(f"in_{k}").cast("long").alias(f"n_{k}") for k, *_ in KINDS], base.alias("base"), "windows"
    ).select("*", F.when(F.size("windows") > 0, outside).otherwise(F.col("windows")).alias("hot")).drop("windows")


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest of :func:`find_secrets`: counts, hash of the base spans, all spans."""
    return find_secrets(docs, key, text).select(
        "doc_id",
        *[f"n_{k}" for k, *_ in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "hot"))).alias("spans"),
    )


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by ``mark``; touching spans by one mark.

    All columns stay. Null texts stay null.
    """
    body = F.col(text)
    spans = [_or_none(_found(body, p, g, n, k, i)) for i, (k, p, g, n) in enumerate(KINDS)]
    spans.append(F.coalesce(F.when(body.rlike(CANDIDATE), _hot(body)), F.array().cast(EMPTY)))
    every = F.array_sort(F.concat(*spans))

    def told(block: Column) -> Column:
        """The text from where the spans before a block end to where those in it do; places count from there."""
        base = block[0]["at"]
        until = F.aggregate(block, base, lambda acc, p: F.greatest(acc, p["item"]["end"]))
        part = lambda own, p: F.when(
            p["item"]["start"] >= p["at"], F.concat(F.substring(own, p["at"] - base + 1, p["item"]["start"] - p["at"]), F.lit(mark))
        ).otherwise(F.lit(""))
        return _let(F.substring(body, base + 1, until - base), lambda own: F.array_join(F.transform(block, lambda p: part(own, p)), ""))

    # the spans are sought once for what is before the last of them and what is after it
    merged = _let(
        _let(
            every,
            lambda found: F.struct(
                _before(found, lambda m: m["end"], lambda a, x: F.greatest(a, x)).alias("blocks"),
                F.aggregate(found, F.lit(0), lambda acc, m: F.greatest(acc, m["end"])).alias("last"),
            ),
        ),
        lambda s: F.concat(F.array_join(F.transform(F.filter(s["blocks"], lambda b: F.size(b) > 0), told), ""), F.substring(body, s["last"] + 1, F.char_length(body))),
    )
    return docs.withColumn(text, merged)
