"""SpotSigs fingerprints (Theobald, Siddharth and Paepcke, 2008).

A signature starts at an anchor, a common word followed by a content word, and
is the chain of that anchor and the next three content words. A fingerprint is
the set of a text's signatures, each as twelve hexadecimal digits of its MD5,
sorted and written one after another. Two fingerprints are as alike as the
Jaccard similarity of the sets.

All of it is native expressions. ``near_duplicates`` finds all pairs at or over
a similarity: fingerprints are partitioned by set length, since sets whose
lengths differ by more than the similarity allows can't be that alike; each
emits the rarest of its signatures that any partner must share one of, meets
partners there, and pairs are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.llm.common import stable, text_of
from cuelight.llm.graph import connected_components

#: Common words of English, German, French and Spanish (fixed values).
ANCHORS = (
    "the of and to a in is that it was for on are with as be at by this have from or "
    "der die das und zu den mit von für auf ist im dem nicht ein eine als auch "
    "le la les de des et un une en du que qui est pour dans par sur pas au avec "
    "el los y una por con para se no es lo del las su"
).split()
CHAIN = 3
DIGITS = 12


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The distinct signatures of a text, sorted.

    Chains at the end of a text are as long as what is left. A text without any
    anchor has one signature, of all its words: alike only to itself.
    """
    is_anchor = lambda w: w.isin(ANCHORS)

    def cut(words: Column) -> Column:
        content = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ~is_anchor(F.get(words, i)))
        content = F.when(F.size(words) > 0, content).otherwise(F.array().cast("array<int>"))

        def chains(at: Column) -> Column:
            starts = F.filter(
                F.transform(at, lambda i, k: F.struct(i.alias("i"), k.alias("k"))),
                lambda s: (s["i"] > 0) & is_anchor(F.get(words, s["i"] - 1)),
            )
            return F.transform(
                starts,
                lambda s: F.concat_ws(" ", F.get(words, s["i"] - 1), *[F.get(words, F.get(at, s["k"] + j)) for j in range(chain)]),
            )

        spots = _let(content, chains)
        return _let(spots, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.concat(F.lit("all "), F.array_join(words, " ")))))

    found = _let(_words(text), cut)
    return F.array_sort(F.array_distinct(F.transform(found, lambda s: F.substring(F.md5(F.encode(s, "UTF-8")), 1, DIGITS))))


def jaccard(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Similarity of two sets, which are never empty.

    Where the lengths alone keep it under ``at_least`` it is null, and the sets
    aren't compared.
    """
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(bound >= at_least, shared / (F.size(a) + F.size(b) - shared))


def fingerprint_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, and their likeness.

    The edit replaces the last half of a text by the beginning of the text of
    the next document, by ascending key, and the last document's next is the
    first. To meet their next, documents are dealt to ranges of the key between
    quantiles over all rows; the first document of a range is also sent to the
    range before. So the texts are shuffled once, and no task sees all of an
    order. A null text is empty. Null keys come first; rows with equal keys
    follow each other by the hash of their text. Other columns are not read.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("body"))
    ranges = 1
    while ranges < 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) or ranges < 256:
        ranges *= 2
    steps = [k / ranges for k in range(1, ranges)]
    edges = read.agg(
        F.min("doc_id").alias("first"),
        F.percentile_approx("doc_id", steps, 20 * ranges).alias("edges"),
        F.count_if(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    if edges["first"] is None:  # no keys: the rows are one range, by hash
        bounds = [0]
    else:
        bounds = sorted({edges["first"], *edges["edges"]})
    first = None if edges["nulls"] else bounds[0]
    last = len(bounds) - 1
    known = F.array(*[F.lit(b).cast("long") for b in bounds])
    halves = []
    while (1 << len(halves)) <= last:
        halves.append(1 << len(halves))
    deal = F.aggregate(
        F.array(*[F.lit(h) for h in reversed(halves)]) if halves else F.array().cast("array<int>"),
        F.lit(0),
        lambda at, h: F.when((at + h <= last) & (F.get(F.col("known"), at + h) <= F.col("doc_id")), at + h).otherwise(at),
    )
    # the first row of a range also stands after the range before; that of all rows after the last
    ghost = F.when(F.get(F.col("known"), F.col("range")) == F.col("doc_id"), F.pmod(F.col("range") - 1, F.lit(last + 1)))
    if first is None:
        ghost = F.when(F.col("doc_id").isNull(), F.lit(last)).when(F.col("range") > 0, ghost)
    dealt = (
        read.withColumn("known", known)
        .withColumn("range", F.coalesce(deal, F.lit(0)))
        .withColumn("ghost", ghost)
        .drop("known")
        .withColumn(
            "copy",
            F.explode(
                F.array_compact(
                    F.array(
                        F.struct(F.col("range").alias("to"), F.lit(0).alias("kind")),
                        F.when(
                            F.col("ghost").isNotNull(),
                            F.struct(F.col("ghost").alias("to"), F.lit(1).alias("kind")),
                        ),
                    )
                )
            ),
        )
        .select("doc_id", "body", F.col("copy.to").alias("range"), F.col("copy.kind").alias("kind"))
    )
    marked = dealt.repartition("range").withColumn("marks", signatures(F.col("body")))
    order = Window.partitionBy("range").orderBy("kind", F.asc_nulls_first("doc_id"), F.xxhash64("body"))
    size = F.char_length("body")
    half = F.floor(size / 2).cast("int")
    following = (
        marked.withColumn("next_body", F.lead("body").over(order))
        .withColumn("next_marks", F.lead("marks").over(order))
        .where("kind = 0")
        .select(
            "doc_id",
            size.cast("long").alias("n_chars"),
            F.concat(F.substring("body", F.lit(1), size - half), F.substring("next_body", F.lit(1), half)).alias("edited"),
            "marks",
            "next_marks",
        )
        .withColumn("edited_marks", signatures(F.col("edited")))
    )
    return following.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.array_join("marks", "").alias("fingerprint"),
        F.array_join("edited_marks", "").alias("edited_fingerprint"),
        jaccard(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        jaccard(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, at_least: float = 0.8, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: pairs of classes at or over ``at_least``, and the class of every row.

    A class is the rows of one fingerprint; its id is their smallest key.
    ``pairs(a, b, similarity)`` has each pair of classes once, a < b. The
    signatures a class emits are the rarest, by the number of classes that have
    them: as many as leave too few for a partner that shares none of them. Each
    partition of set lengths is joined to itself and the next ones alone, by
    length blocks that grow by the similarity.
    """
    marked = docs.select(F.col(key).alias("doc_id"), signatures(text_of(text)).alias("marks")).withColumn(
        "print", F.sha2(F.array_join("marks", ""), 256)
    )
    marked = stable(marked.select("doc_id", "print", "marks"))
    classes = stable(marked.groupBy("print").agg(F.min("doc_id").alias("class_id"), F.first("marks").alias("marks")))
    members = marked.select("doc_id", "print").join(classes.select("print", "class_id"), "print").select("doc_id", "class_id")
    spots = classes.select("class_id", F.size("marks").alias("n"), F.explode("marks").alias("mark"))
    common = spots.groupBy("mark").agg(F.count("*").alias("df"))
    emitted = F.col("n") - F.ceil(F.col("n") * at_least) + 1
    ranked = (
        spots.join(common, "mark")
        .groupBy("class_id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "mark"))).alias("by_rarity"))
        .select("class_id", "n", F.explode(F.slice("by_rarity", F.lit(1), emitted.cast("int"))).alias("spot"))
        .select("class_id", "n", F.col("spot.mark").alias("mark"), F.floor(F.log("n") / F.log(F.lit(1 / at_least))).alias("block"))
    )
    right = ranked.select(
        F.col("class_id").alias("b"), F.col("n").alias("nb"), "mark", F.explode(F.array("block", F.col("block") - 1)).alias("block")
    )
    met = (
        ranked.withColumnRenamed("class_id", "a")
        .join(right, ["mark", "block"])
        .where("(n < nb or (n = nb and a < b)) and a <> b")
        .where(F.col("n") >= F.col("nb") * at_least)
        .select("a", "b")
        .distinct()
    )
    sets = classes.select("class_id", "marks")
    pairs = (
        met.join(sets.toDF("a", "marks_a"), "a")
        .join(sets.toDF("b", "marks_b"), "b")
        .withColumn("similarity", jaccard(F.col("marks_a"), F.col("marks_b"), at_least))
        .where(F.col("similarity") >= at_least)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    )
    return pairs, members


def components(docs: DataFrame, at_least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, component_id`` of every row, over the links of :func:`near_duplicates`."""
    pairs, members = near_duplicates(docs, at_least, key, text)
    parts = connected_components(pairs.select("a", "b")).withColumnRenamed("node", "class_id")
    return members.join(parts, "class_id", "left").select("doc_id", F.coalesce("component", "class_id").alias("component_id"))
