"""The prefix trie of conversations, from their sorted order.

Distinct sequences of turns are sorted; each block of the order is a range of
sequences. With the length of the prefix that each sequence shares with the one
before (its LCP), the nodes of the trie are the intervals of the Cartesian tree
over these lengths: an interval of depth d reaches from the nearest smaller
value on its left to the nearest smaller on its right. A stack finds both within a block; it
has one entry for each depth, so that equal values are one node, and depths that
no LCP names are expanded. What a stack leaves open at a border of its block is
a fragment of an interval. The fragment of depth d belongs to the one that was opened in the last
block before whose least LCP is under d, which the minima of the blocks tell.
All figures of a node are sums and minima over fragments, so they are merged by
one aggregation, and the work doesn't grow with the depth times the blocks.

A conversation is one row: its turns are 16 bytes of a digest and a length each.
Texts never leave the scan. Equal conversations are one row from the first
aggregation on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.llm.common import small_text_batches, stable, text_of

#: Conversations are listed in chunks of 2 ** CHUNK ids.
CHUNK = 12
#: Rows of a batch that a task returns.
ROWS = 20_000
FRAGMENT = (
    "block int, depth int, at int, left boolean, right boolean, whole boolean, n long, first long, parent_at int, parent long, "
    "children long, leaves long, saved long, ends string"
)


def turn_lists(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns`` with ``turns`` an array of ``(code, size)`` by turn, null first.

    Rows of one turn follow each other by role and by the MD5 of the text, and
    repeated rows are turns of their own. A null role or text is empty; rows
    without a conversation are left out. Other columns are not read.
    """
    said = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        text_of(role).alias("role"),
        F.unhex(F.md5(text_of(text))).alias("digest"),
        F.octet_length(text_of(text)).alias("size"),
    )
    lists = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "size"))).alias("turns"))
    code = lambda t: F.unhex(F.md5(F.concat(t["digest"], t["role"].cast("binary"))))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(code(t).alias("code"), t["size"].alias("size"))).alias("turns"))


def with_shared_heads(lists: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """``lists`` with the first h turns of each conversation c taken from c - c % every.

    h is the CRC-32 of c in decimal, modulo ``most``. What the other conversation
    hasn't is left out, and so are the first h turns of c itself; it may be left
    with no turn at all.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = lists.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    joined = lists.select("conv_id", "turns", base.alias("base"), h.alias("h")).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    shared = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(shared, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _shared(a: Column, b: Column) -> Column:
    """Length of the common prefix of two different arrays; -1 where there is no other."""
    unlike = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)) - 1
    return F.coalesce(unlike.cast("int"), F.lit(-1))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the chunks of ids of each class, which come one after another and sorted; only one digest is open."""
    like, running = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch["like"], batch["ids"]):
            if key != like:
                if like is not None:
                    done.append((like, running.hexdigest()))
                like, running = key, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["like", "ends"])
    if like is not None:
        yield pd.DataFrame([(like, running.hexdigest())], columns=["like", "ends"])


def _classes(seqs: DataFrame) -> DataFrame:
    """Distinct sequences: ``codes, sizes, n, first, ends`` with the digest of the ids that have it."""
    key = F.md5(F.array_join(F.transform("codes", lambda c: F.hex(c)), ""))
    seqs = stable(seqs.select("conv_id", "codes", "sizes", key.alias("like")))
    ids = F.array_sort(F.collect_list("conv_id"))
    chunks = stable(
        seqs.groupBy("like", F.shiftright("conv_id", CHUNK).alias("chunk"))
        .agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), ids.alias("ids"))
        .withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))
    )
    told = chunks.groupBy("like").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.count("*").alias("parts"), F.min("ids").alias("ids"))
    several = told.where("parts > 1").select("like")
    # written first: else the planner takes the join's partitioning for this one, and may then turn that join into another
    listed = stable(chunks.join(several, "like", "left_semi").select("like", "chunk", "ids"))
    digests = listed.repartition("like").sortWithinPartitions("like", "chunk").mapInPandas(_digests, "like string, ends string")
    told = told.join(digests, "like", "left").select("first", "n", F.coalesce("ends", F.sha2("ids", 256)).alias("ends"))
    return seqs.select(F.col("conv_id").alias("first"), "codes", "sizes").join(told, "first")


class _Block:
    """The stack over one block. An entry is the open node of its depth: where it began, and what it has gathered."""

    AT, SIZE, N, FIRST, CHILDREN, LEAVES, SAVED, ENDS, INNER, WAITING = range(10)

    def __init__(self, block: int, before: int, after: int):
        self.block, self.before, self.after = block, before, after
        self.stack: list[list] = []
        self.last: list = []
        self.at = 0
        self.out: list[tuple] = []

    def add(self, codes, sizes, n: int, first: int, ends: str) -> None:
        lcp = self.before
        if self.at:
            lcp, most = 0, min(len(codes), len(self.last))
            while lcp < most and codes[lcp] == self.last[lcp]:
                lcp += 1
            while len(self.stack) > lcp + 1:
                self.close(False)
        for depth in range(len(self.stack), len(codes) + 1):
            self.stack.append([self.at, int(sizes[depth - 1]) if depth else 0, 0, None, 0, 0, 0, None, False, []])
        top = self.stack[-1]
        top[self.N] += n
        top[self.FIRST] = first if top[self.FIRST] is None else min(top[self.FIRST], first)
        top[self.ENDS] = ends
        self.last = codes
        self.at += 1

    def close(self, at_end: bool) -> None:
        depth = len(self.stack) - 1
        node = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        left, right = node[self.AT] == 0 and depth <= self.before, at_end and depth <= self.after
        if not node[self.INNER] and not right:
            node[self.LEAVES] += 1
        node[self.SAVED] += (node[self.N] - (not left)) * node[self.SIZE]
        if above is not None:
            above[self.N] += node[self.N]
            above[self.FIRST] = node[self.FIRST] if above[self.FIRST] is None else min(above[self.FIRST], node[self.FIRST])
            above[self.CHILDREN] += not left
            above[self.LEAVES] += node[self.LEAVES]
            above[self.SAVED] += node[self.SAVED]
            above[self.INNER] = True
        whole = at_end and node[self.AT] == 0
        row = (
            self.block, depth, node[self.AT], left, right, whole, node[self.N], node[self.FIRST], above[self.AT] if above else None,
            None, node[self.CHILDREN], node[self.LEAVES], node[self.SAVED], node[self.ENDS],
        )
        known = None if left or right else node[self.FIRST]
        self.out += [(*r[:9], known, *r[10:]) for r in node[self.WAITING]]
        # a node whose parent may end in this block waits for the parent's smallest id
        if above is None or left or right:
            self.out.append(row)
        else:
            above[self.WAITING].append(row)

    def end(self) -> None:
        while self.stack:
            self.close(True)


def _fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in FRAGMENT.split(", ")]

    def rows(out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=names)
        return made.astype({"parent_at": "Int32", "parent": "Int64"})

    now = None
    for batch in batches:
        for block, before, after, codes, sizes, n, first, ends in zip(*(batch[c] for c in ("block", "before", "after", "codes", "sizes", "n", "first", "ends"))):
            if now is None or now.block != block:
                if now is not None:
                    now.end()
                    yield rows(now.out)
                now = _Block(int(block), int(before), int(after))
            now.add(codes, sizes, int(n), int(first), ends)
            if len(now.out) >= ROWS:
                yield rows(now.out)
                now.out = []
    if now is not None:
        now.end()
        yield rows(now.out)


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """The nodes of the trie over ``seqs(conv_id, turns)``, one row for each.

    ``conv_id`` (a distinct number a row) is the smallest member of a node, ``depth`` its
    number of turns, from the root at 0 on; ``parent_conv_id`` is that of its
    parent (null at the root), ``n_convs`` its members, ``n_children`` its
    children, ``n_leaves`` the childless nodes of its subtree, ``saved_tokens`` the
    bytes that the members of its subtree's nodes share, each counted once less
    than it is used, and ``ends_sha256`` the digest of the ids that end in it. Conversations
    without turns are members of the root alone. An empty table has no node.
    """
    spark = seqs.sparkSession
    small_text_batches(spark)
    read = seqs.select("conv_id", F.col("turns.code").alias("codes"), F.col("turns.size").alias("sizes"))
    blocks = stable(_classes(read).repartitionByRange("codes").sortWithinPartitions("codes").withColumn("block", F.spark_partition_id()))
    order = Window.orderBy("block")
    # a row for each block, so their number is that of the partitions
    ends = blocks.groupBy("block").agg(F.min("codes").alias("head"), F.max("codes").alias("tail"))
    edges = ends.select(
        "block", _shared(F.lag("tail").over(order), F.col("head")).alias("before"), _shared(F.col("tail"), F.lead("head").over(order)).alias("after")
    )
    wanted = ["block", "before", "after", "codes", "sizes", "n", "first", "ends"]
    found = stable(blocks.join(F.broadcast(edges), "block").select(*wanted).mapInPandas(_fragments, FRAGMENT))
    least = found.groupBy("block").agg(F.coalesce(F.max(F.expr("if(left and whole, depth, null)")), F.lit(-1)).alias("least"))
    minima = least.agg(F.collect_list(F.struct("block", "least")).alias("minima"))
    opened = F.array_max(F.transform(F.filter("minima", lambda m: (m["block"] < F.col("block")) & (m["least"] < F.col("depth"))), lambda m: m["block"]))
    cut = found.where("left or right")
    owned = stable(
        cut.where("left").crossJoin(F.broadcast(minima)).withColumn("own", opened).drop("minima").unionByName(cut.where("not left").withColumn("own", F.col("block")))
    )
    whole = stable(
        owned.groupBy("depth", "own").agg(
            *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
            F.min("first").alias("first"),
            F.max("ends").alias("ends"),
            F.max(F.expr("if(left, null, parent_at)")).alias("parent_at"),
        )
    )
    names = owned.select("block", "depth", "at", "own").join(whole.select("depth", "own", "first"), ["depth", "own"])
    parents = names.select(F.col("block").alias("p_block"), (F.col("depth") + 1).alias("p_depth"), F.col("at").alias("p_at"), F.col("first").alias("p_first"))
    inner = found.where("not left and not right")
    figures = ["depth", "n", "first", "children", "leaves", "saved", "ends"]
    ask = inner.where("parent is null").select("block", "parent_at", *figures).unionByName(whole.select(F.col("own").alias("block"), "parent_at", *figures))
    met = ask.join(parents, [ask["block"] == parents["p_block"], ask["depth"] == parents["p_depth"], ask["parent_at"] == parents["p_at"]], "left")
    nodes = inner.where("parent is not null").select("parent", *figures).unionByName(met.select(F.col("p_first").alias("parent"), *figures))
    return nodes.select(
        F.col("first").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
