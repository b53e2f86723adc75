"""The prefix trie of conversations, as balanced parentheses shard by shard.

A node is the sequence of a conversation's first d turns, named by its depth and two hashes that are
running xors of position-salted turn hashes, so that names come from a prefix scan and no
conversation is ever a group of one task.  Each distinct conversation becomes a path, cut behind the
first node it shares with no other; paths in order of their names go through the trie depth first.
A shard (an Arrow batch of paths) writes its part as balanced parentheses: range minima and maxima
of the excess find where a node closes, ranks of ``()`` pairs in between count its leaves, and
differences of cumulative arrays give its members and savings.  Nodes on a shard's first and last
path may go on in other shards: these spines are merged by name and summed up along themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.functions.blocks import running
from corpusprep.functions.durable import stored

BLOCK = 64  # parentheses whose least and greatest excess are kept
NAME = ["depth", "k1", "k2"]
NODE = (
    "depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, conv_id bigint, parent_conv_id bigint,"
    " n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, bytes bigint, spine boolean"
)


# ---------------------------------------------------------------- balanced parentheses
class Parentheses:
    """A tree as parentheses (true opens) with a tree of range minima and maxima of the excess."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        blocks = -(-len(opens) // BLOCK)
        self.width = 1 << max(blocks - 1, 0).bit_length()  # leaves of the tree of blocks
        filled = np.concatenate([self.excess, np.full(blocks * BLOCK - len(opens), self.excess[-1])]).reshape(-1, BLOCK)
        self.low = np.full(2 * self.width, np.iinfo(np.int64).max)
        self.high = np.full(2 * self.width, np.iinfo(np.int64).min)
        self.low[self.width : self.width + blocks], self.high[self.width : self.width + blocks] = filled.min(1), filled.max(1)
        for i in range(self.width - 1, 0, -1):
            self.low[i] = min(self.low[2 * i], self.low[2 * i + 1])
            self.high[i] = max(self.high[2 * i], self.high[2 * i + 1])

    def _scan(self, found: np.ndarray, who: np.ndarray, at: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Looks from ``at`` to the end of its block; returns those of ``who`` that found nothing."""
        missed = [who[:0]]
        while len(who):
            hit = self.excess[at] == goal
            found[who[hit]] = at[hit]
            at = at + 1
            ended = ~hit & ((at % BLOCK == 0) | (at == len(self.excess)))
            missed.append(who[ended])
            go = ~hit & ~ended
            who, at, goal = who[go], at[go], goal[go]
        return np.concatenate(missed)

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one at ``at``: the next place with an excess
        one lower, in its own block or else in the next block whose range reaches that low."""
        goal = self.excess[at] - 1
        found = np.full(len(at), -1)
        inner = (at + 1) % BLOCK != 0
        missed = self._scan(found, np.flatnonzero(inner), at[inner] + 1, goal[inner])
        who = np.concatenate([np.flatnonzero(~inner), missed])
        if len(who):
            node, target = at[who] // BLOCK + self.width, goal[who]
            climbing = np.ones(len(who), bool)
            while climbing.any():  # up to a right neighbour whose range holds the excess
                i = node[climbing]
                ready = (i % 2 == 0) & (self.low[np.minimum(i + 1, len(self.low) - 1)] <= target[climbing])
                node[climbing] = np.where(ready, i + 1, i // 2)
                climbing[np.flatnonzero(climbing)[ready]] = False
            while (inside := node < self.width).any():  # down to the first such block
                i = 2 * node[inside]
                node[inside] = np.where((self.low[i] <= target[inside]) & (self.high[i] >= target[inside]), i, i + 1)
            self._scan(found, who, (node - self.width) * BLOCK, target)
        return found


def _nodes(paths: pa.RecordBatch) -> pa.RecordBatch:
    """The nodes of some successive paths; those on the first and last path hold what this shard
    has of them, the others are done."""
    lists = [paths.column(n) for n in ("k1s", "k2s", "sizes")]
    length = np.diff(lists[0].offsets.to_numpy())
    k1, k2, size = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    conv, copies, tail = (paths.column(n).to_numpy(zero_copy_only=False) for n in ("conv_id", "copies", "tail"))
    n = len(length)
    start = np.cumsum(length) - length
    row = np.repeat(np.arange(n), length)
    depth = np.arange(len(row)) - np.repeat(start, length) + 1
    # Shared depth with the path before: names are hashes of prefixes, so equal ones are a prefix.
    known = (row > 0) & (depth <= length[row - 1])
    before = np.where(known, start[row - 1] + depth - 1, 0)
    known &= (k1 == k1[before]) & (k2 == k2[before])
    shared = np.bincount(row[known], minlength=n)
    new = depth > shared[row]
    # Nodes in preorder, the root first; entries not new take the node of the path before.
    number = np.cumsum(new)
    order = np.lexsort((row, depth))
    held = np.maximum.accumulate(np.where(new[order], np.arange(len(order)), 0))
    of = np.empty(len(order), np.int64)
    of[order] = number[order[held]]
    entry = np.flatnonzero(new)
    parent = np.concatenate([[-1], np.where(depth[entry] > 1, of[entry - 1], 0)])
    # Parentheses: a path closes what the one before does not share with it and opens its new nodes.
    closed = np.cumsum(np.concatenate([[0], length[:-1] - shared[1:]])) if n else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.arange(len(entry)) + 1 + closed[row[entry]]])
    opens = np.zeros(2 * len(at), bool)
    opens[at] = True
    tree = Parentheses(opens)
    close = tree.find_close(at)
    # What each node has of its own, as cumulative arrays over the parentheses.
    last = np.where(length > 0, of[np.maximum(start + length - 1, 0)] if len(of) else 0, 0)
    is_tail = np.concatenate([[False], tail[row[entry]] & (depth[entry] == length[row[entry]])])
    spine = np.zeros(len(at), bool)
    spine[of[(row == 0) | (row == n - 1)]] = True
    spine[0] = True
    spine &= ~is_tail

    def under(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[close + 1] - sums[at]

    def at_nodes(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(opens), np.int64)
        out[at] = values
        return out

    members = under(at_nodes(np.bincount(last, copies, len(at)).astype(np.int64)))
    passing = under(at_nodes(np.bincount(last, minlength=len(at))))
    size_of = np.concatenate([[0], size[entry]])
    pairs = np.zeros(len(opens), np.int64)
    pairs[at] = (close == at + 1) & ~spine
    leaves = under(pairs)
    saved = under(at_nodes(np.where(spine, 0, (members - 1) * size_of)))
    first = np.concatenate([[0], row[entry]])
    padded = np.append(conv, np.iinfo(np.int64).max)
    least = np.minimum.reduceat(padded, np.stack([first, first + passing], 1).reshape(-1))[::2]
    children = np.bincount(parent[1:][~spine[1:]], minlength=len(at))
    name1, name2 = np.concatenate([[0], k1[entry]]), np.concatenate([[0], k2[entry]])
    deep = np.concatenate([[0], depth[entry]])
    up = np.maximum(parent, 0)
    root = np.arange(len(at)) == 0
    columns = [
        deep, name1, name2, name1[up], name2[up], least,
        pa.array(least[up], mask=root | spine | spine[up]),
        members, children, leaves, saved, size_of, spine,
    ]
    made = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=_names(NODE))
    return made.filter(pa.array(~is_tail))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(",")]


def _spine_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged spine nodes, all of them, completed along the spines: counts of spine children, and
    leaves and savings of their own added to every ancestor."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held)
    col = {c: table.column(c).to_numpy().copy() for c in table.column_names if c != "parent_conv_id"}
    index = {k: i for i, k in enumerate(zip(col["depth"].tolist(), col["k1"].tolist(), col["k2"].tolist()))}
    up = np.array([index.get(k, -1) for k in zip((col["depth"] - 1).tolist(), col["p1"].tolist(), col["p2"].tolist())])
    inner = up >= 0
    np.add.at(col["n_children"], up[inner], 1)
    leaf = (col["n_children"] == 0).astype(np.int64)
    own = (col["n_convs"] - 1) * col["bytes"]
    order = np.argsort(-col["depth"], kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(col["depth"][order])) + 1):  # the deepest first
        higher = some[inner[some]]
        np.add.at(leaf, up[higher], leaf[higher])
        np.add.at(own, up[higher], own[higher])
    col["n_leaves"] += leaf
    col["saved_tokens"] += own
    col["parent_conv_id"] = pa.array(col["conv_id"][up], mask=~inner)
    yield pa.RecordBatch.from_arrays(
        [c if isinstance(c := col[n], pa.Array) else pa.array(c) for n in _names(NODE)], names=_names(NODE)
    )


# ---------------------------------------------------------------- who ends where
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted ``depth, k1, k2, conv_id``: the ids of each node in a batch as one text."""
    for batch in batches:
        names = np.stack([batch.column(c).to_numpy() for c in NAME], 1)
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1), len(ids)]
        texts = [",".join(map(str, ids[s:e].tolist())) for s, e in zip(cuts, cuts[1:])]
        heads = cuts[:-1]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(names[heads, i]) for i in range(3)], pa.array(ids[heads]), pa.array(texts)], names=[*NAME, "first", "ids"]
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted ``depth, k1, k2, first, ids``: one SHA-256 of each node's texts joined by commas."""
    name, digest, out = None, None, []
    for batch in batches:
        for *key, text in zip(*[batch.column(c).to_pylist() for c in (*NAME, "ids")]):
            if key != name:
                if name is not None:
                    out.append((*name, digest.hexdigest()))
                name, digest = key, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip((*NAME, "ends_sha256"), r)) for r in out])
            out = []
    if name is not None:
        yield pa.RecordBatch.from_pylist([dict(zip((*NAME, "ends_sha256"), (*name, digest.hexdigest())))])


def _ends(finals: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` of the nodes at which conversations end.  Ids are sorted and
    joined in ranges; a node's digest then reads its joined ranges one after the other."""
    order = ["k1", "k2", "depth"]
    chunks = (
        finals.select(*NAME, "conv_id")
        .repartitionByRange(*order, "conv_id")
        .sortWithinPartitions(*order, "conv_id")
        .mapInArrow(_chunks, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string")
    )
    return (
        chunks.repartition(*order)
        .sortWithinPartitions(*order, "first")
        .mapInArrow(_digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")
    )


# ---------------------------------------------------------------- conversations
def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, a, b, bytes``: turns numbered from 1 by turn (null first, ties by role and
    text), as two hashes of role and text and the UTF-8 size of the text."""
    turns = conversations.filter(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("bigint").alias("conv_id"),
        F.coalesce(conversations["turn"].cast("bigint"), F.lit(-(1 << 63))).alias("t"),
        conversations["turn"].isNotNull().alias("numbered"),
        F.coalesce(conversations["role"], F.lit("")).alias("role"),
        F.coalesce(conversations["text"], F.lit("")).alias("text"),
    )
    each = turns.groupBy("conv_id", "t").agg(F.count(F.lit(1)).alias("n"))
    before = running(each, ["conv_id"], "t", {"before": ("sum", F.col("n"))}, exclusive=True).select("conv_id", "t", "before")
    ties = Window.partitionBy("conv_id", "t").orderBy("numbered", "role", "text")
    return turns.join(before, ["conv_id", "t"]).select(
        "conv_id",
        (F.col("before") + F.row_number().over(ties)).alias("pos"),
        F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit(1), "role", "text").alias("b"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group: ``conv_id, pos, a, b, bytes`` of the
    rebuilt turns, and all ``conv_id``.

    Conversation c takes the first h turns of c - c % group, h = crc32(c as decimal) % ``most``, and
    its own turns after its first h.
    """
    turns = stored(numbered_turns(conversations))
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    asked = sizes.select(
        "conv_id", (c - c % group).alias("base"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h")
    )
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plans = stored(
        asked.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n")
    )
    heads = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base").join(plans, "base").filter(F.col("pos") <= F.col("h"))
    own = turns.join(plans, "conv_id").filter(F.col("pos") > F.col("h")).withColumn("pos", F.col("taken") + F.col("pos") - F.col("h"))
    columns = ["conv_id", "pos", "a", "b", "bytes"]
    return heads.select(*columns).unionByName(own.select(*columns)), plans.select("conv_id")


def trie(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """The prefix trie of conversations given as ``conv_id, pos, a, b, bytes`` (``pos`` from 1
    without gaps) and all their ids: a row for each node.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (each node's members but one times
    the size of its last turn, summed over the subtree), ``ends_sha256`` (of the ids that end there).
    Conversations without turns are members of the root alone; no conversations, no nodes.
    """
    salted = lambda *first: F.xxhash64(*first, "pos", "a", "b")
    named = running(
        turns,
        ["conv_id"],
        "pos",
        {"k1": ("xor", salted()), "k2": ("xor", salted(F.lit(1))), "through": ("sum", F.col("bytes"))},
    )
    rows = stored(named.select("conv_id", F.col("pos").alias("depth"), "k1", "k2", "bytes", "through"))
    lengths = rows.groupBy("conv_id").agg(F.max_by(F.struct(*NAME, "through"), "depth").alias("e"))
    empty = {"depth": F.lit(0), "k1": F.lit(0), "k2": F.lit(0), "through": F.lit(0)}
    finals = stored(
        conv_ids.join(lengths, "conv_id", "left").select(
            "conv_id", *[F.coalesce(F.col(f"e.{n}"), v.cast("bigint")).alias(n) for n, v in empty.items()]
        )
    )
    # One path for all conversations that are equal.
    paths = stored(
        finals.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"), F.first("through").alias("total"))
    )
    ends = paths.select("conv_id", "copies", "total", F.col("depth").alias("length"))
    steps = rows.join(paths.select("conv_id"), "conv_id", "left_semi")
    alone = steps.groupBy(*NAME).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).filter("n = 1")
    cut = stored(alone.groupBy("conv_id").agg(F.min("depth").alias("cut")))
    held = ends.join(cut, "conv_id", "left").withColumn("cut", F.coalesce("cut", "length"))
    marked = stored(steps.join(held, "conv_id"))
    shards = _shards(marked.filter("depth <= cut"), ends)
    nodes = stored(shards.mapInArrow(lambda batches: (_nodes(b) for b in batches if b.num_rows), NODE))
    partial = {n: F.sum for n in ("n_convs", "n_children", "n_leaves", "saved_tokens")} | {"conv_id": F.min}
    kept = {n: F.first for n in ("p1", "p2", "bytes", "spine", "parent_conv_id")}
    merged = nodes.filter("spine").groupBy(*NAME).agg(*[f(n).alias(n) for n, f in (partial | kept).items()])
    spines = stored(merged.select(*_names(NODE)).repartition(1).mapInArrow(_spine_sums, NODE))
    above = spines.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_up"))
    others = nodes.filter("not spine")
    within = others.filter("parent_conv_id is not null")
    hanging = others.filter("parent_conv_id is null").join(above, ["depth", "p1", "p2"]).withColumn("parent_conv_id", F.col("_up"))
    # Behind the cut a path is alone with its copies.
    tails = marked.filter("depth > cut").select(
        *NAME,
        "conv_id",
        F.col("conv_id").alias("parent_conv_id"),
        F.col("copies").alias("n_convs"),
        (F.col("depth") < F.col("length")).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("copies") - 1) * (F.col("total") - F.col("through") + F.col("bytes"))).alias("saved_tokens"),
    )
    columns = tails.columns
    every = tails
    for part in (spines, within, hanging):
        every = every.unionByName(part.select(*columns))
    nobody = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(_ends(finals), NAME, "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", nobody).alias("ends_sha256"),
    )


def _shards(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """Paths in order of their names: ``k1s, k2s, sizes`` of the nodes up to the cut, then, where
    turns follow it, one more entry that stands for them."""
    listed = F.sort_array(F.collect_list(F.struct("depth", "k1", "k2", "bytes")))
    lists = steps.groupBy("conv_id").agg(listed.alias("s"), F.max("cut").alias("cut"), F.max_by("through", "depth").alias("through"))
    whole = ends.join(lists, "conv_id", "left")
    tail = F.coalesce(F.col("cut") < F.col("length"), F.lit(False))

    def values(field: str, last: Column) -> Column:
        own = F.coalesce(F.transform("s", lambda s: s[field]), F.array().cast("array<bigint>"))
        return F.concat(own, F.when(tail, F.array(last)).otherwise(F.array().cast("array<bigint>")))

    named = whole.select(
        F.array_join(F.transform("s", lambda s: F.lpad(F.hex(s["k1"]), 16, "0")), "").alias("name"),
        values("k1", F.xxhash64(F.lit("tail"), "conv_id")).alias("k1s"),
        values("k2", F.col("conv_id")).alias("k2s"),
        values("bytes", F.col("total") - F.col("through")).alias("sizes"),
        "conv_id",
        "copies",
        tail.alias("tail"),
    )
    ordered = named.withColumn("name", F.coalesce("name", F.lit("")))
    return ordered.repartitionByRange("name").sortWithinPartitions("name").drop("name")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie (see ``trie``) of the rebuilt conversations (see ``rebuilt``) of ``conversations``.

    Null roles and texts are empty, turns without a number come first, ties go by role and text, so
    repeated rows are repeated turns.  Rows without ``conv_id`` belong to no conversation and take
    no part.  Other columns, whatever their names, play no part.
    """
    return trie(*rebuilt(conversations))
