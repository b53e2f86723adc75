"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(branch | class, history) * ... down to a single word or,
for rare words, a spelling group.  Every factor is a softmax over hashed features of the node and of
the three words before: the last one, the last two, and the second and third last alone (skips).
Only the rare word within its spelling group comes from smoothed counts.  Counts are taken
over all training texts by Spark.  Texts are then cut into words once more and stored as item numbers,
two bytes a token; the softmax is trained in rounds, each over all positions of another part of the
training texts, whose tasks send their weight changes to be averaged; texts are scored in numpy
batches, and counts of rare words meet them in a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.durable import stored
from corpusprep.llm.words import chunks, mix, words_of

END = np.uint64(0x5E4D0FD0C5E4D0FD)  # stands for the end of a text among word hashes
FREQUENT = 1 << 18  # words whose counts travel with the model
OWN = (8192, 16384)  # of them, words that are items themselves: an eighth of all, within these
GROUPS = 4096  # items of all other words, by first and last letters
CONTEXT = 64  # most frequent items, for the classes
CLASSES = 32  # also the branches of a node below
ALONE = 96  # an item with more than this part of all tokens is a class of its own
FEATURE_BITS = (14, 16)  # a feature row for 128 training tokens, within these
TEXT = 1 << 18  # bytes of text cut into words at a time
ROUNDS = 4
BATCH = 1024  # tokens of a gradient step
SCORED = 4096  # tokens scored at a time
RATE = 0.8
LAYERS = 16  # rows of a run that are added one after the other
BOUND = 12.0  # greatest size of a weight: four of them leave a softmax far from overflow without its maximum
TASK_TOKENS = 1 << 23  # tokens of a learning task where there are more of them than cores


@dataclass
class Vocabulary:
    """Frequent words (sorted hashes), their counts, and their item or -1; ``own`` words are items."""

    hashes: np.ndarray
    counts: np.ndarray
    item: np.ndarray
    own: int

    def __post_init__(self) -> None:
        # The most frequent word of each value of the first bits is found at once; -1: there is none.
        self.shift = np.uint64(64 - max(4, (4 * len(self.hashes)).bit_length()))
        self.first = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        order = np.argsort(self.counts, kind="stable")
        self.first[self.hashes[order] >> self.shift] = order

    @property
    def items(self) -> int:
        return self.own + GROUPS

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = self.first[hashes >> self.shift].astype(np.int64)
        left = np.flatnonzero((at >= 0) & (self.hashes[at] != hashes))
        rest = np.minimum(np.searchsorted(self.hashes, hashes[left]), len(self.hashes) - 1)
        at[left] = np.where(self.hashes[rest] == hashes[left], rest, -1)
        return at


def is_training(doc_id: Column) -> Column:
    """Texts to learn from: the id's CRC-32 is not 2 modulo 7; rows without an id as well."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, groups, rows)``: the words of each text with an end after them; ``groups`` is the
    spelling group of each."""
    data, starts, ends, hashes, rows = words_of(column)
    first, last = data[starts].astype(np.uint64), data[ends - 1].astype(np.uint64)
    second = data[np.maximum(ends - 2, starts)].astype(np.uint64)
    third = data[np.maximum(ends - 3, starts)].astype(np.uint64)
    spelled = ((first * np.uint64(256) + last) * np.uint64(256) + second) * np.uint64(256) + third
    groups = (mix(spelled) >> np.uint64(52)).astype(np.int64)
    bounds = rows + np.arange(len(rows))
    return np.insert(hashes, rows[1:], END), np.insert(groups, rows[1:], 0), bounds


def token_counts(texts: DataFrame) -> DataFrame:
    """``h, g, c``: every distinct token of ``_text`` with its group and count."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, g, c = (np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]
        order = np.argsort(h)
        h = h.take(order)
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h.take(head), g.take(order.take(head)), np.add.reduceat(c.take(order), head)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2])], names=["h", "g", "c"])
        for batch in batches:
            for part in chunks(batch, "_text", TEXT):
                hashes, groups, _ = tokens_of(part.column("_text"))
                if len(hashes):
                    held.append(summed([(hashes, groups, np.ones(len(hashes), np.int64))]))
                    size += len(held[-1][0])
                if size > 2_000_000:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield out(held.pop())
                        size = 0
        if held:
            yield out(summed(held))

    rows = texts.mapInArrow(work, "h bigint, g bigint, c bigint")
    return rows.groupBy("h").agg(F.min("g").alias("g"), F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, types: int) -> Vocabulary:
    """The ``FREQUENT`` most frequent words of ``types``, ties by hash."""
    table = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    h, c = table["h"].to_numpy().view(np.uint64), table["c"].to_numpy()
    own = min(max(OWN[0], min(OWN[1], types // 8)), len(h))
    rank = np.lexsort((h, -c))
    item = np.full(len(h), -1, np.int64)
    item[rank[:own]] = np.arange(own)
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], item[order], own)


def items_of(words: Vocabulary, at: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Item of each token from its place among the frequent words and its group."""
    own = np.where(at >= 0, words.item[at] if len(words.item) else -1, -1)
    return np.where(own >= 0, own, words.own + groups)


def before(values: np.ndarray, rows: np.ndarray, steps: int, none: int) -> np.ndarray:
    """The value ``steps`` tokens earlier in the same text, or ``none``."""
    out = np.empty_like(values)
    out[steps:] = values[: max(len(values) - steps, 0)]
    first = rows[:-1, None] + np.arange(steps)
    out[first[first < rows[1:, None]]] = none
    return out


def encoded(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """Every text of ``_id, _train, _round, _text`` as ``items``, 16-bit item numbers, with what its
    frequent words (``known``, ``seen``) and other words (``rare``) give to the base score."""
    given = rows.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = given.value
        logs = np.log10(vocabulary.counts + 1.0)
        for batch in batches:
            for part in chunks(batch, "_text", TEXT):
                hashes, groups, bounds = tokens_of(part.column("_text"))
                at = vocabulary.find(hashes)
                known = at >= 0
                seen = np.where(known, logs[at] if len(logs) else 0.0, 0.0)
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
                items = items_of(vocabulary, at, groups).astype(np.uint16)
                rare_at = np.concatenate([[0], np.cumsum(~known)])[bounds]
                offsets = pa.py_buffer((2 * bounds).astype(np.int64).tobytes())
                packed = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, offsets, pa.py_buffer(items.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        part.column("_train"),
                        part.column("_round"),
                        pa.array(np.diff(bounds)),
                        pa.array(sums(known.astype(np.int64))),
                        pa.array(sums(seen)),
                        pa.ListArray.from_arrays(pa.array(rare_at.astype(np.int32)), pa.array(hashes[~known].view(np.int64))),
                        packed.cast(pa.binary()),
                    ],
                    names=["_id", "_train", "_round", "n_tokens", "known", "seen", "rare", "items"],
                )

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "_train", "_round", "_text").mapInArrow(
        work,
        f"_id {kind}, _train boolean, _round bigint, n_tokens bigint, known bigint, seen double, rare array<bigint>, items binary",
    )


def item_chunks(batch: pa.RecordBatch, limit: int = 1 << 17) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """``(slice, items, bounds)`` of an encoded batch, about ``limit`` tokens each; a longer text stands alone."""
    if not batch.num_rows:
        return
    column = batch.column("items").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    items = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view(np.uint16)
    bounds = (bounds - bounds[0]) // 2
    cuts = np.flatnonzero(np.diff(np.cumsum(np.diff(bounds)) // limit)) + 1
    for s, e in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(s), int(e - s)), items[bounds[s] : bounds[e]].astype(np.int64), bounds[s : e + 1] - bounds[s]


def neighbour_counts(texts: DataFrame, words: Vocabulary) -> np.ndarray:
    """How often each item follows each of the ``CONTEXT`` most frequent ones within three words."""
    n, last = words.items, min(CONTEXT, words.own)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * CONTEXT, np.int64)
        for batch in batches:
            for _, items, rows in item_chunks(batch):
                for steps in (1, 2, 3):
                    past = before(items, rows, steps, n)
                    near = np.flatnonzero(past < last)
                    np.add.at(total, items.take(near) * CONTEXT + past.take(near), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "c"])

    table = texts.mapInArrow(work, "cell bigint, c bigint").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(n * CONTEXT)
    out[table["cell"].to_numpy()] = table["c"].to_numpy()
    return out.reshape(n, CONTEXT)


def classes_of(near: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Items grouped by what they follow: weighted k-means on square roots of shares.  Items of more than
    a share of 1 / ``ALONE``, half of the classes at most, are classes of their own."""
    alone = np.argsort(-mass, kind="stable")[: CLASSES // 2]
    alone = alone[mass[alone] * ALONE > mass.sum()]
    weight = near.sum(1)
    weight[alone] = 0
    points = np.sqrt((near + 0.02 * (near.sum(0) + 1) / (near.sum() + CONTEXT)) / (near.sum(1) + 0.02)[:, None])
    heavy = np.argsort(-weight, kind="stable")
    centres = points[heavy[: CLASSES - len(alone)]].copy()
    for _ in range(20):
        chosen = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, 1)
        for c in range(len(centres)):
            mine = (chosen == c) & (weight > 0)
            if mine.any():
                centres[c] = np.average(points[mine], axis=0, weights=weight[mine])
    chosen[alone] = len(centres) + np.arange(len(alone))
    return chosen


@dataclass
class Tree:
    """Paths of the items: entries ``start[i]`` to ``start[i + 1]`` of ``node`` and ``branch`` lead to
    item ``i``; ``share`` has the log share of each branch of a node by counts alone."""

    start: np.ndarray
    node: np.ndarray
    branch: np.ndarray
    share: np.ndarray

    def steps(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(at, node, branch)`` of every step to the items; ``at`` is the item's place."""
        first = self.start[items]
        n = self.start[items + 1] - first
        at = np.repeat(np.arange(len(items)), n)
        entry = np.arange(len(at)) + np.repeat(first - np.cumsum(n) + n, n)
        return at, self.node[entry], self.branch[entry]


def joined(part: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, list]:
    """``(items, branches)`` of a subtree over ``part``: the rarest ``CLASSES`` items or subtrees become one
    until one is left, which gives the shortest mean path; only the first joins fewer."""
    heap = [(m, k, part[k : k + 1], []) for k, m in enumerate(mass[part].tolist())]
    heapq.heapify(heap)
    number, size = len(heap), (len(heap) - 2) % (CLASSES - 1) + 2
    while len(heap) > 1:
        taken = [heapq.heappop(heap) for _ in range(size)][::-1]
        below = np.concatenate([t[2] for t in taken])
        heapq.heappush(heap, (sum(t[0] for t in taken), number, below, [t[2:] for t in taken]))
        number, size = number + 1, CLASSES
    return heap[0][2:] if heap else (part, [])


def tree_of(item_class: np.ndarray, mass: np.ndarray) -> Tree:
    """The classes below the root, and below each class its items, the more frequent the nearer."""
    paths: list[list[tuple[int, int]]] = [[] for _ in mass]
    todo = [[joined(np.flatnonzero(item_class == c), mass) for c in range(CLASSES)]]
    shares = []
    while todo:
        parts, node = todo.pop(), len(shares)
        sums = np.array([mass[items].sum() for items, _ in parts] + [0.0] * (CLASSES - len(parts)))
        shares.append(np.where(sums > 0, np.log(np.maximum(sums, 1e-9) / sums.sum()), -1e4))
        for branch, (items, branches) in enumerate(parts):
            for i in items:
                paths[i].append((node, branch))
            if branches:
                todo.append(branches)
    flat = np.array([step for path in paths for step in path], np.int64).reshape(-1, 2)
    start = np.concatenate([[0], np.cumsum([len(path) for path in paths])]).astype(np.int64)
    return Tree(start, flat[:, 0].copy(), flat[:, 1].copy(), np.array(shares, np.float32))


def histories(items: np.ndarray, rows: np.ndarray, none: int) -> np.ndarray:
    """Four keys of the words before each token."""
    one, two, three = (before(items, rows, s, none).astype(np.uint64) for s in (1, 2, 3))
    kinds = [one, two * np.uint64(65537) + one, two, three]
    return np.stack([k * np.uint64(8) + np.uint64(i) for i, k in enumerate(kinds)])


def features_of(keys: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Feature rows of each step: its history's keys hashed with its node."""
    return (mix(keys + node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def softmax(share: np.ndarray, weights: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(logits, powers, sums)`` from the branches' log shares, which are overwritten."""
    logits = raised(share, weights, found)
    powers = np.exp(logits)
    return logits, powers, row_sums(powers)


def raised(share: np.ndarray, weights: np.ndarray, found: np.ndarray) -> np.ndarray:
    """``share``, overwritten by the logits."""
    for rows in found:
        share += weights.take(rows, 0)
    return share


def row_sums(powers: np.ndarray) -> np.ndarray:
    return powers @ np.ones(powers.shape[1], np.float32)


def run_sums(values: np.ndarray, order: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Sums of the rows ``values[order]`` over the runs that start at ``head``.

    Most runs are one row.  The others are added up longest first, so that the runs with a j-th row
    are a prefix and each addition is one of whole slices; what is past ``LAYERS`` rows goes at once.
    """
    sizes = np.diff(head, append=len(order))
    sums = values.take(order.take(head), 0)
    many = np.flatnonzero(sizes > 1)
    if not len(many):
        return sums
    many = many.take(np.argsort(-sizes.take(many)))
    size, start, part = sizes.take(many), head.take(many), sums.take(many, 0)
    longer = np.searchsorted(-size, -np.arange(LAYERS + 1))  # runs of more than 0, 1, ... rows
    for j in range(1, LAYERS):
        part[: longer[j]] += values.take(order.take(start[: longer[j]] + j), 0)
        if not longer[j + 1]:
            break
    if n := longer[LAYERS]:
        rest = size[:n] - LAYERS
        first = np.cumsum(rest) - rest
        at = np.arange(rest.sum()) + np.repeat(start[:n] + LAYERS - first, rest)
        part[:n] += np.add.reduceat(values.take(order.take(at), 0), first, 0)
    as_cells(sums)[many] = as_cells(part)
    return sums


def as_cells(rows: np.ndarray) -> np.ndarray:
    """Rows as single values: numpy sets chosen ones of them much faster than rows."""
    return rows.view(f"V{rows.strides[0]}")[:, 0]


def gradient(share: np.ndarray, weights: np.ndarray, found: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touched feature rows, the gradient of the log-likelihood for each, and their occurrences."""
    slope = raised(share, weights, found)
    np.exp(slope, out=slope)
    slope *= (-1 / row_sums(slope))[:, None]
    n = len(target)
    slope[np.arange(n), target] += 1
    # Feature row and step in one number; half the size sorts in half the time.
    bits = n.bit_length()
    kind = np.uint32 if len(weights) << bits <= 1 << 32 else np.uint64
    order = ((found.astype(kind) << kind(bits)) | np.arange(n, dtype=kind)).ravel()
    order.sort()
    flat = order >> kind(bits)
    head = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    uses = np.diff(head, append=len(order))
    return flat.take(head).astype(np.int64), run_sums(slope, (order & kind((1 << bits) - 1)).astype(np.int64), head), uses


def learn(items: np.ndarray, rows: np.ndarray, none: int, paths: Tree, weights: np.ndarray, speed: np.ndarray, seen: np.ndarray, width: int) -> None:
    """Changes ``weights`` along the gradient of every position; each feature row has one pace, by
    the squares of its past gradients in ``speed``; ``seen`` counts the uses of blocks of ``width`` rows."""
    bits = len(weights).bit_length() - 1
    keys = histories(items, rows, none)
    cells = as_cells(weights)
    for s in range(0, len(items), BATCH):
        at, node, branch = paths.steps(items[s : s + BATCH])
        found = features_of(keys[:, s : s + BATCH].take(at, 1), node, bits)
        touched, slope, uses = gradient(paths.share.take(node, 0), weights, found, branch)
        paced = speed.take(touched) + np.einsum("ij,ij->i", slope, slope)
        speed[touched] = paced
        slope *= (RATE / np.sqrt(paced))[:, None]
        slope += weights.take(touched, 0)
        cells[touched] = as_cells(np.clip(slope, -BOUND, BOUND, out=slope))
        seen += np.bincount(touched // width, uses, len(seen))


def train(texts: DataFrame, words: Vocabulary, tree: Tree, bits: int, tokens: int) -> np.ndarray:
    """Weights ``(features, branches)`` after ``ROUNDS`` rounds over ``_round, items`` of ``tokens`` in all.

    A round has as many tasks as cores, or one for ``TASK_TOKENS`` where that is more, so that
    what the tasks send stays small beside what they read.  Weights and paces are averaged after a
    round, by the uses of their block in each task, and the next one goes on from there.
    """
    context = texts.sparkSession.sparkContext
    weights, paces = np.zeros((1 << bits, CLASSES), np.float32), np.ones(1 << bits, np.float32)
    width = 64  # features in one sent block
    none = words.items
    tasks = max(context.defaultParallelism, tokens // ROUNDS // TASK_TOKENS)
    for r in range(ROUNDS):
        given = context.broadcast((tree, weights, paces))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            paths, start, speed = given.value  # noqa: B023
            now, speed = start.copy(), speed.copy()
            seen = np.zeros(len(start) // width)
            for batch in batches:
                for _, items, rows in item_chunks(batch):
                    learn(items, rows, none, paths, now, speed, seen, width)
            blocks = np.flatnonzero(seen)
            change = (now - start).reshape(len(seen), -1)[blocks].astype(np.float16)
            pace = speed.reshape(len(seen), -1)[blocks]
            packed = [pa.array([row.tobytes() for row in part], pa.binary()) for part in (change, pace)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(seen[blocks]), *packed], names=["block", "seen", "change", "pace"])

        def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Blocks are whole in a partition; each holds one running sum.
            sums: dict[int, list] = {}
            for batch in batches:
                for block, n, *raw in zip(*(batch.column(c).to_pylist() for c in ("block", "seen", "change", "pace"))):
                    change, pace = (n * np.frombuffer(x, kind).astype(np.float64) for x, kind in zip(raw, (np.float16, np.float32)))
                    old = sums.get(block, (0, 0, 0))
                    sums[block] = [old[0] + n, old[1] + change, old[2] + pace]
            packed = [pa.array([(x[k] / x[0]).astype(np.float32).tobytes() for x in sums.values()], pa.binary()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), *packed], names=["block", "change", "pace"])

        part = texts.filter(F.col("_round") == r).select("items").coalesce(tasks)
        sent = part.mapInArrow(work, "block bigint, seen double, change binary, pace binary")
        table = sent.repartition("block").mapInArrow(averaged, "block bigint, change binary, pace binary").toArrow()
        weights, paces = weights.copy(), paces.copy()
        for block, change, pace in zip(*(table[c].to_pylist() for c in ("block", "change", "pace"))):
            rows = slice(block * width, (block + 1) * width)
            weights[rows] += np.frombuffer(change, np.float32).reshape(width, -1)
            paces[rows] = np.frombuffer(pace, np.float32)
    return weights


def item_totals(counts: DataFrame, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of every item, from the whole count table."""
    given = counts.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = given.value
        n = vocabulary.items
        total = np.zeros((2, n))
        for batch in batches:
            h, g, c = (batch.column(x).to_numpy() for x in ("h", "g", "c"))
            mine = items_of(vocabulary, vocabulary.find(h.view(np.uint64)), g)
            total += [np.bincount(mine, c, n), np.bincount(mine, minlength=n)]
        used = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], names=["item", "tokens", "types"])

    rows = counts.mapInArrow(work, "item bigint, tokens double, types double")
    table = rows.groupBy("item").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).toArrow()
    out = np.zeros((2, words.items))
    out[:, table["item"].to_numpy()] = table["tokens"].to_numpy(), table["types"].to_numpy()
    return out[0], out[1]


@dataclass
class Model:
    """Words, paths and weights; ``inside`` has the log10 mass of every item."""

    words: Vocabulary
    tree: Tree
    weights: np.ndarray
    inside: np.ndarray

    def log10s(self, items: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Log10 of every token's item after the words before it in its text."""
        bits = len(self.weights).bit_length() - 1
        keys = histories(items, rows, self.words.items)
        out = np.empty(len(items))
        for s in range(0, len(items), SCORED):
            step, node, branch = self.tree.steps(items[s : s + SCORED])
            found = features_of(keys[:, s : s + SCORED].take(step, 1), node, bits)
            logits = raised(self.tree.share.take(node, 0), self.weights, found)
            reached = logits[np.arange(len(branch)), branch]
            reached -= np.log(row_sums(np.exp(logits, out=logits)))
            out[s : s + SCORED] = np.bincount(step, reached, len(items[s : s + SCORED]))
        return out / np.log(10)


def fit(rows: DataFrame) -> tuple[Model, DataFrame, DataFrame, int, int]:
    """``(model, table, counts, tokens, types)`` of ``_id, _train, _round, _text``: the model learned from
    the training texts, all texts encoded and the training texts' token counts, both stored."""
    counts = stored(token_counts(rows.filter("_train").select("_text")))
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("h")).first()
    words = frequent_words(counts, types)
    table = stored(encoded(rows, words).withColumn("_row", F.monotonically_increasing_id()))
    texts = table.filter("_train").select("_round", "items")
    # Every task sends all cells it has seen, so there are no more tasks than learning would take.
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, total // TASK_TOKENS)
    near = neighbour_counts(texts.select("items").coalesce(tasks), words)
    tokens, kinds = item_totals(counts, words)
    mass = tokens + np.where(np.arange(words.items) < words.own, 1, kinds + 1)
    tree = tree_of(classes_of(near, mass), mass)
    bits = int(np.clip(np.ceil(np.log2(total / 128 + 1)), *FEATURE_BITS))
    return Model(words, tree, train(texts, words, tree, bits, total), np.log10(mass)), table, counts, total, types


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Tokens are words between blanks with A-Z lowered and one end for each text.  ``base_score`` is
    the log10 probability under smoothed counts of single tokens, ``score`` under the model, whose
    spelling groups each keep one smoothed place for words not seen in training.

    A null text is empty: its end alone.  A row without an id is trained on.  Repeated rows are
    trained on and answered each.  With no training text every token is unknown.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).alias("_id"),
        is_training(F.col(doc_id)).alias("_train"),
        F.pmod(F.xxhash64(F.lit(3), F.col(doc_id)), F.lit(ROUNDS)).alias("_round"),
        F.col(text).alias("_text"),
    )
    model, table, counts, total, types = fit(rows)
    given = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = given.value
        for batch in batches:
            for part, items, bounds in item_chunks(batch):
                chosen = fitted.log10s(items, bounds) - fitted.inside[items]
                model = np.diff(np.concatenate([[0], np.cumsum(chosen)])[bounds])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(model)], names=[*kept, "model"])

    kept = ["_row", "_id", "_train", "n_tokens", "known", "seen"]
    fields = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in kept)
    scored = table.select(*kept, "items").mapInArrow(work, f"{fields}, model double")
    rare = table.select("_row", F.explode("rare").alias("h")).groupBy("_row", "h").agg(F.count(F.lit(1)).alias("n"))
    rare = rare.join(counts.select("h", "c"), "h").groupBy("_row").agg(
        F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_seen")
    )
    seen = F.col("seen") + F.coalesce("rare_seen", F.lit(0.0))
    return scored.join(rare, "_row", "left").select(
        "_id",
        (~F.col("_train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (seen - F.col("n_tokens") * float(np.log10(total + types + 1))).alias("base_score"),
        (seen + F.col("model")).alias("score"),
    )
