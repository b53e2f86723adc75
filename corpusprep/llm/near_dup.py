"""Near duplicates on word shingles with HyperMinHash registers; every link is confirmed on full sets.

Documents with equal shingle sets are one class before anything is compared.  A class sends one
key for each band of compressed registers.  Small buckets give their pairs; a large bucket gives
only pairs with its most central member, and its members also take part in an exact
prefix-filtered join of rare shingles, which finds what the centres leave open.  Pairs far below
the threshold by the collision-corrected estimate go; the rest is compared set against set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.durable import stored
from corpusprep.llm.bitmap import likely
from corpusprep.llm.components import smallest_reachable
from corpusprep.llm.words import chunks, mix, shingles, words_of

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA = 10  # bits kept after the leading-zero count
ROWS = 4  # registers in a band: at a similarity of 0.8 all 32 bands miss with a chance of 5e-8
SKETCH = 1 << 16  # slots
SMALL = 32  # members of a bucket whose pairs are all compared


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers of sorted hash sets: for each bucket of the top bits, the leading
    zeros of the smallest rest and the bits that follow, as uint16.

    An empty bucket takes the next full one's register, mixed with the distance between them.
    """
    n = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), n)
    cell = row * REGISTERS + (every >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    head = np.flatnonzero(np.diff(cell, prepend=-1))  # sets are sorted: the first is the smallest
    rest = every[head] << np.uint64(BUCKET_BITS)
    zeros = 63 - np.floor(np.log2(np.maximum(rest.astype(np.float64), 1))).astype(np.int64)
    zeros = np.clip(zeros, 0, 63 - MANTISSA)
    kept = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out = np.full(len(sets) * REGISTERS, -1, np.int64)
    out[cell[head]] = (zeros << MANTISSA) | kept.astype(np.int64)
    out = out.reshape(len(sets), REGISTERS)
    # Distance to the next full bucket, round the end.
    twice = np.concatenate([out, out], 1)
    places = np.where(twice >= 0, np.arange(2 * REGISTERS), 4 * REGISTERS)
    following = np.minimum.accumulate(places[:, ::-1], 1)[:, ::-1][:, :REGISTERS]
    far = following - np.arange(REGISTERS)
    value = np.take_along_axis(twice, following, 1).astype(np.uint64)
    mixed = mix(value * np.uint64(REGISTERS) + far.astype(np.uint64)) & np.uint64(0xFFFF)
    return np.where(far > 0, mixed, value).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One int64 for each band of ``ROWS`` registers."""
    bands = regs.reshape(len(regs), -1, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2])
    for i in range(ROWS):
        key = mix(key * np.uint64(1 << 16) + bands[:, :, i])
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of register rows, corrected for equal registers by chance.

    Two smallest values of unrelated sets fall into one cell of width u / 2^MANTISSA with a chance
    of about 0.72 / 2^MANTISSA * l m / (l + m)^2, for l and m elements a bucket.
    """
    same = (a == b).mean(1)
    low, high = n_a / REGISTERS, n_b / REGISTERS
    chance = 0.72 / (1 << MANTISSA) * low * high / (low + high) ** 2
    return np.maximum(same - chance, 0) / (1 - chance)


def least_estimate(threshold: float, n: np.ndarray) -> np.ndarray:
    """Pairs at the threshold lie above this by six standard deviations; small sets, whose
    registers are copies of few, get a wider margin."""
    free = np.minimum(REGISTERS / 1.6, n / 2)
    return threshold - 6 * np.sqrt(threshold * (1 - threshold) / np.maximum(free, 1))


def _sets(text: pa.Array, width: int) -> list[np.ndarray]:
    _, _, _, hashes, rows = words_of(text)
    return [np.unique(shingles(hashes[s:e], width)) for s, e in zip(rows, rows[1:])]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``_id, _fp, n, f1, f2, regs`` of every row of ``_id, _fp, _text``; ``f1, f2`` is a 128-bit hash of the set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                sets = _sets(part.column("_text"), width)
                n = np.array([len(x) for x in sets], np.int64)
                full = np.flatnonzero(n)
                regs = np.zeros((len(sets), REGISTERS), np.uint16)
                if len(full):
                    regs[full] = registers([sets[i] for i in full])
                finger = b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets)
                finger = np.frombuffer(finger, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        part.column("_fp"),
                        pa.array(n),
                        pa.array(finger[:, 0]),
                        pa.array(finger[:, 1]),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    names=["_id", "_fp", "n", "f1", "f2", "regs"],
                )

    return docs.mapInArrow(work, "_id bigint, _fp bigint, n bigint, f1 bigint, f2 bigint, regs binary")


def text_hash(text: Column) -> Column:
    """Tells rows with one id and different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``_id`` and the sorted set as bytes (``_set``) of every row of ``_id, _text``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                sets = [x.tobytes() for x in _sets(part.column("_text"), width)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(sets, pa.binary())], names=["_id", "_set"]
                )

    return docs.mapInArrow(work, "_id bigint, _set binary")


def _filtered(pairs: DataFrame, columns: list[str], keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The ``columns`` of the pairs for which ``keep`` gives a score (not nan), with it as ``score``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                score = keep(part)
                took = np.flatnonzero(~np.isnan(score))
                out = part.select(columns).take(pa.array(took))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(score[took])], names=[*columns, "score"])

    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in columns)
    return pairs.mapInArrow(work, f"{schema}, score double")


def estimated(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` that may reach the threshold by their registers, with both weights and the estimate."""
    side = lambda x: classes.select(F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "w", "regs")])
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def keep(part: pa.RecordBatch) -> np.ndarray:
        regs = [
            np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b")
        ]
        n = [part.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b")]
        found = similarity(*regs, *n)
        return np.where(found >= least_estimate(threshold, np.minimum(*n)), found, np.nan)

    return _filtered(joined, ["a", "b", "w_a", "w_b"], keep)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sets have ``100 * intersection >= percent * union``."""
    side = lambda x: sets.select(F.col("_id").alias(x), F.col("_set").alias(f"s_{x}"))
    pairs = pairs.select("a", "b")
    joined = pairs.join(likely(side("b"), "b", pairs, "b"), "b").join(likely(side("a"), "a", pairs, "a"), "a")

    def one(a: bytes, b: bytes) -> float:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = np.concatenate([x, y])
        both.sort(kind="stable")  # merges the two sorted runs
        common = int((both[1:] == both[:-1]).sum())
        union = len(x) + len(y) - common
        return common / union if 100 * common >= percent * union else np.nan

    def keep(part: pa.RecordBatch) -> np.ndarray:
        return np.array([one(a, b) for a, b in zip(part.column("s_a").to_pylist(), part.column("s_b").to_pylist())], float)

    return _filtered(joined, ["a", "b"], keep).select("a", "b")


def shingle_sketch(sets: DataFrame) -> np.ndarray:
    """Sets that hold each of ``SKETCH`` slots of shingle hashes: no count is below a shingle's own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for raw in batch.column("_set"):
                total[np.unique(np.frombuffer(raw.as_py(), np.uint64) % np.uint64(SKETCH))] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "c"])

    table = sets.select("_set").mapInArrow(work, "slot bigint, c bigint").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(SKETCH, np.int64)
    out[table["slot"].to_numpy()] = table["c"].to_numpy()
    return out


def rare_shingle_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``members`` (``_id, n, group``) of different groups that can reach the threshold.

    Exact: sets in one common order share a shingle in their prefixes of n - ceil(t n) + 1, at places
    that leave room for the overlap.  The order is by a sketch of how many members hold a shingle,
    rarest first, and those that only one holds go.  Of a shingle's holders, those of its most
    frequent group are not paired with each other.
    """
    members = stored(members)
    rows = stored(members.join(likely(sets, "_id", members, "_id"), "_id").select("_id", "n", "group", "_set"))
    given = members.sparkSession.sparkContext.broadcast(shingle_sketch(rows))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = given.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens, places, times = [], [], []
                for raw in part.column("_set"):
                    token = np.frombuffer(raw.as_py(), np.uint64)
                    held = counts[(token % np.uint64(SKETCH)).astype(np.int64)]
                    first = np.lexsort((token, held))[: len(token) + (-percent * len(token)) // 100 + 1]
                    place = np.flatnonzero(held[first] > 1)
                    tokens.append(token[first[place]].view(np.int64))
                    places.append(place)
                    times.append(len(place))
                took = pa.array(np.repeat(np.arange(len(times)), times))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), *[part.column(c).take(took) for c in ("_id", "n", "group")], pa.array(np.concatenate(places))],
                    names=["token", "_id", "n", "group", "at"],
                )

    t = percent
    placed = stored(rows.mapInArrow(prefixes, "token bigint, _id bigint, n bigint, group bigint, at bigint"))
    per_group = placed.groupBy("token", "group").agg(F.count(F.lit(1)).alias("c"))
    main = per_group.groupBy("token").agg(
        F.max_by("group", F.struct("c", "group")).alias("main"), F.count(F.lit(1)).alias("groups")
    ).filter("groups > 1").select("token", "main")
    held = placed.join(main, "token")
    left = held.filter("group <> main").select("token", *[F.col(c).alias(f"{c}_a") for c in ("_id", "n", "group", "at")])
    right = held.select("token", "main", *[F.col(c).alias(f"{c}_b") for c in ("_id", "n", "group", "at")])
    total = F.col("n_a") + F.col("n_b")
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = (
        (F.col("group_a") != F.col("group_b"))
        & ((F.col("group_b") == F.col("main")) | (F.col("_id_a") < F.col("_id_b")))
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * t)
        & (room * (100 + t) >= total * t)
    )
    pairs = left.join(right, "token").filter(fits)
    return pairs.select(F.least("_id_a", "_id_b").alias("a"), F.greatest("_id_a", "_id_b").alias("b")).distinct()


def bands(classes: DataFrame) -> DataFrame:
    """``key, rep, n`` for every band of every class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = band_keys(np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS))
                times = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), part.column("rep").take(times), part.column("n").take(times)],
                    names=["key", "rep", "n"],
                )

    return classes.select("rep", "n", "regs").mapInArrow(work, "key bigint, rep bigint, n bigint")


def _pairs(left: DataFrame, right: DataFrame, on: str, percent: int) -> DataFrame:
    """Distinct pairs ``a < b`` of equal ``on`` whose sizes allow the threshold."""
    l = left.select(on, F.col("rep").alias("x"), F.col("n").alias("n_x"))
    r = right.select(on, F.col("rep").alias("y"), F.col("n").alias("n_y"))
    sizes = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
    return l.join(r, on).filter((F.col("x") < F.col("y")) & sizes).select(F.col("x").alias("a"), F.col("y").alias("b"))


def class_links(classes: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Confirmed links ``a, b`` between classes, enough to connect every two that are linked.

    ``sets`` gives ``_id, _set`` for a frame of ``rep``.
    """
    rows = bands(classes)
    size = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    shared = stored(likely(rows, "key", size, "key").join(size, "key"))
    small, large = shared.filter(F.col("size") <= SMALL), shared.filter(F.col("size") > SMALL)
    weight = shared.groupBy("rep").agg(F.sum("size").alias("w"), F.max("size").alias("widest"))
    known = stored(likely(classes.select("rep", "n", "regs"), "rep", shared, "rep").join(weight, "rep"))
    # Of a large bucket the class that meets most others in all its buckets.
    central = large.join(known.select("rep", "w"), "rep").groupBy("key").agg(
        F.max_by(F.struct("rep", "n"), F.struct("w", -F.col("rep"))).alias("c")
    ).select("key", F.col("c.rep").alias("c_rep"), F.col("c.n").alias("c_n"))
    near = _pairs(small, small, "key", percent)
    star = large.join(central, "key").filter(
        (F.col("rep") != F.col("c_rep")) & (F.least("n", "c_n") * 100 >= F.greatest("n", "c_n") * percent)
    ).select(F.least("rep", "c_rep").alias("a"), F.greatest("rep", "c_rep").alias("b"))
    found = stored(estimated(stored(near.unionAll(star).distinct()), known, percent / 100))
    up = F.struct("w_a", -F.col("a")) > F.struct("w_b", -F.col("b"))
    members = known.filter(F.col("widest") > SMALL).select("rep", "n")
    held = found.select(F.col("a").alias("rep")).unionAll(found.select(F.col("b").alias("rep"))).unionAll(members.select("rep"))
    full = stored(sets(stored(held.distinct())))
    # First every class with its likeliest partner of more weight: that joins most copies.
    first = stored(
        found.select(F.when(up, F.col("b")).otherwise(F.col("a")).alias("low"), F.when(up, F.col("a")).otherwise(F.col("b")).alias("high"), F.greatest("w_a", "w_b").alias("w"), "score")
        .groupBy("low").agg(F.max_by("high", F.struct("score", "w", -F.col("high"))).alias("high"))
        .select(F.col("low").alias("a"), F.col("high").alias("b"))
    )
    links = stored(confirmed(first, full, percent))
    groups = stored(smallest_reachable(links))
    group = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"g_{x}"))
    of = lambda x: F.coalesce(F.col(f"g_{x}"), F.col(x))
    # Then pairs that are still apart, and exactly those of large buckets that were not paired.
    apart = found.join(group("a"), "a", "left").join(group("b"), "b", "left").filter(of("a") != of("b")).select("a", "b")
    open_members = (
        members.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.col("rep").alias("_id"), "n", F.coalesce("component", "rep").alias("group"))
    )
    rest = stored(apart.unionAll(rare_shingle_pairs(open_members, full, percent)).distinct())
    return links.unionAll(confirmed(rest, full, percent))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``_id, _fp, n_shingles, component_id`` of every row; ``_fp`` is a hash of the text.

    Documents are linked if 100 * intersection >= percent * union of their distinct ``width``-word
    shingles (A-Z lowered, words between blanks; fewer words are one shingle).  ``component_id`` is
    the smallest id reachable over links.  Empty and null texts are linked with nothing.

    Ids are integers.  Rows that share an id are answered each for its own text; texts whose
    smallest holder is the same id are one node.  A row without an id takes no part in links and
    gets a null component.
    """
    kind = docs.schema[doc_id].dataType
    docs = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    rows = stored(signatures(docs.select("_id", text_hash(F.col("_text")).alias("_fp"), "_text"), width))
    classes = stored(
        rows.filter((F.col("n") > 0) & F.col("_id").isNotNull()).groupBy("f1", "f2")
        .agg(F.min("_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("regs").alias("regs"))
    )

    def sets(reps: DataFrame) -> DataFrame:
        reps = reps.withColumnRenamed("rep", "_id")
        return shingle_sets(likely(docs, "_id", reps, "_id").join(reps, "_id", "left_semi"), width)

    links = class_links(classes, sets, percent)
    groups = smallest_reachable(links).withColumnRenamed("node", "rep")
    answer = classes.join(groups, "rep", "left").select(
        "f1", "f2", F.coalesce("component", "rep").alias("component")
    )
    found = rows.select("_id", "_fp", "n", "f1", "f2").join(answer, ["f1", "f2"], "left")
    alone = (F.col("n") == 0) | F.col("_id").isNull()
    return found.select(
        F.col("_id").cast(kind),
        "_fp",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("_id")).otherwise(F.col("component")).cast(kind).alias("component_id"),
    )
