"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

The target model is counted over labelled good documents, the raw one over all; a document's
weight is the log ratio of its probabilities under the two, and the sample takes the k
documents with the largest weight plus Gumbel noise, which is sampling without replacement in
proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.functions.durable import stored
from corpusprep.llm.words import SPACES, chunks, mix, text_bytes, word_hashes

BUCKET_BITS = 15
SAMPLE = 20_000  # labelled rows that fit the target model and the cut, by the hash of their id
SEED = 17
_KIND = np.full(256, 2, np.int8)  # 0 blank, 1 letters, digits and characters outside ASCII, 2 signs
_KIND[SPACES] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def pieces_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(data, starts, ends, hashes, rows)`` of runs of word characters and runs of signs."""
    data, offsets = text_bytes(column)
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    seen = kind[starts] != 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[seen], ends[seen]
    return data, starts, ends, word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of every piece, ``(pieces, 3)``, and the rows' bounds: the piece, the piece
    after the one before it, and the shapes of the last three pieces."""
    data, starts, ends, hashes, rows = pieces_of(column)
    n = len(hashes)
    if not n:
        return np.zeros((0, 3), np.int64), rows
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    size, capitals, first = ends - starts, upper[ends] - upper[starts], data[starts]
    word = _KIND[first] == 1
    head = np.zeros(n, bool)
    head[rows[:-1][rows[:-1] < n]] = True
    before = np.where(head, np.uint64(1), np.roll(hashes, 1))
    form = np.where(capitals == 0, 0, np.where((capitals == size) & (size > 1), 1, np.where(capitals == 1, 2, 3)))
    shape = np.where(word, 4 * np.minimum(np.log2(size).astype(np.int64), 5) + form, 64 + first.astype(np.int64) * 4 + np.minimum(size, 3))
    shape = mix((shape * 2 + (hashes == before)).astype(np.uint64))
    one = np.where(head, np.uint64(2), np.roll(shape, 1))
    two = np.where(head, np.uint64(3), np.roll(one, 1))
    down = np.uint64(64 - BUCKET_BITS)
    found = [
        mix(hashes),
        mix(before * np.uint64(31) + hashes + np.uint64(5)),
        mix(mix(two * np.uint64(31) + one) * np.uint64(31) + shape),
    ]
    return np.stack([(f >> down).astype(np.int64) for f in found], 1), rows


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """``_id, _text, _label``; the label of at most ``SAMPLE`` labelled ids, else null."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    some = known.groupBy(F.col(doc_id).alias("_key")).agg(F.max(F.col(label)).cast("int").alias("_label"))
    some = some.orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE)
    rows = docs.select(F.col(doc_id).alias("_id"), docs["text"].alias("_text"))
    return rows.join(F.broadcast(some), F.col("_id") == F.col("_key"), "left").select("_id", "_text", "_label")


def feature_counts(rows: DataFrame) -> np.ndarray:
    """Counts of every bucket over all texts and over target texts, ``(buckets, 2)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BUCKET_BITS, 2), np.int64)
        for batch in batches:
            for part in chunks(batch, "_text"):
                found, rows_ = features(part.column("_text"))
                target = np.repeat(part.column("_label").fill_null(0).to_numpy() == 1, np.diff(rows_))
                total[:, 0] += np.bincount(found.ravel(), minlength=len(total))
                total[:, 1] += np.bincount(found[target].ravel(), minlength=len(total))
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used, 0]), pa.array(total[used, 1])], names=["b", "raw", "target"])

    sums = rows.mapInArrow(work, "b bigint, raw bigint, target bigint").groupBy("b").agg(F.sum("raw"), F.sum("target"))
    out = np.zeros((1 << BUCKET_BITS, 2))
    for b, raw, target in sums.collect():  # a fixed number of buckets
        out[b] = raw, target
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) of every bucket, each smoothed towards the raw model."""
    raw = (counts[:, 0] + 1) / (counts[:, 0].sum() + len(counts))
    pull = 50.0
    target = (counts[:, 1] + pull * raw) / (counts[:, 1] + 0).sum() if counts[:, 1].sum() else raw
    target = target / target.sum()
    return np.log(target / raw).astype(np.float32)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise that depends on the id only."""
    unit = F.when(doc_id.isNotNull(), (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) + 0.5) / float(1 << 52))
    return F.coalesce(-F.log(-F.log(unit)), F.lit(0.0))


def top_cut(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, exactly: digit by digit of its order-preserving bits, each time from
    at most 65,536 counts.  None if there are no more than k rows."""
    # Doubles are sent to integers of the same order by way of their decimal form.
    bits = F.rint(F.col(column) * 1e6).cast("bigint") + F.lit(1 << 62)
    rows, want, prefix = keys.select(bits.alias("v")), k, 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("v", shift).bitwiseAND(0xFFFF)
        counts = rows.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("c"))
        above = F.sum("c").over(Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0))
        row = counts.withColumn("above", above).filter(F.col("above") >= want).orderBy("above").first()
        if row is None:
            return None
        want -= row["above"] - row["c"]
        prefix |= row["d"] << shift
        rows = rows.filter(F.shiftright("v", shift) == prefix >> shift)
    return (prefix - (1 << 62)) / 1e6


def separating_cut(good: np.ndarray, bad: np.ndarray, cost: float = 20.0) -> float:
    """The key below which a document is rejected: least bad rows kept plus ``cost`` times the good
    rows lost, among the labelled rows.  Keeps everything if one of the two is missing."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.concatenate([good, bad])
    order = np.argsort(values, kind="stable")
    is_good = (np.arange(len(values)) < len(good))[order]
    lost = np.concatenate([[0], np.cumsum(is_good)]) * cost
    kept_bad = len(bad) - np.concatenate([[0], np.cumsum(~is_good)])
    best = int(np.argmin(lost + kept_bad))
    at = np.concatenate([[-np.inf], values[order]])
    return float((at[best] + values[order][best]) / 2) if 0 < best < len(values) else (-np.inf if best == 0 else np.inf)


def _model(docs: DataFrame, labels: DataFrame, doc_id: str, label: str, k: int | None) -> tuple[DataFrame, np.ndarray, float]:
    """The scored rows, the model, and the least key that is kept."""
    rows = _labelled(docs, labels, doc_id, label)
    ratios = log_ratios(feature_counts(rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                n, weight = _weights(part.column("_text"), ratios)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_label"), pa.array(n), pa.array(weight)],
                    names=["_id", "_label", "n_features", "log_weight"],
                )

    kind = rows.schema["_id"].dataType.simpleString()
    scored = rows.mapInArrow(work, f"_id {kind}, _label int, n_features bigint, log_weight double")
    scored = stored(scored.withColumn("sample_key", _key(F.col("log_weight"), F.col("_id"))))
    if k is None:
        labelled = scored.filter("_label is not null").select("_label", "sample_key").collect()  # SAMPLE ids
        keys = [np.array([r[1] for r in labelled if r[0] == x]) for x in (1, 0)]
        cut = separating_cut(*keys)
        k = scored.filter(F.col("sample_key") >= cut).count() if np.isfinite(cut) else None
    cut = None if k is None else top_cut(scored, "sample_key", k) if k else np.inf
    return scored, ratios, -np.inf if cut is None else cut


def _weights(column: pa.Array, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, bounds = features(column)
    sums = np.concatenate([[0.0], np.cumsum(ratios[found].sum(1, dtype=np.float64))])
    # The running sum is subtracted at six decimals, so that a text's weight is its own.
    return np.diff(bounds) * 3, np.round(np.diff(sums[bounds]), 6) + 0.0


def _key(log_weight: Column, doc_id: Column) -> Column:
    return F.round(log_weight + gumbel(doc_id), 4)


def resample(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", k: int | None = None
) -> DataFrame:
    """``_id, n_features, log_weight, sample_key, kept`` of every row of ``docs`` (text in ``text``).

    The ``k`` rows with the largest keys are kept; all with the last one's key.  Without ``k`` it is
    the number of rows whose key reaches the cut that best parts labelled good from labelled bad
    rows, so that rows like the good ones stay.  Keys compare at four decimals.

    A null or empty text has no feature, weight 0 and is kept or not by its noise; a row without an
    id has no noise.  Repeated rows get the same key.  Labels without an id or value are left out; an
    id with several takes the largest.  With no labelled row of either kind nothing is rejected.
    """
    scored, _, cut = _model(docs, labels, doc_id, label, k)
    return scored.select("_id", "n_features", "log_weight", "sample_key", (F.col("sample_key") >= F.lit(cut)).alias("kept"))


def sampled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, all columns.

    Every row is weighed again where it stands, which moves no text.
    """
    _, ratios, cut = _model(docs, labels, doc_id, label, k)

    @F.arrow_udf("double")
    def weight(text: pa.Array) -> pa.Array:
        parts = list(chunks(pa.RecordBatch.from_arrays([text], names=["t"]), "t"))
        return pa.array(np.concatenate([_weights(p.column("t"), ratios)[1] for p in parts]) if parts else np.zeros(0))

    return docs.filter(_key(weight(F.col("text")), F.col(doc_id)) >= F.lit(cut))
