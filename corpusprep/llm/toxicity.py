"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Labelled rows fall into three parts by the hash of their id: the first finds a lexicon of words
and word beginnings (spelling tricks undone), the second fits the trees, the third the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.durable import stored
from corpusprep.llm.words import LOWER, chunks, mix, text_bytes, word_hashes, word_spans

SAMPLE = 20_000  # labelled rows used at most, by the hash of their id
ENTRIES = 5_000  # of the lexicon at most
PREFIXES = (4, 5, 6)  # bytes
FEATURES = (
    "hits words_per_100 prefixes_per_100 strongest near_you you_per_100 capitals shouted exclaims questions signs "
    "digits_inside signs_inside undone repeats log_words mean_length"
).split()
# Second-person words of English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos "
    "usted ustedes ti tus vosotros"
).split()

# What a byte stands for in a disguised word; 0 is left out.
_PLAIN = LOWER.copy()
for sign in b"!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~":
    _PLAIN[sign] = 0
for sign, letter in zip(b"013457@$", b"oieastas"):
    _PLAIN[sign] = letter
_SOLID = np.zeros(256, bool)  # letters and digits
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words:
    """The words of a text column, with disguises undone."""

    def __init__(self, column: pa.Array):
        raw, offsets = text_bytes(column)
        self.raw, self.offsets = raw, offsets
        starts, ends = word_spans(raw, offsets)
        # From the first letter or digit to the last; words of signs only go.
        solid = np.concatenate([[0], np.cumsum(_SOLID[raw])])
        places = np.flatnonzero(_SOLID[raw])
        real = solid[ends] > solid[starts]
        self.starts, self.ends = starts, ends
        starts, ends = starts[real], ends[real]
        starts, ends = (places[solid[starts]], places[solid[ends] - 1] + 1) if len(starts) else (starts, ends)
        self.core_starts, self.core_ends = starts, ends
        plain = _PLAIN[raw]
        inside = np.zeros(len(raw) + 1, np.int32)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        head = np.zeros(len(raw), bool)
        head[starts] = True
        kept = (np.cumsum(inside[:-1]) > 0) & (plain != 0)
        # A letter that repeats the one before it, within a word, counts once.
        places = np.flatnonzero(kept)
        word = np.cumsum(head)[places]
        again = np.zeros(len(places), bool)
        again[1:] = (plain[places][1:] == plain[places][:-1]) & (word[1:] == word[:-1])
        self.repeats = np.bincount(word[again] - 1, minlength=len(starts))
        kept[places[again]] = False
        count = np.concatenate([[0], np.cumsum(kept)])
        self.data = plain[kept]
        self.begin, self.end = count[starts], count[ends]
        self.hashes = word_hashes(self.data, self.begin, self.end)
        self.rows = np.searchsorted(starts, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.rows))

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are longer than ``size`` bytes, and the hashes of their beginnings."""
        long = np.flatnonzero(self.end - self.begin > size)
        return long, mix(word_hashes(self.data, self.begin[long], self.begin[long] + size) + np.uint64(size))


def _present(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place in the sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def lexicon(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words and beginnings that mark toxic texts, and their weights.

    An entry's toxic texts exceed what chance gives by three standard deviations and are most of
    its texts.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                words = Words(part.column("_text"))
                toxic = part.column("_label").to_numpy()
                found = [(words.hashes, words.row)]
                for size in PREFIXES:
                    long, hashes = words.prefixes(size)
                    found.append((hashes, words.row[long]))
                h, r = (np.concatenate(x) for x in zip(*found))
                pairs = np.unique(np.stack([h, r.astype(np.uint64)], 1), axis=0)  # once a text
                unique, at = np.unique(pairs[:, 0], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(unique.view(np.int64)),
                        pa.array(np.bincount(at, toxic[pairs[:, 1].astype(np.int64)], len(unique)).astype(np.int64)),
                        pa.array(np.bincount(at, minlength=len(unique))),
                    ],
                    names=["h", "t", "n"],
                )

    share = rows.agg(F.avg("_label")).first()[0] or 0.0
    counts = rows.mapInArrow(work, "h bigint, t bigint, n bigint").groupBy("h").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    over = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    best = counts.filter((over >= 3) & (F.col("t") >= 0.6 * F.col("n"))).orderBy(F.desc(over), "h").limit(ENTRIES).toArrow()
    h, t, n = (best[c].to_numpy() for c in ("h", "t", "n"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], ((t + 0.5) / (n + 1))[order]


def _features(column: pa.Array, known: np.ndarray, weights: np.ndarray, you: np.ndarray) -> np.ndarray:
    """``FEATURES`` of every text."""
    words = Words(column)
    n_rows = len(words.offsets) - 1
    per_row = lambda values: np.bincount(words.row, values, n_rows)
    n = np.maximum(np.diff(words.rows), 1)
    at = _present(known, words.hashes)
    word_hit = at >= 0
    weight = np.where(word_hit, weights[at] if len(weights) else 0.0, 0.0)
    prefix_hit = np.zeros(len(at), bool)
    for size in PREFIXES:
        long, hashes = words.prefixes(size)
        found = _present(known, hashes)
        prefix_hit[long] |= found >= 0
        weight[long] = np.maximum(weight[long], np.where(found >= 0, weights[found] if len(weights) else 0.0, 0.0))
    hit = word_hit | prefix_hit
    second = _present(you, words.hashes) >= 0
    near = np.zeros(len(hit), bool)
    for step in (1, 2, 3):
        same = words.row[step:] == words.row[:-step]
        near[step:] |= second[:-step] & same
        near[:-step] |= second[step:] & same
    strongest = np.zeros(n_rows)
    np.maximum.at(strongest, words.row, weight)
    raw = words.raw
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    text = lambda mask: np.diff(upto(mask)[words.offsets])
    core = lambda mask: upto(mask)[words.core_ends] - upto(mask)[words.core_starts]
    capital = (raw >= 65) & (raw <= 90)
    letters = capital | (raw >= 97) & (raw <= 122)
    digit = (raw >= 48) & (raw <= 57)
    signs = ~_SOLID[raw] & (raw > 32)
    size = words.core_ends - words.core_starts
    mixed = (core(digit) > 0) & (core(letters) > 0)
    odd = core(signs) > 0
    chars = np.maximum(np.diff(words.offsets), 1)
    columns = [
        np.log1p(per_row(hit)),
        100 * per_row(word_hit) / n,
        100 * per_row(prefix_hit) / n,
        strongest,
        per_row(hit & near) / np.maximum(per_row(hit), 1),
        100 * per_row(second) / n,
        text(capital) / np.maximum(text(letters), 1),
        per_row((core(capital) == size) & (size > 1)) / n,
        100 * text(raw == 33) / chars,
        100 * text(raw == 63) / chars,
        100 * text(signs) / chars,
        100 * per_row(mixed) / n,
        100 * per_row(odd) / n,
        100 * per_row(hit & (mixed | odd | (words.repeats > 0))) / n,
        100 * per_row(words.repeats > 1) / n,
        np.log1p(np.diff(words.rows)),
        per_row(size) / n,
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)


def is_held_out(doc_id: Column) -> Column:
    """Rows never learned from: the id's CRC-32 is 1 modulo 3; rows without an id as well."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``_id, held_out, score, predicted`` of every row of ``docs``.

    Labels are read only for rows that are not held out, ``SAMPLE`` at most; ids, languages and
    sources are no input of a score.  ``score`` is the calibrated probability, 0.02 of it the trees'
    own, which orders rows of one calibrated step; ``predicted`` is 1 from 0.7 on.

    Null and empty texts are scored by features of no words.  Rows without an id are held out.
    Repeated rows get one score; an id with several labels takes the largest, labels without id or
    value are left out.  If a part has not both labels, all scores are the mean label (0 without labels).
    """
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col(doc_id)))
    some = known.groupBy(F.col(doc_id).alias("_key")).agg(F.max(F.col(label)).cast("int").alias("_label"))
    some = some.orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = rows.join(F.broadcast(some), F.col("_id") == F.col("_key"), "left").select("_id", "_text", "_label")
    part = F.pmod(F.xxhash64(F.lit(6), F.col("_id")), F.lit(10))
    entries, weights = lexicon(rows.filter(F.col("_label").isNotNull() & (part < 5)).select("_text", "_label"))
    you = np.sort(Words(pa.array(SECOND_PERSON)).hashes)
    kind = rows.schema["_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "_text"):
                found = _features(piece.column("_text"), entries, weights, you)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("_id"), piece.column("_label"), *[pa.array(c) for c in found.T]], names=["_id", "_label", *FEATURES]
                )

    schema = f"_id {kind}, _label int, " + ", ".join(f"{f} double" for f in FEATURES)
    table = stored(rows.mapInArrow(work, schema))
    labelled = table.filter("_label is not null").withColumn("_label", F.col("_label").cast("double"))
    fit, calibrate = (stored(labelled.filter(f).coalesce(4)) for f in ((part >= 5) & (part < 8), part >= 8))
    held = is_held_out(F.col("_id")).alias("held_out")
    kinds = [{r[0] for r in x.select("_label").distinct().collect()} for x in (fit, calibrate)]
    if any(len(k) < 2 for k in kinds):
        share = labelled.agg(F.avg("_label")).first()[0] or 0.0
        return table.select("_id", held, F.lit(share).alias("score"), F.lit(int(share >= 0.7)).alias("predicted"))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="_x")
    trees = GBTClassifier(featuresCol="_x", labelCol="_label", maxIter=15, maxDepth=3, stepSize=0.3, minInstancesPerNode=3, seed=7)
    model = trees.fit(vector.transform(fit))
    raw = lambda x: model.transform(vector.transform(x)).withColumn("_p", vector_to_array("probability")[1])
    steps = IsotonicRegression(featuresCol="_p", labelCol="_label", predictionCol="_step").fit(raw(calibrate).select("_p", "_label"))
    scored = steps.transform(raw(table).select("_id", "_p"))
    score = F.col("_step") * 0.98 + F.col("_p") * 0.02
    return scored.select("_id", held, score.alias("score"), (score >= 0.7).cast("int").alias("predicted"))
