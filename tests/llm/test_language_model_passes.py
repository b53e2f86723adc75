"""The passes of the language model over texts and items: right, and in little memory at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from corpusprep.llm import language_model, words


def peak_of(work):
    tracemalloc.start()
    work()
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return top


def test_before_stays_inside_a_text():
    rng = np.random.default_rng(4)
    for sizes in ([0], [1], [2], [3], [0, 1, 0, 2, 5, 0, 3, 1, 1, 4, 0], rng.integers(0, 6, 200).tolist()):
        rows = np.concatenate([[0], np.cumsum(sizes)])
        values = rng.integers(0, 90, rows[-1])
        for steps in (1, 2, 3):
            expected = [values[s + k - steps] if k >= steps else 99 for s, n in zip(rows, sizes) for k in range(n)]
            assert language_model.before(values, rows, steps, 99).tolist() == expected


def test_before_needs_no_more_than_its_result():
    values, rows = np.arange(1 << 20), np.arange(0, (1 << 20) + 1, 1 << 10)
    assert peak_of(lambda: language_model.before(values, rows, 2, -1)) < 1.2 * values.nbytes


def test_hashes_of_long_texts_are_those_of_their_words_in_little_memory():
    rng = np.random.default_rng(5)
    texts = ["w" * 200_000, *(" ".join("".join(chr(97 + x) for x in rng.integers(0, 26, n)) for n in rng.integers(1, 12, 30_000)) for _ in range(3))]
    data, starts, ends, hashes, _ = words.words_of(pa.array(texts))
    at = [0, 1, *rng.integers(0, len(starts), 200).tolist(), len(starts) - 1]
    assert [words.words_of(pa.array([bytes(data[starts[k] : ends[k]]).decode()]))[3][0] for k in at] == hashes[at].tolist()
    # At 2^18 bytes at a time the work on them took 8 MB beside the result.
    own = starts > 200_000
    assert peak_of(lambda: words.word_hashes(data, starts[own], ends[own])) < 4 * 8 * own.sum() + (3 << 20)


def test_neighbours_are_counted_in_no_more_tasks_than_cores(spark, monkeypatch):
    rows = spark.range(0, 64, numPartitions=16).selectExpr("id _id", "id % 7 != 2 _train", "id % 4 _round", "concat('a b c ', id, ' a b') _text")
    split, counted, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), language_model.neighbour_counts, []

    def watched(texts, vocabulary):
        seen.append((texts.rdd.getNumPartitions(), texts.count()))
        return counted(texts, vocabulary)

    monkeypatch.setattr(language_model, "neighbour_counts", watched)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        language_model.fit(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0][0] <= spark.sparkContext.defaultParallelism and seen[0][1] == rows.filter("_train").count()


def test_neighbour_counts_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, n).clip(max=300)) for n in [0, 1, 2, 3, *rng.integers(4, 60, 80)]]
    rows = spark.createDataFrame([(i, True, 0, t) for i, t in enumerate([*texts, None])], "_id bigint, _train boolean, _round bigint, _text string")
    counts = language_model.token_counts(rows.select("_text"))
    vocabulary = language_model.frequent_words(counts, counts.count())
    table = language_model.encoded(rows, vocabulary).select("items")
    expected = np.zeros((vocabulary.items, language_model.CONTEXT))
    for row in table.collect():
        items = np.frombuffer(row["items"], np.uint16).astype(int)
        for k in range(len(items)):
            for past in items[max(k - 3, 0) : k]:
                if past < min(language_model.CONTEXT, vocabulary.own):
                    expected[items[k], past] += 1
    assert (language_model.neighbour_counts(table, vocabulary) == expected).all()
