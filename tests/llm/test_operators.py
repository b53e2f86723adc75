"""Edge cases and brute force on a small fixture: nulls, empty and long texts, ties, repeated rows,
empty tables, and extra columns whose names clash with the operators' own."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusprep.llm import (
    bitmap,
    components,
    decontaminate,
    dual_tree,
    html_text,
    language_model,
    line_dedup,
    near_dup,
    packing,
    resample,
    token_counts,
    toxicity,
)
from corpusprep.llm.queries import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, n bigint, _id string, key string"


def _documents():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    shared = "A shared License line that is longer than forty characters."
    passage = " ".join(vocabulary[:14])
    rows = [(None, "no id here " + passage), (1, None), (2, ""), (3, "One"), (4, "one"), (5, " \t\n"), (6, "é <|endoftext|> ▁x  y\n\n")]
    for i in range(10, 60):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        lines = [" ".join(text), shared.upper() if i % 3 else "  " + shared] if i % 2 else [" ".join(text)]
        rows.append((i, "\n".join(lines + ([passage.title()] if i % 7 == 0 else []))))
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(60, 110):  # a group of near copies larger than a small bucket
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"edit{i}"
        rows.append((i, " ".join(copy)))
    rows += [(200, " ".join(rng.choice(vocabulary) for _ in range(30_000))), rows[20], rows[20]]
    return rows


ROWS = _documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, "x", "y") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 2) for i in range(0, 110)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_resampling_keeps_exactly_k(docs, none, labels):
    rows = resample.resample(docs, labels, k=20).collect()
    assert len(rows) == len(ROWS)
    keys = sorted((r.sample_key for r in rows), reverse=True)
    assert {r.sample_key for r in rows if r.kept} == {k for k in keys if k >= keys[19]}
    assert all(r.log_weight == 0 for r in rows if r.n_features == 0)
    kept = resample.sampled(docs, labels, k=20)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in rows)
    assert resample.resample(none, labels).count() == 0
    assert all(r.kept for r in resample.resample(docs, labels.limit(0)).collect())


def test_packing_is_gapless_and_whole(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, length=64).collect()
    expected = sorted(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for _, t in ROWS)
    laid = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32
        laid[p.sequence_id * 64 + p.offset] = (p.start, ids, p.doc_tokens)
    at, found, now = 0, [], []
    while at in laid:
        start, ids, size = laid[at]
        assert start == len(now)
        now += ids.tolist()
        if len(now) == size:
            found.append(tuple(now))
            now = []
        at += len(ids)
    assert sorted(found) == expected and at == sum(map(len, expected))
    assert packing.pack(none, path).count() == 0


def test_hilbert_curve_visits_every_cell_by_single_steps():
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_tokenizer_spans_give_the_tokenizers_ids():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer, cache, rng = Tokenizer.from_file(path), packing.word_ids(path), random.Random(3)
    parts = ["a", "B", "it's", "'LL", "’", " ", "\n", "É", "́", "漢", "12", "…", ",", "!!", "_", "<|endoftext|>", "<|", "\xa0", "İ"]
    for _ in range(10):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(100)]
        data, starts, ends, rows = packing.tokenizer_spans(pa.array(texts))
        flat, sizes = cache.of(data, starts, ends, packing.word_hashes(data, starts, ends))
        bounds = np.concatenate([[0], np.cumsum(sizes)])[rows]
        for text, s, e in zip(texts, bounds, bounds[1:]):
            assert flat[s:e].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_line_dedup_by_hand(docs, none):
    blanks = " \t\n\x0b\x0c\r"
    keys = [[x.strip(blanks).translate(LOWER) for x in (t or "").split("\n")] for _, t in ROWS]
    holders = {}
    for (i, _), lines in zip(ROWS, keys):
        for line in lines:
            if len(line) >= 40:
                holders.setdefault(line, set()).add(i)
    last = {k: max(x for x in v if x is not None) for k, v in holders.items() if len(v) >= 5}
    expected = []
    for (i, t), lines in zip(ROWS, keys):
        raw = (t or "").split("\n")
        kept = [a for a, b in zip(raw, lines) if b not in last or last[b] == i]
        expected.append((str(i), len(raw), len(raw) - len(kept), "\n".join(kept)))
    found = line_dedup.keep_bitmaps(docs)
    assert set(docs.columns) < set(found.columns)
    got = found.select(F.col("doc_id").cast("string"), "n_lines", "n_dropped", line_dedup.kept_text(F.col("text"), F.col("keep_runs")))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(expected)
    assert line_dedup.keep_bitmaps(none).count() == 0


def test_prefix_counts_equal_the_library_at_every_prefix(docs, none):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = token_counts.prefix_counts(docs, path).select("text", "n_bytes", "n_tokens", "prefix_steps", "key").collect()
    for r in rows:
        text = r.text or ""
        assert (r.n_bytes, r.n_tokens, r.key) == (len(text.encode()), len(model.encode(text)), "y")
        counts = np.cumsum(np.frombuffer(r.prefix_steps, np.int8), dtype=np.int64)
        for k in range(1, min(len(text), 60) + 1):
            assert counts[k] == len(model.encode(text[:k]))
    short = token_counts.truncated(token_counts.prefix_counts(docs, path), 10).select("text", "fit_text").collect()
    assert all(len(model.encode(r.fit_text)) <= 10 and (r.text or "").startswith(r.fit_text) for r in short)
    assert token_counts.prefix_counts(none, path).count() == 0


def test_texts_without_spaces_equal_the_library_in_linear_time():
    import base64
    import time

    counter = token_counts.PrefixCounter(tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(8)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x4E00 + 900)) for _ in range(20_000))
    texts = [cjk, base64.b64encode(rng.randbytes(30_000)).decode(), "ab" * 9_000, "é😀x" * 3_000, "letters" * 4_000, "▁" * 500]
    counter.counts_along(" warm")
    for text in texts:
        at = time.process_time()
        steps, sizes = counter._steps_of([" " + text])
        assert time.process_time() - at < 8
        counts = np.cumsum(steps, dtype=np.int64)[1:]
        assert sizes.tolist() == [len(text) + 1]
        for k in [1, 2, 3, 50, 199, len(text) // 2, len(text)]:
            if k <= len(text):
                assert counts[k - 1] == len(counter.model.encode(text[:k]))
    # The two ways agree at every prefix.
    some = ["▁" + t[:300] for t in texts]
    table, _ = counter.counts(some)
    for row, text in zip(table, some):
        assert (row[: len(text) + 1] == counter.counts_along(text)).all()


def test_main_text(spark):
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/x'>Home</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies, please agree.</div><article><h1>Big &amp; small</h1>"
        "<p>First <b>bold</b>\n text,   with marks.<p>Second one, longer, with more words in it.<br>Still here.</p>"
        "<form>Mail <input></form><div class=ad>Buy now, cheap things, today only!</div></article>"
        "<div id='comments'><p>Nice article, thank you, very much so.</p></div><footer>Imprint</footer></body>"
    )
    rows = [(1, page, "a"), (2, None, "b"), (3, "", "c"), (4, "plain &lt;text&gt;", "d"), (5, "<p>open", "e")]
    frame = spark.createDataFrame(rows, "page_id bigint, html string, n_blocks string")
    got = {r.page_id: r.main_text for r in html_text.main_text(frame).collect()}
    assert got[1] == "Big & small\nFirst bold text, with marks.\nSecond one, longer, with more words in it. Still here."
    assert (got[2], got[3], got[4], got[5]) == ("", "", "plain <text>", "open")
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_slug_words_are_no_veto():
    long = lambda n: f"Sentence {n} of the text, which is long enough, has marks, and goes on for a while. " * 3
    kept = "".join(
        f"<{tag} id='{slug}'><h2 id='related-work-{i}'>Title {i}</h2><p>{long(i)}</p></{tag}>"
        for i, (tag, slug) in enumerate([("section", "intro"), ("section", "search-algorithms"), ("section", "social-impact"), ("div", "ad-spending-2020")])
    )
    gone = "".join(f"<div class='{slug}'><p>Gone, {long(9)}</p></div>" for slug in ("post-comments", "entry-footer", "page-sidebar"))
    got = html_text.main_blocks(f"<body><article>{kept}{gone}</article></body>")
    assert got == [x for i in range(4) for x in (f"Title {i}", long(i).strip())]
    assert html_text.main_blocks(f"<body><div class='layout has-sidebar'><p>{long(1)}</p></div></body>") == [long(1).strip()]


def test_all_blocks_of_the_article_stay():
    long = "A sentence of the text, which is long enough, has marks, and goes on for a while. " * 8
    blocks = ["<div>Short lead</div>", f"<p>{long}</p>", f"<p>{long}</p>", "<p><a href='/x'>One linked paragraph</a></p>", "<section>Bare</section>", f"<p>{long}</p>"]
    sources = "".join(f"<li><a href='/{i}'>Author {i}: A title of some work. Journal, 20{i}.</a></li>" for i in range(10, 14))
    menu = "".join(f"<div><a href='/{i}'>Topic {i}</a></div>" for i in range(4))
    got = html_text.main_blocks(f"<body><article>{''.join(blocks)}<ul>{sources}</ul><center>{menu}</center></article></body>")
    plain = long.strip()
    assert got == ["Short lead", plain, plain, "One linked paragraph", "Bare", plain, *(f"Author {i}: A title of some work. Journal, 20{i}." for i in range(10, 14))]


def test_toxicity_learns_words_and_beginnings(spark, none, labels):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioubdfgkmnpr") for _ in range(5)) for _ in range(200)]
    rows, marks = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(30)]
        if toxic:
            text[3:3] = ["you", rng.choice(["Vilz0", "vilzo", "zuxta" + rng.choice(words)])]
            text[20:20] = [rng.choice(["vilzo!!", "zuxta" + rng.choice(words)])]
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    rows += [(None, "x"), (1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    truth = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    got = toxicity.scores(docs, truth).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r._id is not None and r._id < 900]
    assert all(r.held_out == (zlib.crc32(str(r._id).encode()) % 3 == 1) for r in got if r._id is not None)
    right = sum((r.predicted == 1) == (r._id % 5 == 0) for r in held)
    assert right >= 0.97 * len(held)
    assert toxicity.scores(none, labels).count() == 0
    assert {r.score for r in toxicity.scores(docs, truth.limit(0)).collect()} == {0.0}


def test_language_model_counts_and_gain(docs, none):
    got = language_model.scores(docs).collect()
    texts = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]) for i, t in ROWS]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = {}
    for i, tokens in texts:
        if not held(i):
            for t in tokens:
                counts[t] = counts.get(t, 0) + 1
    total = sum(counts.values())
    base = lambda ts: sum(np.log10((counts.get(t, 0) + 1) / (total + len(counts) + 1)) for t in ts)
    expected = sorted((str(i), held(i), len(ts), sum(t in counts for t in ts), total, round(base(ts), 4)) for i, ts in texts)
    assert sorted((str(r._id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model.scores(none).count() == 0


def test_language_model_learns_from_every_position(spark):
    # One round has all training texts; with its end each has a multiple of four tokens, so that
    # every fourth position is always the same word.
    ids = spark.range(2000).withColumnRenamed("id", "doc_id")
    train = ids.filter(language_model.is_training(F.col("doc_id")) & (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) == 0)).limit(120)
    held = ids.filter(~language_model.is_training(F.col("doc_id"))).limit(3)
    rows = train.unionAll(held).select("doc_id", F.concat(F.repeat(F.lit("ab cd ef gh "), 500), F.lit("ab cd ef")).alias("text"))
    for r in language_model.scores(rows).filter("held_out").collect():
        assert r.score / r.n_tokens > -0.1 and r.base_score / r.n_tokens < -0.5


def test_language_model_tells_words_of_a_class_apart(spark):
    # Each of 200 equally frequent words follows one other: 32 classes alone leave six words for each.
    cycle = " ".join(f"w{i}" for i in range(200))
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.expr(f"array_join(array_repeat('{cycle}', 6), ' ')").alias("text"))
    for r in language_model.scores(rows).filter("held_out").limit(5).collect():
        assert r.score / r.n_tokens > -0.3 and r.base_score / r.n_tokens < -2


def test_language_model_gradient_sums_every_occurrence():
    rng = np.random.default_rng(8)
    n, size = 700, 64
    found = np.minimum(rng.zipf(1.3, (4, n)) - 1, size - 1)
    weights = rng.normal(size=(size, 32)).astype(np.float32)
    share = np.log(rng.dirichlet(np.ones(32), n)).astype(np.float32)
    target = rng.integers(0, 32, n)
    expected, uses = np.zeros((size, 32)), np.zeros(size)
    for i in range(n):
        logits = [share[i, b] + sum(float(weights[found[k, i], b]) for k in range(4)) for b in range(32)]
        over = sum(np.exp(x) for x in logits)
        for k in range(4):
            uses[found[k, i]] += 1
            for b in range(32):
                expected[found[k, i], b] += (b == target[i]) - np.exp(logits[b]) / over
    touched, slope, times = language_model.gradient(share.copy(), weights, found, target)
    assert touched.tolist() == np.flatnonzero(uses).tolist() and times.tolist() == uses[touched].astype(int).tolist()
    assert np.allclose(slope, expected[touched], atol=1e-3)


def test_language_model_scores_are_those_of_a_plain_softmax(spark):
    # Scores of small texts by loops over tokens, nodes and branches, from the fitted weights.
    texts = ["the cat sat", "", None, "a dog sat on the mat", "The CAT ran", "zebra unseen words"] * 30
    rows = spark.createDataFrame([(i, not i % 7 == 2, i % 4, t) for i, t in enumerate(texts)], "_id bigint, _train boolean, _round bigint, _text string")
    model, table, counts, total, types = language_model.fit(rows)
    tree, words, bits = model.tree, model.words, len(model.weights).bit_length() - 1
    assert np.abs(model.weights).max() > 0.05
    got = {r._id: r for r in table.collect()}
    for i in range(12):
        items = np.frombuffer(got[i].items, np.uint16).astype(int)
        assert len(items) == got[i].n_tokens == len((texts[i] or "").split()) + 1
        expected = []
        for k, item in enumerate(items):
            past = [int(items[k - s]) if k >= s else words.items for s in (1, 2, 3)]
            kinds = [past[0], past[1] * 65537 + past[0], past[1], past[2]]
            log = 0.0
            for step in range(tree.start[item], tree.start[item + 1]):
                node = int(tree.node[step])
                keys = [np.array([(v * 8 + j + node * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64) for j, v in enumerate(kinds)]
                feature = [int(language_model.mix(key)[0] >> np.uint64(64 - bits)) for key in keys]
                logits = [float(tree.share[node, b]) + sum(float(model.weights[f, b]) for f in feature) for b in range(32)]
                log += logits[tree.branch[step]] - np.log(sum(np.exp(x) for x in logits))
            expected.append(log / np.log(10))
        assert np.allclose(model.log10s(items, np.array([0, len(items)])), expected, atol=1e-4)
    # After any history the items' probabilities sum to one.
    every = np.arange(words.items)
    at, node, branch = tree.steps(every)
    keys = np.repeat(language_model.histories(np.array([3, 1, 2, 0]), np.array([0, 4]), words.items)[:, 3:], len(at), 1)
    logits, _, over = language_model.softmax(tree.share.take(node, 0), model.weights, language_model.features_of(keys, node, bits))
    reached = np.bincount(at, logits[np.arange(len(at)), branch] - np.log(over), words.items)
    assert abs(np.exp(reached).sum() - 1) < 1e-3


def test_language_model_tree_reaches_every_item_by_its_share():
    rng = np.random.default_rng(3)
    mass, item_class = rng.integers(1, 1000, 5000).astype(float), np.minimum(rng.integers(0, 60, 5000), 31)
    tree = language_model.tree_of(item_class, mass)
    at, node, branch = tree.steps(np.arange(5000))
    assert np.allclose(np.bincount(at, tree.share[node, branch]), np.log(mass / mass.sum()), atol=1e-4)
    assert len({tuple(zip(node[at == i], branch[at == i])) for i in range(5000)}) == 5000


def test_language_model_tree_has_short_paths():
    # A root over 32 classes and the shortest code inside each: 2.626; equal parts below a class took 2.640.
    mass = 1e6 / np.arange(51, 20051.0)
    tree = language_model.tree_of(np.arange(20000) % 32, mass)
    steps = (np.diff(tree.start) * mass).sum() / mass.sum()
    entropy = -(mass / mass.sum() * np.log2(mass / mass.sum())).sum() / 5
    assert entropy <= steps < 2.63
    mass[:5] = mass.sum() / 50
    near = np.random.default_rng(1).integers(0, 50, (20000, language_model.CONTEXT)).astype(float)
    item_class = language_model.classes_of(near, mass)
    assert len(set(item_class)) <= 32 and np.bincount(item_class)[item_class[:5]].tolist() == [1] * 5
    assert (language_model.tree_of(item_class, mass).start[:6] == np.arange(6)).all()


def test_language_model_run_sums_of_all_lengths():
    rng = np.random.default_rng(2)
    values = rng.normal(size=(900, 32)).astype(np.float32)
    for lengths in ([1], [1, 1, 1], [2], [16, 17, 1, 300, 15, 2, 33], rng.zipf(1.4, 200).clip(max=500)):
        order = rng.integers(0, 900, sum(lengths))
        head = np.cumsum(lengths) - lengths
        expected = [values[order[s : s + n]].astype(float).sum(0) for s, n in zip(head, lengths)]
        assert np.allclose(language_model.run_sums(values, order, head), expected, atol=1e-4)


def test_dual_tree_search_is_exact(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.05]) for i in range(300)]
    rows += [(i, rows[50][1]) for i in range(300, 420)]  # ties
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    expected = []
    for q, v in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:5]
            expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    rows += [(None, rows[0][1]), (1000, None), (1050, [1.0, None] * 4), (1100, [float("nan")] * 8), (1150, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = dual_tree.top_k(frame, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    assert dual_tree.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_cover_tree_prunes_and_keeps_all_rows():
    points = np.repeat(np.arange(200.0)[:, None], 3, 1)
    tree = dual_tree.CoverTree(points)

    def leaves(node):
        assert (np.linalg.norm(points[node.rows] - node.centre, axis=1) <= node.radius + 1e-9).all()
        return [node.rows] if not node.children else sum((leaves(c) for c in node.children), [])

    assert sorted(np.concatenate(leaves(tree))) == list(range(200)) and tree.children


def test_contamination_by_hand(spark, docs, none):
    items = [(1, " ".join(ROWS[0][1].split()[3:])), (2, "one"), (3, None), (4, "never seen anywhere at all"), (None, "ONE")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add("null" if i is None else str(i))
    expected = []
    for i, t in ROWS:
        w, hit, names = split(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[s : s + k]))) is not None:
                    hit |= set(range(s, s + k))
                    names |= found
        expected.append((str(i), len(w), len(hit), sorted(names)))
    got = decontaminate.contamination(docs, bench).collect()
    assert sorted((str(r._id), r.n_words, r.n_hit, r.item_ids) for r in got) == sorted(expected)
    assert sum(n > 0 for _, _, n, _ in expected) > 5
    assert decontaminate.contamination(none, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.contamination(docs, bench.limit(0)).collect())


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_by_brute_force(docs, none, width, percent):
    sets = {}
    for i, t in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        if i is not None:
            sets[i] = {tuple(w[s : s + width]) for s in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if i < j and common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = near_dup.near_duplicates(docs, width=width, percent=percent).collect()
    assert {(r._id, r.n_shingles, r.component_id) for r in got if r._id is not None} == {(i, len(s), find(i)) for i, s in sets.items()}
    assert all(r.component_id is None for r in got if r._id is None)
    assert near_dup.near_duplicates(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 600 + i) for i in range(50)] + [(7, 7)]
    got = components.smallest_reachable(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in range(101)} | {(i, 500) for i in [500, *range(600, 650)]}


def _smallest(edges):
    least = {x: x for e in edges for x in e}
    while True:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


@pytest.mark.parametrize("rows", [bitmap.FEW, 0])
def test_components_of_any_links_sent_or_shuffled(spark, monkeypatch, rows):
    monkeypatch.setattr(bitmap, "FEW", rows)
    rng = random.Random(3)
    edges = [(900, i) for i in range(800, 830)] + [(i, (i * 7 + 3) % 40 + 300) for i in range(300, 340)]
    edges += [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(2, 1), (1, 2)]
    edges = [(a, b) for a, b in edges if a != b]
    got = components.smallest_reachable(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted(_smallest(edges).items())
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert components.smallest_reachable(none).collect() == []


def test_few_links_take_few_tasks(spark):
    partitions = 40
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint").coalesce(1)
    tracker = spark.sparkContext.statusTracker()
    try:
        for k, v in zip(kept, (str(partitions), "false")):
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("components", "few links")
        components.smallest_reachable(edges).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    infos = [tracker.getStageInfo(s) for s in stages]
    assert 0 < sum(i.numCompletedTasks for i in infos if i) < 8 * partitions


@pytest.mark.parametrize("rows", [bitmap.FEW, 0])
def test_likely_rows_sent_or_mapped(spark, monkeypatch, rows):
    monkeypatch.setattr(bitmap, "FEW", rows)
    table = spark.createDataFrame([(i, i * 3, str(i)) for i in range(1000)], "x bigint, key bigint, y string")
    values = spark.createDataFrame([(30,), (30,), (2997,), (7,)], "key bigint")
    got = bitmap.likely(table, "key", values, "key")
    assert got.columns == ["x", "key", "y"]
    found = sorted(r.x for r in got.collect())
    assert {10, 999} <= set(found) and len(found) == len(set(found)) < 40


def test_near_duplicates_when_nothing_is_few(spark, monkeypatch):
    rows = [(i, t) for i, t in ROWS if i is not None and i < 110]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    take = lambda: sorted(tuple(r) for r in near_dup.near_duplicates(frame, width=3, percent=85).collect())
    sent = take()
    monkeypatch.setattr(bitmap, "FEW", 0)
    assert take() == sent


def test_kept_digest_is_of_the_text(docs):
    row = line_dedup.keep_bitmaps(docs).filter("doc_id = 3").select("text", F.sha2(line_dedup.kept_text(F.col("text"), F.col("keep_runs")), 256)).first()
    assert row[1] == hashlib.sha256(row[0].encode()).hexdigest()


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = "a shared line that is certainly longer than forty characters"
    rows = [(i, f"own {i}\n{line}", *["kept"] * 5) for i in range(6)]
    schema = "doc_id bigint, text string, _fp string, _ld_fp string, _ld_id string, _c0 string, `a.b` string"
    got = line_dedup.keep_bitmaps(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()
    assert [r.n_dropped for r in got] == [1, 1, 1, 1, 1, 0] and {tuple(r)[2:7] for r in got} == {("kept",) * 5}
