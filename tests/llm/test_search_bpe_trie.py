"""Ranked search, byte-level BPE and the conversation trie against brute force, and their odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusprep.llm import byte_bpe, conversation_trie, max_sketch
from corpusprep.llm.queries import tokenizer_path
from corpusprep.llm.words import text_bytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS = "byte_bpe_multi_50k.tiktoken"


# ---------------------------------------------------------------- ranked search
def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def _ranking(docs, queries, k):
    counted = [(i, Counter(_terms(t)), len(_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, c, n in counted:
            m = 25 + 75 * n * n_docs // max(n_terms, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in _terms(text)
                if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return out


def _texts(rng):
    words = [f"w{i}" for i in range(150)] + ["été", "漢字", "Naïve", "3D"]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([5, 40, 154])]) for _ in range(rng.randint(1, 90)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, " .,!? "), (503, "w1 " * 70_000 + "Rare"), (504, "RARE rare-rare"), (None, "rare w7")]
    return docs + docs[:3] + [(i, "tie breaker") for i in (900, 700, 800)]


@pytest.mark.parametrize("slots", [2048, 4])
def test_search_equals_brute_force(spark, slots):
    docs = _texts(random.Random(3))
    queries = [(1, "w3 w3 W9 rare"), (2, None), (3, ""), (4, "Tie"), (5, "unknown"), (6, " ".join(f"w{i}" for i in range(150))), (7, "été 漢字")]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, n int, _id string").repartition(3)
    asked = spark.createDataFrame([(*q, 1) for q in queries + queries[:1]], "item_id bigint, text string, rank int")
    index = max_sketch.index(table, slots=slots)
    got = sorted(tuple(r) for r in max_sketch.search(index, asked, 6).select("item_id", "rank", "doc_id", "score").collect())
    assert got == sorted(_ranking(docs, queries, 6))


def test_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(max_sketch, "QUERIES", 2)
    docs = _texts(random.Random(4))
    queries = [(i, f"w{i} w{i + 1} rare") for i in range(5)]
    index = max_sketch.index(spark.createDataFrame(docs, "doc_id bigint, text string"))
    got = sorted(tuple(r) for r in max_sketch.search(index, spark.createDataFrame(queries, "item_id bigint, text string"), 3).collect())
    assert got == sorted(_ranking(docs, queries, 3))


def test_bounds_hold_and_spare_exact_scores():
    rng = np.random.default_rng(5)
    terms = [np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64)) for _ in range(3000)]
    asked = [rng.choice(np.concatenate(terms), 4) for _ in range(5)]
    known = {int(t): 1000 for q in asked for t in q}
    best = max_sketch.Searcher(asked, known, (3000, 180_000), 10, 2048)
    for s in range(0, 3000, 500):
        some = terms[s : s + 500]
        peaks = np.zeros((500, 2048), np.uint8)
        for row, t in enumerate(some):
            peaks[row, (t & np.uint64(2047)).astype(int)] = 1
        bounds = np.cumsum([0, *map(len, some)])
        flat = np.concatenate(some)
        best.add(np.arange(s, s + 500), np.diff(bounds), peaks, flat, np.ones(len(flat), np.int64), bounds)
    want = {q: {i for i, t in enumerate(terms) if np.isin(asked[q], t).any()} for q in range(5)}
    assert all(want[q] == set(best.id[best.query == q]) for q in range(5))
    assert best.scored < best.bounded / 4


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert max_sketch.search(max_sketch.index(docs), asked).collect() == []
    full = max_sketch.index(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    assert max_sketch.search(full, asked.limit(0)).collect() == []
    assert [r.doc_id for r in max_sketch.search(full, asked).collect()] == [1]


# ---------------------------------------------------------------- byte-level BPE
@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    bpe = byte_bpe.encoder(tokenizer_path(RANKS))
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_the_pattern_is_the_one_of_the_files():
    import public_tokenizers

    assert public_tokenizers.PATTERN == byte_bpe.PATTERN


def _fuzz(rng):
    parts = ["'", "s", "t", "r", "e", "v", "l", "m", "d", " ", "  ", "\n", "\t", " ", "　", "1", "²", "é", "漢", "!", "-", "a", "B"]
    parts += ["𝒳", "̀", "\x00", "�", "''", "'ll", "'re", "͸", "<|endoftext|>", "\U00011f02"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    long = ["x" * 5000, "漢字" * 3000, " " * 4000 + "a", "'" * 3000, "".join(rng.choice("abcdef") for _ in range(20_000)), "the end " * 30_000]
    return [None, "", *texts, *long, *texts[:5]]


def test_encoding_and_decoding_equal_the_library(spark, library):
    texts = _fuzz(random.Random(6))
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids int, _value string, _c0 string").repartition(3)
    path = tokenizer_path(RANKS)
    encoded = byte_bpe.encode(docs, path)
    assert encoded.columns == ["doc_id", "text", "_value", "_c0", "ids", "id_ends"]
    got = byte_bpe.decode(encoded, path).collect()
    assert len(got) == len(rows)
    bpe = byte_bpe.encoder(path)
    for r in got:
        text = r.text or ""
        assert r.ids == library.encode_ordinary(text) and bytes(r.decoded) == text.encode() and (r._value, r._c0) == ("x", "y")
        assert r.id_ends == np.cumsum(bpe.sizes[np.array(r.ids, int)]).tolist()


def test_an_encoded_text_is_read_in_places():
    bpe = byte_bpe.encoder(tokenizer_path(RANKS))
    text = "It's a naïve 漢字 test, isn't it?".encode()
    data, offsets = text_bytes(pa.array([text.decode()]))
    ids, ends, _ = bpe.encode(data, offsets)
    for first in range(len(text) + 1):
        for last in range(first, len(text) + 1):
            assert byte_bpe.bytes_between(bpe, ids, ends, first, last) == text[first:last]


def test_two_slices_of_one_hash_are_told_apart(monkeypatch, library):
    bpe = byte_bpe.ByteBpe(tokenizer_path(RANKS))
    monkeypatch.setattr(byte_bpe, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    data, offsets = text_bytes(pa.array(["one two six", "abc"]))
    ids, _, bounds = bpe.encode(data, offsets)
    assert ids[: bounds[1]].tolist() == library.encode_ordinary("one two six")


def test_encoding_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    path = tokenizer_path(RANKS)
    assert byte_bpe.decode(byte_bpe.encode(docs, path), path).collect() == []


# ---------------------------------------------------------------- conversation trie
def _brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in sorted(built.items()):
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
    return {
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items()
    }


def _conversations(rng):
    texts = ["", "hi", "héllo", "漢字", None, "x" * 300]
    rows = []
    for c in [*range(-7, 120), 1000, 1002, 5004]:
        if c % 11 == 3:
            continue
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts[: rng.choice([1, 2, 6])])) for t in range(rng.randint(1, 14))]
    for c in range(200, 260):  # copies, and prefixes of copies
        rows += [(c, t, "user", f"turn {t}") for t in range(9 + c % 3)]
    rows += [(300, t, "user", f"{t % 7}") for t in range(70)] + [(301, t, "user", f"{t % 7}") for t in range(70)]
    rows += [(400, None, "user", "first"), (400, 0, "user", "b"), (400, 0, "user", "a"), (400, -5, None, "before")]
    rows += [(None, 0, "user", "nobody"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("batch", ["10000", "3", "1"])
def test_trie_equals_brute_force(spark, batch):
    rows = _conversations(random.Random(7))
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn int, role string, text string, depth int, k1 string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [tuple(r) for r in conversation_trie.conversation_trie(table).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == _brute_trie(rows)


def test_closing_parentheses():
    rng = random.Random(8)
    for n in (1, 2, 70, 3000):
        opens, depth, left = [], 0, n
        while left or depth:
            go = left and (not depth or rng.random() < 0.52)
            opens.append(bool(go))
            depth, left = depth + (1 if go else -1), left - bool(go)
        # One tree needs one root around the forest.
        whole = np.array([True, *opens, False])
        stack, want = [], {}
        for i, o in enumerate(whole.tolist()):
            if o:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = np.flatnonzero(whole)
        assert conversation_trie.Parentheses(whole).find_close(at).tolist() == [want[i] for i in at.tolist()]


def test_trie_of_an_empty_table(spark):
    table = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversation_trie.conversation_trie(table).collect() == []


def test_conversations_without_turns_left(spark):
    # crc32("2") % 9 is at least 1 here, so the only turn goes and the first of the group is absent.
    rows = [(c, 0, "user", "x") for c in range(1, 5)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert {tuple(r) for r in conversation_trie.conversation_trie(table).collect()} == _brute_trie(rows)
