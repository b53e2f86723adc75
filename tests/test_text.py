import base64
import math
import random
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from corpusprep.operators import ngrams, relations, retrieval, text


def one(spark, value, fn, ddl="text string"):
    return fn(spark.createDataFrame([(value,)], ddl)).first()[0]


def test_clean_corpus(spark):
    assert one(spark, "a\x00b�c\x07d͸e\tf\ng h​i", text.clean_corpus) == "abcde f g hi"


def test_clean_corpus_of_every_code_point(spark):
    def cleaned(texts):
        out = []
        for t in texts:
            kept = [c for c in t if c in "\t\n\r" or not (c in "\0\ufffd" or unicodedata.category(c)[0] == "C")]
            out.append("".join(" " if c in "\t\n\r" or unicodedata.category(c) == "Zs" else c for c in kept))
        return out

    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(points[i : i + 512]) for i in range(0, len(points), 512)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert [r.text for r in text.clean_corpus(rows).orderBy("id").collect()] == cleaned(texts)


def test_space_cjk(spark):
    assert one(spark, "a字b\U00020000", text.space_cjk) == "a 字 b \U00020000 "


def test_strip_accents_equals_python(spark):
    s = "Éçã ñ 각 ﬁ Å"
    want = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    assert one(spark, s, text.strip_accents) == want


def test_squeeze(spark):
    assert one(spark, " a \t b-c ", lambda d: relations.squeeze_whitespace(d, separate=True)) == "a b - c"


def test_tokenize(spark):
    df = spark.createDataFrame([(1, "ab,c!!  ^d"), (2, "  ")], "doc_id int, text string")
    rows = text.tokenize(df, "doc_id").orderBy("pos").collect()
    assert [r.token for r in rows] == ["ab", ",", "c", "!", "!", "^", "d"]
    steps = text.tokenize(spark.createDataFrame([(1, "É字x\x00")], "doc_id int, text string"), "doc_id", steps=("clean", "cjk", "accents", "lower"))
    assert [r.token for r in steps.orderBy("pos").collect()] == ["e", "字", "x"]


def test_decode_base64(spark):
    cells = [None, "nan", "w6k=", "a", base64.b64encode(b"\xff").decode(), "w6\nk=", "YWI"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r.c for r in text.decode_base64_column(df, "c").orderBy("i").collect()]
    assert got == [" ", " ", "é", " ", " ", "é", " "]


def test_to_text(spark):
    assert one(spark, bytearray(b"a\xffb\xc3\xa9"), lambda d: text.to_text(d, "b"), "b binary") == "abé"


def test_vocab_and_encoding(spark):
    lines = spark.createDataFrame([(0, " a"), (1, "b"), (2, "a"), (3, "")], "line_no bigint, line string")
    assert {r.token: r.id for r in text.build_vocab(lines).collect()} == {"a": 2, "b": 1, "": 3}
    vocab = spark.createDataFrame([("the", 5)], "token string, id bigint")
    docs = spark.createDataFrame([(1, ["The", "cat"]), (2, [])], "doc_id int, tokens array<string>")
    ids = lambda **kw: {r.doc_id: r.ids for r in text.encode_tokens(docs, vocab, "doc_id", **kw).collect()}
    assert ids(max_len=4) == {1: [5, 1, 0, 0], 2: [0, 0, 0, 0]}
    assert ids(max_len=1) == {1: [5], 2: [0]}
    assert ids() == {1: [5, 1], 2: []}
    assert ids(uncased=False) == {1: [1, 1], 2: []}


def test_truncate_pairs_equals_step_by_step_lengths(spark):
    rows = [(i, [f"a{k}" for k in range(i % 13)], [f"b{k}" for k in range(i // 13)]) for i in range(169)]
    df = spark.createDataFrame(rows, "id int, tokens_a array<string>, tokens_b array<string>")
    for m in (5, 8):
        for r in text.truncate_pairs(df, "id", m).collect():
            a, b = rows[r.id][1], rows[r.id][2]
            la, lb = len(a), len(b)
            while la + lb > m:
                if la > lb:
                    la -= 1
                else:
                    lb -= 1
            assert (len(r.tokens_a), len(r.tokens_b)) == (la, lb)
            for full, cut in ((a, r.tokens_a), (b, r.tokens_b)):
                assert any(full[k : k + len(cut)] == cut for k in range(len(full) - len(cut) + 1))


def _grams(s, num):
    counts, left, right = Counter(), {}, {}
    for j in range(1, num + 1):
        for i in range(len(s)):
            if i + j < len(s) - num - 2:
                g = s[i : i + j]
                counts[g] += 1
                left.setdefault(g, []).append(s[i - 1])
                right.setdefault(g, []).append(s[i + j])
    return counts, left, right


def test_char_ngrams(spark):
    rng = random.Random(0)
    texts = ["", "abcdef", "\n😀ab😀ab\nab😀abab"] + ["".join(rng.choice("ab\n") for _ in range(80)) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    plain, full = {}, {}
    for r in ngrams.char_ngrams(df, "doc_id", num=3).collect():
        plain.setdefault(r.doc_id, {})[r.gram] = (r.cnt, r.freq)
    for r in ngrams.char_ngrams(df, "doc_id", num=3, neighbours=True).collect():
        full.setdefault(r.doc_id, {})[r.gram] = (r.cnt, r.left, r.right)
    for i, s in enumerate(texts):
        counts, left, right = _grams(s, 3)
        assert plain.get(i, {}) == {g: (c, c / len(s)) for g, c in counts.items()}
        assert full.get(i, {}) == {g: (c, left[g], right[g]) for g, c in counts.items()}


def test_bm25_equals_formula(spark):
    docs = {1: "a b b c", 2: "a d", 3: "e e e", 4: "b"}
    query = "b b a z"
    toks = {k: v.split() for k, v in docs.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(t for v in toks.values() for t in set(v))

    def score(words):
        total = 0.0
        for q in query.split():
            tf, qf = words.count(q), query.split().count(q)
            if tf:
                idf = math.log((n - df[q] + 0.5) / (df[q] + 0.5))
                total += idf * tf * 3 / (tf + 2 * (0.5 + 0.5 * len(set(words)) / avg)) * qf * 2 / (qf + 1)
        return total

    d = spark.createDataFrame([(k, v) for k, v in toks.items()], "doc_id int, tokens array<string>")
    q = spark.createDataFrame([(9, query.split())], "query_id int, tokens array<string>")
    scores = retrieval.bm25(d, q)
    got = {r.doc_id: r.score for r in scores.collect()}
    assert set(got) == {1, 2, 4}
    assert all(math.isclose(got[k], score(toks[k]), rel_tol=1e-12) for k in got)
    pairs = spark.createDataFrame([(9, 3), (9, 4)], "query_id int, doc_id int")
    assert {r.doc_id: round(r.score, 6) for r in retrieval.score_pairs(pairs, scores).collect()} == {3: 0.0, 4: round(score(["b"]), 6)}
    assert retrieval.top_documents(scores, 2).select(F.max("rank")).first()[0] == 2


def test_char_ngrams_are_counted_outside_of_row_expressions(spark, monkeypatch):
    """Nulls, repeated and missing ids, astral characters and alphabets past 63 bits; no expression of every gram's text."""
    wide = "".join(chr(0x4E00 + i * 7919 % 9000) for i in range(900)) * 2
    rows = [(1, None), (2, ""), (3, "abcdefgh"), (4, "abababababab😀😀x"), (4, "abababababab😀😀x"), (None, "é\n" * 9), (5, wide)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    monkeypatch.setattr(ngrams, "CHARACTERS", 40)
    want = Counter()
    for i, t in rows:
        one = Counter(t[p : p + j] for j in range(1, 8) for p in range(max(len(t) - 9 - j, 0))) if t else {}
        want.update((i, g, n, round(n / len(t), 9)) for g, n in one.items())
    found = ngrams.char_ngrams(df, "id", num=7)
    assert Counter((r.id, r.gram, r.cnt, round(r.freq, 9)) for r in found.collect()) == want
    assert "regexp_extract_all" not in found._jdf.queryExecution().toString()


def test_decode_base64_removes_other_characters_in_one_pass(spark):
    raw = "Zürich\n" * 999
    broken = base64.encodebytes(raw.encode()).decode().replace("\n", "\r\n")
    df = spark.createDataFrame([(broken,), ("#" + broken,), ("YWJj====",), ("a=b=",), (None,)], "t string")
    found = text.decode_base64_column(df, "t")
    assert [r.t for r in found.collect()] == [raw, raw, " ", " ", " "]
    assert "regexp_replace" not in found._jdf.queryExecution().toString()
