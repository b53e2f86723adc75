import random

import pyarrow as pa
import pytest

from corpusprep.operators import span_columns
from corpusprep.operators import spans as span_steps

ANN = pa.list_(
    pa.struct(
        [
            ("attribute_value", pa.string()),
            ("attribute_type", pa.string()),
            ("source", pa.string()),
            ("score", pa.float64()),
            ("start_idx", pa.int32()),
            ("end_idx", pa.int32()),
            ("line_idx", pa.int32()),
        ]
    )
)
PIECES = ["a", "b", "red", "é", "日", "_", ".", " ", " ", "  ", "-", "😀", "\n", "x1", "²"]


def _rows(rng, odd):
    """Titles and annotations; some that disagree with their title, and odd ones with missing values or strange places."""
    for _ in range(40):
        title = "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 8, 40])))
        anns = []
        for _ in range(rng.choice([0, 1, 5, 25])):
            s = rng.randint(0, len(title))
            e = rng.randint(s, min(len(title), s + 6))
            if odd and rng.random() < 0.1:
                s, e = rng.choice([s, len(title) + 2]), rng.choice([None, -2, e + 9])
            val = rng.choice([title[s:e], title[s:e], title[s:e][:-1], rng.choice(PIECES), ""])
            typ = rng.choice(["A", "B", " c d "] + [None] * odd)
            anns.append((val, typ, rng.choice(["title"] * 4 + ["description"]), 1.0, s, e, rng.choice([0, 0, 1])))
        if rng.random() < 0.8:
            anns = sorted({(a[6], a[4], a[5] or 0): a for a in anns}.items())
            anns = [a for _, a in anns]
        yield (None if odd and rng.random() < 0.05 else title), (None if odd and rng.random() < 0.05 else anns)


def _arrays(rows):
    names = [f.name for f in ANN.value_type]
    lists = [None if anns is None else [dict(zip(names, a)) for a in anns] for _, anns in rows]
    return pa.array([t for t, _ in rows], pa.string()), pa.array(lists, ANN)


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("piece", [1, 1 << 17])
def test_columns_equal_the_loops(spark, monkeypatch, odd, piece):
    rng = random.Random(piece + odd)
    monkeypatch.setattr(span_columns, "PIECE", piece)
    for _ in range(10):
        title, anns = _arrays(list(_rows(rng, odd)))
        for strict in (False, True):
            tagged = span_steps.tagged(strict, None).func
            bio = [span_steps.bio(scheme, order).func for scheme in ("BIO", "BIOSE") for order in ("type", "position")]
            quick = tagged(title, anns)
            tags = [f(title, quick) for f in bio]
            with monkeypatch.context() as m:
                m.setattr(span_columns, "plain_annotations", lambda t, a: span_columns.np.zeros(len(t), bool))
                m.setattr(span_columns, "plain_spans", lambda t, a: span_columns.np.zeros(len(t), bool))
                slow = tagged(title, anns)
                assert quick.to_pylist() == slow.to_pylist()
                assert [t.to_pylist() for t in tags] == [f(title, slow).to_pylist() for f in bio]


def test_ordered_annotations_inside_their_title_take_no_loop(spark, monkeypatch):
    def fails(*_):
        raise AssertionError("a loop over one item")

    for name in ("_repair", "_tags"):
        monkeypatch.setattr(span_steps, name, fails)
    title, anns = _arrays([("new york is red", [("new york", "place", "title", 1.0, 0, 8, 0), ("red", "c d", "title", 1.0, 11, 14, 0)])])
    spans = span_steps.tagged(False, None).func(title, anns)
    assert [(s["indexed_text"], s["start_idx"]) for s in spans.to_pylist()[0]] == [("new york", 0), ("red", 12)]
    tags = span_steps.bio("BIOSE", "position").func(title, spans).to_pylist()[0]
    assert [(t["word"], t["tag"]) for t in tags["tags"]] == [("new", "B-place"), ("york", "E-place"), ("is", "O"), ("red", "S-c##d")]
