"""Relation-extraction samples: normalise, clean, align to spans, cut into windows.

A sample is one row: ``id, text, relation_list`` and optionally ``entity_list`` / ``event_list``.
Relations, entities and events are arrays of the sample, as in the source data, and are handled
inside the row; only a caller-supplied token table needs a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions import arrays as A
from corpusprep.functions import patterns as P
from corpusprep.operators.sampling import with_ordinal
from corpusprep.operators.spans import texts
from corpusprep.operators.text import squeezed

SPAN = "struct<s:int,e:int>"


def _fields(df: DataFrame, col: str) -> list[str]:
    return df.schema[col].dataType.elementType.fieldNames()


def _patched(item: Column, names: list[str], **new: Column) -> Column:
    """``item`` with fields replaced or added."""
    kept = [item[n].alias(n) for n in names if n not in new]
    return F.struct(*kept, *[v.alias(k) for k, v in new.items()])


def _shift(span: Column, by: Column) -> Column:
    return F.struct((span["s"] - by).cast("int").alias("s"), (span["e"] - by).cast("int").alias("e"))


# ---------------------------------------------------------------- normalise and clean
def normalize_samples(
    df: DataFrame, fmt: str, dataset_type: str, add_id: bool = True, order: str | None = None
) -> DataFrame:
    """Three source layouts to ``text, [id,] relation_list<subject, predicate, object>``.

    ``casrel`` (text, triple_list), ``etl_span`` (tokens, spo_list), ``raw_nyt`` (sentText,
    relationMentions).  ``id`` is ``{dataset_type}_{ordinal}``, the 0-based position by the
    unique integer column ``order``.
    """

    def positional(rel: Column) -> Column:
        return F.struct(
            F.get(rel, F.lit(0)).alias("subject"),
            F.get(rel, F.lit(1)).alias("predicate"),
            F.get(rel, F.lit(2)).alias("object"),
        )

    def named(rel: Column) -> Column:
        return F.struct(
            rel["em1Text"].alias("subject"), rel["label"].alias("predicate"), rel["em2Text"].alias("object")
        )

    layouts = {
        "casrel": (lambda: F.col("text"), "triple_list", positional),
        "etl_span": (lambda: F.array_join("tokens", " "), "spo_list", positional),
        "raw_nyt": (lambda: F.col("sentText"), "relationMentions", named),
    }
    if fmt not in layouts:
        raise ValueError(f"unknown format {fmt!r}; one of {sorted(layouts)}")
    text, relations, shape = layouts[fmt]
    cols = [text().alias("text"), F.transform(relations, shape).alias("relation_list")]
    if add_id:
        if order is None:
            raise ValueError("ids are positions: name the integer column that orders the rows")
        df = with_ordinal(df, order, "_pos")
        cols.insert(0, F.concat_ws("_", F.lit(dataset_type), F.col("_pos").cast("string")).alias("id"))
    return strip_replacement_char(df.select(*cols))


def _clean_texts(df: DataFrame, clean, relations: bool = True) -> DataFrame:
    out = df.withColumn("text", clean(F.col("text")))
    if not relations or "relation_list" not in df.columns:
        return out
    names = _fields(df, "relation_list")

    def one(rel: Column) -> Column:
        done = {"subject": clean(rel["subject"]), "object": clean(rel["object"])}
        return F.struct(*[done.get(n, rel[n]).alias(n) for n in names])

    return out.withColumn("relation_list", F.transform("relation_list", one))


def strip_replacement_char(df: DataFrame) -> DataFrame:
    return _clean_texts(df, lambda c: F.replace(c, F.lit("�"), F.lit("")))


def squeeze_whitespace(df: DataFrame, separate: bool = False, data_type: str = "train") -> DataFrame:
    """Whitespace runs to one space in text, subject and object; ``test`` rows: text only."""
    return _clean_texts(df, lambda c: squeezed(c, separate), data_type != "test")


def validate_spans(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(clean, bad)``: trim entities, move their spans, compare them with the text.

    Only spaces move a span while all whitespace is trimmed, so a tab-edged entity fails.
    ``bad`` holds samples with a failing relation, all relations, ``stake`` 0 on the failing
    ones; ``clean`` holds the passing relations of samples that have any.
    """
    names = _fields(df, "relation_list")
    text = F.col("text")

    def side(rel: Column, name: str, span: str) -> tuple[Column, Column]:
        ent = rel[name]
        lead = F.length(ent) - F.length(F.ltrim(ent))
        trail = F.length(ent) - F.length(F.rtrim(ent))
        moved = F.struct(
            (rel[span]["s"] + lead).cast("int").alias("s"), (rel[span]["e"] - trail).cast("int").alias("e")
        )
        return F.regexp_replace(ent, P.SPACE_EDGES, ""), moved

    def trimmed(rel: Column) -> Column:
        subj, subj_span = side(rel, "subject", "subj_char_span")
        obj, obj_span = side(rel, "object", "obj_char_span")
        new = {"subject": subj, "object": obj, "subj_char_span": subj_span, "obj_char_span": obj_span}
        return F.struct(*[new.get(n, rel[n]).alias(n) for n in names])

    def passes(paged: Column, rel: Column) -> Column:
        def matches(name: str, span: str) -> Column:
            found = A.page_slice(text, paged, rel[span]["s"], rel[span]["e"])
            return (F.length(rel[name]) > 0) & (rel[name] == found)

        both = matches("subject", "subj_char_span") & matches("object", "obj_char_span")
        return F.coalesce(both, F.lit(False))

    def staked(paged: Column) -> Column:
        return F.transform(
            F.transform("relation_list", trimmed),
            lambda r: F.struct(*[r[n].alias(n) for n in names], F.when(~passes(paged, r), 0).alias("stake")),
        )

    # Both outputs filter on the result, so it is pinned instead of evaluated again per filter.
    checked = A.once(df.withColumn("relation_list", A.let(A.pages(text), staked)), "relation_list")
    bad = checked.filter(F.exists("relation_list", lambda r: r["stake"].isNotNull()))
    good = F.transform(
        F.filter("relation_list", lambda r: r["stake"].isNull()),
        lambda r: F.struct(*[r[n].alias(n) for n in names]),
    )
    some_good = checked.filter(F.exists("relation_list", lambda r: r["stake"].isNull()))
    return some_good.withColumn("relation_list", good), bad


# ---------------------------------------------------------------- character spans
def entity_spans(text: Column, entity: Column, ignore_subword: bool = True) -> Column:
    """Spans of every occurrence of ``entity`` in ``text``, left to right without overlap.

    With ``ignore_subword`` the entity must stand between spaces, and a match uses up its
    trailing space: the second of two adjacent equal words is missed.  Otherwise a match of an
    entity that starts with a digit must not touch another digit.
    """
    if ignore_subword:
        padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
        return F.transform(
            A.find_all(padded(text), padded(entity)),
            lambda s: F.struct(s.alias("s"), (s + F.length(entity)).cast("int").alias("e")),
        )
    digit = lambda c: c.rlike(r"^\p{Nd}")

    def apart(s: Column) -> Column:
        before = F.when(s > 0, F.substring(text, s, 1)).otherwise("")
        after = F.substring(text, s + F.length(entity) + 1, F.lit(1))
        return ~digit(entity) | ~(digit(before) | digit(after))

    return F.transform(
        F.filter(A.find_all(text, entity), apart),
        lambda s: F.struct(s.alias("s"), (s + F.length(entity)).cast("int").alias("e")),
    )


def _word_spans(column: pa.Array, names: pa.Array) -> pa.Array:
    """``entity_spans`` between spaces of every name of a row; null names have none, a null text null ones."""
    starts, sizes, missing = [], [], []
    inner, outer, none = [0], [0], []
    for text, entities in zip(texts(column), names.to_pylist()):
        none.append(entities is None)
        padded = None if text is None else f" {text} "
        known: dict[str | None, list[int]] = {None: []}
        for name in entities or ():
            missing.append(padded is None and name is not None)
            if padded is not None and name not in known:
                known[name] = _found(padded, f" {name} ")
            found = known.get(name, [])
            starts += found
            sizes += [len(name or "")] * len(found)
            inner.append(len(starts))
        outer.append(len(inner) - 1)
    first = np.array(starts, np.int32)
    span = pa.StructArray.from_arrays([pa.array(first), pa.array(first + np.array(sizes, np.int32))], ["s", "e"])
    each = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), span, mask=pa.array(missing, pa.bool_()))
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), each, mask=pa.array(none, pa.bool_()))


def _found(text: str, target: str) -> list[int]:
    """Starts of the occurrences of ``target``, left to right, none inside another."""
    out, at = [], text.find(target)
    while at >= 0:
        out.append(at)
        at = text.find(target, at + len(target))
    return out


def attach_char_spans(df: DataFrame, ignore_subword: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(samples, miss)``: one relation per pair of subject and object occurrences.

    Entities get one entry per occurrence.  ``miss`` holds the unchanged samples that ended up
    with fewer relations than before.
    """

    names = F.flatten(F.transform("relation_list", lambda r: F.array(r["subject"], r["object"])))
    places = df
    if ignore_subword:
        places = A.once(df.withColumn("_places", F.arrow_udf(_word_spans, f"array<array<{SPAN}>>")("text", names)), "_places")

    def spans(rel: Column, name: str, at: Column) -> Column:
        return F.get("_places", at) if ignore_subword else entity_spans(F.col("text"), rel[name], False)

    def located(rel: Column, i: Column) -> Column:
        return A.let(
            spans(rel, "object", 2 * i + 1),
            lambda objs: F.flatten(
                F.transform(
                    spans(rel, "subject", 2 * i),
                    lambda ss: F.transform(
                        objs,
                        lambda os: F.struct(
                            rel["subject"].alias("subject"),
                            rel["predicate"].alias("predicate"),
                            rel["object"].alias("object"),
                            ss.alias("subj_char_span"),
                            os.alias("obj_char_span"),
                        ),
                    ),
                )
            ),
        )

    found = places.withColumn("_rels", F.flatten(F.transform("relation_list", located))).drop("_places")
    miss = found.filter(F.size("_rels") < F.size("relation_list")).drop("_rels")
    out = found.withColumn("relation_list", F.col("_rels")).drop("_rels")
    if "entity_list" in df.columns:
        out = out.withColumn(
            "entity_list",
            F.flatten(
                F.transform(
                    F.coalesce("entity_list", F.expr("slice(entity_list, 1, 0)")),
                    lambda ent: F.transform(
                        entity_spans(F.col("text"), ent["text"], ignore_subword),
                        lambda sp: F.struct(
                            ent["text"].alias("text"), ent["type"].alias("type"), sp.alias("char_span")
                        ),
                    ),
                )
            ),
        )
    return out, miss


# ---------------------------------------------------------------- token spans
CELL = 64  # characters per join cell


def token_spans(spans: DataFrame, tokens: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Character spans ``(*keys, span_no, s, e)`` to token spans ``(*keys, span_no, ts, te)``.

    ``tokens`` is ``(*keys, tok_ind, cs, ce)``.  ``ts`` is the lowest token over character ``s``,
    ``te`` one more than the highest token over character ``e - 1``; -1 where the character is
    whitespace.  The range condition is an equi join on (sample, 64-character cell) with the
    bounds checked inside the cell, so a long sample is neither one task nor all pairs.
    """
    keys = list(keys)
    ends = spans.select(
        *keys,
        "span_no",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("first"), F.col("s").alias("pos")),
                F.struct(F.lit(False).alias("first"), (F.col("e") - 1).alias("pos")),
            )
        ).alias("p"),
    ).select(*keys, "span_no", "p.*", F.floor(F.col("p.pos") / CELL).alias("_cell"))
    cells = F.when(
        F.col("ce") > F.col("cs"), F.sequence(F.floor(F.col("cs") / CELL), F.floor((F.col("ce") - 1) / CELL))
    ).otherwise(F.array().cast("array<bigint>"))
    covered = tokens.select(*keys, "tok_ind", "cs", "ce", F.explode(cells).alias("_cell"))
    hits = (
        ends.join(covered, [*keys, "_cell"], "left")
        .withColumn("_hit", F.when((F.col("pos") >= F.col("cs")) & (F.col("pos") < F.col("ce")), F.col("tok_ind")))
    )
    return hits.groupBy(*keys, "span_no").agg(
        F.coalesce(F.min(F.when(F.col("first"), F.col("_hit"))), F.lit(-1)).cast("int").alias("ts"),
        F.coalesce(F.max(F.when(~F.col("first"), F.col("_hit"))) + 1, F.lit(-1)).cast("int").alias("te"),
    )


_PACK = 1 << 16  # tokens of a packed row
_INTS = ("tok_ind", "cs", "ce")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Successive tokens of one id as one row, cut where a batch ends and every ``_PACK`` tokens."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("id")
        new = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
        head = np.flatnonzero(np.concatenate([[True], new.astype(bool)]))
        run = np.arange(len(ids)) - np.repeat(head, np.diff(head, append=len(ids)))
        head = np.flatnonzero(run % _PACK == 0)
        bounds = pa.array(np.append(head, len(ids)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, batch.column(c)) for c in _INTS]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(head)), *lists], names=["id", *_INTS])


NONE = 1 << 33  # stands for a missing position; no token is there


def _key(group: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number that orders by group and position."""
    return (group << 36) + (np.clip(at, -NONE, NONE) + (1 << 34))


def _covering(of: np.ndarray, tok: np.ndarray, group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest of the tokens of its group over each character, or -1.  Tokens are columns of
    ``tok_ind, cs, ce`` in the groups ``of``."""
    some = tok[2] > tok[1]
    of, tok = of[some], tok[:, some]
    order = np.lexsort((tok[0], tok[2], tok[1], of))
    of, (ind, cs, ce) = of.take(order), tok.take(order, 1)
    first = np.searchsorted(_key(of, ce), _key(group, at), "right")
    past = np.searchsorted(_key(of, cs), _key(group, at), "right")
    hit = np.flatnonzero(first < past)
    low, high = np.full(len(at), -1), np.full(len(at), -1)
    low[hit], high[hit] = ind.take(first[hit]), ind.take(past[hit] - 1)
    back = (of[1:] == of[:-1]) & ((ce[1:] < ce[:-1]) | (ind[1:] < ind[:-1]))
    for g in np.unique(of[1:][back]):
        # Tokens that lie inside each other or count backwards: each is painted over the stretches it covers.
        mine, asked = slice(*np.searchsorted(of, [g, g + 1])), np.flatnonzero(group == g)
        low[asked], high[asked] = _painted(ind[mine], cs[mine], ce[mine], at[asked])
    return low, high


def _painted(ind: np.ndarray, cs: np.ndarray, ce: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.unique(np.concatenate([cs, ce]))
    lows, highs = np.full(len(cuts) + 1, -1), np.full(len(cuts) + 1, -1)
    begin, end = np.searchsorted(cuts, cs) + 1, np.searchsorted(cuts, ce) + 1
    rank = np.argsort(ind, kind="stable")
    for k in rank:
        highs[begin[k] : end[k]] = ind[k]
    for k in rank[::-1]:
        lows[begin[k] : end[k]] = ind[k]
    place = np.searchsorted(cuts, at, "right")
    return lows[place], highs[place]


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The lists' values in one array, and the length of each; a null list is empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    return pc.fill_null(column.flatten(), NONE).to_numpy(), lengths


def _answers(rows: pa.RecordBatch) -> pa.RecordBatch:
    """``id, _tok`` from all rows of some ids, in order of the id."""
    ids = rows.column("id")
    new = np.concatenate([[True], pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)])
    group = np.cumsum(new) - 1
    token, lengths = zip(*(_flat(rows.column(c)) for c in _INTS))
    ends, counts = zip(*(_flat(rows.column(c)) for c in ("s", "e")))
    of, asking = np.repeat(group, lengths[0]), np.repeat(group, counts[0])
    low, _ = _covering(of, np.stack(token), asking, ends[0])
    _, high = _covering(of, np.stack(token), asking, ends[1] - (ends[1] < NONE))
    most = np.zeros(group[-1] + 1, np.int64)
    np.maximum.at(most, group, counts[0])
    bounds = np.concatenate([[0], np.cumsum(most)])
    place = bounds[asking] + np.arange(len(asking)) - np.repeat(np.cumsum(counts[0]) - counts[0], counts[0])
    ts, te = np.full(bounds[-1], NONE), np.full(bounds[-1], -1)
    np.minimum.at(ts, place, np.where(low < 0, NONE, low))
    np.maximum.at(te, place, np.where(high < 0, -1, high + 1))
    spans = pa.StructArray.from_arrays([pa.array(np.where(ts == NONE, -1, ts), pa.int32()), pa.array(te, pa.int32())], ["s", "e"])
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)
    return pa.RecordBatch.from_arrays([ids.filter(pa.array(new.astype(bool))), lists], names=["id", "_tok"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_answers`` of sorted rows; the last id of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("id")
        if held and held[-1].column("id")[-1] != ids[0]:
            yield _answers(_joined(held))
            held = []
        cut = pc.index(ids, ids[-1]).as_py()
        if cut:
            yield _answers(_joined([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _answers(_joined(held))


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(batches) if len(batches) > 1 else batches[0]


def _aligned(samples: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(id, _tok)``: the token spans of the ``_spans`` of every id by their number; ids that repeat share
    their tokens, and their spans of one number give the lowest start and the highest end."""
    kind = samples.schema["id"].dataType.simpleString()
    ints = ", ".join(f"{c} array<bigint>" for c in _INTS)
    packs = tokens.filter("id IS NOT NULL").select(F.col("id").cast(kind).alias("id"), *(F.col(c).cast("bigint").alias(c) for c in _INTS))
    packs = packs.filter("tok_ind IS NOT NULL AND cs IS NOT NULL AND ce IS NOT NULL").mapInArrow(_packed, f"id {kind}, {ints}")
    ends = lambda c: F.transform("_spans", lambda x: x[c].cast("bigint"))
    spans = samples.filter("id IS NOT NULL").select("id", ends("s").alias("s"), ends("e").alias("e"))
    both = packs.unionByName(spans, allowMissingColumns=True).repartition("id").sortWithinPartitions("id")
    return both.mapInArrow(_align, f"id {kind}, _tok array<{SPAN}>")


def attach_token_spans(df: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds ``subj_tok_span``, ``obj_tok_span``, ``tok_span``, ``trigger_tok_span`` from character spans.

    ``tokens`` is ``(id, tok_ind, token, cs, ce)`` from any tokeniser.  All character spans of a
    sample are numbered in one list, aligned as by ``token_spans`` and put back by number.  A sample's
    spans and tokens, packed by the task that makes them, meet as a few rows of integers.
    """
    empty = F.array().cast(f"array<{SPAN}>")
    has_ent, has_ev = "entity_list" in df.columns, "event_list" in df.columns
    rel_spans = F.flatten(
        F.transform("relation_list", lambda r: F.array(r["subj_char_span"], r["obj_char_span"]))
    ).cast(f"array<{SPAN}>")
    ent_spans = F.transform("entity_list", lambda x: x["char_span"]).cast(f"array<{SPAN}>") if has_ent else empty
    ev_spans = (
        F.flatten(
            F.transform(
                "event_list",
                lambda ev: F.concat(
                    F.array(ev["trigger_char_span"]), F.transform(ev["argument_list"], lambda a: a["char_span"])
                ),
            )
        ).cast(f"array<{SPAN}>")
        if has_ev
        else empty
    )
    all_spans = F.concat(*[F.coalesce(c, empty) for c in (rel_spans, ent_spans, ev_spans)])
    joined = df.join(_aligned(df.select("id", all_spans.alias("_spans")), tokens), "id", "left")
    at = lambda i: F.get("_tok", i)
    rel_names = _fields(df, "relation_list")
    out = joined.withColumn(
        "relation_list",
        F.transform(
            "relation_list",
            lambda r, i: _patched(r, rel_names, subj_tok_span=at(2 * i), obj_tok_span=at(2 * i + 1)),
        ),
    )
    n_rel = 2 * F.size(F.coalesce(F.col("relation_list"), F.expr("slice(relation_list, 1, 0)")))
    n_ent = F.lit(0)
    if has_ent:
        ent_names = _fields(df, "entity_list")
        n_ent = F.greatest(F.size("entity_list"), F.lit(0))
        out = out.withColumn(
            "entity_list", F.transform("entity_list", lambda x, i: _patched(x, ent_names, tok_span=at(n_rel + i)))
        )
    if has_ev:
        ev_names = _fields(df, "event_list")
        arg_names = (
            df.schema["event_list"].dataType.elementType["argument_list"].dataType.elementType.fieldNames()
        )

        def event(ev: Column, i: Column) -> Column:
            earlier = F.aggregate(
                F.slice("event_list", F.lit(1), i), F.lit(0), lambda acc, e: acc + 1 + F.size(e["argument_list"])
            )
            return A.let(
                n_rel + n_ent + earlier,
                lambda base: _patched(
                    ev,
                    ev_names,
                    trigger_tok_span=at(base),
                    argument_list=F.transform(
                        ev["argument_list"], lambda a, j: _patched(a, arg_names, tok_span=at(base + 1 + j))
                    ),
                ),
            )

        out = out.withColumn("event_list", F.transform("event_list", event))
    return out.drop("_tok")


# ---------------------------------------------------------------- windows
_NUMBERED = "array<struct<s:int,i:int,odd:boolean>>"


def _first_at(starts: Column, bound: Column) -> Column:
    """How many of the ascending ``starts`` are smaller than ``bound``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(29, -1, -1)])

    def step(pos: Column, half: Column) -> Column:
        return F.when(F.get(starts, pos + half - 1) < bound, pos + half).otherwise(pos)

    return F.aggregate(steps, F.lit(0), step)


def sliding_windows(
    df: DataFrame,
    max_len: int,
    stride: int = 50,
    data_type: str = "train",
    tokens: str | None = None,
    subword: bool = False,
) -> DataFrame:
    """Overlapping token windows ``(id, win, text, tok_offset, char_offset, ...)`` per sample.

    Starts are 0, stride, ... up to and including the first window that ends behind the last
    token.  ``train`` / ``valid`` windows keep the relations, entities and events that lie inside,
    relations and entities re-based to the window (event spans keep their values); ``test``
    windows have no labels and are dropped when empty.  Tokens are the single-space pieces of the
    text, or the array column ``tokens`` of ``tok_ind, token, cs, ce``; with ``subword`` a start
    moves left off ``##`` pieces.

    Windows are built inside the row and exploded as finished structs, so the token array of a
    long text is never repeated per window.
    """
    text = F.col("text")
    labels = [c for c in ("event_list", "entity_list", "relation_list") if c in df.columns]
    if data_type == "test":
        labels = []
    names = {c: _fields(df, c) for c in labels}
    rebased = {
        "entity_list": ("tok_span", "char_span"),
        "relation_list": ("subj_tok_span", "obj_tok_span", "subj_char_span", "obj_char_span"),
    }
    token_sides = {c: [x for x in spans if x.endswith("tok_span")] for c, spans in rebased.items()}
    looked_up = [c for c in labels if c in rebased]

    def word_starts(toks: Column) -> Column:
        """For every token the nearest token at or before it that begins a word."""
        here = lambda last, t: F.when(F.contains(t["token"], F.lit("##")), last).otherwise(
            t["tok_ind"]
        )
        return A.scan(toks, F.lit(0), "int", here, here, "int")

    def starts(toks: Column) -> Column:
        grid = F.sequence(F.lit(0), F.floor((F.size(toks) - 1) / stride).cast("int"))
        if subword:
            moved = A.let(word_starts(toks), lambda ws: F.transform(grid, lambda k: F.get(ws, k * stride)))
        else:
            moved = F.transform(grid, lambda k: k * stride)
        # A window follows only if the one before it did not end behind the last token.
        return A.let(
            moved,
            lambda m: F.filter(m, lambda s, k: (k == 0) | (F.get(m, k - 1) + max_len <= F.size(toks))),
        )

    def placements(col: str) -> Column:
        """Numbers ``at`` of the labels by their first span's start, and of those that end before it."""
        span = lambda x: x[token_sides[col][0]]
        numbered = F.transform(
            col, lambda x, i: F.struct(span(x)["s"].alias("s"), i.alias("i"), (span(x)["s"] > span(x)["e"]).alias("odd"))
        )

        def split(rows: Column) -> Column:
            return A.let(
                F.sort_array(F.filter(rows, lambda r: ~r["odd"])),
                lambda plain: F.struct(
                    F.transform(plain, lambda r: r["s"]).alias("starts"),
                    F.transform(plain, lambda r: r["i"]).alias("at"),
                    F.transform(F.filter(rows, lambda r: r["odd"]), lambda r: r["i"]).alias("odd"),
                ),
            )

        return A.let(F.coalesce(numbered.cast(_NUMBERED), F.array().cast(_NUMBERED)), split)

    def window(toks: Column, placed: Column | None, start: Column, win: Column) -> Column:
        end = start + max_len
        cs = F.get(toks, start)["cs"]
        ce = F.get(toks, F.least(end, F.size(toks)) - 1)["ce"]
        within = lambda span: (span["s"] >= start) & (span["e"] <= end)
        def label(col: str) -> Column:
            if col == "event_list":
                return F.transform(
                    F.filter(col, lambda ev: within(ev["trigger_tok_span"])),
                    lambda ev: _patched(
                        ev,
                        names[col],
                        argument_list=F.filter(ev["argument_list"], lambda a: within(a["tok_span"])),
                    ),
                )
            spans = rebased[col]
            token_side = token_sides[col]

            def inside(x: Column) -> Column:
                checks = [within(x[n]) for n in token_side]
                return checks[0] if len(checks) == 1 else checks[0] & checks[1]

            near = placed[f"_{col}"]
            low, high = _first_at(near["starts"], start), _first_at(near["starts"], end + 1)
            numbers = F.concat(F.slice(near["at"], low + 1, high - low), near["odd"])
            found = F.filter(F.transform(F.sort_array(numbers), lambda i: F.get(F.col(col), i)), inside)
            return F.transform(
                F.when(F.col(col).isNotNull(), found),
                lambda x: _patched(
                    x, names[col], **{n: _shift(x[n], start if n in token_side else cs) for n in spans}
                ),
            )

        return F.struct(
            win.cast("int").alias("win"),
            A.py_slice(text, cs, ce).alias("text"),
            start.cast("int").alias("tok_offset"),
            cs.cast("int").alias("char_offset"),
            *[label(c).alias(c) for c in labels],
        )

    def windows(toks: Column) -> Column:
        made = lambda placed: F.transform(starts(toks), lambda s, k: window(toks, placed, s, k))
        if not looked_up:
            return F.when(F.size(toks) > 0, made(None))
        return F.when(
            F.size(toks) > 0, A.let(F.struct(*[placements(c).alias(f"_{c}") for c in looked_up]), made)
        )

    toks = A.space_tokens(text) if tokens is None else F.col(tokens)
    out = A.unnest(df, ["id"], A.let(toks, windows), "w").select("id", "w.*")
    return out.filter(F.length("text") > 0) if data_type == "test" else out
