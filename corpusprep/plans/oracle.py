r"""SQL counterparts of the catalogue's queries for a second engine, over the same tables.

They restate the stand-in views and the operators in plain SQL, by other means where there are
any (global windows instead of blocks, list folds instead of chunked scans).
"""

from __future__ import annotations

from corpusprep.functions import patterns as P

# Whitespace, word and punctuation classes as in Python's str.
_SPACE = (
    r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
_WORD = r"\p{L}\p{N}_"
_PUNCT = r"!-/:-@\[-`{-~\p{P}"
_CJK = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
)

ORACLE: dict[str, str] = {}


def _chain(*parts: str) -> str:
    """``WITH a AS (...), b AS (...)`` out of ``name AS (...)`` parts and a final select."""
    *ctes, final = parts
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + final.strip()


def _letters(name: str, source: str, key: str) -> str:
    """Rows of lower-cased words and punctuation characters with their position."""
    return f"""{name} AS (
  SELECT {key}, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT {key}, regexp_extract_all(lower(text), '[{_PUNCT}]|[^{_PUNCT}{_SPACE}]+') AS l FROM {source}))"""


# ---------------------------------------------------------------- retrieval
_BM25 = (
    _letters("d", "documents", "doc_id"),
    _letters("q", "benchmark", "item_id"),
    "tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL)",
    "dl AS (SELECT doc_id, count(*) AS dl FROM tf GROUP BY ALL)",
    "n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM d) / (SELECT count(*) FROM documents) AS len)",
    "df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)",
    "qf AS (SELECT item_id, term, count(*) AS qf FROM q GROUP BY ALL)",
    """scores AS (
  SELECT qf.item_id AS query_id, tf.doc_id, round(sum(
    qf * ln((n.n - df + 0.5) / (df + 0.5)) * (tf * 3.0 / (tf + 2.0 * (0.5 + 0.5 * dl / n.len)))
       * (qf * 2.0 / (qf + 1.0))), 6) AS score
  FROM qf JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN n
  GROUP BY ALL)""",
)
ORACLE["bm25_scores"] = _chain(*_BM25, "SELECT query_id, doc_id, score FROM scores")
ORACLE["bm25_top10"] = _chain(
    *_BM25,
    """SELECT query_id, doc_id, score, rank FROM (
  SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS int) AS rank FROM scores)
WHERE rank <= 10""",
)
ORACLE["bm25_term_stats"] = _chain(
    *_BM25[:1],
    *_BM25[2:6],
    """SELECT term, df, round(ln((n.n - df + 0.5) / (df + 0.5)), 6) AS idf, n.n AS n_docs,
  round(n.len, 6) AS avg_len FROM df CROSS JOIN n""",
)

# ---------------------------------------------------------------- text
# Surrogates are not in any text of the second engine.
_DROPPED = P.flat_class(r for r in P.DROPPED if not 0xD800 <= r[0] <= 0xDFFF)
_CLEAN = f"regexp_replace(regexp_replace({{}}, '[{_DROPPED}]', '', 'g'), '[{P.flat_class(P.BLANKS)}]', ' ', 'g')"
ORACLE["clean_corpus"] = "SELECT doc_id, " + _CLEAN.replace("{}", "text") + " AS text FROM documents"
ORACLE["decode_base64"] = "SELECT doc_id, coalesce(decode(from_base64(to_base64(encode(text)))), ' ') AS text FROM documents"
ORACLE["to_text"] = "SELECT page_id, replace(html, chr(65533), '') AS html FROM pages"
ORACLE["parse_attribute_pairs"] = r"""WITH parts AS (
  SELECT p_partkey AS item_id, regexp_split_to_array(concat_ws(';', ' Type : ' || p_type,
    'no pair; Brand:' || p_brand || ' ||| ' || p_size || ',' || p_name, 'a:b:' || p_brand || '；type:' || p_name), '[;；]') AS l FROM part),
pairs AS (SELECT item_id, string_split(unnest(l), ':') AS kv, generate_subscripts(l, 1) AS n FROM parts),
named AS (SELECT item_id, n, lower(trim(kv[1])) AS attr, regexp_split_to_array(lower(trim(kv[2])), '\|\|\||,') AS vals FROM pairs WHERE len(kv) = 2),
kept AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY item_id, attr ORDER BY n DESC) = 1)
SELECT item_id, attr, cast(generate_subscripts(vals, 1) - 1 AS int) AS pos, trim(unnest(vals)) AS value FROM kept"""
ORACLE["explode_description"] = """SELECT doc_id AS item_id, cast(generate_subscripts(l, 1) - 1 AS int) AS line_idx, unnest(l) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""
ORACLE["strip_accents"] = "SELECT doc_id, strip_accents(text) AS text FROM documents"
_CJK_SQL = rf"regexp_replace({{}}, '([{_CJK}])', ' \1 ', 'g')"
ORACLE["space_cjk"] = "SELECT doc_id, " + _CJK_SQL.replace("{}", "text") + " AS text FROM documents"
ORACLE["squeeze_whitespace"] = rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(
  trim(regexp_replace(text, '[{_SPACE}]+', ' ', 'g')), '([^A-Za-z0-9])', ' \1 ', 'g'), '[{_SPACE}]+', ' ', 'g')) AS text
FROM documents"""
ORACLE["strip_replacement_char"] = "SELECT doc_id, replace(text, chr(65533), '') AS text FROM documents"
ORACLE["tokenize"] = rf"""SELECT doc_id, cast(generate_subscripts(l, 1) - 1 AS int) AS pos, unnest(l) AS token
FROM (SELECT doc_id, regexp_extract_all(lower({_CJK_SQL.replace("{}", _CLEAN.replace("{}", "text"))}),
  '[{_PUNCT}]|[^{_PUNCT}{_SPACE}]+') AS l FROM documents)"""


def _space_tokens(name: str, source: str, key: str, text: str) -> str:
    """Single-space pieces with token number and character offsets."""
    return f"""{name} AS (
  SELECT {key}, i AS tok_ind, w AS token, cast(coalesce(sum(length(w) + 1) OVER (
      PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS int) AS cs
  FROM (SELECT {key}, unnest(l) AS w, cast(generate_subscripts(l, 1) - 1 AS int) AS i
        FROM (SELECT {key}, string_split({text}, ' ') AS l FROM {source})))"""


ORACLE["whitespace_tokens"] = _chain(
    _space_tokens("t", "documents", "doc_id", "text"),
    "SELECT doc_id, tok_ind, token, cs, cast(cs + length(token) AS int) AS ce FROM t",
)
ORACLE["build_vocab"] = "SELECT trim(p_name) AS token, max(p_partkey) AS id FROM part GROUP BY ALL"
_VOCAB = (
    _letters("b", "benchmark", "item_id"),
    "vocab AS (SELECT term, min(item_id) + 2 AS id FROM b GROUP BY ALL)",
    _letters("d", "documents", "doc_id"),
    "ids AS (SELECT doc_id, cast(pos AS int) AS pos, coalesce(id, 1) AS id FROM d LEFT JOIN vocab USING (term))",
)
ORACLE["encode_tokens"] = _chain(*_VOCAB, "SELECT doc_id, pos, id FROM ids")
ORACLE["encode_tokens_padded"] = _chain(
    *_VOCAB,
    """SELECT g.doc_id, cast(g.pos AS int) AS pos, coalesce(ids.id, 0) AS id
FROM (SELECT doc_id, unnest(range(128)) AS pos FROM documents) g
LEFT JOIN ids ON ids.doc_id = g.doc_id AND ids.pos = g.pos""",
)


def _cut_list(name: str, size: str, keep: str) -> str:
    heads = f"""len(list_filter(range(1, greatest({size} - {keep}, 0) + 1),
      lambda i: substr(md5('0:{name}:' || pair_id || ':' || i), 1, 1) < '8'))"""
    return f"array_to_string(list_slice({name}, {heads} + 1, {heads} + {keep}), ' ')"


ORACLE["truncate_pairs"] = _chain(
    "c AS (SELECT conv_id, turn, conv_id * 2147483648 + turn AS pair_id, string_split(text, ' ') AS toks FROM conversations)",
    """p AS (SELECT a.pair_id, a.toks AS tokens_a, b.toks AS tokens_b, len(a.toks) AS la, len(b.toks) AS lb
  FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""",
    """k AS (SELECT *,
    CASE WHEN la + lb <= 64 THEN la WHEN 2 * least(la, lb) <= 64 THEN CASE WHEN la > lb THEN 64 - lb ELSE la END ELSE 32 END AS ka,
    CASE WHEN la + lb <= 64 THEN lb WHEN 2 * least(la, lb) <= 64 THEN CASE WHEN la > lb THEN lb ELSE 64 - la END ELSE 32 END AS kb
  FROM p)""",
    f"SELECT pair_id, {_cut_list('tokens_a', 'la', 'ka')} AS text_a, {_cut_list('tokens_b', 'lb', 'kb')} AS text_b FROM k",
)


def _grams(source: str, key: str, num: int) -> str:
    """Grams out of each character and the ones that follow it."""
    nth = [f"lead(c, {d}) OVER w" for d in range(1, num)]
    grams = ["c"] + [" || ".join(["c", *nth[:j]]) for j in range(1, num)]
    listed = ", ".join(f"{{'j': {j + 1}, 'gram': {g}, 'rgt': lead(c, {j + 1}) OVER w}}" for j, g in enumerate(grams))
    return f"""ch AS (SELECT {key}, len, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS i
  FROM (SELECT {key}, string_split(text, '') AS l, length(text) AS len FROM {source})),
g AS (SELECT {key}, len, i, x.gram AS gram, lft, x.rgt AS rgt FROM (
    SELECT {key}, len, i, unnest([{listed}]) AS x,
      coalesce(lag(c) OVER w, last_value(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS lft
    FROM ch WINDOW w AS (PARTITION BY {key} ORDER BY i))
  WHERE i + x.j < len - {num} - 2)"""


ORACLE["char_ngrams"] = _chain(
    _grams("documents", "doc_id", 5),
    "SELECT doc_id, gram, count(*) AS cnt, count(*) / any_value(len) AS freq FROM g GROUP BY doc_id, gram",
)
ORACLE["char_ngram_neighbours"] = _chain(
    _grams("(SELECT conv_id * 2147483648 + turn AS turn_no, text FROM conversations)", "turn_no", 5),
    """SELECT turn_no, gram, count(*) AS cnt, string_agg(lft, '' ORDER BY i) AS "left",
  string_agg(rgt, '' ORDER BY i) AS "right" FROM g GROUP BY turn_no, gram""",
)

# ---------------------------------------------------------------- sampling
_O = "o_orderkey, o_custkey, o_orderstatus"


def _order_rank(seed: str, source: str = "orders") -> str:
    return f"row_number() OVER (ORDER BY md5('{seed}:' || o_orderkey))"


ORACLE["head"] = f"SELECT {_O} FROM orders ORDER BY o_orderkey LIMIT 1000"
ORACLE["ratio_sample"] = f"""SELECT {_O} FROM (SELECT *, {_order_rank('3')} AS r, count(*) OVER () AS n FROM orders)
WHERE r <= floor(n * 0.3::double)"""
ORACLE["random_split"] = f"""SELECT {_O}, r <= ceil(n * 0.2::double) AS is_test
FROM (SELECT *, {_order_rank('7')} AS r, count(*) OVER () AS n FROM orders)"""
_STRATA = (
    """codes AS (SELECT DISTINCT l_orderkey, label FROM (
    SELECT l_orderkey, ascii(l_returnflag) AS label FROM lineitem
    UNION ALL SELECT l_orderkey, ascii(l_linestatus) FROM lineitem))""",
    "s AS (SELECT coalesce(label, -1) AS label, o_orderkey AS row_id FROM orders LEFT JOIN codes ON l_orderkey = o_orderkey)",
    """picked AS (SELECT label, row_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('1:' || row_id))
      <= floor(count(*) OVER (PARTITION BY label) * 0.3::double + 1) THEN 'sampled' ELSE 'rest' END AS part FROM s)""",
)
ORACLE["stratified_sample"] = _chain(*_STRATA, "SELECT label, row_id, part FROM picked")
ORACLE["stratum_report"] = _chain(
    *_STRATA,
    """SELECT label, count(*) AS total, count(*) FILTER (part = 'sampled') AS sampled,
  count(*) FILTER (part = 'rest') AS rest FROM picked GROUP BY label""",
)
ORACLE["part_sizes"] = """SELECT cast(part AS int) AS part, n // 7 + CASE WHEN part = 6 THEN n % 7 ELSE 0 END AS size
FROM (SELECT count(*) AS n, unnest(range(7)) AS part FROM orders)"""
ORACLE["assign_part"] = """SELECT o_orderkey, least((row_number() OVER (ORDER BY o_orderkey) - 1)
  // (count(*) OVER () // 7), 6) AS part FROM orders"""
ORACLE["fixed_batches"] = _chain(
    f"r AS (SELECT o_orderkey, {_order_rank('5')} - 1 AS r, count(*) OVER () AS n FROM orders)",
    "e AS (SELECT *, row_number() OVER (ORDER BY md5('5:fill:' || o_orderkey)) AS f FROM r WHERE r // 64 < n // 64)",
    """SELECT o_orderkey, r // 64 AS batch, false AS filler FROM r
UNION ALL SELECT o_orderkey, n // 64, true FROM e WHERE f <= (64 - n % 64) % 64""",
)
_CLICKS = """clicks AS (SELECT user_id, cast(floor(value) AS bigint) AS click_article_id,
    date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS click_timestamp FROM events)"""
_CLICK_COLS = "user_id, click_article_id, click_timestamp"
ORACLE["dedup_clicks"] = _chain(_CLICKS, f"SELECT DISTINCT {_CLICK_COLS} FROM clicks")
ORACLE["click_log"] = _chain(
    _CLICKS,
    f"""SELECT {_CLICK_COLS} FROM clicks UNION
SELECT user_id, click_article_id, click_timestamp + 1 FROM clicks""",
)
ORACLE["sample_users"] = _chain(
    _CLICKS,
    "u AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM clicks) ORDER BY md5('2:' || user_id) LIMIT 10)",
    f"SELECT DISTINCT {_CLICK_COLS} FROM clicks WHERE user_id IN (SELECT user_id FROM u)",
)

# ---------------------------------------------------------------- evaluation
_TRIPLES = (
    """gold AS (SELECT l_orderkey AS sample_id, p_name AS subject, l_returnflag AS predicate, s_name AS object,
    l_linenumber AS ss, l_linenumber + 2 AS se, l_suppkey AS os, l_suppkey + 2 AS oe, l_tax, l_discount
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)""",
    """pred AS (SELECT * REPLACE (CASE WHEN l_discount > 0.05 THEN 'X' ELSE predicate END AS predicate)
  FROM gold WHERE l_tax < 0.07)""",
)
_KEYS = {
    "only_head_index": "sample_id, ss, predicate, os",
    "whole_span": "sample_id, ss, se, predicate, os, oe",
    "whole_text": "sample_id, subject, predicate, object",
    "only_head_text": "sample_id, split_part(subject, ' ', 1) AS sh, predicate, split_part(object, ' ', 1) AS oh",
}


def _matched(pattern: str) -> tuple[str, ...]:
    k = _KEYS[pattern]
    return (
        *_TRIPLES,
        f"""m AS (SELECT
    (SELECT count(*) FROM (SELECT {k} FROM gold INTERSECT SELECT {k} FROM pred)) AS correct_num,
    (SELECT count(*) FROM (SELECT DISTINCT {k} FROM pred)) AS pred_num,
    (SELECT count(*) FROM (SELECT DISTINCT {k} FROM gold)) AS gold_num)""",
    )


for _pattern in _KEYS:
    ORACLE[f"match_triples_{_pattern}"] = _chain(*_matched(_pattern), "SELECT * FROM m")
ORACLE["prf_eps"] = _chain(
    *_matched("only_head_text"),
    "pr AS (SELECT *, correct_num / (pred_num + 1e-10) AS p, correct_num / (gold_num + 1e-10) AS r FROM m)",
    """SELECT correct_num, pred_num, gold_num, round(p, 6) AS precision, round(r, 6) AS recall,
  round(2 * p * r / (p + r + 1e-10), 6) AS f1 FROM pr""",
)
ORACLE["prf_percent"] = _chain(
    *_matched("whole_text"),
    """pr AS (SELECT *, CASE WHEN pred_num <> 0 THEN correct_num / pred_num * 100 ELSE 0 END AS p,
    CASE WHEN gold_num <> 0 THEN correct_num / gold_num * 100 ELSE 0 END AS r FROM m)""",
    """SELECT correct_num, pred_num, gold_num, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p <> 0 OR r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr""",
)
ORACLE["sample_accuracy"] = _chain(
    """t AS (SELECT l_orderkey AS id, l_linenumber AS pos, max(ascii(l_returnflag)) AS g, max(l_tax) AS tax
  FROM lineitem GROUP BY ALL)""",
    "s AS (SELECT id, bool_and(g = CASE WHEN tax > 0.07 THEN g + 1 ELSE g END) AS ok FROM t GROUP BY id)",
    "SELECT round(avg(CASE WHEN ok THEN 1.0::double ELSE 0.0::double END), 6) AS sample_acc FROM s",
)
_BATCHES = """b AS (SELECT user_id AS run, cast(dayofmonth(ts) AS int) AS epoch, event_id AS batch, value AS loss,
    value / 7 AS ent_acc FROM events)"""
ORACLE["epoch_means"] = _chain(
    _BATCHES,
    "SELECT run, epoch, round(avg(loss), 6) AS loss, round(avg(ent_acc), 6) AS ent_acc FROM b GROUP BY run, epoch",
)
ORACLE["running_means"] = _chain(
    _BATCHES,
    """SELECT run, epoch, batch, round(avg(loss) OVER w, 6) AS avg_loss, round(avg(ent_acc) OVER w, 6) AS avg_ent_acc
FROM b WINDOW w AS (PARTITION BY run, epoch ORDER BY batch ROWS UNBOUNDED PRECEDING)""",
)
ORACLE["best_so_far"] = _chain(
    _BATCHES,
    """m AS (SELECT run, batch, loss, max(loss) OVER (PARTITION BY run ORDER BY batch
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM b)""",
    "SELECT run, batch, loss, best_before, best_before IS NULL OR loss > best_before AS improved FROM m",
)

# ---------------------------------------------------------------- annotations
_LINES = """lines AS (
  SELECT doc_id * 2147483648 + generate_subscripts(l, 1) - 1 AS item_id, unnest(l) AS title
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
_ANNS = (
    _LINES,
    _space_tokens("toks", "lines", "item_id", "title"),
    "nxt AS (SELECT *, lead(token) OVER (PARTITION BY item_id ORDER BY tok_ind) AS nw FROM toks)",
    """anns AS (SELECT item_id, tok_ind, token AS val,
    CASE length(token) % 3 WHEN 0 THEN 'size' WHEN 1 THEN 'colour code' ELSE 'brand' END AS typ,
    CASE WHEN tok_ind % 13 = 0 THEN 'description' ELSE 'title' END AS src,
    cs + CASE WHEN tok_ind % 7 = 0 THEN 1 ELSE 0 END AS s,
    cs + length(token) + CASE WHEN tok_ind % 11 = 0 AND nw IS NOT NULL THEN 1 + length(nw) ELSE 0 END AS e
  FROM nxt)""",
)


def _runs(text: str) -> str:
    """``text`` with chr(64976), a noncharacter, behind every run of word or other characters."""
    return f"regexp_replace({text}, '([{_WORD}]+|[^{_WORD}]+)', '\\1' || chr(64976), 'g')"


def _hit(target: str) -> str:
    """Length of what precedes the first whole-word hit of ``target`` in the title, NULL if none.

    The marked title has the separator exactly at its word edges.
    """
    at = f"instr(marked, chr(64976) || {_runs(target)})"
    return f"""CASE WHEN {target} <> '' AND {at} > 0
    THEN length(replace(left(marked, {at} - 1), chr(64976), '')) END"""


_REPAIRED = (
    *_ANNS,
    f"""marks AS (SELECT item_id, title, CASE WHEN regexp_matches(title, '^[{_WORD}]') THEN chr(64976) ELSE '' END
    || CASE WHEN regexp_matches(title, '[^{_WORD}]$') THEN left({_runs('title')}, -1) ELSE {_runs('title')} END AS marked
  FROM lines)""",
    "cut AS (SELECT a.*, title, marked, substr(title, s + 1, e - s) AS piece FROM anns a JOIN marks USING (item_id))",
    f"""hits AS (SELECT *, CASE WHEN src = 'title' AND val <> piece THEN {_hit('val')} END AS vh FROM cut)""",
    f"""hits2 AS (SELECT *, CASE WHEN src = 'title' AND val <> piece AND vh IS NULL THEN {_hit('piece')} END AS ph
  FROM hits)""",
    """spans AS (SELECT item_id, src, typ, val, s, e, CASE WHEN src <> 'title' OR val = piece THEN s ELSE coalesce(vh, ph) END AS rs,
    CASE WHEN src <> 'title' OR val = piece THEN e WHEN vh IS NOT NULL THEN vh + length(val)
         ELSE ph + length(piece) END AS re, title FROM hits2)""",
    """ok AS (SELECT *, substr(title, rs + 1, re - rs) AS txt,
    row_number() OVER (PARTITION BY item_id ORDER BY s, e, typ, val) AS k FROM spans WHERE rs IS NOT NULL)""",
)
# The ordered scan as a fold: state is the end and type that decide, out the kept positions.
_FOLD = """folded AS (SELECT item_id, list_reduce(
    list({'k': k, 's': rs, 'e': re, 't': typ} ORDER BY k),
    lambda st, x: CASE WHEN x.s < st.e AND x.t = st.t AND st.e >= x.e THEN st
      ELSE {'e': x.e, 't': x.t, 'out': list_append(st.out, x.k)} END,
    {'e': -1::bigint, 't': '', 'out': []::bigint[]}).out AS keep
  FROM ok WHERE src = 'title' GROUP BY item_id)"""
_KEPT = """kept AS (SELECT item_id, txt AS indexed_text, typ AS attribute_type, cast(rs AS int) AS start_idx,
    cast(re AS int) AS end_idx, k
  FROM ok JOIN (SELECT item_id, unnest(keep) AS k FROM folded) USING (item_id, k))"""
_TAGGED = (
    *_REPAIRED,
    _FOLD,
    _KEPT,
    "tagged AS (SELECT DISTINCT item_id, indexed_text, attribute_type, start_idx, end_idx FROM kept)",
)
_SPAN_COLS = "item_id, indexed_text, attribute_type, start_idx, end_idx"
_STRICT = (
    *_REPAIRED,
    """before AS (SELECT *, lag(re) OVER (PARTITION BY item_id ORDER BY k) AS last_end FROM ok WHERE src = 'title')""",
    """tagged AS (SELECT DISTINCT item_id, txt AS indexed_text, typ AS attribute_type, cast(rs AS int) AS start_idx,
    cast(re AS int) AS end_idx FROM before WHERE last_end IS NULL OR rs >= last_end)""",
)
ORACLE["filter_types"] = _chain(
    *_ANNS,
    """SELECT item_id, val AS attribute_value, typ AS attribute_type, cast(s AS int) AS start_idx, cast(e AS int) AS end_idx
FROM anns WHERE typ IN ('size', 'brand') AND s >= 0 AND e >= 0""",
)
ORACLE["repair_deoverlap"] = _chain(*_TAGGED, f"SELECT {_SPAN_COLS} FROM tagged")
ORACLE["repair_strict"] = _chain(*_STRICT, f"SELECT {_SPAN_COLS} FROM tagged")
_DEDUPED = (
    *_TAGGED,
    """sets AS (SELECT item_id, list({'s': start_idx, 'e': end_idx, 't': attribute_type, 'x': indexed_text}
    ORDER BY start_idx, end_idx, attribute_type, indexed_text) AS spans FROM tagged GROUP BY item_id)""",
    """survivors AS (SELECT min(item_id) AS item_id, title, spans FROM sets JOIN lines USING (item_id)
  GROUP BY title, spans)""",
)
ORACLE["drop_duplicates"] = _chain(*_DEDUPED, "SELECT item_id, title, cast(len(spans) AS int) AS n_spans FROM survivors")
ORACLE["attribute_types"] = _chain(
    *_ANNS, "SELECT DISTINCT typ AS attr_type, replace(trim(typ), ' ', '##') AS tag FROM anns"
)
ORACLE["count_type_value"] = _chain(
    *_TAGGED,
    "SELECT attribute_type AS attr_type, indexed_text AS value_content, count(*) AS count FROM tagged GROUP BY ALL",
)
ORACLE["count_type"] = _chain(
    *_TAGGED, "SELECT attribute_type AS attr_type, count(*) AS count FROM tagged GROUP BY ALL"
)
ORACLE["count_source_type"] = _chain(
    *_REPAIRED,
    _FOLD,
    _KEPT,
    """SELECT 'title-' || attribute_type AS source_type, count(*) AS count FROM kept GROUP BY ALL
UNION ALL SELECT 'description-' || typ, count(*) FROM ok WHERE src <> 'title' GROUP BY typ""",
)
ORACLE["count_source_type_strict"] = _chain(
    *_REPAIRED, "SELECT src || '-' || typ AS source_type, count(*) AS count FROM ok GROUP BY ALL"
)
ORACLE["values_by_type"] = _chain(
    *_ANNS,
    "SELECT item_id, typ AS attr_type, string_agg(val, ' ' ORDER BY tok_ind) AS vals FROM anns GROUP BY item_id, typ",
)


def _rare(counts: str, ratio: str, threshold: int) -> tuple[str, ...]:
    """Rank-by-rank search for the depth k over a ``(attr_type, value_content, count)`` table."""
    return (
        f"tot AS (SELECT attr_type, sum(count) AS total FROM {counts} GROUP BY ALL)",
        f"small AS (SELECT attr_type FROM tot WHERE total < {4 * threshold})",
        f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY attr_type ORDER BY count, md5('value:' || value_content)) AS r
    FROM {counts} WHERE attr_type NOT IN (SELECT attr_type FROM small))""",
        f"target AS (SELECT floor(sum(count)::double * {ratio}::double) AS t FROM ranked)",
        f"""per_rank AS (SELECT r, sum(CASE WHEN count < {threshold} THEN count ELSE 0 END) AS c,
    sum(CASE WHEN r = 1 THEN count ELSE 0 END) AS first FROM ranked GROUP BY r)""",
        """grown AS (SELECT r, CASE WHEN r = 1 THEN first ELSE sum(c) OVER (ORDER BY r) END AS s FROM per_rank)""",
        """grown2 AS (SELECT * FROM grown UNION ALL SELECT max(r) + 1, max_by(s, r) FROM grown)""",
        """depth AS (SELECT min(r) AS k FROM (SELECT r, s, lag(s) OVER (ORDER BY r) AS prev FROM grown2)
    WHERE s >= (SELECT t FROM target) OR s = prev)""",
        f"""rare AS (SELECT attr_type, value_content, count FROM ranked
    WHERE r <= (SELECT k FROM depth) AND count < {threshold})""",
    )


_WORDS = """words AS (SELECT attr_type, value_content, count(*) AS count FROM (
    SELECT lang AS attr_type, unnest(regexp_split_to_array(text, '[ \\n]')) AS value_content FROM documents)
  WHERE value_content <> '' GROUP BY ALL)"""
ORACLE["select_rare_values"] = _chain(
    _WORDS, *_rare("words", "0.2", 50), "SELECT attr_type, value_content, count FROM rare"
)
ORACLE["value_count_report"] = _chain(
    _WORDS,
    *_rare("words", "0.2", 50),
    """SELECT w.attr_type, count(*) AS all_values, count(r.value_content) AS selected_values
FROM words w LEFT JOIN rare r ON r.attr_type = w.attr_type AND r.value_content = w.value_content GROUP BY ALL""",
)


def _flagged(threshold: int) -> tuple[str, ...]:
    return (
        "counts AS (SELECT attribute_type AS attr_type, indexed_text AS value_content, count(*) AS count FROM tagged GROUP BY ALL)",
        *_rare("counts", "0.2", threshold),
        """flags AS (SELECT item_id, bool_or(CASE WHEN attribute_type IN (SELECT attr_type FROM small)
      THEN substr(md5('0:' || item_id || ':' || attribute_type || ':' || start_idx || ':' || end_idx), 1, 8) < '0ccccccc'
      ELSE r.value_content IS NOT NULL END) AS is_test
    FROM tagged LEFT JOIN rare r ON r.attr_type = attribute_type AND r.value_content = indexed_text GROUP BY item_id)""",
    )


ORACLE["new_value_split"] = _chain(
    *_TAGGED,
    *_flagged(40),
    "SELECT item_id, coalesce(is_test, false) AS is_test FROM lines LEFT JOIN flags USING (item_id)",
)


def _bio(order: str, scheme: str, title: str = "title") -> tuple[str, ...]:
    """Accepted spans, the pieces between and inside them, and their words with tags."""
    pattern = f"[{_WORD}]+|[^{_WORD}{_SPACE}]"
    if scheme == "BIO":
        prefix = "CASE WHEN i = 1 THEN 'B' ELSE 'I' END"
    else:
        prefix = "CASE WHEN n = 1 THEN 'S' WHEN i = 1 THEN 'B' WHEN i = n THEN 'E' ELSE 'I' END"
    return (
        f"""vis AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {order}) AS v FROM tagged)""",
        """acc AS (SELECT item_id, list_reduce(list({'v': v, 's': start_idx, 'e': end_idx} ORDER BY v),
      lambda st, x: CASE WHEN x.s >= st.e THEN {'e': x.e, 'out': list_append(st.out, x.v)} ELSE st END,
      {'e': 0, 'out': []::bigint[]}).out AS keep, count(*) AS n_all FROM vis GROUP BY item_id)""",
        """accepted AS (SELECT item_id, v, start_idx, end_idx, attribute_type,
      coalesce(lag(end_idx) OVER (PARTITION BY item_id ORDER BY v), 0) AS prev_end
    FROM vis JOIN (SELECT item_id, unnest(keep) AS v FROM acc) USING (item_id, v))""",
        f"""pieces AS (
    SELECT item_id, 2 * v AS ord, 'O' AS typ, substr({title}, prev_end + 1, start_idx - prev_end) AS piece
      FROM accepted JOIN lines USING (item_id)
    UNION ALL SELECT item_id, 2 * v + 1, attribute_type, substr({title}, start_idx + 1, end_idx - start_idx)
      FROM accepted JOIN lines USING (item_id)
    UNION ALL SELECT item_id, 1000000000, 'O', substr({title}, coalesce(last_end, 0) + 1)
      FROM lines LEFT JOIN (SELECT item_id, max_by(end_idx, v) AS last_end FROM accepted GROUP BY item_id) USING (item_id))""",
        f"""ws AS (SELECT item_id, ord, typ, len(l) AS n, unnest(l) AS word, generate_subscripts(l, 1) AS i
    FROM (SELECT *, regexp_extract_all(piece, '{pattern}') AS l FROM pieces))""",
        f"""tags AS (SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY ord, i) - 1 AS int) AS pos, word,
      CASE WHEN ord % 2 = 0 THEN 'O' ELSE {prefix} || '-' || replace(trim(typ), ' ', '##') END AS tag FROM ws)""",
        """dropped AS (SELECT item_id, coalesce(n_all - len(keep), 0) AS num_overlap
    FROM lines LEFT JOIN acc USING (item_id))""",
        """bio AS (SELECT item_id, coalesce(string_agg(word || ' ' || tag, chr(10) ORDER BY pos), '') AS bio
    FROM lines LEFT JOIN tags USING (item_id) GROUP BY item_id)""",
    )


_BY_TYPE = "attribute_type, start_idx, end_idx DESC"
_BIO = _bio(_BY_TYPE, "BIO")
ORACLE["bio_tags"] = _chain(*_TAGGED, *_BIO, "SELECT item_id, pos, word, tag FROM tags")
ORACLE["bioes_tags"] = _chain(
    *_TAGGED, *_bio("start_idx, end_idx DESC, attribute_type", "BIOSE"), "SELECT item_id, pos, word, tag FROM tags"
)
ORACLE["bio_overlaps"] = _chain(*_TAGGED, *_BIO, "SELECT item_id, num_overlap FROM dropped")
_SPLIT = "row_number() OVER (ORDER BY md5('0:' || item_id)) <= ceil(count(*) OVER () * 0.2::double)"
ORACLE["build_single_value_set"] = _chain(
    *_STRICT,
    *_bio(_BY_TYPE, "BIO", "lower(title)"),
    f"""SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM tagged) THEN bio END AS bio, num_overlap, {_SPLIT} AS is_test
FROM bio JOIN dropped USING (item_id)""",
)
ORACLE["build_multi_value_set"] = _chain(
    *_TAGGED,
    *_BIO,
    f"""SELECT item_id, bio, num_overlap, {_SPLIT} AS is_test FROM bio JOIN dropped USING (item_id)
WHERE item_id IN (SELECT item_id FROM tagged)""",
)
ORACLE["build_new_value_set"] = _chain(
    *_TAGGED,
    *_BIO,
    *_flagged(50),
    """SELECT item_id, bio, num_overlap, coalesce(is_test, false) AS is_test
FROM bio JOIN dropped USING (item_id) JOIN flags USING (item_id)""",
)
ORACLE["build_training_set"] = _chain(
    *_DEDUPED,
    *_BIO,
    f"SELECT item_id, bio, num_overlap, {_SPLIT} AS is_test FROM bio JOIN dropped USING (item_id) JOIN survivors USING (item_id)",
)
ORACLE["build_training_set_new_value"] = _chain(
    *_DEDUPED,
    *_BIO,
    *_flagged(40),
    """SELECT item_id, bio, num_overlap, coalesce(is_test, false) AS is_test
FROM bio JOIN dropped USING (item_id) JOIN flags USING (item_id) JOIN survivors USING (item_id)""",
)

# ---------------------------------------------------------------- relations
ORACLE["normalize_samples"] = """SELECT 'train_' || (row_number() OVER (ORDER BY conv_id * 2147483648 + turn) - 1) AS id,
  replace(text, chr(65533), '') AS text, replace(split_part(text, ' ', 1), chr(65533), '') AS subject,
  role AS predicate, replace(split_part(text, ' ', -1), chr(65533), '') AS object FROM conversations"""


def _occurrences(name: str, entity: str) -> str:
    """Starts of ``entity`` between spaces, left to right, from the lengths of the split pieces."""
    return f"""{name} AS (SELECT id, cast(sum(length(p) + length(ent) + 2) OVER (PARTITION BY id ORDER BY i) - length(ent) - 2 AS int) AS s,
    cast(s + length(ent) AS int) AS e, i, n
  FROM (SELECT id, ent, len(l) AS n, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (
    SELECT id, {entity} AS ent, string_split(' ' || text || ' ', ' ' || {entity} || ' ') AS l FROM smp WHERE {entity} <> '')))"""


_CHAR_SPANS = (
    _LINES,
    """smp AS (SELECT cast(item_id AS varchar) AS id, title AS text, split_part(title, ' ', 1) AS subject,
    split_part(title, ' ', -1) AS object FROM lines)""",
    _occurrences("so", "subject"),
    _occurrences("oo", "object"),
    """rels AS (SELECT id, subject, object, so.s AS subj_s, so.e AS subj_e, oo.s AS obj_s, oo.e AS obj_e
  FROM smp JOIN so USING (id) JOIN oo USING (id) WHERE so.i < so.n AND oo.i < oo.n)""",
)
ORACLE["char_spans"] = _chain(*_CHAR_SPANS, "SELECT * FROM rels")
ORACLE["validate_spans"] = _chain(
    *_CHAR_SPANS,
    """checked AS (SELECT r.id, substr(text, subj_s + 1, subj_e - subj_s) = trim(r.subject)
      AND substr(text, obj_s + 1, obj_e - obj_s) = trim(r.object) AND trim(r.subject) <> '' AND trim(r.object) <> '' AS good
  FROM rels r JOIN smp USING (id))""",
    """SELECT id, 'clean' AS side, cast(count(*) AS int) AS n_rel FROM checked WHERE good GROUP BY id
UNION ALL SELECT id, 'bad', cast(count(*) AS int) FROM checked GROUP BY id HAVING NOT bool_and(good)""",
)
_DOC_TOKENS = _space_tokens("toks", "documents", "doc_id", "text")
ORACLE["token_spans"] = _chain(
    _DOC_TOKENS,
    """ln AS (SELECT doc_id, span_no, line, cast(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY span_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS int) AS s
  FROM (SELECT doc_id, unnest(l) AS line, cast(generate_subscripts(l, 1) - 1 AS int) AS span_no
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))""",
    "cover AS (SELECT doc_id, tok_ind, cs, cs + length(token) AS ce FROM toks WHERE token <> '')",
    # The only token that can cover a character is the last one that starts at or before it.
    """SELECT ln.doc_id, span_no, CASE WHEN s < a.ce THEN a.tok_ind ELSE -1 END AS ts,
  CASE WHEN s + length(line) - 1 < b.ce THEN b.tok_ind + 1 ELSE -1 END AS te
FROM ln ASOF LEFT JOIN cover a ON a.doc_id = ln.doc_id AND ln.s >= a.cs
ASOF LEFT JOIN cover b ON b.doc_id = ln.doc_id AND ln.s + length(line) - 1 >= b.cs WHERE line <> ''""",
)
ORACLE["attach_token_spans"] = _chain(
    *_CHAR_SPANS,
    _space_tokens("toks", "smp", "id", "text"),
    "cover AS (SELECT id, tok_ind, cs, cs + length(token) AS ce FROM toks WHERE token <> '')",
    # Subject and object are whole words here, so a span's ends are ends of tokens.
    """SELECT r.id, subj_s AS subj_cs, obj_s AS obj_cs,
  coalesce(a.tok_ind, -1) AS subj_ts, coalesce(b.tok_ind + 1, -1) AS subj_te,
  coalesce(c.tok_ind, -1) AS obj_ts, coalesce(d.tok_ind + 1, -1) AS obj_te
FROM rels r LEFT JOIN cover a ON a.id = r.id AND a.cs = subj_s LEFT JOIN cover b ON b.id = r.id AND b.ce = subj_e
LEFT JOIN cover c ON c.id = r.id AND c.cs = obj_s LEFT JOIN cover d ON d.id = r.id AND d.ce = obj_e""",
)


def _windows(max_len: int, stride: int) -> tuple[str, ...]:
    return (
        _DOC_TOKENS,
        "size AS (SELECT doc_id, max(tok_ind) + 1 AS n FROM toks GROUP BY doc_id)",
        f"""starts AS (SELECT doc_id, n, cast(k AS int) AS win, cast(k * {stride} AS int) AS start FROM (
      SELECT *, unnest(range(0, (n - 1) // {stride} + 1)) AS k FROM size)
    WHERE k = 0 OR (k - 1) * {stride} + {max_len} <= n)""",
        f"""win AS (SELECT w.*, a.cs AS c0, b.cs + length(b.token) AS c1 FROM starts w
    JOIN toks a ON a.doc_id = w.doc_id AND a.tok_ind = start
    JOIN toks b ON b.doc_id = w.doc_id AND b.tok_ind = least(start + {max_len}, n) - 1)""",
    )


_WIN_RELS = (
    *_windows(100, 50),
    """rel AS (SELECT a.doc_id, a.tok_ind AS st, b.tok_ind AS ot, a.token AS subject, b.token AS object, a.cs AS sc,
    b.cs + length(b.token) AS oc
  FROM toks a JOIN toks b ON b.doc_id = a.doc_id AND b.tok_ind = a.tok_ind + 3)""",
    """inside AS (SELECT win.doc_id, win, subject, object, st - start AS st, ot + 1 - start AS ot, sc - c0 AS sc, oc - c0 AS oc
  FROM win JOIN rel ON rel.doc_id = win.doc_id AND st >= start AND ot + 1 <= start + 100)""",
)
ORACLE["sliding_windows"] = _chain(
    *_WIN_RELS,
    """cnt AS (SELECT doc_id, win, cast(count(*) AS int) AS n_rel FROM inside GROUP BY ALL)""",
    """SELECT cast(doc_id AS varchar) AS id, win, substr(text, c0 + 1, c1 - c0) AS text, start AS tok_offset, c0 AS char_offset,
  coalesce(n_rel, 0) AS n_rel FROM win JOIN documents USING (doc_id) LEFT JOIN cnt USING (doc_id, win)""",
)
ORACLE["sliding_window_relations"] = _chain(
    *_WIN_RELS,
    """SELECT cast(doc_id AS varchar) AS id, win, subject, object, cast(st AS int) AS subj_ts, cast(ot AS int) AS obj_te,
  cast(sc AS int) AS subj_cs, cast(oc AS int) AS obj_ce FROM inside""",
)
ORACLE["sliding_windows_test"] = _chain(
    *_windows(64, 64),
    """SELECT doc_id AS id, win, substr(text, c0 + 1, c1 - c0) AS text, start AS tok_offset, c0 AS char_offset
FROM win JOIN documents USING (doc_id) WHERE c1 > c0""",
)

# ---------------------------------------------------------------- logs
ORACLE["extract_series"] = r"""SELECT path, cast(generate_subscripts(m, 1) - 1 AS int) AS i, unnest(m) AS value FROM (
  SELECT cast(doc_id AS varchar) AS path, regexp_extract_all(array_to_string(list_transform(
    CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END, lambda x: 'eval f1 = ' || length(x) || chr(10)), ''),
    '\sf1\s=([\s\d.]+)\n', 1) AS m
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
ORACLE["third_decimal"] = r"""SELECT cast(l_orderkey AS varchar) AS path, cast(l_linenumber AS bigint) AS line_no,
  regexp_extract_all(l_quantity || ' ' || l_tax || ' ' || l_extendedprice, '\d+\.\d+')[3] AS value
FROM lineitem WHERE l_linenumber >= 2"""


def _log(line: str) -> str:
    return f"""log AS (SELECT cast(user_id AS varchar) AS path,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line_no, {line} AS line FROM events)"""


ORACLE["block_pick"] = _chain(
    _log("event_type || ' (' || value || ', ' || event_id || ')'"),
    r"""picks AS (SELECT path, line_no // 6 AS k, count(*) OVER (PARTITION BY path) AS n,
    regexp_extract(line, '([\d.]+)[,)]', 1) AS value FROM log WHERE line_no % 6 = 5)""",
    """SELECT path, CASE n - k WHEN 3 THEN 2 WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE k + 2 END AS pos, value
FROM picks WHERE n - k <= 3 OR k >= 1""",
)
ORACLE["slice_sections"] = _chain(
    _log(
        """CASE WHEN event_type = 'signup' THEN '---------------- Results -----------------------'
        || CASE WHEN event_id % 3 = 0 THEN ' Total epoch7:' ELSE '' END
      WHEN event_type = 'error' THEN 'Total epoch' || (event_id % 50 + 1) || ':' ELSE event_type || ' f1 = ' || value END"""
    ),
    r"""ev AS (SELECT path, line_no, contains(line, '---------------- Results') AS m, regexp_matches(line, 'Total epoch(\d*):') AS e
  FROM log)""",
    # The loop over the lines of a log as a fold: a flag, and the lines at which it changes.
    """flips AS (SELECT path, list_reduce(list({'n': line_no, 'm': m, 'e': e} ORDER BY line_no),
      lambda st, x: CASE WHEN (st.ins AND x.e) OR (NOT st.ins AND x.m)
        THEN {'ins': NOT st.ins, 'pts': list_append(st.pts, x.n)} ELSE st END,
      {'ins': false, 'pts': []::bigint[]}).pts AS pts FROM ev WHERE m OR e GROUP BY path)""",
    """sec AS (SELECT path, unnest(range(1, len(pts) + 1, 2)) AS i, pts FROM flips)""",
    """spans AS (SELECT path, (i + 1) // 2 AS section, pts[i] AS a, pts[i + 1] AS z FROM sec)""",
    r"""SELECT s.path, cast(section AS bigint) AS section, l.line_no, l.line,
  cast(regexp_extract(t.line, 'Total epoch(\d*):', 1) AS int) - 1 AS epoch
FROM spans s JOIN log l ON l.path = s.path AND l.line_no > a AND (z IS NULL OR l.line_no < z)
LEFT JOIN log t ON t.path = s.path AND t.line_no = z""",
)
_BLOCKS = (
    _log(
        """CASE event_type WHEN 'signup' THEN 'run start' WHEN 'click' THEN '''test_triples'''
      ELSE 'score 0.' || event_id || ' end' END"""
    ),
    """b AS (SELECT *, count(*) FILTER (contains(line, 'start')) OVER w AS run,
    count(*) FILTER (contains(line, 'test_triples')) OVER w AS block FROM log
  WINDOW w AS (PARTITION BY path ORDER BY line_no))""",
    """c AS (SELECT *, row_number() OVER (PARTITION BY path, block ORDER BY line_no) AS pos FROM b)""",
    # Every run is a list of its own, so a value's number starts at 0 in each.
    r"""vals AS (SELECT path, run, row_number() OVER (PARTITION BY path, run ORDER BY line_no) - 1 AS idx,
    regexp_extract(line, '0\.\d+') AS value FROM c WHERE run >= 1 AND block >= 1 AND pos = 3)""",
)
ORACLE["run_blocks"] = _chain(*_BLOCKS, "SELECT path, run, idx, value FROM vals")
ORACLE["run_blocks_max"] = _chain(
    *_BLOCKS,
    """done AS (SELECT path, run, idx, try_cast(value AS double) AS value FROM vals v
  WHERE run < (SELECT max(run) FROM b WHERE b.path = v.path))""",
    """placed AS (SELECT path, idx, value, dense_rank() OVER (PARTITION BY path ORDER BY run) AS epoch,
    (max(idx) OVER (PARTITION BY path) + 1) // 2 AS half FROM done)""",
    """cells AS (SELECT path, epoch, idx AS col, value, half FROM placed
  UNION ALL SELECT path, epoch, idx - 1, value, half FROM placed)""",
    """SELECT path, epoch, col, max(value) AS value FROM cells
WHERE epoch > 1 AND col >= 0 AND col < half GROUP BY path, epoch, col""",
)
ORACLE["align_runs"] = _chain(
    "a AS (SELECT row_number() OVER (ORDER BY event_id) AS rn, value AS ent_a, event_id::double AS head_a, 0.25::double AS tail_a FROM events)",
    "b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS rn, o_totalprice AS ent_b, o_orderkey::double AS head_b, 0.25::double AS tail_b FROM orders)",
    """SELECT rn, ent_a, head_a, tail_a, ent_b, head_b, tail_b
FROM a FULL JOIN (SELECT * FROM b WHERE rn <= (SELECT count(*) FROM a) + 1) USING (rn)""",
)
_PAIRS = (
    """ev AS (SELECT cast(user_id AS varchar) AS path, event_id, value,
    CASE event_type WHEN 'signup' THEN 'student' WHEN 'view' THEN 'teacher' END AS kind,
    event_type IN ('click', 'purchase') AS closes FROM events WHERE event_type <> 'error')""",
    """g AS (SELECT *, coalesce(sum(closes::int) OVER (PARTITION BY path ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS grp FROM ev)""",
    """grp AS (SELECT path, grp, count(kind) AS n_acc, max(kind) AS kind, max(value) FILTER (kind IS NOT NULL) AS ent,
    max(event_id) FILTER (kind IS NOT NULL) AS head, max(value) FILTER (closes) AS score
  FROM g GROUP BY path, grp HAVING bool_or(closes) AND count(kind) > 0)""",
)
ORACLE["pair_metrics"] = _chain(
    *_PAIRS,
    "good AS (SELECT *, min(grp) FILTER (kind = 'student') OVER (PARTITION BY path) AS first FROM grp WHERE n_acc = 1)",
    """SELECT path, kind, grp, round(ent + head + 0.5::double, 6) AS "all", ent, head::double AS head, 0.5::double AS tail, score
FROM good WHERE kind = 'teacher' OR grp > first""",
)
ORACLE["pair_metrics_errors"] = _chain(*_PAIRS, "SELECT path, grp, n_acc FROM grp WHERE n_acc > 1")
ORACLE["pairwise_max"] = _chain(
    """m AS (SELECT cast(dayofmonth(ts) AS int) AS day, cast(hour(ts) AS int) AS col, max(value) AS value
  FROM events GROUP BY ALL)""",
    "r AS (SELECT *, dense_rank() OVER (ORDER BY day) AS epoch FROM m)",
    """SELECT t.epoch, t.i AS col, max(r.value) AS value
FROM (SELECT DISTINCT epoch, cast(i AS int) AS i FROM r CROSS JOIN
      (SELECT unnest(range((SELECT (max(col) + 1) // 2 FROM m))) AS i)) t
JOIN r ON r.epoch = t.epoch AND r.col IN (t.i, t.i + 1) WHERE t.epoch > 1 GROUP BY t.epoch, t.i""",
)

# ---------------------------------------------------------------- chunks, knowledge base, union
_CHUNKS = (
    "c AS (SELECT l_suppkey AS chunk_id, count(*) AS n_rows FROM lineitem GROUP BY ALL)",
    "cum AS (SELECT *, cast(sum(n_rows) OVER (ORDER BY chunk_id) AS bigint) AS cumulative FROM c)",
)
ORACLE["cumulative_sizes"] = _chain(*_CHUNKS, "SELECT chunk_id, n_rows, cumulative FROM cum")
ORACLE["locate_rows"] = _chain(
    *_CHUNKS,
    """ix AS (SELECT DISTINCT cast(floor(o_totalprice / 7) - 5000 AS bigint) AS idx FROM orders)""",
    """p AS (SELECT idx, CASE WHEN idx < 0 THEN idx + (SELECT count(*) FROM lineitem) ELSE idx END AS pos FROM ix)""",
    """SELECT idx, chunk_id, pos - (cumulative - n_rows) AS row_in_chunk,
  CASE WHEN chunk_id IS NULL THEN 'out_of_range' ELSE 'ok' END AS status
FROM p LEFT JOIN cum ON pos >= cumulative - n_rows AND pos < cumulative""",
)


def _kb(name: str, entry: str) -> str:
    return f"""SELECT name, page, string_agg(entry, ',' ORDER BY pos) AS entries FROM (
  SELECT {name} AS name, {entry} AS entry, p_partkey AS pos,
    (row_number() OVER (PARTITION BY {name} ORDER BY p_partkey) - 1) // 100 AS page FROM part) GROUP BY name, page"""


ORACLE["invert_kb"] = _kb("p_type", "p_brand")
ORACLE["invert_kb_reverse"] = _kb("p_brand", "p_type")
ORACLE["concat_texts"] = """SELECT 0 AS src, item_id AS row_id, text FROM benchmark
UNION ALL SELECT 1, doc_id, text FROM documents"""
