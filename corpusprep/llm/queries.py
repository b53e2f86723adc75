"""Catalogue queries of the subpackage over the given tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.llm import (
    byte_bpe,
    conversation_trie,
    decontaminate,
    dual_tree,
    html_text,
    language_model,
    line_dedup,
    max_sketch,
    near_dup,
    packing,
    resample,
    token_counts,
    toxicity,
)

LIMIT = 4096  # tokens


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("_id", "doc_id")


def op2_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select(
        F.col("_id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.keep_bitmaps(table(spark, sf_dir, "documents"))
    text = line_dedup.kept_text(F.col("text"), F.col("keep_runs"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


def op4_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_counts.prefix_counts(docs, tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


def op5_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


def op6_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("_id", "doc_id")


def op7_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


def op8_dual_tree_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select(
        F.col("_id").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def op11_max_sketch_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = max_sketch.index(table(spark, sf_dir, "documents"))
    return max_sketch.search(index, table(spark, sf_dir, "benchmark"), 10)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks)
    found = byte_bpe.decode(encoded.select("doc_id", "ids"), ranks)
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_importance_resampling,
        op2_curve_packing,
        op3_line_dedup,
        op4_prefix_token_counts,
        op5_tag_path_text,
        op6_toxicity_trees,
        op7_maxent_scores,
        op8_dual_tree_top5,
        op9_decontamination,
        op10_hyperminhash,
        op11_max_sketch_top10,
        op12_byte_bpe,
        op13_conversation_trie,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op3_line_dedup": r"""
WITH rows_ AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM rows_),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, holder IS NOT NULL AND holder <> doc_id AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op8_dual_tree_top5": """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op9_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, w[s:s + 9] AS x FROM starts),
sizes AS (SELECT DISTINCT len(x) AS k FROM windows),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes),
found AS (SELECT doc_id, s, k, item_id FROM (SELECT doc_id, s, k, w[s:s + k - 1] AS x FROM places) JOIN windows USING (x)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n,
  sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS names FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  coalesce(items.names, sha256('')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
    "op10_hyperminhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
each AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM d WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g FROM each),
n AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN least USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_max_sketch_top10": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
asked AS (SELECT item_id, t, count(*) AS times FROM b GROUP BY ALL),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
each AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d),
counted AS (SELECT doc_id, n, t, count(*) AS tf FROM each WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT t, count(*) AS df FROM counted GROUP BY t), totals),
scored AS (SELECT item_id, doc_id,
  CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (t) JOIN counted USING (t), totals GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_conversation_trie": """
WITH turns AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': r, 't': t} ORDER BY pos) AS p FROM turns GROUP BY conv_id),
crc AS (SELECT conv_id, p, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
    lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 9 AS h FROM own),
built AS (SELECT crc.conv_id, list_concat(coalesce(b.p[1:h], []), crc.p[h + 1:]) AS p
  FROM crc LEFT JOIN own b ON b.conv_id = crc.conv_id - crc.conv_id % 5),
steps AS (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM built),
nodes AS (SELECT p[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(p) = d), '')) AS ends_sha256
  FROM steps GROUP BY ALL),
children AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
known AS (SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(k[d].t) ELSE 0 END AS saving
  FROM nodes LEFT JOIN children USING (k)),
above AS (SELECT k, n_children, saving, unnest(range(0, d + 1)) AS a FROM known),
sums AS (SELECT k[1:a] AS k, CAST(sum(saving) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY 1)
SELECT known.conv_id, known.d AS depth, up.conv_id AS parent_conv_id, known.n_convs, known.n_children, n_leaves, saved_tokens, known.ends_sha256
FROM known JOIN sums USING (k) LEFT JOIN nodes up ON known.d > 0 AND up.d = known.d - 1 AND up.k = known.k[1:known.d - 1]""",
}
