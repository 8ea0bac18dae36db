"""Contract queries of the numbered operators: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, lexical_search, line_dedup, lm_scoring, ngram_join, packing, prefix_trie, quality_rules, sentencepiece_fst, sharding, topk_search, url_filter, vector_graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_rest(column: str, by: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lm_scoring.token_table(table(spark, sf_dir, "documents"))
    model = lm_scoring.fit_tokens(tokens.where(crc_rest("_lm_id", 5) != 1))
    held = F.coalesce(crc_rest("doc_id", 5) == 1, F.lit(False))
    out = lm_scoring.score_tokens(tokens, model)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = tokenizer_path("piece_bpe_32k.model")
    out = sentencepiece_fst.decode(sentencepiece_fst.encode(docs, model), model)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), words_each=5, percent=80)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, length=4096)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.train_network(docs.where(crc_rest("doc_id", 4) != 2))
    out = language_id.identify(docs, net, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(crc_rest("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_lang_score").alias("score"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).drop("score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = vector_graph.near_groups(table(spark, sf_dir, "embeddings"), least=0.93).rows
    return groups.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_topk_search": op5_topk_search,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_url_filter": op9_url_filter,
    "op10_language_id": op10_language_id,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_vector_graph": op13_vector_graph,
}

LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_line_dedup": f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS i FROM parts),
keyed AS (SELECT *, {LOWER_SQL.format("trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))")} AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, first IS NOT NULL AND doc_id <> first AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op6_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({LOWER_SQL.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM each a JOIN each b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= 80 * (na + nb - i) UNION ALL SELECT b, a FROM pairs WHERE 100 * i >= 80 * (na + nb - i)),
reach AS (SELECT DISTINCT a AS node, a AS low FROM links UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.node)
SELECT sets.doc_id, len(s) AS n_shingles, coalesce(least(sets.doc_id, min(low)), sets.doc_id) AS component_id
FROM sets LEFT JOIN reach ON reach.node = sets.doc_id GROUP BY sets.doc_id, s""",
    "op11_prefix_trie": """
WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
-- CRC-32, bit by bit
h AS (SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
  lambda s, b: list_reduce(list_concat([xor(s, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)),
taken AS (SELECT h.c, t.pos, role, text FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.pos <= h.h),
n AS (SELECT h.c, h.h, count(taken.pos) AS took FROM h LEFT JOIN taken ON taken.c = h.c GROUP BY h.c, h.h),
r AS (SELECT * FROM taken UNION ALL SELECT t.c, n.took + t.pos - n.h, role, text FROM t JOIN n USING (c) WHERE t.pos > n.h),
-- a prefix is named by the hashes of its turns, one after the other
pre AS (SELECT c, 0 AS d, '' AS path, 0 AS bytes FROM n
  UNION ALL SELECT pre.c, pre.d + 1, pre.path || sha256(length(r.role) || ':' || r.role || r.text), strlen(r.text) FROM pre JOIN r ON r.c = pre.c AND r.pos = pre.d + 1),
node AS (SELECT path, d, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes FROM pre GROUP BY path, d),
kids AS (SELECT p.path, count(k.path) AS n_children FROM node p LEFT JOIN node k ON k.d = p.d + 1 AND k.path[:64 * p.d] = p.path GROUP BY p.path),
sub AS (SELECT p.path, count(*) FILTER (kids.n_children = 0) AS n_leaves, sum((u.n - 1) * u.bytes) AS saved
  FROM node p JOIN node u ON u.d >= p.d AND u.path[:64 * p.d] = p.path JOIN kids ON kids.path = u.path GROUP BY p.path),
total AS (SELECT c, max(d) AS d FROM pre GROUP BY c),
ends AS (SELECT pre.path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM pre JOIN total USING (c, d) GROUP BY pre.path)
SELECT node.c AS conv_id, CAST(node.d AS BIGINT) AS depth, up.c AS parent_conv_id, node.n AS n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN kids USING (path) JOIN sub USING (path) LEFT JOIN ends USING (path) LEFT JOIN node up ON up.d = node.d - 1 AND up.path = node.path[:64 * (node.d - 1)]""",
    "op12_lexical_search": f"""
WITH pat AS (SELECT '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+' AS p),
dt AS (SELECT doc_id, unnest(regexp_extract_all({LOWER_SQL.format("text")}, (SELECT p FROM pat))) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM dt GROUP BY doc_id, t),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
facts AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM n),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, facts GROUP BY t),
m AS (SELECT doc_id, 25 + (75 * n * big_n) // l AS m FROM n, facts),
q AS (SELECT item_id, unnest(regexp_extract_all({LOWER_SQL.format("text")}, (SELECT p FROM pat))) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
    "op13_vector_graph": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT DISTINCT a AS node, a AS low FROM links UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.node),
low AS (SELECT node, min(low) AS low FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(low, vec_id), vec_id) AS component_id, coalesce(least(low, vec_id), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN low ON node = vec_id""",
}
