"""The operators as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.llm import exact, fim, langid, mixing, packing, pieces, radix, sentences, simhash, sketch, tokens, trie, urls


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_documents(spark, sf_dir).select("doc_id", "text"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_checked(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def document_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(_documents(spark, sf_dir).select("doc_id", "text"))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir).select("doc_id", "text", "source"))


def sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentences.remove_repeated(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "__found.n_sentences", "__found.n_removed", F.sha2("__found.kept", 256).alias("kept_sha256"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    n = tokens.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = radix.remove_repeated_bytes(_documents(spark, sf_dir).select("doc_id", "text"))
    cut = [F.col(f"__cut.{c}") for c in ("n_bytes", "n_removed", "n_spans")]
    return found.select("doc_id", *cut, F.sha2("__cut.kept", 256).alias("kept_sha256"))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_documents(spark, sf_dir).select("doc_id", "text"))


def sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.rearrange(_documents(spark, sf_dir).select("doc_id", "text"))
    restored = fim.restore(F.col("output"), F.col("form"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.grafted_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node_id", "parent_id")


QUERIES = {
    "op1_simhash": near_dedup,
    "op2_language_id": language_id,
    "op3_pieces": piece_encoding,
    "op4_sketches": document_sketches,
    "op5_urls": url_verdicts,
    "op6_mix": source_mix,
    "op7_sentences": sentence_dedup,
    "op8_tokens": token_counts,
    "op9_windows": window_dedup,
    "op10_exact": exact_dedup,
    "op11_packing": sequence_packing,
    "op12_fim": fill_in_middle,
    "op13_trie": conversation_trie,
}

ORACLES = {
    "op10_exact": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), d AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""",
    "op12_fim": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS k FROM documents
), h AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    [('0x' || substr(k, 1 + 8 * i, 8))::BIGINT for i in range(4)] AS h FROM d
), c AS (
  SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
      WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
""",
    "op13_trie": r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations
), convs AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT for x in string_split(c::VARCHAR, '')],
    lambda r, x: list_reduce([xor(r, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, y: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)
), heads AS (SELECT v.c, b.pos, b.id, b.words FROM convs v JOIN t b ON b.c = v.base AND b.pos < v.h
), rebuilt AS (
  SELECT * FROM heads
  UNION ALL SELECT t.c, t.pos - v.h + (SELECT count(*) FROM heads x WHERE x.c = t.c), t.id, t.words FROM t JOIN convs v ON v.c = t.c WHERE t.pos >= v.h
), paths AS (
  SELECT c, pos + 1 AS depth, words, sha256(string_agg(id, '') OVER w) AS node, coalesce(sha256(string_agg(id, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '') AS parent
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY pos)
  UNION ALL SELECT c, 0, 0, '', NULL FROM convs
), nodes AS (SELECT node, depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM paths GROUP BY node, depth
), kids AS (SELECT parent, count(*) AS n FROM nodes GROUP BY parent
), own AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.parent = n.node
), below AS (
  SELECT p.node, sum(CASE WHEN o.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((o.n_convs - 1) * o.words)::BIGINT AS saved_tokens
  FROM own o JOIN paths p ON p.c = o.conv_id AND p.depth <= o.depth GROUP BY p.node
), ends AS (
  SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256 FROM (SELECT c, node FROM paths QUALIFY depth = max(depth) OVER (PARTITION BY c)) GROUP BY node)
SELECT o.conv_id, o.depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, b.n_leaves, b.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM own o JOIN below b ON b.node = o.node LEFT JOIN nodes u ON u.node = o.parent LEFT JOIN ends e ON e.node = o.node
""",
}
