"""The given tables seen as labelled, annotated corpora.

The tables hold plain text, so annotations are stand-ins computed by fixed rules from the
words themselves; the SQL next to each function applies the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.functions.text import begins_with_letter, let
from wordfold.operators.tokens import TokenOptions, clean_tokens

# ---------------------------------------------------------------- plain tables

#: Parts that texts of an input split are dealt to when they are moved.
PARTS_PER_SPLIT = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """``(doc_id, label, text)`` with the language as label.

    A table in fewer splits than there are cores is spread by document, which also leaves
    every later grouping by document without a shuffle.  Larger inputs are moved only for jobs that group what they
    take out of a text by its document (``together``): the text is smaller than its words or phrases.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), "text")
    cores, splits = spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()
    if splits < cores:
        return docs.repartition(cores, "doc_id")
    # a fixed number, since what becomes of a text is many times as large and should fit into memory
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_PER_SPLIT * splits)
    return docs.repartition(parts, "doc_id") if together else docs


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"))


DOCS = "docs AS (SELECT doc_id, lang AS label FROM documents)"

# ---------------------------------------------------------------- plain words


def word_array(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def words(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """One row per word: ``(doc_id, label, feature)``."""
    return documents(spark, sf_dir, together).select("doc_id", "label", F.explode_outer(word_array()).alias("feature")).where(
        "feature is not null"
    )


WORD_LISTS = (
    "word_lists AS (SELECT doc_id, lang AS label, list_filter(regexp_split_to_array(lower(text), '[^\\pL]+'),"
    " lambda w: w <> '') AS ws FROM documents)"
)
WORDS = f"{WORD_LISTS},\nwords AS (SELECT doc_id, label, unnest(ws) AS feature FROM word_lists)"
DTM = f"{WORDS},\ndtm AS (SELECT doc_id, label, feature, count(*)::DOUBLE AS weight FROM words GROUP BY ALL)"

# ---------------------------------------------------------------- labelled by quality


def quality_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a quality label: a binary task."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))


QDOCS = "qdocs AS (SELECT doc_id, quality::VARCHAR AS label FROM labels)"
QDTM = (
    f"{DTM},\n{QDOCS},\nqdtm AS (SELECT d.doc_id, q.label, d.feature, d.weight FROM dtm d JOIN qdocs q ON d.doc_id = q.doc_id)"
)

# ---------------------------------------------------------------- annotated sentences

# tag by word length modulo 10; words without a letter are punctuation
TAGS = ("VBZ", "DT", "IN", "NN", "JJ", "NNS", "VBD", "JJR", "NNP", "CD")
COARSE = {"JJ": "J", "JJR": "J", "NN": "N", "NNS": "N", "NNP": "N", "VBZ": "V", "VBD": "V"}
RELATIONS = {("J", "N"): ("amod", True), ("N", "N"): ("nn", True), ("V", "N"): ("dobj", False), ("N", "V"): ("nsubj", True)}
STOPWORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "by", "was", "one", "not")


# line ends as Java's regular expressions know them
_LAST_OF_S = ["s", "\n", "\r", "\u0085", "\u2028", "\u2029"]


def _annotated(w: Column, i: Column) -> Column:
    return let(F.char_length(w), lambda length: _annotated_by_length(w, i, length))


def _annotated_by_length(w: Column, i: Column, length: Column) -> Column:
    # lambdas are interpreted: cheap tests stand before regular expressions
    capital = (w >= "A") & (w < "[")
    tag = F.get(F.array(*[F.lit(t) for t in TAGS]), length % 10)
    ends = (length > 4) & F.right(w, F.lit(1)).isin(*_LAST_OF_S)
    return F.struct(
        (i + 1).alias("idx"),
        w.alias("word"),
        F.when(ends, F.regexp_replace(w, "s$", "")).otherwise(w).alias("lemma"),
        F.when(begins_with_letter(w) | w.rlike(r"\p{L}"), tag).otherwise(F.lit(".")).alias("pos"),
        F.when(length == 2, F.lit(None).cast("string"))
        .when((length % 6 == 0) & capital, F.lit("Person"))
        .when((length % 6 == 3) & capital, F.lit("misc"))
        .otherwise(F.lit("O"))
        .alias("ner"),
    )


#: Coarse tags as numbers, no other being 0, and for a pair of them (4 * left + right) its relation, and whether the right token is the head.
_PLACES = ("-", "J", "N", "V")
_PAIRS = [RELATIONS.get((a, b), ("dep", False)) for a in _PLACES for b in _PLACES]


def _edge(tokens: Column, codes: Column, i: Column) -> Column:
    a, b = F.get(tokens, i)["idx"], F.get(tokens, i + 1)["idx"]

    def related(pair: Column) -> Column:
        backward = F.get(F.array(*[F.lit(back) for _, back in _PAIRS]), pair)
        return F.struct(
            F.when(backward, b).otherwise(a).alias("head"),
            F.when(backward, a).otherwise(b).alias("dep"),
            F.get(F.array(*[F.lit(name) for name, _ in _PAIRS]), pair).alias("type"),
        )

    return let(F.get(codes, i) * 4 + F.get(codes, i + 1), related)


def annotated_line(line: Column) -> Column:
    """A run without blanks is a token, neighbouring tokens are related: a struct of tokens and edges."""
    split = F.filter(F.split(line, "[ \t]+"), lambda w: w != "")

    def related(tokens: Column) -> Column:
        pairs = F.when(F.size(tokens) > 1, F.sequence(F.lit(0), F.size(tokens) - 2)).otherwise(F.array().cast("array<int>"))
        code = F.create_map(*[F.lit(x) for fine, coarse in COARSE.items() for x in (fine, _PLACES.index(coarse))])
        codes = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(code, t["pos"]), F.lit(0)))
        edges = let(codes, lambda c: F.transform(pairs, lambda i: _edge(tokens, c, i)))
        return F.struct(tokens.alias("tokens"), edges.alias("edges"))

    return let(F.transform(split, _annotated), related)


def sentences(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """A line is a sentence."""
    lines = documents(spark, sf_dir, together).select("doc_id", "label", F.posexplode(F.split("text", "\n")).alias("sent_id", "line"))
    return lines.select(
        "doc_id", "label", (F.col("sent_id") + 1).alias("sent_id"), annotated_line(F.col("line")).alias("s")
    ).select("doc_id", "label", "sent_id", "s.tokens", "s.edges")


def cleaned(spark: SparkSession, sf_dir: str, options: TokenOptions = TokenOptions(), together: bool = False) -> DataFrame:
    return clean_tokens(sentences(spark, sf_dir, together), options)


_TAG_SQL = "list_extract([" + ", ".join(f"'{t}'" for t in TAGS) + "], length(word) % 10 + 1)"
_COARSE_SQL = "CASE pos " + " ".join(f"WHEN '{f}' THEN '{c}'" for f, c in COARSE.items()) + " ELSE '-' END"
# the tags of TAGS through the full coarse map
_FULL_COARSE_SQL = (
    "CASE pos " + " ".join(f"WHEN '{f}' THEN '{c}'" for f, c in COARSE.items())
    + " WHEN 'DT' THEN 'DET' WHEN 'IN' THEN 'CONJ' WHEN '.' THEN 'PUNCT' ELSE 'UNK' END"
)
NUMBER_SQL = (
    "(NOT regexp_matches({0}, '\\pL') OR regexp_matches({0},"
    " '(?i)^[+-]?([0-9][0-9_]*\\.?[0-9_]*|\\.[0-9][0-9_]*)e[+-]?[0-9][0-9_]*$|^[+-]?(nan|inf|infinity)$'))"
)
TOKENS = f"""sent_lines AS (
  SELECT doc_id, label, unnest(ls) AS line, generate_subscripts(ls, 1) AS sent_id
  FROM (SELECT doc_id, lang AS label, string_split(text, chr(10)) AS ls FROM documents)),
sent_words AS (
  SELECT doc_id, label, sent_id, list_filter(regexp_split_to_array(line, '[ \t]+'), lambda w: w <> '') AS ws FROM sent_lines),
plain_tokens AS (
  SELECT doc_id, label, sent_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS idx FROM sent_words),
tokens AS (
  SELECT doc_id, label, sent_id, idx, word,
    CASE WHEN length(word) > 4 THEN regexp_replace(word, 's$', '') ELSE word END AS lemma,
    CASE WHEN NOT regexp_matches(word, '\\pL') THEN '.' ELSE {_TAG_SQL} END AS pos,
    CASE WHEN length(word) = 2 THEN NULL
         WHEN regexp_matches(word, '^[A-Z]') AND length(word) % 6 = 0 THEN 'Person'
         WHEN regexp_matches(word, '^[A-Z]') AND length(word) % 6 = 3 THEN 'misc' ELSE 'O' END AS ner
  FROM plain_tokens)"""
# the token rules with the default options
KEPT = f"""{TOKENS},
marked AS (
  SELECT doc_id, label, sent_id, idx, lower(lemma) AS text, {_FULL_COARSE_SQL} AS cpos, {_COARSE_SQL} AS rel,
    coalesce(upper(ner), 'MISSING') AS ner,
    NOT {NUMBER_SQL.format('lemma')} AND pos <> '.' AND NOT regexp_matches(lemma, '[/_]') AS keep
  FROM tokens),
kept AS (SELECT doc_id, label, sent_id, idx, text, cpos AS pos, ner FROM marked WHERE keep)"""
EDGES = f"""{KEPT},
pairs AS (
  SELECT *, lead(idx) OVER w AS idx2, lead(text) OVER w AS text2, lead(cpos) OVER w AS cpos2, lead(ner) OVER w AS ner2,
    lead(keep) OVER w AS keep2, rel || lead(rel) OVER w AS tagpair
  FROM marked WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY idx)),
edges AS (
  SELECT doc_id, label, sent_id,
    CASE tagpair WHEN 'JN' THEN 'amod' WHEN 'NN' THEN 'nn' WHEN 'VN' THEN 'dobj' WHEN 'NV' THEN 'nsubj' ELSE 'dep' END AS type,
    CASE WHEN tagpair IN ('JN', 'NN', 'NV') THEN idx2 ELSE idx END AS head_idx,
    CASE WHEN tagpair IN ('JN', 'NN', 'NV') THEN idx ELSE idx2 END AS dep_idx
  FROM pairs WHERE keep AND keep2)"""
ARCS = f"""{EDGES},
arcs AS (
  SELECT e.doc_id, e.label, e.sent_id, e.type, h.idx AS head_idx,
    h.text AS head_text, h.pos AS head_pos, h.ner AS head_ner, d.text AS dep_text, d.pos AS dep_pos, d.ner AS dep_ner
  FROM edges e
  JOIN kept h ON h.doc_id = e.doc_id AND h.sent_id = e.sent_id AND h.idx = e.head_idx
  JOIN kept d ON d.doc_id = e.doc_id AND d.sent_id = e.sent_id AND d.idx = e.dep_idx)"""
_DEP = "dep_text || '/' || dep_pos"
_HEAD = "head_text || '/' || head_pos"
_ENT = "('ORGANIZATION', 'PERSON', 'LOCATION')"
PHRASES = f"""{ARCS},
an AS (SELECT doc_id, label, 'AN' AS ftype, {_DEP} || '_' || {_HEAD} AS feature, head_ner IN {_ENT} OR dep_ner IN {_ENT} AS entity
       FROM arcs WHERE type = 'amod' AND head_pos = 'N' AND dep_pos = 'J'),
nn AS (SELECT doc_id, label, 'NN' AS ftype, {_DEP} || '_' || {_HEAD} AS feature, head_ner IN {_ENT} OR dep_ner IN {_ENT} AS entity
       FROM arcs WHERE type IN ('nn', 'compound') AND head_pos = 'N' AND dep_pos = 'N'),
vo AS (SELECT doc_id, label, 'VO' AS ftype, {_HEAD} || '_' || {_DEP} AS feature, head_ner IN {_ENT} OR dep_ner IN {_ENT} AS entity
       FROM arcs WHERE type = 'dobj' AND head_pos = 'V' AND dep_pos = 'N'),
svo AS (SELECT o.doc_id, o.label, 'SVO' AS ftype,
         s.dep_text || '/' || s.dep_pos || '_' || o.head_text || '/' || o.head_pos || '_' || o.dep_text || '/' || o.dep_pos AS feature,
         o.head_ner IN {_ENT} OR o.dep_ner IN {_ENT} OR s.dep_ner IN {_ENT} AS entity
        FROM arcs s JOIN arcs o ON s.doc_id = o.doc_id AND s.sent_id = o.sent_id AND s.head_idx = o.head_idx
        WHERE s.type = 'nsubj' AND s.head_pos = 'V' AND s.dep_pos = 'N' AND o.type = 'dobj' AND o.head_pos = 'V' AND o.dep_pos = 'N'),
uni AS (SELECT doc_id, label, '1-GRAM' AS ftype, text || '/' || pos AS feature, ner IN {_ENT} AS entity FROM kept WHERE pos IN ('J', 'N', 'V')),
feats AS (SELECT * FROM an UNION ALL SELECT * FROM nn UNION ALL SELECT * FROM vo UNION ALL SELECT * FROM svo UNION ALL SELECT * FROM uni)"""

# ---------------------------------------------------------------- word vectors


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(w, w2)``: each word with the one after it in its document."""
    docs = documents(spark, sf_dir).select(word_array().alias("ws"))
    rest = F.greatest(F.size("ws") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("ws", F.lit(1), rest).alias("w"), F.slice("ws", F.lit(2), rest).alias("w2"))
    # the outer form, so that Spark does not make the array twice
    return docs.select(F.inline_outer(pairs).alias("w", "w2")).where("w is not null")


def followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(feature, ctx, weight)``: counts of the words directly right (``r:``) of each word, whole corpus."""
    counts = word_pairs(spark, sf_dir).groupBy("w", "w2").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return counts.select(F.col("w").alias("feature"), F.concat(F.lit("r:"), "w2").alias("ctx"), "weight")


def context_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the words directly left (``l:``) and right (``r:``) of each word, whole corpus."""
    # a pair is counted once and then seen from both sides
    counts = word_pairs(spark, sf_dir).groupBy("w", "w2").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    side = lambda f, c, name: F.struct(F.col(f).alias("feature"), F.concat(F.lit(name), c).alias("ctx"))
    return counts.select(F.inline(F.array(side("w", "w2", "r:"), side("w2", "w", "l:"))), "weight")


VECTORS = f"""{WORD_LISTS},
word_places AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM word_lists),
word_pairs AS (SELECT w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS w2 FROM word_places),
vectors AS (
  SELECT feature, ctx, count(*)::DOUBLE AS weight FROM (
    SELECT w AS feature, 'r:' || w2 AS ctx FROM word_pairs WHERE w2 IS NOT NULL
    UNION ALL SELECT w2 AS feature, 'l:' || w AS ctx FROM word_pairs WHERE w2 IS NOT NULL) GROUP BY ALL)"""


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("feature"), "embedding", F.col("label").alias("cluster")
    )


DENSE = "dense AS (SELECT vec_id::VARCHAR AS feature, embedding::DOUBLE[] AS embedding, label AS cluster FROM embeddings)"
