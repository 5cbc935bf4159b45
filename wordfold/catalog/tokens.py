"""Token rules and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.catalog import inputs as i
from wordfold.catalog.registry import query, with_ctes
from wordfold.functions import text as tx
from wordfold.operators import features as ft, tokens as tk, vectorize as vz


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.explode_tokens(i.sentences(spark, sf_dir))


def _counted(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


@query("choose_text", with_ctes(i.TOKENS, select="SELECT lemma AS text, count(*) AS n FROM tokens GROUP BY ALL"))
def choose_text(spark, d):
    return _counted(_raw(spark, d), tx.choose_text(F.col("word"), F.col("lemma"), True).alias("text"))


@query(
    "is_number",
    with_ctes(i.TOKENS, select=f"SELECT word, count(*) AS n FROM tokens WHERE {i.NUMBER_SQL.format('word')} GROUP BY ALL"),
)
def is_number(spark, d):
    return _counted(_raw(spark, d).where(tx.is_number(F.col("word"))), "word")


_STOP = ", ".join(f"'{w}'" for w in i.STOPWORDS)


@query(
    "drop_stopwords",
    with_ctes(i.TOKENS, select=f"SELECT lemma AS text, count(*) AS n FROM tokens WHERE lower(lemma) NOT IN ({_STOP}) GROUP BY ALL"),
)
def drop_stopwords(spark, d):
    text = F.col("lemma")
    return _counted(_raw(spark, d).where(~tx.is_stopword(text, list(i.STOPWORDS))), text.alias("text"))


@query("drop_short", with_ctes(i.TOKENS, select="SELECT lemma AS text, count(*) AS n FROM tokens WHERE length(lemma) > 3 GROUP BY ALL"))
def drop_short(spark, d):
    return _counted(_raw(spark, d).where(~tx.is_short(F.col("lemma"))), F.col("lemma").alias("text"))


@query("drop_long", with_ctes(i.TOKENS, select="SELECT lemma AS text, count(*) AS n FROM tokens WHERE length(lemma) < 25 GROUP BY ALL"))
def drop_long(spark, d):
    return _counted(_raw(spark, d).where(~tx.is_long(F.col("lemma"))), F.col("lemma").alias("text"))


@query("use_pos", with_ctes(i.TOKENS, select="SELECT upper(pos) AS pos, count(*) AS n FROM tokens GROUP BY ALL"))
def use_pos(spark, d):
    return _counted(_raw(spark, d), tx.use_pos(F.col("pos")).alias("pos"))


@query("coarse_pos", with_ctes(i.KEPT, select="SELECT doc_id, cpos AS pos, count(*) AS n FROM marked GROUP BY ALL"))
def coarse_pos(spark, d):
    return _counted(_raw(spark, d), "doc_id", tx.coarse_pos(F.col("pos")).alias("pos"))


@query("drop_punct", with_ctes(i.TOKENS, select="SELECT doc_id, count(*) AS n FROM tokens WHERE pos <> '.' GROUP BY ALL"))
def drop_punct(spark, d):
    return _counted(_raw(spark, d).where(tx.coarse_pos(F.col("pos")) != "PUNCT"), "doc_id")


@query("ner_tag", with_ctes(i.TOKENS, select="SELECT doc_id, coalesce(upper(ner), 'MISSING') AS ner, count(*) AS n FROM tokens GROUP BY ALL"))
def ner_tag(spark, d):
    return _counted(_raw(spark, d), "doc_id", tx.ner_tag(F.col("ner")).alias("ner"))


@query(
    "drop_separator_tokens",
    with_ctes(i.TOKENS, select="SELECT word, count(*) AS n FROM tokens WHERE NOT regexp_matches(word, '[/_]') GROUP BY ALL"),
)
def drop_separator_tokens(spark, d):
    return _counted(_raw(spark, d).where(~tx.has_separator(F.col("word"))), "word")


@query("lowercase", with_ctes(i.TOKENS, select="SELECT lower(word) AS text, count(*) AS n FROM tokens GROUP BY ALL"))
def lowercase(spark, d):
    return _counted(_raw(spark, d), F.lower("word").alias("text"))


@query(
    "normalise_entities",
    with_ctes(
        i.KEPT,
        select="""SELECT CASE WHEN ner IN ('O', 'MISSING', '_') THEN text ELSE '__NER-' || ner || '__' END AS text,
  CASE WHEN ner IN ('O', 'MISSING', '_') THEN pos ELSE '' END AS pos, count(*) AS n FROM kept GROUP BY ALL""",
    ),
)
def normalise_entities(spark, d):
    kept = tk.clean_token_rows(i.sentences(spark, d), tk.TokenOptions(normalise_entities=True))
    return _counted(kept, "text", "pos")


@query("clean_tokens", with_ctes(i.KEPT, select="SELECT text, pos, ner, count(*) AS n, sum(idx)::BIGINT AS places FROM kept GROUP BY ALL"))
def clean_tokens(spark, d):
    kept = tk.clean_token_rows(i.sentences(spark, d))
    return kept.groupBy("text", "pos", "ner").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("places"))


@query(
    "surviving_edges",
    with_ctes(
        i.EDGES,
        select="""SELECT doc_id, type, count(*) AS n, sum(head_idx)::BIGINT AS heads, sum(dep_idx)::BIGINT AS deps
FROM edges GROUP BY ALL""",
    ),
)
def surviving_edges(spark, d):
    edges = tk.surviving_edges(i.cleaned(spark, d))
    return edges.groupBy("doc_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("head_idx").alias("heads"), F.sum("dep_idx").alias("deps")
    )


def _feature_counts(name: str, source: str, build) -> None:
    sql = with_ctes(i.PHRASES, select=f"SELECT feature, ftype, count(*) AS n FROM {source} GROUP BY ALL")

    @query(name, sql)
    def run(spark, d):
        return _counted(build(i.cleaned(spark, d)), "feature", "ftype")


_feature_counts("unigrams", "uni", ft.unigrams)
_feature_counts("adj_noun", "an", ft.adj_noun)
_feature_counts("noun_noun", "nn", ft.noun_noun)
_feature_counts("verb_object", "vo", ft.verb_object)
_feature_counts("subj_verb_obj", "svo", ft.subj_verb_obj)
_feature_counts("drop_ner_features", "feats WHERE ftype = '1-GRAM' OR NOT entity", lambda c: ft.drop_ner_features(ft.extract_features(c)))

_NGRAMS = f"""{i.KEPT},
runs AS (
  SELECT doc_id, text || '/' || pos AS a, lead(text || '/' || pos) OVER w AS b, lead(text || '/' || pos, 2) OVER w AS c
  FROM kept WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY idx)),
grams AS (
  SELECT doc_id, '2-GRAM' AS ftype, a || '_' || b AS feature FROM runs WHERE b IS NOT NULL
  UNION ALL SELECT doc_id, '3-GRAM', a || '_' || b || '_' || c FROM runs WHERE c IS NOT NULL)"""


@query(
    "ngrams",
    with_ctes(
        _NGRAMS,
        select="""SELECT doc_id, ftype, count(*) AS n, count(DISTINCT feature) AS features, min(feature) AS first_feature,
  max(feature) AS last_feature, sum(length(feature))::BIGINT AS chars FROM grams GROUP BY ALL""",
    ),
)
def ngrams(spark, d):
    return (
        ft.ngrams(i.cleaned(spark, d, together=True), 3)
        .groupBy("doc_id", "ftype")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("feature").alias("features"),
            F.min("feature").alias("first_feature"),
            F.max("feature").alias("last_feature"),
            F.sum(F.char_length("feature")).alias("chars"),
        )
    )


_EXTRACT = with_ctes(i.PHRASES, select="SELECT doc_id, label, feature, count(*) AS n FROM feats GROUP BY ALL")


@query("extract_features", _EXTRACT)
def extract_features(spark, d):
    return _counted(ft.extract_features(i.cleaned(spark, d, together=True)), "doc_id", "label", "feature")


@query(
    "forget_position",
    with_ctes(i.PHRASES, select="SELECT doc_id, label, feature, count(*) AS n FROM feats WHERE ftype <> '1-GRAM' GROUP BY ALL"),
)
def forget_position(spark, d):
    return ft.forget_position(ft.extract_features(i.cleaned(spark, d), ft.FeatureOptions(unigram_pos="")))


# features that do not parse: two words joined by the separator, one of them without a tag
_MESSY = f"""{i.TOKENS},
messy AS (SELECT word || '/' || pos AS feature FROM tokens)"""
_VALID = "regexp_matches(feature, '^[^/_]*\\pL[^/_]*/[A-Z]+(_[^/_]*\\pL[^/_]*/[A-Z]+)*$')"


def _messy(spark, d):
    return _raw(spark, d).select(F.concat_ws("/", "word", "pos").alias("feature"))


@query("drop_invalid_features", with_ctes(_MESSY, select=f"SELECT feature, count(*) AS n FROM messy WHERE {_VALID} GROUP BY ALL"))
def drop_invalid_features(spark, d):
    return _counted(ft.drop_invalid_features(_messy(spark, d)), "feature")


@query(
    "parse_feature",
    with_ctes(
        i.PHRASES,
        "typed AS (SELECT feature, list_transform(string_split(feature, '_'), lambda t: regexp_extract(t, '/(.*)$', 1)) AS tags FROM feats)",
        select="""SELECT feature, array_to_string(tags, ' ') AS tags,
  CASE array_to_string(tags, ' ') WHEN 'J N' THEN 'AN' WHEN 'N N' THEN 'NN' WHEN 'V N' THEN 'VO' WHEN 'N V N' THEN 'SVO'
    ELSE len(tags)::VARCHAR || '-GRAM' END AS ftype, count(*) AS n
FROM typed GROUP BY ALL""",
    ),
)
def parse_feature(spark, d):
    found = ft.extract_features(i.cleaned(spark, d)).select("feature")
    typed = ft.with_type(_counted(found, "feature"))
    tags = F.array_join(F.transform("tokens", lambda t: t["pos"]), " ")
    return typed.select("feature", tags.alias("tags"), "ftype", "n")


@query(
    "remove_pos",
    with_ctes(
        i.PHRASES,
        select="SELECT doc_id, regexp_replace(feature, '/[A-Z]+', '', 'g') AS feature, count(*) AS n FROM feats WHERE ftype <> '1-GRAM' GROUP BY ALL",
    ),
)
def remove_pos(spark, d):
    phrases = ft.extract_features(i.cleaned(spark, d), ft.FeatureOptions(unigram_pos="", remove_pos=True))
    return _counted(phrases, "doc_id", "feature")


@query(
    "filter_features",
    with_ctes(
        i.PHRASES,
        select="""SELECT doc_id, feature, count(*) AS n FROM feats
WHERE (ftype IN ('AN', 'VO') OR (ftype = '1-GRAM' AND feature LIKE '%/N')) AND NOT entity GROUP BY ALL""",
    ),
)
def filter_features(spark, d):
    wanted = ft.FeatureOptions(unigram_pos="N", phrase_types=("AN", "VO"), drop_ner=True)
    return _counted(ft.filter_features(ft.extract_features(i.cleaned(spark, d)), wanted), "doc_id", "feature")


@query(
    "feature_inventory",
    with_ctes(
        i.PHRASES,
        "inv AS (SELECT DISTINCT feature, ftype FROM feats)",
        select="""SELECT ftype, CASE WHEN ftype = '1-GRAM' THEN regexp_extract(feature, '/(.*)$', 1) END AS unigram_pos, count(*) AS n
FROM inv GROUP BY ALL""",
    ),
)
def feature_inventory(spark, d):
    return ft.inventory_counts(ft.feature_inventory(ft.extract_features(i.cleaned(spark, d)), include_unigrams=True))


def phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counted features of all kinds, for queries further on."""
    return vz.doc_term_counts(ft.extract_features(i.cleaned(spark, d)).select("doc_id", "label", "feature"))

