"""Vocabularies, document-feature matrices, replacement, selection and their statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wordfold.catalog import inputs as i
from wordfold.catalog.registry import query, with_ctes
from wordfold.functions.draws import draw_sql
from wordfold.operators import select as sel, splits, stats, vectorize as vz
from wordfold.sources import sinks
from wordfold.storage import materialize

K = 3
BY = ["cv_no"]
FOLDS = f"{i.DOCS},\nfolds AS (SELECT doc_id, label, ntile(5) OVER (PARTITION BY label ORDER BY doc_id) - 1 AS fold FROM docs)"
# five stratified folds; the vocabulary of a fold has words of two or more of its training documents
SPLIT = f"""{i.DTM},
{FOLDS},
cv AS (SELECT unnest(range(5))::INT AS cv_no),
train_docs AS (SELECT cv_no, doc_id, label FROM folds JOIN cv ON fold <> cv_no),
train AS (SELECT c.cv_no, d.* FROM dtm d JOIN train_docs c ON d.doc_id = c.doc_id),
test AS (SELECT f.fold::INT AS cv_no, d.* FROM dtm d JOIN folds f ON d.doc_id = f.doc_id),
vocab AS (SELECT cv_no, feature, count(*) AS df FROM train GROUP BY cv_no, feature HAVING count(*) >= 2)"""
# a precomputed thesaurus: what follows a word, with its share
THESAURUS = f"""{i.WORD_LISTS},
word_places AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM word_lists),
word_pairs AS (SELECT w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS w2 FROM word_places),
follow AS (SELECT w AS feature, w2 AS neighbour, count(*) AS n FROM word_pairs WHERE w2 IS NOT NULL GROUP BY ALL),
thesaurus AS (SELECT feature, neighbour, n / sum(n) OVER (PARTITION BY feature) AS sim FROM follow)"""
# both CTE lists start with the word lists
BOTH = f"{THESAURUS},\n" + SPLIT.split(",\n", 1)[1]
REPLACE = f"""{BOTH},
usable AS (SELECT v.cv_no, t.* FROM thesaurus t JOIN vocab v ON t.neighbour = v.feature),
best AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY cv_no, feature ORDER BY sim DESC, neighbour) <= {K}),
entries AS (SELECT DISTINCT feature FROM thesaurus),
flags AS (
  SELECT t.*, v.feature IS NOT NULL AS iv, e.feature IS NOT NULL AS it
  FROM test t LEFT JOIN vocab v ON t.cv_no = v.cv_no AND t.feature = v.feature LEFT JOIN entries e ON t.feature = e.feature)"""


def dtm(spark, d):
    return vz.doc_term_counts(i.words(spark, d, together=True))


def thesaurus(spark, d, side: str = "r:", contexts=None):
    if contexts is None:
        follow = materialize(_contexts(spark, d, side), "contexts")
    else:
        follow = contexts.where(F.col("ctx").startswith(side))
    return _shares(follow)


def _contexts(spark, d, side):
    return i.followers(spark, d) if side == "r:" else i.context_vectors(spark, d).where(F.col("ctx").startswith(side))


def _shares(follow):
    # over a window, so that jobs that want only the entries leave it out
    total = F.sum("weight").over(Window.partitionBy("feature"))
    return follow.select("feature", F.substring("ctx", 3, 1 << 20).alias("neighbour"), (F.col("weight") / total).alias("sim"))


def stored_thesaurus(spark, d):
    """For jobs that look at it several times; written once, with its shares."""
    return materialize(_shares(_contexts(spark, d, "r:")), "thesaurus")


def test_parts(spark, d):
    """(vocabulary of the training documents, test, test docs) of five stratified folds, without a copy of a row for each fold."""
    vocab, rows, test = _fold_rows(spark, d)
    return vocab, rows.select("doc_id", "label", "feature", "weight", F.inline("test")), test


def _fold_rows(spark, d):
    """(vocabulary, every row once with the folds that train on its document and those that test it, test docs)."""
    folds = materialize(splits.stratified_kfold(i.doc_labels(spark, d), 5), "folds")
    train, test = (folds.where(F.col("role") == r).select(*BY, "doc_id", "label") for r in ("train", "test"))
    # rows get the folds of their document while those of a document are still together, and are not moved by document again
    rows = materialize(vz.with_folds(dtm(spark, d), BY, train=train, test=test), "counts")
    vocab = materialize(vz.limit_df(vz.build_vocab(rows, BY, "train"), min_df=2, by=BY), "vocab")
    return vocab, rows, test


def parts(spark, d):
    """(train, test, train docs, test docs) of five stratified folds, told apart by ``cv_no``."""
    folds = materialize(splits.stratified_kfold(i.doc_labels(spark, d), 5), "folds")
    rows = materialize(dtm(spark, d), "counts")
    docs = {r: folds.where(F.col("role") == r).select(*BY, "doc_id", "label") for r in ("train", "test")}
    return *[rows.join(docs[r].select(*BY, "doc_id"), "doc_id") for r in ("train", "test")], docs["train"], docs["test"]


def train_vocab(train):
    return vz.limit_df(vz.build_vocab(train, BY), min_df=2, by=BY)


def _rounded(df):
    return df.select(*BY, "doc_id", "feature", F.round("weight", 6).alias("weight"))


@query("doc_term_counts", with_ctes(i.DTM, select="SELECT * FROM dtm"))
def doc_term_counts(spark, d):
    return dtm(spark, d)


@query(
    "build_vocab",
    with_ctes(
        i.PHRASES,
        "v AS (SELECT feature, count(DISTINCT doc_id) AS df FROM feats GROUP BY feature)",
        select="""SELECT feature, df, row_number() OVER (ORDER BY len(string_split(feature, '_')), feature) - 1 AS idx FROM v""",
    ),
)
def build_vocab(spark, d):
    from wordfold.catalog.tokens import phrase_counts

    # numbering reads its input three times: to draw split points, to size ranges, to number
    return vz.index_vocab(materialize(vz.build_vocab(phrase_counts(spark, d)), "vocab"))


@query(
    "limit_df",
    with_ctes(
        i.DTM,
        "v AS (SELECT feature, count(*) AS df FROM dtm GROUP BY feature)",
        select="SELECT * FROM v WHERE df BETWEEN 2 AND round_even(0.3 * (SELECT count(*) FROM documents), 0)",
    ),
)
def limit_df(spark, d):
    return vz.limit_df(vz.build_vocab(dtm(spark, d)), 2, 0.3, i.doc_labels(spark, d))


@query(
    "dropped_features",
    with_ctes(i.DTM, select="SELECT feature, count(*) AS df FROM dtm GROUP BY feature HAVING count(*) < 2 OR count(*) > 500"),
)
def dropped_features(spark, d):
    vocab = vz.build_vocab(dtm(spark, d))
    return vz.dropped_features(vocab, vz.limit_df(vocab, 2, 500))


@query(
    "reindex_vocab",
    with_ctes(
        i.DTM,
        "v AS (SELECT feature, count(*) AS df, row_number() OVER (ORDER BY feature) - 1 AS old FROM dtm GROUP BY feature)",
        select="SELECT feature, df, row_number() OVER (ORDER BY old) - 1 AS idx FROM v WHERE df > 1",
    ),
)
def reindex_vocab(spark, d):
    indexed = vz.index_vocab(materialize(vz.build_vocab(dtm(spark, d)), "vocab"))
    return vz.reindex_vocab(materialize(indexed, "indexed"), F.col("df") > 1)


@query("mark_iv_it", with_ctes(REPLACE, select="SELECT cv_no, doc_id, iv, it, count(*) AS n, sum(weight) AS weight FROM flags GROUP BY ALL"))
def mark_iv_it(spark, d):
    vocab, test, _ = test_parts(spark, d)
    marked = vz.mark_iv_it(test, vocab, stored_thesaurus(spark, d), BY)
    return marked.groupBy(*BY, "doc_id", "iv", "it").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query("base", with_ctes(SPLIT, select="SELECT cv_no, doc_id, feature, weight FROM test SEMI JOIN vocab USING (cv_no, feature)"))
def base(spark, d):
    vocab, test, _ = test_parts(spark, d)
    return vz.apply_handler(test, vocab, "base", by=BY).select(*BY, "doc_id", "feature", "weight")


def _handled(kept: str, looked_up: str, sim: str = "sim") -> str:
    parts_sql = []
    if kept:
        parts_sql.append(f"SELECT cv_no, doc_id, feature, weight FROM flags WHERE {kept}")
    parts_sql.append(
        f"SELECT cv_no, doc_id, neighbour AS feature, weight * {sim} AS weight FROM flags JOIN best USING (cv_no, feature) WHERE {looked_up}"
    )
    union = " UNION ALL ".join(parts_sql)
    return with_ctes(REPLACE, select=f"SELECT cv_no, doc_id, feature, round(sum(weight), 6) AS weight FROM ({union}) GROUP BY ALL")


@query("signifier_signified", _handled("iv", "NOT iv AND it"))
def signifier_signified(spark, d):
    vocab, test, _ = test_parts(spark, d)
    return _rounded(vz.apply_handler(test, vocab, "signifier_signified", stored_thesaurus(spark, d), k=K, by=BY))


@query("signified_only", _handled("", "it"))
def signified_only(spark, d):
    vocab, test, _ = test_parts(spark, d)
    return _rounded(vz.apply_handler(test, vocab, "signified_only", stored_thesaurus(spark, d), k=K, by=BY))


@query("sim_fn", _handled("iv", "NOT iv AND it", "1.0::DOUBLE"))
def sim_fn(spark, d):
    vocab, test, _ = test_parts(spark, d)
    return _rounded(vz.apply_handler(test, vocab, "signifier_signified", stored_thesaurus(spark, d), k=K, sim_fn=vz.one, by=BY))


@query(
    "sim_fn_custom",
    with_ctes(
        REPLACE,
        select="""SELECT cv_no, doc_id, neighbour AS feature, round(sum(weight * sqrt(sim)), 6) AS weight
FROM flags JOIN best USING (cv_no, feature) WHERE NOT iv GROUP BY ALL""",
    ),
)
def sim_fn_custom(spark, d):
    vocab, test, _ = test_parts(spark, d)
    rules = {(True, True): vz.IGNORE, (True, False): vz.IGNORE, (False, True): vz.EXPAND, (False, False): vz.IGNORE}
    return _rounded(vz.apply_handler(test, vocab, rules, stored_thesaurus(spark, d), k=K, sim_fn=F.sqrt, by=BY))


_LOOKUP = ("doc_id", "feature", "nth")
_START, _STRIDE = draw_sql(1, "'start'", *_LOOKUP), draw_sql(1, "'stride'", *_LOOKUP)


@query(
    "signified_random",
    with_ctes(
        BOTH,
        "indexed AS (SELECT cv_no, feature, row_number() OVER (PARTITION BY cv_no ORDER BY feature) - 1 AS idx FROM vocab)",
        "vocab_sizes AS (SELECT cv_no, count(*) AS n FROM vocab GROUP BY cv_no)",
        "lookups AS (SELECT cv_no, doc_id, feature, unnest(range(1, weight::BIGINT + 1)) AS nth FROM test"
        " WHERE feature IN (SELECT feature FROM thesaurus))",
        f"""starts AS (SELECT cv_no, doc_id, n, {_START} % n AS first, {_STRIDE} % greatest(1, (n - 1) // {K}) + 1 AS stride
  FROM lookups JOIN vocab_sizes USING (cv_no))""",
        f"drawn AS (SELECT cv_no, doc_id, (first + step * stride) % n AS idx FROM starts, range({K}) r(step) WHERE step < n)",
        select="SELECT cv_no, doc_id, feature, count(*)::DOUBLE AS weight FROM drawn JOIN indexed USING (cv_no, idx) GROUP BY ALL",
    ),
)
def signified_random(spark, d):
    vocab, test, _ = test_parts(spark, d)
    return vz.handle_random(test.select(*BY, "doc_id", "feature", "weight"), vocab, K, 1, thesaurus(spark, d), BY)


@query(
    "expand",
    with_ctes(
        REPLACE,
        select="""SELECT cv_no, doc_id, neighbour AS feature, round(sum(weight * sim), 6) AS weight
FROM test JOIN best USING (cv_no, feature) GROUP BY ALL""",
    ),
)
def expand(spark, d):
    vocab, test, _ = test_parts(spark, d)
    return _rounded(vz.merge_duplicates(vz.expand(test, stored_thesaurus(spark, d), vocab, K, by=BY), BY))


@query(
    "merge_duplicates",
    with_ctes(
        i.DTM,
        select="SELECT doc_id, label, substr(feature, 1, 3) AS feature, sum(weight) AS weight FROM dtm GROUP BY ALL",
    ),
)
def merge_duplicates(spark, d):
    return vz.merge_duplicates(dtm(spark, d).withColumn("feature", F.substring("feature", 1, 3)))


@query("transform_test", _handled("iv", "NOT iv AND it"))
def transform_test(spark, d):
    vocab, test, _ = test_parts(spark, d)
    return _rounded(vz.transform_test(test, vocab, "signifier_signified", stored_thesaurus(spark, d), k=K, by=BY))


# clusters of words: by their length and first letter
_CLUSTERS = "clusters AS (SELECT DISTINCT feature, (length(feature) * 31 + ascii(feature)) % 50 AS cluster FROM vocab WHERE df > 2)"


@query(
    "cluster_vectorize",
    with_ctes(
        SPLIT,
        _CLUSTERS,
        "named AS (SELECT feature, 'cluster' || cluster AS c FROM clusters)",
        "seen AS (SELECT DISTINCT cv_no, c FROM train t JOIN named n ON t.feature = n.feature)",
        select="""SELECT t.cv_no, t.doc_id, t.label, n.c AS feature, sum(t.weight) AS weight
FROM test t JOIN named n ON t.feature = n.feature JOIN seen s ON n.c = s.c AND t.cv_no = s.cv_no GROUP BY ALL""",
    ),
)
def cluster_vectorize(spark, d):
    train, test, _, _ = parts(spark, d)
    vocab = train_vocab(train).where("df > 2")
    number = ((F.char_length("feature") * 31 + F.ascii("feature")) % 50).alias("cluster")
    clusters = vocab.select("feature", number).distinct()
    seen = vz.build_vocab(vz.cluster_vectorize(train, clusters, by=BY), BY)
    return vz.cluster_vectorize(test, clusters, seen, BY)


@query(
    "dump_dtm",
    with_ctes(
        REPLACE,
        "applied AS (SELECT doc_id, feature, weight FROM flags WHERE iv UNION ALL "
        "SELECT doc_id, neighbour, weight * sim FROM flags JOIN best USING (cv_no, feature) WHERE NOT iv AND it)",
        "m AS (SELECT doc_id, feature, sum(weight) AS weight FROM applied GROUP BY ALL)",
        "totals AS (SELECT doc_id, round(sum(weight), 6) AS total, count(*) AS n FROM m GROUP BY doc_id)",
        select="""SELECT f.doc_id AS id, '' AS target, coalesce(total, 0) AS total_feat_weight, coalesce(n, 0) AS nonzero_feats,
  m.feature, round(m.weight::DECIMAL(18, 9), 2)::DOUBLE AS weight
FROM folds f LEFT JOIN totals t ON f.doc_id = t.doc_id LEFT JOIN m ON f.doc_id = m.doc_id""",
    ),
)
def dump_dtm(spark, d):
    vocab, test, test_docs = test_parts(spark, d)
    matrix = vz.transform_test(test, vocab, "signifier_signified", stored_thesaurus(spark, d), k=K, by=BY, check=False)
    rows = sinks.dump_dtm(matrix, test_docs, test=True)
    total = F.round("total_feat_weight", 6).alias("total_feat_weight")
    return rows.select("id", "target", total, "nonzero_feats", F.explode_outer("weights").alias("feature", "weight"))


# ---------------------------------------------------------------- selection


@query("keep_in_model", with_ctes(BOTH, select="SELECT * FROM vocab WHERE feature IN (SELECT feature FROM thesaurus)"))
def keep_in_model(spark, d):
    return sel.keep_in_model(train_vocab(parts(spark, d)[0]), thesaurus(spark, d))


CHI2 = f"""{i.DTM},
{i.DOCS},
share AS (SELECT label, count(*) / (SELECT count(*) FROM docs) AS p FROM docs GROUP BY label),
totals AS (SELECT feature, sum(weight) AS t FROM dtm GROUP BY feature),
seen AS (SELECT feature, label, sum(weight) AS o FROM dtm GROUP BY ALL),
chi2 AS (
  SELECT t.feature, sum(power(coalesce(o, 0) - p * t, 2) / (p * t)) AS score
  FROM totals t CROSS JOIN share s LEFT JOIN seen USING (feature, label) GROUP BY t.feature)"""


@query("chi2_scores", with_ctes(CHI2, select="SELECT feature, round(score, 5) AS score FROM chi2"))
def chi2_scores(spark, d):
    scores = sel.chi2_scores(dtm(spark, d), i.doc_labels(spark, d))
    return scores.select("feature", F.round("score", 5).alias("score"))


@query(
    "select_k_best",
    with_ctes(CHI2, select="SELECT feature, round(score, 5) AS score FROM chi2 ORDER BY round(score, 9) DESC, feature LIMIT 500"),
)
def select_k_best(spark, d):
    best = sel.select_k_best(sel.chi2_scores(dtm(spark, d), i.doc_labels(spark, d)), 500)
    return best.select("feature", F.round("score", 5).alias("score"))


ODDS = f"""{i.QDTM},
odds_counts AS (SELECT feature, count(*) AS n, count(*) FILTER (label = '0') AS n0 FROM qdtm GROUP BY feature),
odds AS (SELECT feature, (n0 + 1e-6) / (n + 2e-6) AS p FROM odds_counts)"""


@query("log_odds", with_ctes(ODDS, select="SELECT feature, round(ln(p) - ln(1 - p), 6) AS score FROM odds WHERE abs(ln(p) - ln(1 - p)) > 0.5"))
def log_odds(spark, d):
    docs = i.quality_docs(spark, d)
    scores = sel.log_odds(dtm(spark, d).drop("label"), docs)
    return sel.filter_log_odds(scores, 0.5).select("feature", F.round("score", 6).alias("score"))


@query(
    "select_features",
    with_ctes(
        f"{BOTH},\n{i.QDOCS},\nqdtm AS (SELECT d.doc_id, q.label, d.feature, d.weight FROM dtm d JOIN qdocs q ON d.doc_id = q.doc_id)",
        "share AS (SELECT label, count(*) / (SELECT count(*) FROM qdocs) AS p FROM qdocs GROUP BY label)",
        "totals AS (SELECT feature, sum(weight) AS t FROM qdtm GROUP BY feature)",
        "seen AS (SELECT feature, label, sum(weight) AS o FROM qdtm GROUP BY ALL)",
        """chi2 AS (SELECT t.feature, sum(power(coalesce(o, 0) - p * t, 2) / (p * t)) AS score
  FROM totals t CROSS JOIN share s LEFT JOIN seen USING (feature, label) GROUP BY t.feature)""",
        "top AS (SELECT feature FROM chi2 ORDER BY round(score, 9) DESC, feature LIMIT 2000)",
        "odds AS (SELECT feature, (count(*) FILTER (label = '0') + 1e-6) / (count(*) + 2e-6) AS p FROM qdtm GROUP BY feature)",
        "strong AS (SELECT feature FROM odds WHERE abs(ln(p) - ln(1 - p)) > 0.1)",
        "kept AS (SELECT feature, count(*) AS df FROM qdtm WHERE feature IN (FROM top) AND feature IN (FROM strong) "
        "AND feature IN (SELECT feature FROM thesaurus) GROUP BY feature)",
        select="SELECT feature, df, row_number() OVER (ORDER BY feature) - 1 AS idx FROM kept",
    ),
)
def select_features(spark, d):
    docs = i.quality_docs(spark, d)
    rows = sel.labelled(dtm(spark, d).drop("label"), docs)
    vocab = materialize(vz.index_vocab(materialize(vz.build_vocab(rows), "vocab")), "indexed")
    return sel.select_features(vocab, rows, docs, 2000, thesaurus(spark, d), True, 0.1)


@query(
    "keep_docs_min_weight",
    with_ctes(i.DTM, i.DOCS, select="SELECT doc_id, label FROM docs WHERE doc_id IN (SELECT doc_id FROM dtm GROUP BY doc_id HAVING sum(weight) >= 100)"),
)
def keep_docs_min_weight(spark, d):
    return sel.keep_docs_min_weight(i.doc_labels(spark, d), dtm(spark, d), 100)


@query(
    "drop_empty_features",
    with_ctes(
        SPLIT,
        "heavy AS (SELECT cv_no, doc_id FROM train GROUP BY cv_no, doc_id HAVING sum(weight) >= 500)",
        "used AS (SELECT DISTINCT cv_no, feature FROM train SEMI JOIN heavy USING (cv_no, doc_id))",
        select="SELECT cv_no, feature, df FROM vocab SEMI JOIN used USING (cv_no, feature)",
    ),
)
def drop_empty_features(spark, d):
    train, _, train_docs, _ = parts(spark, d)
    kept = sel.keep_docs_min_weight(train_docs, train, 500, BY)
    return sel.drop_empty_features(train_vocab(train), train.join(kept.select(*BY, "doc_id"), [*BY, "doc_id"], "left_semi"), BY)


# ---------------------------------------------------------------- statistics


@query(
    "coverage_counts",
    with_ctes(
        REPLACE,
        select="""SELECT cv_no AS cv_fold, 'ev' AS stage, feature, iv::INT AS "IV", it::INT AS "IT", sum(weight)::BIGINT AS "count"
FROM flags GROUP BY ALL
UNION ALL SELECT t.cv_no, 'tr', t.feature, 1, (e.feature IS NOT NULL)::INT, sum(t.weight)::BIGINT
FROM train t LEFT JOIN entries e ON t.feature = e.feature GROUP BY ALL""",
    ),
)
def coverage_counts(spark, d):
    """Both stages: the training documents of a fold, whose features all count as known, and its test documents."""
    vocab, rows, _ = _fold_rows(spark, d)
    near = stored_thesaurus(spark, d)
    trained = vz.mark_iv_it(vz.feature_totals(rows, BY, "train"), None, near, BY)
    tested = vz.mark_iv_it(vz.feature_totals(rows, BY, "test"), vocab, near, BY)
    return stats.coverage_counts(tested, "ev").unionByName(stats.coverage_counts(trained, "tr"))


@query(
    "replacement_counts",
    with_ctes(
        REPLACE,
        "looked AS (SELECT cv_no, feature, sum(weight)::BIGINT AS n FROM flags WHERE NOT iv AND it GROUP BY cv_no, feature)",
        "avail AS (SELECT cv_no, feature, count(*) AS a FROM usable GROUP BY cv_no, feature)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY cv_no, feature ORDER BY sim DESC, neighbour) AS r FROM best)",
        select="""SELECT l.cv_no AS cv_fold, 'ev' AS stage, l.feature, coalesce(a, 0)::INT AS available_replacements,
  coalesce(max(neighbour) FILTER (r = 1), '') AS neigh1, round(max(sim) FILTER (r = 1), 6) AS neigh1_sim,
  coalesce(max(neighbour) FILTER (r = 2), '') AS neigh2, round(max(sim) FILTER (r = 2), 6) AS neigh2_sim,
  coalesce(max(neighbour) FILTER (r = 3), '') AS neigh3, round(max(sim) FILTER (r = 3), 6) AS neigh3_sim, l.n AS "count"
FROM looked l LEFT JOIN avail v ON l.cv_no = v.cv_no AND l.feature = v.feature
  LEFT JOIN placed p ON l.cv_no = p.cv_no AND l.feature = p.feature GROUP BY l.cv_no, l.feature, a, l.n""",
    ),
)
def replacement_counts(spark, d):
    vocab, test, _ = test_parts(spark, d)
    near = stored_thesaurus(spark, d)
    looked = vz.mark_iv_it(vz.feature_totals(test, BY), vocab, near, BY).where("not iv and it")
    out = stats.replacement_counts(looked, near, vocab, K, "ev", BY)
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("_sim") else c for c in out.columns])


@query(
    "survival_counts",
    with_ctes(
        SPLIT,
        "heavy AS (SELECT cv_no, doc_id FROM train GROUP BY cv_no, doc_id HAVING sum(weight) >= 100)",
        select="""SELECT cv_no, (SELECT count(*) FROM train_docs t WHERE t.cv_no = cv.cv_no) AS docs,
  (SELECT count(*) FROM heavy t WHERE t.cv_no = cv.cv_no) AS docs_kept,
  (SELECT count(DISTINCT feature) FROM train t WHERE t.cv_no = cv.cv_no) AS features,
  (SELECT count(*) FROM vocab t WHERE t.cv_no = cv.cv_no) AS features_kept,
  (SELECT count(*) FROM train t WHERE t.cv_no = cv.cv_no) AS entries FROM cv""",
    ),
)
def survival_counts(spark, d):
    train, _, train_docs, _ = parts(spark, d)
    kept = sel.keep_docs_min_weight(train_docs, train, 100, BY)
    full = vz.build_vocab(train, BY)
    return stats.survival_counts(train_docs, kept, full, vz.limit_df(full, 2, by=BY), train, BY)
