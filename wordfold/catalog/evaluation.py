"""Splits, classifiers and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordfold.catalog import inputs as i
from wordfold.catalog.matrices import dtm
from wordfold.catalog.registry import query, with_ctes
from wordfold.functions.draws import draw_sql
from wordfold.operators import classify as cl, crossval as cv, linear as ln, metrics as mt, select as sel, splits, vectorize as vz
from wordfold.storage import materialize

BY = ["cv_no"]
_ROLES = "SELECT doc_id, label, cv_no, CASE WHEN fold = cv_no THEN 'test' ELSE 'train' END AS role FROM {0}, range(5) r(cv_no)"
_STRAT = f"{i.DOCS},\nassigned AS (SELECT doc_id, label, ntile(5) OVER (PARTITION BY label ORDER BY doc_id) - 1 AS fold FROM docs)"


@query(
    "kfold",
    with_ctes(i.DOCS, "assigned AS (SELECT doc_id, label, ntile(5) OVER (ORDER BY doc_id) - 1 AS fold FROM docs)", select=_ROLES.format("assigned")),
)
def kfold(spark, d):
    return splits.kfold(i.doc_labels(spark, d), 5)


@query("stratified_kfold", with_ctes(_STRAT, select=_ROLES.format("assigned")))
def stratified_kfold(spark, d):
    return splits.stratified_kfold(i.doc_labels(spark, d), 5)


@query("oracle_split", with_ctes(i.DOCS, select="SELECT doc_id, label, 0 AS cv_no, unnest(['train', 'test']) AS role FROM docs"))
def oracle_split(spark, d):
    return splits.oracle_split(i.doc_labels(spark, d))


_GIVEN = f"""{i.DOCS},
given_test AS (SELECT * FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)),
given_train AS (SELECT * FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""


def _given(spark, d):
    """Documents with a quality label as the test set, the others as training set."""
    docs, judged = i.doc_labels(spark, d), i.quality_docs(spark, d).select("doc_id")
    return docs.join(judged, "doc_id", "left_anti"), docs.join(judged, "doc_id", "left_semi")


@query(
    "predefined_split",
    with_ctes(_GIVEN, select="SELECT *, 0 AS cv_no, 'train' AS role FROM given_train UNION ALL SELECT *, 0, 'test' FROM given_test"),
)
def predefined_split(spark, d):
    return splits.predefined_split(*_given(spark, d))


@query(
    "subsampled_split",
    with_ctes(
        _GIVEN,
        "sizes AS (SELECT label, round_even(count(*) * 50 / (SELECT count(*) FROM docs), 0)::BIGINT AS size FROM docs GROUP BY label)",
        "runs AS (SELECT unnest(range(3))::INT AS cv_no)",
        f"""drawn AS (SELECT doc_id, label, cv_no, row_number() OVER (PARTITION BY cv_no, label
  ORDER BY {draw_sql(1, 'doc_id', 'cv_no')}, doc_id) AS place FROM given_train, runs)""",
        select="""SELECT doc_id, label, cv_no, 'train' AS role FROM drawn JOIN sizes USING (label) WHERE place <= size
UNION ALL SELECT doc_id, label, cv_no, 'test' FROM given_test, runs""",
    ),
)
def subsampled_split(spark, d):
    return splits.subsampled_split(*_given(spark, d), runs=3, sample_size=50, seed=1)


@query("first_fold_only", with_ctes(_STRAT, select=f"SELECT * FROM ({_ROLES.format('assigned')}) WHERE cv_no = 0"))
def first_fold_only(spark, d):
    return splits.first_fold_only(splits.stratified_kfold(i.doc_labels(spark, d), 5))


@query(
    "shuffle_labels",
    with_ctes(
        i.DOCS,
        "places AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM docs)",
        f"dealt AS (SELECT label, row_number() OVER (ORDER BY {draw_sql(3, 'doc_id')}, doc_id) AS place FROM docs)",
        select="SELECT doc_id, label FROM places JOIN dealt USING (place)",
    ),
)
def shuffle_labels(spark, d):
    return splits.shuffle_labels(i.doc_labels(spark, d), 3)


# ---------------------------------------------------------------- classifiers: language of a document, five folds

_FOLDED = f"""{i.DTM},
{_STRAT},
folds AS ({_ROLES.format('assigned')}),
train_docs AS (SELECT cv_no, doc_id, label FROM folds WHERE role = 'train'),
test_docs AS (SELECT cv_no, doc_id, label FROM folds WHERE role = 'test'),
train AS (SELECT f.cv_no, f.doc_id, f.label, d.feature, d.weight FROM train_docs f JOIN dtm d ON f.doc_id = d.doc_id),
vocab AS (SELECT DISTINCT cv_no, feature FROM train),
test AS (SELECT f.cv_no, f.doc_id, d.feature, d.weight FROM test_docs f JOIN dtm d ON f.doc_id = d.doc_id
  JOIN vocab v ON v.cv_no = f.cv_no AND v.feature = d.feature),
class_sizes AS (SELECT cv_no, label, count(*) AS docs FROM train_docs GROUP BY ALL),
priors AS (SELECT cv_no, label, docs, ln(docs / sum(docs) OVER (PARTITION BY cv_no)) AS prior FROM class_sizes),
sizes AS (SELECT cv_no, count(*) AS v FROM vocab GROUP BY cv_no)"""


def folded(spark, d, k: int = 5):
    """The matrix and the fold of each document; no copies for each fold."""
    return cv.Folded.of(dtm(spark, d), i.doc_labels(spark, d), k)


def fold_parts(spark, d, docs=None, k: int = 5):
    """(train, train docs, test, test docs, vocabulary) of all folds, keyed by cv_no."""
    # read by several branches below, so written once
    folds = materialize(splits.stratified_kfold(i.doc_labels(spark, d) if docs is None else docs, k), "folds")
    counts = dtm(spark, d).drop("label")
    if docs is not None:
        counts = counts.join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = materialize(counts, "counts")
    train_docs, test_docs = (folds.where(F.col("role") == r).drop("role") for r in ("train", "test"))
    train = counts.join(train_docs, "doc_id")
    vocab = materialize(vz.build_vocab(train, BY), "vocab")
    test = vz.apply_handler(counts.join(test_docs, "doc_id"), vocab, "base", by=BY)
    return train, train_docs, test, test_docs, vocab


def _nb_sql(w: str, train: str = "train", test: str = "test") -> list[str]:
    return [
        f"cw AS (SELECT cv_no, label, feature, sum({w}) AS w FROM {train} GROUP BY ALL)",
        "tot AS (SELECT cv_no, label, sum(w) AS t FROM cw GROUP BY ALL)",
        "model AS (SELECT p.cv_no, p.label, p.prior, coalesce(t.t, 0) + 0.1 * s.v AS den FROM priors p JOIN sizes s ON p.cv_no = s.cv_no "
        "LEFT JOIN tot t ON t.cv_no = p.cv_no AND t.label = p.label)",
        f"terms AS (SELECT e.cv_no, e.doc_id, m.label, sum({w} * (ln(coalesce(c.w, 0) + 0.1) - ln(m.den))) AS s FROM {test} e "
        "JOIN model m ON m.cv_no = e.cv_no LEFT JOIN cw c ON c.cv_no = e.cv_no AND c.label = m.label AND c.feature = e.feature GROUP BY ALL)",
        "scored AS (SELECT d.cv_no, d.doc_id, m.label, round(m.prior + coalesce(t.s, 0), 8) AS s FROM test_docs d "
        "JOIN model m ON m.cv_no = d.cv_no LEFT JOIN terms t ON t.cv_no = d.cv_no AND t.doc_id = d.doc_id AND t.label = m.label)",
        "predicted AS (SELECT cv_no, doc_id, label AS prediction FROM scored "
        "QUALIFY row_number() OVER (PARTITION BY cv_no, doc_id ORDER BY s DESC, label) = 1)",
    ]


_PREDICTED = "SELECT cv_no, doc_id, prediction FROM predicted"


@query(
    "most_common_label",
    with_ctes(
        _FOLDED,
        "top AS (SELECT cv_no, label FROM priors QUALIFY row_number() OVER (PARTITION BY cv_no ORDER BY docs DESC, label) = 1)",
        select="SELECT d.cv_no, d.doc_id, t.label AS prediction FROM test_docs d JOIN top t ON t.cv_no = d.cv_no",
    ),
)
def most_common_label(spark, d):
    folds = splits.stratified_kfold(i.doc_labels(spark, d), 5)
    return cl.most_common_label(folds.where("role = 'train'"), folds.where("role = 'test'"), BY)


@query("multinomial_nb", with_ctes(_FOLDED, *_nb_sql("weight"), select=_PREDICTED))
def multinomial_nb(spark, d):
    return cv.multinomial_nb(folded(spark, d), 0.1)


@query(
    "multinomial_nb_binary",
    with_ctes(
        _FOLDED,
        "btrain AS (SELECT cv_no, doc_id, label, feature, 1.0::DOUBLE AS one FROM train WHERE weight > 1)",
        "btest AS (SELECT cv_no, doc_id, feature, 1.0::DOUBLE AS one FROM test WHERE weight > 1)",
        *_nb_sql("one", "btrain", "btest"),
        select=_PREDICTED,
    ),
)
def multinomial_nb_binary(spark, d):
    return cv.multinomial_nb(folded(spark, d), 0.1, threshold=1.0)


@query(
    "bernoulli_nb",
    with_ctes(
        _FOLDED,
        "dc AS (SELECT cv_no, label, feature, count(*) AS d FROM train GROUP BY ALL)",
        "probs AS (SELECT p.cv_no, p.label, v.feature, (coalesce(dc.d, 0) + 0.1) / (p.docs + 0.2) AS p FROM priors p "
        "JOIN vocab v ON v.cv_no = p.cv_no LEFT JOIN dc ON dc.cv_no = p.cv_no AND dc.label = p.label AND dc.feature = v.feature)",
        "absent AS (SELECT cv_no, label, sum(ln(1 - p)) AS a FROM probs GROUP BY ALL)",
        "terms AS (SELECT e.cv_no, e.doc_id, q.label, sum(ln(q.p) - ln(1 - q.p)) AS s FROM test e "
        "JOIN probs q ON q.cv_no = e.cv_no AND q.feature = e.feature GROUP BY ALL)",
        "scored AS (SELECT d.cv_no, d.doc_id, p.label, round(p.prior + a.a + coalesce(t.s, 0), 8) AS s FROM test_docs d "
        "JOIN priors p ON p.cv_no = d.cv_no JOIN absent a ON a.cv_no = p.cv_no AND a.label = p.label "
        "LEFT JOIN terms t ON t.cv_no = d.cv_no AND t.doc_id = d.doc_id AND t.label = p.label)",
        "predicted AS (SELECT cv_no, doc_id, label AS prediction FROM scored "
        "QUALIFY row_number() OVER (PARTITION BY cv_no, doc_id ORDER BY s DESC, label) = 1)",
        select=_PREDICTED,
    ),
)
def bernoulli_nb(spark, d):
    return cv.bernoulli_nb(folded(spark, d), 0.1)


@query(
    "knn_classify",
    with_ctes(
        _FOLDED,
        "sq AS (SELECT doc_id, sum(weight * weight) AS q FROM dtm GROUP BY doc_id)",
        "tsq AS (SELECT cv_no, doc_id, sum(weight * weight) AS q FROM test GROUP BY ALL)",
        "dots AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(a.weight * b.weight) AS dot FROM dtm a JOIN dtm b ON a.feature = b.feature GROUP BY ALL)",
        "near AS (SELECT t.cv_no, t.doc_id, n.doc_id AS other, n.label, "
        "round(sqrt(greatest(coalesce(tsq.q, 0) + coalesce(s.q, 0) - 2 * coalesce(dot, 0), 0)), 9) AS dist "
        "FROM test_docs t JOIN train_docs n ON n.cv_no = t.cv_no LEFT JOIN tsq ON tsq.cv_no = t.cv_no AND tsq.doc_id = t.doc_id "
        "LEFT JOIN sq s ON s.doc_id = n.doc_id LEFT JOIN dots ON x = t.doc_id AND y = n.doc_id)",
        "best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY cv_no, doc_id ORDER BY dist, other) <= 3)",
        "votes AS (SELECT cv_no, doc_id, label, count(*) AS n FROM best GROUP BY ALL)",
        select="""SELECT cv_no, doc_id, label AS prediction FROM votes
QUALIFY row_number() OVER (PARTITION BY cv_no, doc_id ORDER BY n DESC, label) = 1""",
    ),
)
def knn_classify(spark, d):
    train, train_docs, test, test_docs, _ = fold_parts(spark, d)
    return cl.knn_classify(train, train_docs, test, test_docs, 3, BY)


_OPTIMAL = with_ctes(
    i.QDOCS,
    select="SELECT cv_no::INT AS cv_no, last AS label, n AS documents, true AS optimal FROM (SELECT count(*) AS n, max(label) AS last FROM qdocs), range(5) r(cv_no)",
)


def _fitted(spark, d, loss):
    """All five folds of the documents with a quality label, at the library's defaults."""
    docs = i.quality_docs(spark, d)
    folds = materialize(splits.stratified_kfold(docs, 5), "folds")
    rows = materialize(dtm(spark, d).drop("label").join(docs.select("doc_id"), "doc_id", "left_semi"), "counts")
    return ln.fit(rows, docs, folds.select(*BY, "doc_id", "role"), loss)


def _optimum(fitted):
    """For each fold the predictions made, and whether no entry of the gradient over all training rows is far from zero.

    The objective is convex, so a gradient of zero says that no other coefficients are better.
    """
    made = fitted.predictions().select("doc_id").distinct().agg(F.count(F.lit(1)).alias("documents"))
    slopes = ln.largest_gradient(fitted)
    return slopes.select(*BY, "label", made.scalar().alias("documents"), (F.col("largest_gradient") < 1e-3).alias("optimal"))


@query("logistic_regression", _OPTIMAL)
def logistic_regression(spark, d):
    return _optimum(_fitted(spark, d, "log"))


@query("linear_svc")
def linear_svc(spark, d):
    """All five folds of the documents with a quality label, at the library's defaults."""
    train, train_docs, test, test_docs, vocab = (materialize(x, "svc") for x in fold_parts(spark, d, i.quality_docs(spark, d)))
    return cl.linear_svc(train, train_docs, test, test_docs, vocab, 1.0, BY)


_TWO_SQL = [
    *_nb_sql("weight"),
    "top AS (SELECT cv_no, label FROM priors QUALIFY row_number() OVER (PARTITION BY cv_no ORDER BY docs DESC, label) = 1)",
    """judged AS (
  SELECT 'multinomial_nb' AS classifier, p.cv_no, p.doc_id, t.label, p.prediction FROM predicted p JOIN test_docs t ON t.cv_no = p.cv_no AND t.doc_id = p.doc_id
  UNION ALL SELECT 'most_common_label', d.cv_no, d.doc_id, d.label, t.label FROM test_docs d JOIN top t ON t.cv_no = d.cv_no)""",
]


def two_classifiers(spark, d):
    matrix = folded(spark, d)
    found = cv.run_classifiers({"multinomial_nb": {"alpha": 0.1}, "most_common_label": True, "bernoulli_nb": False}, matrix)
    return found.join(matrix.roles("test"), [*BY, "doc_id"])


@query("run_classifiers", with_ctes(_FOLDED, *_TWO_SQL, select="SELECT classifier, cv_no, doc_id, label, prediction FROM judged"))
def run_classifiers(spark, d):
    return two_classifiers(spark, d)


# ---------------------------------------------------------------- scores


def _scores_sql(by: str, source: str = "judged") -> list[str]:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return [
        f"cells AS (SELECT {lead}label AS c, count(*) FILTER (label = prediction) AS tp, count(*) FILTER (label <> prediction) AS fn, 0 AS fp "
        f"FROM {source} GROUP BY ALL UNION ALL SELECT {lead}prediction, 0, 0, count(*) FILTER (label <> prediction) FROM {source} GROUP BY ALL)",
        f"per AS (SELECT {lead}c, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cells GROUP BY ALL)",
        f"wide AS (SELECT {lead}avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END) AS macroavg_prec, "
        "avg(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END) AS macroavg_rec, "
        "avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) AS macroavg_f1, "
        "sum(tp) / sum(tp + fp) AS microavg_prec, sum(tp) / sum(tp + fn) AS microavg_rec, "
        f"2 * sum(tp) / sum(2 * tp + fp + fn) AS microavg_f1, sum(tp) / sum(tp + fn) AS accuracy_score FROM per {group})",
    ]


# a simple prediction for single metrics: short documents are English, long ones French, the rest German
_GUESS = """judged AS (SELECT source, lang AS label, CASE WHEN n_chars < 1000 THEN 'en' WHEN n_chars > 5000 THEN 'fr' ELSE 'de' END AS prediction
  FROM documents)"""


def guesses(spark, d):
    docs = i.table(spark, d, "documents")
    guess = F.when(F.col("n_chars") < 1000, "en").when(F.col("n_chars") > 5000, "fr").otherwise("de")
    return docs.select("source", F.col("lang").alias("label"), guess.alias("prediction"))


def _metric(name: str, column: str, fn) -> None:
    @query(name, with_ctes(_GUESS, *_scores_sql("source"), select=f"SELECT source, round({column}, 6) AS score FROM wide"))
    def run(spark, d):
        return fn(guesses(spark, d), ["source"]).select("source", F.round("score", 6).alias("score"))


_metric("macro_precision", "macroavg_prec", mt.macro_precision)
_metric("macro_recall", "macroavg_rec", mt.macro_recall)
_metric("macro_f1", "macroavg_f1", mt.macro_f1)
_metric("micro_precision", "microavg_prec", mt.micro_precision)
_metric("micro_recall", "microavg_rec", mt.micro_recall)
_metric("micro_f1", "microavg_f1", mt.micro_f1)
_metric("accuracy", "accuracy_score", mt.accuracy)

_ROWS = " UNION ALL ".join(f"SELECT {{0}}'{m}' AS metric, round({m}, 6) AS score FROM wide" for m in mt.METRICS)


@query("multiple_scores", with_ctes(_GUESS, *_scores_sql(""), select=_ROWS.replace("{0}", "")))
def multiple_scores(spark, d):
    return mt.multiple_scores(guesses(spark, d)).select("metric", F.round("score", 6).alias("score"))


_FOLD_ROWS = _ROWS.replace("{0}", "classifier, cv_no, ")


@query("scores_per_fold", with_ctes(_FOLDED, *_TWO_SQL, *_scores_sql("classifier, cv_no"), select=_FOLD_ROWS))
def scores_per_fold(spark, d):
    return mt.scores_per_fold(two_classifiers(spark, d)).withColumn("score", F.round("score", 6))


@query(
    "training_set_scores",
    with_ctes(
        _FOLDED,
        *[s.replace("test_docs", "train_docs").replace("FROM test e", "FROM train e") for s in _nb_sql("weight")],
        "judged AS (SELECT 'multinomial_nb' AS classifier, p.cv_no, t.label, p.prediction FROM predicted p JOIN train_docs t ON t.cv_no = p.cv_no AND t.doc_id = p.doc_id)",
        *_scores_sql("classifier, cv_no"),
        select=_FOLD_ROWS,
    ),
)
def training_set_scores(spark, d):
    matrix = folded(spark, d)
    found = cv.run_classifiers({"multinomial_nb": {"alpha": 0.1}}, matrix, training=True)
    judged = found.join(matrix.roles("train"), [*BY, "doc_id"])
    return mt.scores_per_fold(judged).withColumn("score", F.round("score", 6))


@query(
    "custom_classifier",
    with_ctes(
        _FOLDED,
        "judged AS (SELECT t.cv_no, t.doc_id, CASE WHEN coalesce(max(e.weight) FILTER (e.feature = 'the'), 0) > 0 THEN 'en' ELSE 'de' END AS prediction "
        "FROM test_docs t LEFT JOIN test e ON e.cv_no = t.cv_no AND e.doc_id = t.doc_id GROUP BY ALL)",
        select="SELECT 'rule' AS classifier, cv_no, doc_id, prediction FROM judged",
    ),
)
def custom_classifier(spark, d):
    def rule(train, train_docs, test, test_docs, vocab, by):
        hits = test.where("feature = 'the'").select(*by, "doc_id", F.lit(True).alias("hit"))
        return test_docs.join(hits, [*by, "doc_id"], "left").withColumn("prediction", F.when(F.col("hit"), "en").otherwise("de"))

    return cl.run_classifiers({"rule": rule}, *fold_parts(spark, d), BY)


@query(
    "custom_scoring",
    with_ctes(
        i.DTM,
        "best AS (SELECT feature, sum(weight) AS score FROM dtm GROUP BY feature ORDER BY score DESC, feature LIMIT 300)",
        select="SELECT feature, count(*) AS df FROM dtm WHERE feature IN (SELECT feature FROM best) GROUP BY feature",
    ),
)
def custom_scoring(spark, d):
    rows = dtm(spark, d)
    total = lambda m, docs, by: m.groupBy(*by, "feature").agg(F.sum("weight").alias("score"))
    return sel.select_features(vz.build_vocab(rows), rows, i.doc_labels(spark, d), 300, scoring=total)
