"""Classifiers as aggregates: fit on ``train``, predict ``test``, for all folds at once.

``train`` is ``(by, doc_id, label, feature, weight)``, ``test`` the same without a need for
labels; ``train_docs`` and ``test_docs`` list all documents, so one without features still
counts in the priors and still gets a prediction.  Results are ``(by, doc_id, prediction)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from wordfold.operators.search import nearest
from wordfold.operators.select import labelled
from wordfold.operators.vectorize import index_vocab
from wordfold.storage import materialize

SMALLEST_ALPHA = 1e-10  # fixed value: additive smoothing is never exactly zero
FITS_AT_ONCE = 4  # folds whose optimisers run side by side at most
FEATURES_AT_ONCE = 1_000_000  # and their features together: the driver holds some thirty numbers for each while a fold is fitted
SCORE_DIGITS = 8  # scores that differ only in rounding noise are ties


def _attach(df: DataFrame, per_fold: DataFrame, by: list[str]) -> DataFrame:
    """Add the columns of a table that has one row per fold."""
    if by:
        return df.join(F.broadcast(per_fold), by)
    for name in per_fold.columns:
        df = df.select("*", per_fold.select(name).scalar().alias(name))
    return df


def most_common_label(train_docs: DataFrame, test_docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    counts = train_docs.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("__n"))
    # the largest count, then the smallest label
    top = counts.groupBy(*by).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col("label"))).alias("__top"))
    best = top.select(*by, F.col("__top.label").alias("prediction"))
    return _attach(test_docs.select(*by, "doc_id"), best, by)


def _feature_model(gains: DataFrame, vocab: DataFrame | None, by: list[str]) -> DataFrame:
    """``(by, label, feature, gain)`` -> one row per feature with an array over its classes.

    With a vocabulary, its features without any class are rows too.
    """
    model = gains.groupBy(*by, "feature").agg(F.collect_list(F.struct("label", "gain")).alias("gains"))
    return model if vocab is None else vocab.select(*by, "feature").join(model, [*by, "feature"], "left")


def _document_sums(test: DataFrame, model: DataFrame, label: DataType, by: list[str]) -> DataFrame:
    """Per document ``units`` (all its weight in known features) and ``hits`` (class -> gain).

    One join looks features up and drops unknown ones; one aggregation, combined map-side,
    sums the weight (under no label) and the gains of every class.
    """
    none = F.array().cast(f"array<struct<label:{label.simpleString()},v:double>>")
    own = F.array(F.struct(F.lit(None).cast(label).alias("label"), F.col("weight").alias("v")))
    gained = F.transform("gains", lambda g: F.struct(g["label"].alias("label"), (g["gain"] * F.col("weight")).alias("v")))
    rows = test.drop("label").join(model, [*by, "feature"])
    sums = (
        rows.select(*by, "doc_id", F.inline_outer(F.concat(own, F.coalesce(gained, none))))
        .groupBy(*by, "doc_id", "label")
        .agg(F.sum("v").alias("v"))
    )
    named = F.col("label").isNotNull()
    return sums.groupBy(*by, "doc_id").agg(
        F.sum(F.when(~named, F.col("v"))).alias("units"),
        F.map_from_entries(F.collect_list(F.when(named, F.struct("label", "v")))).alias("hits"),
    )


def _pick(classes: DataFrame, sums: DataFrame, test_docs: DataFrame, by: list[str]) -> DataFrame:
    """arg max over classes of base + units x slope + hits.

    ``classes (by, label, base, slope)`` becomes one row per fold, so documents are never
    multiplied by classes: a document picks its class inside its own row.
    """
    per_fold = classes.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("label", "base", "slope"))).alias("__classes")
    )
    docs = test_docs.select(*by, "doc_id").join(sums, [*by, "doc_id"], "left")

    def ranked(c: Column) -> Column:
        score = (
            c["base"]
            + F.coalesce(F.col("units"), F.lit(0.0)) * c["slope"]
            + F.coalesce(F.try_element_at(F.col("hits"), c["label"]), F.lit(0.0))
        )
        return F.struct((-F.round(score, SCORE_DIGITS)).alias("s"), c["label"].alias("label"))

    best = F.array_min(F.transform("__classes", ranked))
    return _attach(docs, per_fold, by).select(*by, "doc_id", best["label"].alias("prediction"))


def _priors(train_docs: DataFrame, by: list[str]) -> DataFrame:
    counts = train_docs.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("docs"))
    # a window over (folds x classes) rows
    share = F.col("docs") / F.sum("docs").over(Window.partitionBy(*by))
    return counts.select(*by, "label", "docs", F.ln(share).alias("prior"))


def _vocab_size(train: DataFrame, vocab: DataFrame | None, by: list[str]) -> DataFrame:
    terms = vocab.select(*by, "feature") if vocab is not None else train.select(*by, "feature").distinct()
    return terms.groupBy(*by).agg(F.count(F.lit(1)).alias("terms"))


def multinomial_nb(
    train: DataFrame,
    train_docs: DataFrame,
    test: DataFrame,
    test_docs: DataFrame,
    alpha: float = 0.1,
    vocab: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Multinomial naive Bayes, additive smoothing, unsmoothed priors.

    A feature unseen in a class scores ln(alpha) - ln(total + alpha V); that part is folded
    into the slope, so the model holds only (feature, class) pairs seen in training.
    """
    by, a = list(by), max(alpha, SMALLEST_ALPHA)
    seen = labelled(train, train_docs, by).groupBy(*by, "label", "feature").agg(F.sum("weight").alias("w")).where("w > 0")
    totals = seen.groupBy(*by, "label").agg(F.sum("w").alias("total"))
    classes = _attach(_priors(train_docs, by).join(totals, [*by, "label"], "left"), _vocab_size(train, vocab, by), by)
    denominator = F.ln(F.coalesce(F.col("total"), F.lit(0.0)) + F.lit(a) * F.col("terms"))
    classes = classes.select(*by, "label", F.col("prior").alias("base"), (F.ln(F.lit(a)) - denominator).alias("slope"))
    gains = seen.select(*by, "label", "feature", (F.ln(F.col("w") + a) - F.ln(F.lit(a))).alias("gain"))
    sums = _document_sums(test, _feature_model(gains, vocab, by), train_docs.schema["label"].dataType, by)
    return _pick(classes, sums, test_docs, by)


def binarise(dtm: DataFrame, threshold: float = 0.0) -> DataFrame:
    return dtm.where(F.col("weight") > threshold).withColumn("weight", F.lit(1.0))


def multinomial_nb_binary(
    train: DataFrame,
    train_docs: DataFrame,
    test: DataFrame,
    test_docs: DataFrame,
    alpha: float = 0.1,
    threshold: float = 0.0,
    vocab: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """As ``multinomial_nb`` on presence of features; columns emptied by the threshold still count."""
    terms = vocab if vocab is not None else train.select(*by, "feature").distinct()
    return multinomial_nb(
        binarise(train, threshold), train_docs, binarise(test, threshold), test_docs, alpha, terms, by
    )


def bernoulli_nb(
    train: DataFrame,
    train_docs: DataFrame,
    test: DataFrame,
    test_docs: DataFrame,
    alpha: float = 0.1,
    vocab: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Bernoulli naive Bayes: absent features count too.

    All features absent is a constant per class; features present in the document correct it.
    """
    by, a = list(by), max(alpha, SMALLEST_ALPHA)
    seen = (
        labelled(train, train_docs, by)
        .where("weight > 0")
        .groupBy(*by, "label", "feature")
        .agg(F.count(F.lit(1)).alias("d"))
    )
    priors = _priors(train_docs, by)
    denominator = F.col("docs") + 2 * a
    p, p0 = (F.col("d") + a) / denominator, F.lit(a) / denominator
    rows = seen.join(priors.select(*by, "label", "docs"), [*by, "label"]).select(
        *by,
        "label",
        "feature",
        F.ln(1 - p).alias("absent"),
        ((F.ln(p) - F.ln(1 - p)) - (F.ln(p0) - F.ln(1 - p0))).alias("gain"),
    )
    constant = rows.groupBy(*by, "label").agg(F.sum("absent").alias("absent"), F.count(F.lit(1)).alias("own"))
    classes = _attach(priors.join(constant, [*by, "label"], "left"), _vocab_size(train, vocab, by), by).select(
        *by,
        "label",
        (
            F.col("prior")
            + F.coalesce("absent", F.lit(0.0))
            + (F.col("terms") - F.coalesce("own", F.lit(0))) * F.ln(1 - p0)
        ).alias("base"),
        (F.ln(p0) - F.ln(1 - p0)).alias("slope"),
    )
    # without a vocabulary every training feature counts, and all of those have gains
    present = test.where("weight > 0").withColumn("weight", F.lit(1.0))
    gains = rows.select(*by, "label", "feature", "gain")
    sums = _document_sums(present, _feature_model(gains, vocab, by), train_docs.schema["label"].dataType, by)
    return _pick(classes, sums, test_docs, by)


def knn_classify(
    train: DataFrame,
    train_docs: DataFrame,
    test: DataFrame,
    test_docs: DataFrame,
    k: int = 1,
    by: Sequence[str] = (),
    rows_per_block: int | None = None,
    trace: list[DataFrame] | None = None,
) -> DataFrame:
    """Majority label of the k nearest training documents, Euclidean distance.

    Ties between distances go to the smaller doc_id, between votes to the smaller label.  A document without features is the
    zero vector, not missing.  Documents that are equal in several folds are compared once; see `search.nearest`.
    """
    by = list(by)
    value = [F.col("embedding").alias("vec")] if "embedding" in train.columns else [F.col("feature").alias("ctx"), "weight"]
    rows = lambda t: t.select(*by, F.col("doc_id").alias("name"), *value)
    members = lambda d: d.select(*by, F.col("doc_id").alias("name"))
    near = nearest(rows(test), rows(train), k, "euclidean", by, False, members(test_docs), members(train_docs), rows_per_block, trace)
    votes = (
        near.join(train_docs.select(*by, F.col("doc_id").alias("item"), "label"), [*by, "item"])
        .groupBy(*by, "query", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return votes.groupBy(*by, F.col("query").alias("doc_id")).agg(
        F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("prediction")
    )


def to_vectors(dtm: DataFrame, docs: DataFrame, indexed_vocab: DataFrame, size: int, by: Sequence[str] = ()) -> DataFrame:
    """One ``features`` vector per document (and fold), stored: the only place where rows become ML vectors."""
    by = list(by)
    entries = (
        dtm.join(indexed_vocab.select(*by, "feature", "idx"), [*by, "feature"])
        .groupBy(*by, "doc_id")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("idx").cast("int").alias("i"), F.col("weight").cast("double").alias("w")))).alias("e"))
    )
    keep = [*by, *[c for c in docs.columns if c in ("doc_id", "label")]]
    part = lambda name, kind: F.coalesce(F.col("e")[name], F.array().cast(f"array<{kind}>"))
    # the columns that a stored sparse vector has, so that it is read back as one and no row goes through Python
    features = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), part("i", "int").alias("indices"), part("w", "double").alias("values"))
    rows = docs.select(*keep).join(entries, [*by, "doc_id"], "left").select(*keep, features.alias("features"))
    return materialize(rows, "vectors", StructType([*[f for f in rows.schema if f.name != "features"], StructField("features", VectorUDT())]))


def _fit_predict(estimator, train: DataFrame, test: DataFrame) -> DataFrame:
    labels = StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc").fit(train.select("label"))
    # both are stored, and the optimiser keeps its own blocks of them
    rows = labels.transform(train).select("features", F.col("__y").alias("label"))
    model = estimator(rows.count(), len(labels.labels)).fit(rows)
    names = IndexToString(inputCol="prediction", outputCol="__name", labels=labels.labels)
    return names.transform(model.transform(test)).select("doc_id", F.col("__name").alias("prediction"))


def fits_at_once(features: int) -> int:
    return max(1, min(FITS_AT_ONCE, FEATURES_AT_ONCE // max(1, features)))


def _per_fold(estimator, train, train_docs, test, test_docs, vocab, by: list[str]) -> DataFrame:
    """One fit per fold: the optimiser is iterative, so folds cannot share a plan.

    Vectors of all folds are made together.  Features are numbered once for all folds; one that a fold does not know weighs nothing there.
    """
    if "idx" in vocab.columns:
        indexed = vocab
    elif by:
        indexed = materialize(vocab.select(*by, "feature").join(index_vocab(vocab.select("feature").distinct()).select("feature", "idx"), "feature"), "columns")
    else:
        indexed = materialize(index_vocab(vocab), "columns")
    size = indexed.select("idx").distinct().count()
    train, test = to_vectors(train, train_docs, indexed, size, by), to_vectors(test, test_docs.select(*by, "doc_id"), indexed, size, by)
    if not by:
        return _fit_predict(estimator, train, test)
    folds = [r[0] for r in train_docs.select(*by).distinct().orderBy(*by).collect()]  # one row per fold

    def one(fold) -> DataFrame:
        pick = lambda df: df.where(F.col(by[0]) == fold).drop(*by)
        return _fit_predict(estimator, pick(train), pick(test)).withColumn(by[0], F.lit(fold))

    # a step of the optimiser is a short job that waits for the driver, so some folds take their steps side by side
    with ThreadPoolExecutor(fits_at_once(size)) as pool:
        parts = list(pool.map(inheritable_thread_target(train.sparkSession)(one), folds))
    return reduce(DataFrame.unionByName, parts).select(*by, "doc_id", "prediction")


def logistic_regression(
    train: DataFrame,
    train_docs: DataFrame,
    test: DataFrame,
    test_docs: DataFrame,
    vocab: DataFrame,
    C: float = 1.0,
    by: Sequence[str] = (),
    max_iter: int = 100,
) -> DataFrame:
    """L2 logistic regression; the penalty 1/(C n) is the same objective divided by C n."""
    make = lambda n, classes: LogisticRegression(
        regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter
    )
    return _per_fold(make, train, train_docs, test, test_docs, vocab, list(by))


def linear_svc(
    train: DataFrame,
    train_docs: DataFrame,
    test: DataFrame,
    test_docs: DataFrame,
    vocab: DataFrame,
    C: float = 1.0,
    by: Sequence[str] = (),
    max_iter: int = 100,
) -> DataFrame:
    """Linear support vector machine, one against the rest for more than two labels."""

    def make(n: int, classes: int):
        svc = LinearSVC(regParam=1.0 / (C * n), standardization=False, maxIter=max_iter)
        return svc if classes == 2 else OneVsRest(classifier=svc)

    return _per_fold(make, train, train_docs, test, test_docs, vocab, list(by))


def usable_folds(train_docs: DataFrame, test_docs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Folds that have something to train on and something to test."""
    folds = lambda d: d.select(*by).distinct()
    return folds(train_docs).join(folds(test_docs), list(by), "left_semi")


CLASSIFIERS = {
    "most_common_label": lambda tr, trd, te, ted, v, by, **o: most_common_label(trd, ted, by),
    "multinomial_nb": lambda tr, trd, te, ted, v, by, **o: multinomial_nb(tr, trd, te, ted, vocab=v, by=by, **o),
    "bernoulli_nb": lambda tr, trd, te, ted, v, by, **o: bernoulli_nb(tr, trd, te, ted, vocab=v, by=by, **o),
    "multinomial_nb_binary": lambda tr, trd, te, ted, v, by, **o: multinomial_nb_binary(tr, trd, te, ted, vocab=v, by=by, **o),
    "knn_classify": lambda tr, trd, te, ted, v, by, **o: knn_classify(tr, trd, te, ted, by=by, **o),
    "logistic_regression": lambda tr, trd, te, ted, v, by, **o: logistic_regression(tr, trd, te, ted, v, by=by, **o),
    "linear_svc": lambda tr, trd, te, ted, v, by, **o: linear_svc(tr, trd, te, ted, v, by=by, **o),
}


def run_classifiers(
    classifiers: dict,
    train: DataFrame,
    train_docs: DataFrame,
    test: DataFrame,
    test_docs: DataFrame,
    vocab: DataFrame,
    by: Sequence[str] = ("cv_no",),
) -> DataFrame:
    """``{name: options}`` or ``{name: callable}`` over the same matrices -> (classifier, by, doc_id, prediction).

    A callable takes (train, train_docs, test, test_docs, vocab, by).
    """
    by = list(by)
    if by:
        good = usable_folds(train_docs, test_docs, by)
        train_docs = train_docs.join(F.broadcast(good), by, "left_semi")
        test_docs = test_docs.join(F.broadcast(good), by, "left_semi")
    out = None
    for name, options in classifiers.items():
        if options is None or options is False:
            continue
        if callable(options):
            found = options(train, train_docs, test, test_docs, vocab, by)
        else:
            options = {} if options is True else options
            found = CLASSIFIERS[name](train, train_docs, test, test_docs, vocab, by, **options)
        found = found.select(F.lit(name).alias("classifier"), *by, "doc_id", "prediction")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no classifier is enabled")
    return out
