"""Cross-validation splits: ``(doc_id, label, cv_no, role)`` with role ``train`` or ``test``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordfold.functions.draws import draw
from wordfold.operators.ranking import global_rank


def _check(k: int) -> int:
    if int(k) < 1:
        raise ValueError("there must be at least one fold")
    return int(k)


def contiguous_fold(rank: Column, total: Column, k: int) -> Column:
    """Fold of the rank-th of ``total`` rows: the first ``total mod k`` folds are one larger."""
    small = F.floor(total / F.lit(k))
    large = F.pmod(total, F.lit(k))
    edge = large * (small + 1)
    return F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(
        large + F.floor((rank - edge) / F.greatest(small, F.lit(1)))
    ).cast("int")


def with_roles(assigned: DataFrame, k: int) -> DataFrame:
    """Every document once per fold: test in its own fold, train in the others."""
    keep = [c for c in assigned.columns if c != "fold"]
    return assigned.withColumn("cv_no", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        *keep, "cv_no", F.when(F.col("fold") == F.col("cv_no"), F.lit("test")).otherwise(F.lit("train")).alias("role")
    )


def kfold_assign(docs: DataFrame, k: int) -> DataFrame:
    k = _check(k)
    ranked = global_rank(docs, F.col("doc_id"))
    return ranked.withColumn("fold", contiguous_fold(F.col("rank"), F.col("total"), k)).drop("rank", "total")


def stratified_assign(docs: DataFrame, k: int) -> DataFrame:
    k = _check(k)
    ranked = global_rank(docs, F.col("doc_id"), by=["label"])
    return ranked.withColumn("fold", contiguous_fold(F.col("rank"), F.col("total"), k)).drop("rank", "total")


def kfold(docs: DataFrame, k: int = 5) -> DataFrame:
    return with_roles(kfold_assign(docs, k), k)


def stratified_kfold(docs: DataFrame, k: int = 5) -> DataFrame:
    return with_roles(stratified_assign(docs, k), k)


def oracle_split(docs: DataFrame) -> DataFrame:
    """One fold that trains and tests on everything."""
    return docs.withColumn("cv_no", F.lit(0)).withColumn("role", F.explode(F.array(F.lit("train"), F.lit("test"))))


def predefined_split(train: DataFrame, test: DataFrame) -> DataFrame:
    given = train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))
    return given.withColumn("cv_no", F.lit(0))


def subsampled_split(
    train: DataFrame, test: DataFrame, runs: int, sample_size: int, seed: int = 0, train_only: bool = False
) -> DataFrame:
    """Per run, a stratified sample of the training documents and all test documents.

    Class shares come from training and test labels together (``train_only``: training
    labels).  A class with too few training documents fails the query, since sampling is
    without replacement.
    """
    runs = _check(runs)
    labels = train.select("label") if train_only else train.select("label").unionByName(test.select("label"))
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    share = F.col("__n") / counts.agg(F.sum("__n")).scalar()
    sizes = counts.select("label", F.bround(share * F.lit(int(sample_size))).cast("long").alias("__size"))
    each = train.withColumn("cv_no", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    drawn = global_rank(
        each,
        F.struct(draw(seed, "doc_id", "cv_no").alias("h"), F.col("doc_id").alias("d")),
        by=["cv_no", "label"],
    )
    enough = F.when(
        F.col("__size") > F.col("total"), F.raise_error("a class has fewer training documents than the sample needs").cast("boolean")
    ).otherwise(F.col("rank") < F.col("__size"))
    sample = drawn.join(sizes, "label").where(enough).select(*each.columns).withColumn("role", F.lit("train"))
    tests = test.withColumn("cv_no", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("role", F.lit("test"))
    return sample.unionByName(tests)


def first_fold_only(folds: DataFrame) -> DataFrame:
    return folds.where(F.col("cv_no") == 0)


SPLITS_WITH_TEST_SET = ("test_set", "subsampled_test_set")


def split(
    kind: str, docs: DataFrame, test: DataFrame | None = None, k: int = 5, sample_size: int | None = None, seed: int = 0
) -> DataFrame:
    """The split an experiment asks for by name."""
    if test is not None and kind not in SPLITS_WITH_TEST_SET:
        raise ValueError("only test_set and subsampled_test_set can be used with a test set")
    if test is None and kind in SPLITS_WITH_TEST_SET:
        raise ValueError(f"{kind} needs a test set")
    if kind == "kfold":
        return kfold(docs, k)
    if kind == "skfold":
        return stratified_kfold(docs, k)
    if kind == "oracle":
        return oracle_split(docs)
    if kind == "test_set":
        return predefined_split(docs, test)
    if kind == "subsampled_test_set":
        if sample_size is None:
            raise ValueError("subsampled_test_set needs a sample size")
        return subsampled_split(docs, test, k, sample_size, seed)
    raise ValueError(f"unknown kind of split {kind}")


def shuffle_labels(docs: DataFrame, seed: int = 0) -> DataFrame:
    """A random permutation of the labels over the documents."""
    places = global_rank(docs.drop("label"), F.col("doc_id"))
    deal = F.struct(draw(seed, "doc_id").alias("h"), F.col("doc_id").alias("d"))
    labels = global_rank(docs.select("doc_id", "label"), deal).select("rank", "label")
    return places.join(labels, "rank").drop("rank", "total").select(*docs.columns)
