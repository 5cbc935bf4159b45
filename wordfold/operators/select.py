"""Feature selection and pruning of documents and features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordfold.operators.ranking import global_rank, top_k
from wordfold.operators.vectorize import reindex_vocab

# Up to this k Spark keeps only the k best of every partition before a window's shuffle.
TRIMMED_K = 1000
SMOOTHING = 0.000001  # fixed value


def labelled(dtm: DataFrame, docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attach labels unless the rows already carry them."""
    if "label" in dtm.columns:
        return dtm
    return dtm.join(docs.select(*by, "doc_id", "label"), [*by, "doc_id"])


def keep_in_model(vocab: DataFrame, model: DataFrame | None) -> DataFrame:
    if model is None:
        raise ValueError("vectors or clusters are needed to keep only features that have one")
    return vocab.join(model.select("feature"), "feature", "left_semi")


def chi2_scores(dtm: DataFrame, docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per feature, sum over classes of (observed - expected)^2 / expected.

    Expected is (share of documents in the class) x (total weight T).  A class without the
    feature contributes its expected weight, so only (feature, class) pairs that occur are
    formed and T x (1 - their shares) is added; no large sums are subtracted.
    """
    by = list(by)
    observed = labelled(dtm, docs, by).groupBy(*by, "feature", "label").agg(F.sum("weight").alias("__o"))
    counts = docs.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("__n"))
    shares = _share_of_documents(counts, by)
    feature = Window.partitionBy(*by, "feature")  # at most one row per class
    expected = F.col("__t") * F.col("__share")
    return (
        observed.join(shares, [*by, "label"])
        .withColumn("__t", F.sum("__o").over(feature))
        .groupBy(*by, "feature")
        .agg(F.first("__t").alias("__t"), F.sum("__share").alias("__shares"), F.sum((F.col("__o") - expected) ** 2 / expected).alias("__s"))
        .select(*by, "feature", F.coalesce(F.col("__s") + F.col("__t") * F.greatest(1 - F.col("__shares"), F.lit(0.0)), F.lit(0.0)).alias("score"))
    )


def _share_of_documents(counts: DataFrame, by: list[str]) -> DataFrame:
    if by:
        totals = counts.groupBy(*by).agg(F.sum("__n").alias("__all"))
        rows = counts.join(F.broadcast(totals), by)  # one row per fold
    else:
        rows = counts.select("*", counts.agg(F.sum("__n")).scalar().alias("__all"))
    return rows.select(*by, "label", (F.col("__n") / F.col("__all")).alias("__share"))


def select_k_best(scores: DataFrame, k: int | str, by: Sequence[str] = ()) -> DataFrame:
    """The k best features, ties by name; ``"all"`` keeps everything."""
    if k == "all":
        return scores
    k = int(k)
    by = list(by)
    order = [F.round("score", 9).desc(), F.asc("feature")]
    if k < TRIMMED_K:
        return top_k(scores, order, k, by) if by else scores.orderBy(*order).limit(k)
    key = F.struct((-F.round("score", 9)).alias("s"), F.col("feature").alias("f"))
    return global_rank(scores, key, by).where(F.col("rank") < k).drop("rank", "total")


def log_odds(dtm: DataFrame, docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Smoothed log odds that a document with the feature has the first label.

    Needs exactly two labels; anything else fails the query.
    """
    by = list(by)
    classes = docs.groupBy(*by).agg(
        F.min("label").alias("__first"),
        F.count_distinct("label").alias("__classes"),
    )
    checked = classes.select(
        *by,
        F.when(F.col("__classes") == 2, F.col("__first"))
        .otherwise(F.raise_error("a log odds score needs a binary classification task").cast(docs.schema["label"].dataType))
        .alias("__first"),
    )
    rows = labelled(dtm, docs, by).where(F.col("weight") != 0)
    if by:
        rows = rows.join(F.broadcast(checked), by)  # one row per fold
    else:
        rows = rows.select("*", checked.scalar().alias("__first"))
    counts = rows.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("__all"), F.count_if(F.col("label") == F.col("__first")).alias("__one")
    )
    p = (F.col("__one") + SMOOTHING) / (F.col("__all") + 2 * SMOOTHING)
    return counts.select(*by, "feature", (F.ln(p) - F.ln(1 - p)).alias("score"))


def filter_log_odds(scores: DataFrame, minimum: float) -> DataFrame:
    return scores.where(F.abs("score") > minimum)


def select_features(
    vocab: DataFrame,
    dtm: DataFrame,
    docs: DataFrame,
    k: int | str = "all",
    model: DataFrame | None = None,
    must_be_in_model: bool = False,
    min_log_odds: float = 0,
    scoring: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame] = chi2_scores,
    by: Sequence[str] = (),
) -> DataFrame:
    """Features that pass every test; scores are computed over all features first.

    Parts that would keep everything are not planned at all.
    """
    kept = vocab
    if must_be_in_model:
        kept = keep_in_model(kept, model)
    if k != "all":
        best = select_k_best(scoring(dtm, docs, by), k, by)
        kept = kept.join(best.select(*by, "feature"), [*by, "feature"], "left_semi")
    if min_log_odds > 0:
        strong = filter_log_odds(log_odds(dtm, docs, by), min_log_odds)
        kept = kept.join(strong.select(*by, "feature"), [*by, "feature"], "left_semi")
    return reindex_vocab(kept, F.lit(True), by) if "idx" in kept.columns else kept


def keep_docs_min_weight(docs: DataFrame, dtm: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Documents whose weights add up to the threshold; a document without features weighs 0."""
    if threshold <= 0:
        return docs
    heavy = dtm.groupBy(*by, "doc_id").agg(F.sum("weight").alias("__w")).where(F.col("__w") >= threshold)
    return docs.join(heavy.drop("__w"), [*by, "doc_id"], "left_semi")


def drop_empty_features(vocab: DataFrame, dtm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Features that still have weight in some remaining document."""
    used = dtm.groupBy(*by, "feature").agg(F.sum("weight").alias("__w")).where(F.col("__w") > 0)
    kept = vocab.join(used.drop("__w"), [*by, "feature"], "left_semi")
    return reindex_vocab(kept, F.lit(True), by) if "idx" in kept.columns else kept
