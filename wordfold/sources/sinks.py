"""Writers.  Files are written by the tasks that hold the rows; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordfold.functions import grammar as g
from wordfold.operators.features import with_type
from wordfold.storage import materialize

WRITABLE_TYPES = (g.UNIGRAM, "AN", "NN", "VO", "SVO")
MISSING_SCORE = -1.0


def feature_corpus(features: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """One row per document with all its features: ``(doc_id, label, features)``.

    The list belongs to one document, so its size is that of the document.
    """
    out = features.groupBy("doc_id", "label").agg(F.array_sort(F.collect_list("feature")).alias("features"))
    if docs is None:
        return out
    empty = F.array().cast("array<string>")
    return docs.select("doc_id", "label").join(out.drop("label"), "doc_id", "left").withColumn(
        "features", F.coalesce("features", empty)
    )


def feature_json(corpus: DataFrame) -> DataFrame:
    """The line form ``["label", ["feature", ...]]``."""
    return corpus.select(json_line(F.col("label"), F.col("features")).alias("value"))


def json_line(label: Column, features: Column) -> Column:
    return F.concat(F.lit("["), _json_string(label), F.lit(", "), F.to_json(features), F.lit("]"))


def _json_string(text: Column) -> Column:
    # a one-element JSON array without its brackets
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def write_feature_corpus(features: DataFrame, path: str, docs: DataFrame | None = None) -> DataFrame:
    """Write gzipped JSON lines and return the distinct features."""
    feature_json(feature_corpus(features, docs)).write.text(path, compression="gzip")
    return features.select("feature").distinct()


def bracketed(ftype: Column, tokens: Column) -> Column:
    """Parse-bracket string of a feature; NULL for other types."""
    text = lambda i: F.get(tokens, F.lit(i))["text"]
    tag = lambda i: F.repeat(F.get(tokens, F.lit(i))["pos"], 2)
    return (
        F.when(ftype.isin("AN", "NN"), F.format_string("(ROOT\n (NP (%s %s) (%s %s)))\n\n", tag(0), text(0), tag(1), text(1)))
        .when(ftype == "VO", F.format_string("(ROOT\n  (S\n    (VP (VB %s)\n      (NP (NN %s)))))\n\n", text(0), text(1)))
        .when(
            ftype == "SVO",
            F.format_string(
                "(ROOT\n  (S\n    (NP (NN %s))\n    (VP (VB %s)\n      (NP (NN %s)))))\n\n", text(0), text(1), text(2)
            ),
        )
        .when(ftype == g.UNIGRAM, F.format_string("(ROOT\n (NP (%s %s)))\n\n", tag(0), text(0)))
    )


def feature_inventory_lists(features: DataFrame, separator: str = g.SEPARATOR) -> DataFrame:
    """``(list, value)``: all features, distinct modifiers, distinct verbs, bracket strings.

    One pass emits every list; a feature of any other type fails the query.
    """
    typed = with_type(features.select("feature").distinct(), separator)
    ok = F.col("ftype").isin(*WRITABLE_TYPES)
    checked = typed.withColumn(
        "ftype",
        F.when(ok, F.col("ftype")).otherwise(
            F.raise_error(F.concat(F.lit("wrong feature type: "), F.col("feature"), F.lit(" "), F.col("ftype"))).cast("string")
        ),
    )
    token = lambda i: F.get("tokens", i)
    written = lambda t: g.format_token(t["text"], t["pos"])
    # modifiers and verbs are listed once; the other lists have one entry per feature
    entry = lambda name, value, key=F.lit(None).cast("string"): F.struct(
        F.lit(name).alias("list"), value.alias("value"), key.alias("key")
    )
    feature = F.col("feature")
    lists = F.array(
        entry("all_features", feature, feature),
        entry("np_modifiers", F.when(F.col("ftype").isin("AN", "NN"), written(token(F.lit(0))))),
        entry("verbs", F.when(F.col("ftype").isin("VO", "SVO"), written(token(F.size("tokens") - 2)))),
        entry("brackets", bracketed(F.col("ftype"), F.col("tokens")), feature),
    )
    return checked.select(F.inline(lists)).where("value is not null").distinct().drop("key")


def write_feature_inventory(features: DataFrame, path: str, separator: str = g.SEPARATOR) -> None:
    feature_inventory_lists(features, separator).write.partitionBy("list").text(path)


def score_table(scores: DataFrame) -> DataFrame:
    """Missing and NaN scores become -1."""
    value = F.when(F.col("score").isNull() | F.isnan("score"), F.lit(MISSING_SCORE)).otherwise(F.col("score"))
    return scores.select("classifier", "cv_no", "metric", value.alias("score"))


def write_scores(scores: DataFrame, path: str) -> None:
    scores = materialize(scores, "scores")  # read twice: to test for rows, to write
    if scores.isEmpty():
        raise ValueError("there are no scores: selection may have removed all test documents of all folds")
    score_table(scores).write.csv(path, header=True)


def write_gold(test_docs: DataFrame, path: str) -> None:
    test_docs.select("cv_no", "doc_id", "label").write.partitionBy("cv_no").csv(path, header=True)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.select("cv_no", "classifier", "doc_id", "prediction").write.partitionBy("cv_no", "classifier").csv(
        path, header=True
    )


def _two_digits(name: str) -> Column:
    # first to nine digits, so that sums in another order end on the same side of a half
    return F.round(F.round(name, 9), 2)


def dump_long(dtm: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document its label, total weight, number of non-zero features and features to 2 decimals."""
    nonzero = dtm.where("weight <> 0")
    sums = nonzero.groupBy("doc_id").agg(
        F.sum("weight").alias("total_feat_weight"),
        F.count(F.lit(1)).alias("nonzero_feats"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", _two_digits("weight").alias("w"))))).alias("weights"),
    )
    return docs.join(sums, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("label").alias("target"),
        F.coalesce("total_feat_weight", F.lit(0.0)).alias("total_feat_weight"),
        F.coalesce("nonzero_feats", F.lit(0)).alias("nonzero_feats"),
        F.coalesce("weights", F.create_map().cast("map<string,double>")).alias("weights"),
    )


def dump_dtm(dtm: DataFrame, docs: DataFrame, columns: Sequence[str] | None = None, test: bool = False) -> DataFrame:
    """The matrix for inspection: one column for each of ``columns`` in their order, or a map where none are given.

    Test documents have an empty target.
    """
    rows = dump_long(dtm if columns is None else dtm.where(F.col("feature").isin(*columns)), docs)
    if test:
        rows = rows.withColumn("target", F.lit(""))
    if columns is None:
        return rows
    wide = [F.coalesce(F.try_element_at("weights", F.lit(c)), F.lit(0.0)).alias(c) for c in columns]
    return rows.select("id", "target", "total_feat_weight", "nonzero_feats", *wide)


def dump_entries(dtm: DataFrame, docs: DataFrame, stage: str, by: Sequence[str] = ("cv_no",)) -> DataFrame:
    """The matrix of a stage (``tr``, ``ev``) for inspection, one row for each non-zero weight, to 2 decimals.

    A document without entries has one row without a feature.  Documents of stage ``ev`` have an empty target.
    """
    keys = [*by, "doc_id"]
    entries = dtm.where("weight <> 0").select(*keys, "feature", _two_digits("weight").alias("weight"))
    target = F.lit("") if stage == "ev" else F.col("label")
    rows = docs.select(*keys, "label").join(entries, keys, "left")
    return rows.select(*by, F.lit(stage).alias("stage"), F.col("doc_id").alias("id"), target.alias("target"), "feature", "weight")


def write_dump(entries: DataFrame, path: str) -> None:
    entries.write.partitionBy("cv_no", "stage").parquet(path)


def write_stats(coverage: DataFrame, replacements: DataFrame | None, path: str) -> None:
    """Append the counts of a fold and stage."""
    root = path.rstrip("/")
    coverage.write.mode("append").partitionBy("cv_fold", "stage").parquet(f"{root}/coverage")
    if replacements is not None:
        replacements.write.mode("append").partitionBy("cv_fold", "stage").parquet(f"{root}/replacements")


def np_conll(features: DataFrame, with_pos: bool = False, separator: str = g.SEPARATOR) -> DataFrame:
    """Adjective-noun and noun-noun phrases as two-row dependency snippets in column ``value``."""
    typed = with_type(features.select("feature").distinct(), separator).where(F.col("ftype").isin("AN", "NN"))

    def word(i: int) -> Column:
        t = F.get("tokens", F.lit(i))
        return g.format_token(t["text"], t["pos"]) if with_pos else t["text"]

    relation = F.when(F.col("ftype") == "AN", F.lit("amod")).otherwise(F.lit("compound"))
    return typed.select(F.format_string("1\t%s\t2\t%s\n2\t%s\t0\troot\n\n", word(0), relation, word(1)).alias("value"))


def export_np_conll(features: DataFrame, path: str, with_pos: bool = False) -> None:
    np_conll(features, with_pos).write.option("lineSep", "").text(path)


def write_reduced_vectors(projected: DataFrame, path: str) -> None:
    """``(feature, embedding)`` rows; position i of the array is direction i."""
    projected.write.parquet(path)
