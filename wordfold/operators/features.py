"""Features of cleaned sentences, one output row per occurrence.

Every extractor is an array expression over one sentence followed by a single
``inline``; occurrences of all wanted kinds come out of one pass over the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordfold.functions import grammar as g
from wordfold.functions.text import ENTITY_TAGS, let

PHRASES = ("AN", "NN", "VO", "SVO")


def as_set(values: str | Iterable[str] | None) -> list[str]:
    """``"J,N,V"`` and ``["J", "N", "V"]`` mean the same; membership is exact."""
    if not values:
        return []
    if isinstance(values, str):
        values = values.split(",")
    return [v.strip() for v in values if v and v.strip()]


def _plain(t: Column) -> Column:
    return F.struct(t["text"].alias("text"), t["pos"].alias("pos"), t["ner"].alias("ner"))


def _feature(ftype: str, *tokens: Column) -> Column:
    return F.struct(F.lit(ftype).alias("ftype"), F.array(*[_plain(t) for t in tokens]).alias("tokens"))


def _arcs(relations: Iterable[str], head: str, dep: str) -> Column:
    return F.filter(
        "arcs",
        lambda a: a["type"].isin(*relations) & (a["head"]["pos"] == head) & (a["dep"]["pos"] == dep),
    )


def unigram_array(pos_set: str | Iterable[str]) -> Column:
    return F.transform(
        F.filter("tokens", lambda t: t["pos"].isin(*as_set(pos_set))), lambda t: _feature(g.UNIGRAM, t)
    )


def adj_noun_array(relations: Iterable[str] = ("amod",)) -> Column:
    return F.transform(_arcs(relations, "N", "J"), lambda a: _feature("AN", a["dep"], a["head"]))


def noun_noun_array(relations: Iterable[str] = ("nn", "compound")) -> Column:
    return F.transform(_arcs(relations, "N", "N"), lambda a: _feature("NN", a["dep"], a["head"]))


def verb_object_array(relations: Iterable[str] = ("dobj",)) -> Column:
    return F.transform(_arcs(relations, "V", "N"), lambda a: _feature("VO", a["head"], a["dep"]))


def subj_verb_obj_array(
    subject_relations: Iterable[str] = ("nsubj",), object_relations: Iterable[str] = ("dobj",)
) -> Column:
    """Every subject with every object of the same verb."""
    return let(
        _arcs(object_relations, "V", "N"),
        lambda objects: F.flatten(
            F.transform(
                _arcs(subject_relations, "V", "N"),
                lambda s: F.transform(
                    F.filter(objects, lambda o: o["head"]["idx"] == s["head"]["idx"]),
                    lambda o: _feature("SVO", s["dep"], s["head"], o["dep"]),
                ),
            )
        ),
    )


def ngram_array(n_max: int) -> Column:
    """Contiguous runs of 2..n surviving tokens of a sentence, in token order."""

    def runs(ordered: Column, n: int) -> Column:
        starts = F.when(F.size(ordered) >= n, F.sequence(F.lit(1), F.size(ordered) - (n - 1))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            starts,
            lambda i: F.struct(
                F.lit(f"{n}-GRAM").alias("ftype"), F.transform(F.slice(ordered, i, n), _plain).alias("tokens")
            ),
        )

    return let(
        F.sort_array("tokens"), lambda ordered: F.concat(*[runs(ordered, n) for n in range(2, n_max + 1)])
    )


def _emit(cleaned: DataFrame, arrays: list[Column], separator: str, drop_ner: Column | None = None) -> DataFrame:
    keep = [c for c in cleaned.columns if c not in ("tokens", "arcs")]
    found = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
    # the outer form keeps the optimiser from testing the array, i.e. building it twice
    rows = cleaned.select(*keep, F.inline_outer(found)).where("ftype is not null")
    if drop_ner is not None:
        rows = rows.where(~drop_ner)
    return rows.withColumn("feature", g.format_feature(F.col("tokens"), separator)).select(
        *keep, "feature", "ftype", "tokens"
    )


def unigrams(cleaned: DataFrame, pos_set: str | Iterable[str] = "J,N,V") -> DataFrame:
    return _emit(cleaned, [unigram_array(pos_set)], g.SEPARATOR)


def adj_noun(cleaned: DataFrame) -> DataFrame:
    return _emit(cleaned, [adj_noun_array()], g.SEPARATOR)


def noun_noun(cleaned: DataFrame) -> DataFrame:
    return _emit(cleaned, [noun_noun_array()], g.SEPARATOR)


def verb_object(cleaned: DataFrame) -> DataFrame:
    return _emit(cleaned, [verb_object_array()], g.SEPARATOR)


def subj_verb_obj(cleaned: DataFrame) -> DataFrame:
    return _emit(cleaned, [subj_verb_obj_array()], g.SEPARATOR)


def ngrams(cleaned: DataFrame, n_max: int = 2) -> DataFrame:
    return _emit(cleaned, [ngram_array(n_max)], g.SEPARATOR)


def contains_entity(tokens: str = "tokens") -> Column:
    return F.exists(tokens, lambda t: t["ner"].isin(*ENTITY_TAGS))


def drop_ner_features(features: DataFrame, unigrams_too: bool = False) -> DataFrame:
    """Phrases with a person, place or organisation are dropped; unigrams only on request."""
    hit = contains_entity()
    if not unigrams_too:
        hit = hit & F.col("ftype").isin(*PHRASES)
    return features.where(~hit)


def drop_invalid_features(features: DataFrame, separator: str = g.SEPARATOR, require_pos: bool = True) -> DataFrame:
    return features.where(g.is_valid(F.col("feature"), separator, require_pos))


def forget_position(features: DataFrame) -> DataFrame:
    """Occurrences of one string in one document are the same feature, wherever they stood."""
    by = [c for c in ("doc_id", "label") if c in features.columns]
    return features.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class FeatureOptions:
    unigram_pos: str | tuple[str, ...] = "J,N,V"
    phrase_types: str | tuple[str, ...] = ("AN", "NN", "SVO", "VO")
    ngram_max: int = 0
    drop_ner: bool = False
    remove_pos: bool = False
    require_pos: bool = True
    separator: str = g.SEPARATOR


def extract_unigrams(token_rows: DataFrame, options: FeatureOptions = FeatureOptions()) -> DataFrame:
    """Unigram features straight from surviving token rows, for corpora used without phrases."""
    o = options
    keep = [c for c in token_rows.columns if c not in ("idx", "text", "pos", "ner")]
    rows = token_rows.where(F.col("pos").isin(*as_set(o.unigram_pos))).select(
        *keep,
        g.format_token(F.col("text"), F.col("pos")).alias("feature"),
        F.lit(g.UNIGRAM).alias("ftype"),
        F.array(F.struct("text", "pos", "ner")).alias("tokens"),
    )
    rows = drop_invalid_features(rows, o.separator, o.require_pos)
    return strip_pos(rows, o.separator) if o.remove_pos else rows


def extract_features(cleaned: DataFrame, options: FeatureOptions = FeatureOptions()) -> DataFrame:
    """All wanted kinds of feature, duplicates kept, strings that do not parse dropped."""
    o = options
    wanted = as_set(o.phrase_types)
    kinds = {
        "AN": adj_noun_array,
        "SVO": subj_verb_obj_array,
        "VO": verb_object_array,
        "NN": noun_noun_array,
    }
    arrays = [build() for name, build in kinds.items() if name in wanted]
    if as_set(o.unigram_pos):
        arrays.append(unigram_array(o.unigram_pos))
    if o.ngram_max > 1:
        arrays.append(ngram_array(o.ngram_max))
    if not arrays:
        raise ValueError("no kind of feature was asked for")
    drop = contains_entity() & F.col("ftype").isin(*PHRASES) if o.drop_ner else None
    rows = drop_invalid_features(_emit(cleaned, arrays, o.separator, drop), o.separator, o.require_pos)
    return strip_pos(rows, o.separator) if o.remove_pos else rows


def strip_pos(features: DataFrame, separator: str = g.SEPARATOR) -> DataFrame:
    return features.withColumn("feature", g.remove_pos(F.col("feature"), separator))


def with_type(features: DataFrame, separator: str = g.SEPARATOR, require_pos: bool = True) -> DataFrame:
    """Add ``ftype`` and ``tokens`` to a table that has only feature strings."""
    parsed = g.parse_feature(F.col("feature"), separator, require_pos)
    return features.withColumn("__p", parsed).select("*", "__p.ftype", "__p.tokens").drop("__p")


def filter_features(features: DataFrame, options: FeatureOptions = FeatureOptions()) -> DataFrame:
    """Keep the wanted types and tags of features that were extracted earlier.

    ``ftype`` is used when stored (so the test reaches the parquet scan), else derived.
    """
    o = options
    if "ftype" not in features.columns:
        features = with_type(features, o.separator, o.require_pos)
    elif "tokens" not in features.columns:
        features = features.withColumn("tokens", g.feature_tokens(F.col("feature"), o.separator))
    ftype = F.col("ftype")
    kept = features.where(
        ((ftype == g.UNIGRAM) & F.get("tokens", F.lit(0))["pos"].isin(*as_set(o.unigram_pos)))
        | ftype.isin(*as_set(o.phrase_types))
    )
    if o.drop_ner:
        if "ner" not in features.schema["tokens"].dataType.elementType.names:
            raise ValueError("features carry no entity tags, so they cannot be filtered by them")
        kept = drop_ner_features(kept, unigrams_too=True)
    return strip_pos(kept, o.separator) if o.remove_pos else kept


def feature_inventory(
    features: DataFrame, include_unigrams: bool = False, remove_pos: bool = False, separator: str = g.SEPARATOR
) -> DataFrame:
    """Distinct phrase features (and unigrams on request) with type and unigram tag."""
    kinds = [*PHRASES, g.UNIGRAM] if include_unigrams else list(PHRASES)
    distinct = with_type(features.select("feature").distinct(), separator).where(F.col("ftype").isin(*kinds))
    out = distinct.select(
        "feature",
        "ftype",
        F.when(F.col("ftype") == g.UNIGRAM, F.get("tokens", F.lit(0))["pos"]).alias("unigram_pos"),
    )
    if remove_pos:
        out = out.select(g.remove_pos(F.col("feature"), separator).alias("feature")).distinct()
    return out


def inventory_counts(inventory: DataFrame) -> DataFrame:
    """How many distinct features there are of each type, and of each unigram tag."""
    return inventory.groupBy("ftype", "unigram_pos").agg(F.count(F.lit(1)).alias("n"))
