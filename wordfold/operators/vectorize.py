"""From feature occurrences to weighted document-feature rows.

``by`` names extra grouping columns (normally ``["cv_no"]``): all folds go through one
plan instead of one job per fold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordfold.functions import grammar as g
from wordfold.operators import neighbours as nb
from wordfold.operators.ranking import global_rank, top_k
from wordfold.storage import materialize

KEEP, IGNORE, EXPAND = "keep", "ignore", "expand"

# What to do with a feature: (in vocabulary, in model) -> action.
HANDLERS: dict[str, dict[tuple[bool, bool], str]] = {
    "base": {(True, True): KEEP, (True, False): KEEP, (False, True): IGNORE, (False, False): IGNORE},
    "signifier_signified": {(True, True): KEEP, (True, False): KEEP, (False, True): EXPAND, (False, False): IGNORE},
    "signified_only": {(True, True): EXPAND, (True, False): IGNORE, (False, True): EXPAND, (False, False): IGNORE},
    "signified_random": {(True, True): EXPAND, (True, False): IGNORE, (False, True): EXPAND, (False, False): IGNORE},
}


def unit(sim: Column) -> Column:
    return sim


def one(sim: Column) -> Column:
    return F.lit(1.0)


def doc_term_counts(features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences per document and feature; combined map-side before the shuffle."""
    extra = [c for c in ("label",) if c in features.columns]
    return features.groupBy(*by, "doc_id", *extra, "feature").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def merge_duplicates(dtm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    extra = [c for c in ("label",) if c in dtm.columns]
    return dtm.groupBy(*by, "doc_id", *extra, "feature").agg(F.sum("weight").alias("weight"))


def with_folds(dtm: DataFrame, by: Sequence[str], **docs: DataFrame) -> DataFrame:
    """Adds a column for each ``name=(by, doc_id)`` with the folds of the row's document, one for each time it is listed; rows of no listed document are dropped."""
    listed = None
    for name, rows in docs.items():
        own = rows.select("doc_id", F.lit(name).alias("__role"), F.struct(*by).alias("__fold"))
        listed = own if listed is None else listed.unionByName(own)
    of = lambda name: F.sort_array(F.collect_list(F.when(F.col("__role") == name, F.col("__fold")))).alias(name)
    return dtm.join(listed.groupBy("doc_id").agg(*[of(name) for name in docs]), "doc_id")


def build_vocab(dtm: DataFrame, by: Sequence[str] = (), docs: DataFrame | str | None = None) -> DataFrame:
    """Distinct features with the number of documents that have them.

    With ``docs (by, doc_id)``, the documents of each fold, or the name of such a column of ``with_folds``, ``dtm`` has every row once and no row is
    copied for a fold.
    """
    if docs is not None:
        return _per_fold(dtm, by, docs, F.count(F.lit(1)), "df")
    return dtm.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("df"))


def feature_totals(dtm: DataFrame, by: Sequence[str] = (), docs: DataFrame | str | None = None) -> DataFrame:
    """``(by, feature, weight)``: the weight of a feature in all documents (``docs`` as in ``build_vocab``)."""
    if docs is not None:
        return _per_fold(dtm, by, docs, F.sum("weight"), "weight")
    return dtm.groupBy(*by, "feature").agg(F.sum("weight").alias("weight"))


def _per_fold(dtm: DataFrame, by: Sequence[str], docs: DataFrame | str, amount: Column, name: str) -> DataFrame:
    """Sums for documents of the same folds first, then one copy of a sum for each of these folds."""
    rows = dtm if isinstance(docs, str) else with_folds(dtm.select("doc_id", "feature", "weight"), by, __folds=docs)
    folds = docs if isinstance(docs, str) else "__folds"
    if rows.schema[folds].dataType.elementType.names != list(by):
        rows = rows.withColumn(folds, F.transform(folds, lambda x: F.struct(*[x[c].alias(c) for c in by])))
    rows = rows.select("feature", "weight", F.col(folds).alias("__folds"))
    sums = rows.groupBy("feature", "__folds").agg(amount.alias("__n"))
    return sums.select("feature", "__n", F.inline("__folds")).groupBy(*by, "feature").agg(F.sum("__n").alias(name))


def index_vocab(vocab: DataFrame, by: Sequence[str] = (), separator: str = g.SEPARATOR) -> DataFrame:
    """Consecutive column numbers: shorter features first, then alphabetical."""
    key = F.struct(g.n_tokens(F.col("feature"), separator).alias("n"), F.col("feature").alias("f"))
    return global_rank(vocab, key, by, name="idx", total="__size").drop("__size")


def reindex_vocab(vocab: DataFrame, keep: DataFrame | Column, by: Sequence[str] = ()) -> DataFrame:
    """Drop features and renumber the rest consecutively in their old order."""
    kept = vocab.where(keep) if isinstance(keep, Column) else vocab.join(keep.select(*by, "feature"), [*by, "feature"], "left_semi")
    old = [c for c in kept.columns if c != "idx"]
    return global_rank(kept, F.col("idx"), by, name="__new", total="__size").select(*old, F.col("__new").alias("idx"))


def limit_df(
    vocab: DataFrame,
    min_df: int | float = 0,
    max_df: int | float = 1.0,
    docs: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Keep features whose document frequency lies in [min_df, max_df].

    Whole numbers are documents; fractions are shares of ``docs`` (rounded half to even).
    """
    shares = [b for b in (min_df, max_df) if isinstance(b, float)]
    if any(isinstance(a, type(b)) and a < b for a, b in [(max_df, min_df)]):
        raise ValueError("max_df corresponds to fewer documents than min_df")
    if not shares or (shares == [1.0] and isinstance(max_df, float)):
        # a share of 1.0 never removes anything
        out = vocab.where(F.col("df") >= min_df)
        return out if isinstance(max_df, float) else out.where(F.col("df") <= max_df)
    if docs is None:
        raise ValueError("a share needs the documents it is a share of")
    sizes = docs.groupBy(*by).agg(F.count_distinct("doc_id").alias("__docs"))
    if by:
        rows = vocab.join(F.broadcast(sizes), list(by))  # one row per fold
    else:
        rows = vocab.select("*", sizes.scalar().alias("__docs"))
    bound = lambda b: F.bround(F.lit(b) * F.col("__docs")).cast("long") if isinstance(b, float) else F.lit(b)
    fits = F.when(
        bound(max_df) < bound(min_df), F.raise_error("max_df corresponds to fewer documents than min_df").cast("boolean")
    ).otherwise(F.col("df").between(bound(min_df), bound(max_df)))
    return rows.where(fits).drop("__docs")


def dropped_features(vocab: DataFrame, kept: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return vocab.join(kept, [*by, "feature"], "left_anti")


def mark_iv_it(
    dtm: DataFrame, vocab: DataFrame | None, model: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Flag every row: is the feature in the vocabulary (iv), is it in the model (it).

    Both lookups add a column to an otherwise unchanged table, so a frequent feature can be
    split over tasks by the adaptive skew join; neither side is broadcast unless it is small.
    Without a vocabulary, as while training documents are counted, every feature is in it.
    """
    if vocab is None:
        out = dtm.withColumn("iv", F.lit(True))
    else:
        out = dtm.join(vocab.select(*by, "feature").withColumn("iv", F.lit(True)), [*by, "feature"], "left")
    if model is None:
        out = out.withColumn("it", F.lit(False))
    else:
        out = out.join(model.select("feature").distinct().withColumn("it", F.lit(True)), "feature", "left")
    return out.withColumn("iv", F.coalesce("iv", F.lit(False))).withColumn("it", F.coalesce("it", F.lit(False)))


def usable_neighbours(neighbours: DataFrame, vocab: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Neighbours that are in the vocabulary; with folds, one copy per fold that has them."""
    on = [c for c in by if c in neighbours.columns]
    terms = vocab.select(*by, F.col("feature").alias("neighbour"))
    return neighbours.join(terms, [*on, "neighbour"])


def _usable_by_folds(neighbours: DataFrame, vocab: DataFrame, wanted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Neighbours of the wanted ``(by, feature)`` with ``__folds``, those that want the feature and have the neighbour; no copies for folds."""
    fold = F.struct(*by).alias("__fold")
    asked = wanted.select(*by, "feature").distinct().groupBy("feature").agg(F.collect_list(fold).alias("__asked"))
    known = vocab.groupBy(F.col("feature").alias("neighbour")).agg(F.sort_array(F.collect_list(fold)).alias("__known"))
    rows = neighbours.join(asked, "feature").join(known, "neighbour")
    folds = F.array_intersect("__known", "__asked")
    return rows.withColumn("__folds", folds).drop("__asked", "__known").where(F.size("__folds") > 0)


def available(neighbours: DataFrame, vocab: DataFrame, wanted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, feature, n)``: the number of usable neighbours of the wanted ``(by, feature)``."""
    if not by or set(by) & set(neighbours.columns):
        usable = usable_neighbours(neighbours.join(wanted.select("feature").distinct(), "feature", "left_semi"), vocab, by)
        return usable.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"))
    counts = _usable_by_folds(neighbours, vocab, wanted, by).groupBy("feature", "__folds").agg(F.count(F.lit(1)).alias("__n"))
    return counts.select("feature", "__n", F.inline("__folds")).groupBy(*by, "feature").agg(F.sum("__n").alias("n"))


def replacements(neighbours: DataFrame, vocab: DataFrame, k: int, by: Sequence[str] = (), wanted: DataFrame | None = None) -> DataFrame:
    """The k best in-vocabulary neighbours of every entry, in order.

    With ``wanted (by, feature)`` only those of the features that are looked up, which saves most of the work.
    """
    order = [F.desc("sim"), F.asc("neighbour")]
    if "rank" in neighbours.columns:  # the source has its own order
        order = [F.asc("rank"), F.asc("neighbour")]
    if wanted is None:
        return top_k(usable_neighbours(neighbours, vocab, by), order, k, [*by, "feature"])
    if not by or set(by) & set(neighbours.columns):
        on = [c for c in by if c in neighbours.columns]
        asked = neighbours.join(wanted.select(*on, "feature").distinct(), [*on, "feature"], "left_semi")
        return top_k(usable_neighbours(asked, vocab, by), order, k, [*by, "feature"])
    # what is not among the k best of the neighbours that the same folds have is not among the k best of any of them
    heads = top_k(_usable_by_folds(neighbours, vocab, wanted, by), order, k, ["feature", "__folds"])
    each = heads.select(*neighbours.columns, F.inline("__folds"))
    return top_k(each, order, k, [*by, "feature"])


def expand(
    dtm: DataFrame,
    neighbours: DataFrame,
    vocab: DataFrame,
    k: int,
    sim_fn: Callable[[Column], Column] = unit,
    by: Sequence[str] = (),
) -> DataFrame:
    """Replace each feature by its neighbours, each worth ``sim_fn(sim)`` per occurrence."""
    best = replacements(neighbours, vocab, k, by, dtm).select(*by, "feature", "neighbour", "sim")
    rows = dtm.join(best, [*by, "feature"])
    keep = [c for c in dtm.columns if c not in ("feature", "weight", "iv", "it")]
    return rows.select(
        *keep, F.col("neighbour").alias("feature"), (F.col("weight") * sim_fn(F.col("sim"))).alias("weight")
    )


def apply_handler(
    dtm: DataFrame,
    vocab: DataFrame,
    handler: str | dict[tuple[bool, bool], str] = "base",
    neighbours: DataFrame | None = None,
    model: DataFrame | None = None,
    k: int = 3,
    sim_fn: Callable[[Column], Column] = unit,
    by: Sequence[str] = (),
) -> DataFrame:
    """Decide once per feature (of a fold), fetch the decision per (document, feature) with its count, then add up.

    ``handler`` is one of HANDLERS or any {(in vocabulary, in model): action} table.
    Membership in the model is membership in ``model``, or having a row in ``neighbours``.
    """
    rules = HANDLERS[handler] if isinstance(handler, str) else handler
    keep = [c for c in dtm.columns if c not in ("iv", "it")]
    if EXPAND not in rules.values() and rules[True, True] == rules[True, False] == KEEP and (
        rules[False, True] == rules[False, False] == IGNORE
    ):
        return dtm.select(*keep).join(vocab.select(*by, "feature"), [*by, "feature"], "left_semi")
    if neighbours is None:
        raise ValueError("this handler needs neighbours to replace features with")
    marked = mark_iv_it(dtm.select(*by, "feature").distinct(), vocab, model if model is not None else neighbours, by)
    action = F.lit(IGNORE)
    for (iv, it), what in rules.items():
        action = F.when((F.col("iv") == iv) & (F.col("it") == it), F.lit(what)).otherwise(action)
    marked = materialize(marked.select(*by, "feature", action.alias("__action")).where(F.col("__action") != IGNORE), "lookups")
    best = replacements(neighbours, vocab, k, by, marked.where(F.col("__action") == EXPAND))
    own = marked.where(F.col("__action") == KEEP).select(*by, "feature", F.col("feature").alias("__to"), F.lit(None).cast("double").alias("__worth"))
    decided = own.unionByName(best.select(*by, "feature", F.col("neighbour").alias("__to"), sim_fn(F.col("sim")).cast("double").alias("__worth"), F.lit(True).alias("__other")), True)
    on = [*by, "feature"]
    if rules[False, False] == KEEP:  # also what has no name
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) for c in on]
        rows = dtm.alias("r").join(decided.alias("d"), same).select(*[f"r.{c}" for c in keep], "__to", "__worth", "__other")
    else:
        rows = dtm.join(decided, on)
    worth = F.when(F.col("__other"), F.col("weight") * F.col("__worth")).otherwise(F.col("weight"))
    rows = rows.select(*[c for c in keep if c not in ("feature", "weight")], F.col("__to").alias("feature"), worth.alias("weight"))
    return merge_duplicates(rows, by)


def handle_random(
    occurrences: DataFrame,
    vocab: DataFrame,
    k: int,
    seed: int = 0,
    model: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Replace every occurrence of a known feature by its own draw of k vocabulary entries."""
    known = occurrences
    if model is not None:
        known = occurrences.join(model.select("feature").distinct(), "feature", "left_semi")
    keep = [c for c in occurrences.columns if c not in ("feature", "weight")]
    # counted rows become one row per occurrence again: draws are per lookup
    each = known.repartition("doc_id").withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    vocab = materialize(vocab, "vocab")
    indexed = materialize(index_vocab(vocab, by), "indexed")
    drawn = nb.count_random_neighbours(each, indexed, k, seed, ["doc_id", "feature", "__nth"], keep, by)
    once = vocab.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    # entries of one name are several draws of it; with different names the counts are already whole
    return drawn if once else merge_duplicates(drawn, by)


def handle_marked_random(
    marked: DataFrame, vocab: DataFrame, handler: str | dict[tuple[bool, bool], str], k: int, seed: int = 0, by: Sequence[str] = ()
) -> DataFrame:
    """As ``apply_handler`` with a random source, which has every entry; ``marked`` carries ``iv``."""
    rules = HANDLERS[handler] if isinstance(handler, str) else handler
    keep = [c for c in marked.columns if c not in ("iv", "it")]
    action = F.when(F.col("iv"), F.lit(rules[True, True])).otherwise(F.lit(rules[False, True]))
    kept = marked.where(action == KEEP).select(*keep)
    drawn = handle_random(marked.where(action == EXPAND).select(*keep), vocab, k, seed, None, by)
    return merge_duplicates(kept.unionByName(drawn.select(*keep)), by)


def transform_test(
    dtm: DataFrame,
    vocab: DataFrame,
    handler: str | dict[tuple[bool, bool], str] = "base",
    neighbours: DataFrame | None = None,
    model: DataFrame | None = None,
    k: int = 3,
    sim_fn: Callable[[Column], Column] = unit,
    by: Sequence[str] = (),
    seed: int = 0,
    check: bool = True,
) -> DataFrame:
    """Vectorize unseen documents against a fixed vocabulary."""
    if check and vocab.isEmpty():
        raise ValueError("the vocabulary was not fitted or is empty")
    if handler == "signified_random":
        return handle_random(dtm, vocab, k, seed, model, by)
    return apply_handler(dtm, vocab, handler, neighbours, model, k, sim_fn, by)


def cluster_vectorize(
    features: DataFrame, clusters: DataFrame, train_vocab: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Each occurrence counts once for the cluster of its feature; other features are dropped."""
    extra = [c for c in ("label",) if c in features.columns]
    amount = F.col("weight") if "weight" in features.columns else F.lit(1.0)
    named = clusters.select("feature", F.concat(F.lit("cluster"), F.col("cluster").cast("string")).alias("__cluster"))
    out = (
        features.join(named, "feature")
        .groupBy(*by, "doc_id", *extra, F.col("__cluster").alias("feature"))
        .agg(F.sum(amount).alias("weight"))
    )
    if train_vocab is not None:
        out = out.join(train_vocab.select(*by, "feature"), [*by, "feature"], "left_semi")
    return out
