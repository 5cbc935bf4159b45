"""Vector tables and nearest neighbours.

Sparse vectors ``(feature, ctx, weight)``, dense vectors ``(feature, embedding)``,
neighbours ``(feature, neighbour, sim)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordfold.functions import grammar as g
from wordfold.functions.draws import draw, share
from wordfold.operators.ranking import ROWS_PER_RANGE, global_rank, ranked_heads
from wordfold.operators.search import nearest
from wordfold.storage import materialize

CANDIDATES_PER_NEIGHBOUR = 8  # fixed value: spare candidates so that overlap filtering still leaves k


def knn_cosine(
    vectors: DataFrame,
    k: int,
    vocab: DataFrame | None = None,
    queries: DataFrame | None = None,
    include_self: bool = False,
    candidates: int = CANDIDATES_PER_NEIGHBOUR,
    by: Sequence[str] = (),
    rows_per_block: int | None = None,
    trace: list[DataFrame] | None = None,
) -> DataFrame:
    """The ``candidates * k`` nearest vocabulary entries of every query entry, exactly.

    With ``by`` the vocabulary and the queries are those of each fold; a pair of entries is compared once for all of them.
    """
    value = [F.col("embedding").alias("vec")] if "embedding" in vectors.columns else ["ctx", "weight"]
    rows = vectors.select(F.col("feature").alias("name"), *value)
    members = lambda entries: None if entries is None else entries.select(*by, F.col("feature").alias("name"))
    found = nearest(
        rows, rows, k * candidates, "cosine", by, not include_self, members(queries), members(vocab), rows_per_block, trace
    )
    return found.select(
        *by, F.col("query").alias("feature"), F.col("item").alias("neighbour"), F.col("score").alias("sim")
    )


def with_distance(neighbours: DataFrame) -> DataFrame:
    return neighbours.withColumn("dist", 1 - F.col("sim"))


def sim_threshold(neighbours: DataFrame, threshold: float) -> DataFrame:
    return neighbours.where(F.col("sim") >= threshold)


def max_neighbours(neighbours: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    return ranked_heads(neighbours, [F.desc("sim"), F.asc("neighbour")], n, [*by, "feature"], "__rank").drop("__rank")


def include_self(neighbours: DataFrame, include: bool) -> DataFrame:
    """Drop self rows, or make sure every entry is its own first neighbour with similarity 1."""
    others = neighbours.where(F.col("feature") != F.col("neighbour"))
    if not include:
        return others
    keys = [c for c in neighbours.columns if c not in ("neighbour", "sim")]
    own = neighbours.select(*keys).distinct().select("*", F.col("feature").alias("neighbour"), F.lit(1.0).alias("sim"))
    return others.unionByName(own)


def drop_lexical_overlap(neighbours: DataFrame, separator: str = g.SEPARATOR) -> DataFrame:
    """``daily/J_pais/N`` may have neither ``daily/J`` nor ``pais/N`` as its neighbour."""
    return neighbours.where(~g.shares_token(F.col("feature"), F.col("neighbour"), separator))


def neighbour_strategy(neighbours: DataFrame, n: int, strategy: str = "linear", by: Sequence[str] = ()) -> DataFrame:
    """``linear``: the n most similar.  ``skipping``: the next neighbour is the best
    not yet visited neighbour of the last one.  Adds ``rank``, counted from 0.
    """
    keys = [*by, "feature"]
    if strategy == "linear":
        return ranked_heads(neighbours, [F.desc("sim"), F.asc("neighbour")], n, keys)
    if strategy != "skipping":
        raise ValueError(f"unknown neighbour strategy {strategy}")
    # n steps visit at most n + 1 entries, so n + 1 neighbours per entry always hold an unvisited one
    near = max_neighbours(neighbours, n + 1, by).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("o"), "neighbour", "sim"))).alias("near")
    )
    step = near.select(*by, F.col("feature").alias("at"), "near")
    path = near.select(
        *keys, F.array("feature").alias("visited"), F.col("feature").alias("at"), F.array().cast("array<struct<rank:int,neighbour:string,sim:double>>").alias("path")
    )
    for i in range(n):
        unvisited = F.get(F.filter("near", lambda c: ~F.array_contains(F.col("visited"), c["neighbour"])), F.lit(0))
        path = (
            path.join(step, [*by, "at"], "left")
            .withColumn("__next", unvisited)
            .select(
                *keys,
                F.when(F.col("__next").isNull(), F.col("visited")).otherwise(F.array_append("visited", F.col("__next.neighbour"))).alias("visited"),
                F.col("__next.neighbour").alias("at"),
                F.when(F.col("__next").isNull(), F.col("path"))
                .otherwise(
                    F.array_append(
                        "path",
                        F.struct(F.lit(i).alias("rank"), F.col("__next.neighbour").alias("neighbour"), F.col("__next.sim").alias("sim")),
                    )
                )
                .alias("path"),
            )
        )
    return path.select(*keys, F.inline("path"))


def add_noise(vectors: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """Add to every non-zero entry a seeded share of at most p of the vector's mean non-zero entry."""
    if p == 0:
        return vectors
    if "embedding" in vectors.columns:
        nonzero = F.filter("embedding", lambda x: x != 0)
        mean = F.aggregate(nonzero, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(nonzero), F.lit(0))
        return vectors.withColumn("__mean", mean).withColumn(
            "embedding",
            F.transform(
                "embedding",
                lambda x, i: F.when(x != 0, x + F.col("__mean") * p * share(seed, "feature", i)).otherwise(x),
            ),
        ).drop("__mean")
    means = vectors.where(F.col("weight") != 0).groupBy("feature").agg(F.avg("weight").alias("__mean"))
    return (
        vectors.join(means, "feature", "left")
        .withColumn(
            "weight",
            F.when(F.col("weight") != 0, F.col("weight") + F.col("__mean") * p * share(seed, "feature", "ctx")).otherwise(F.col("weight")),
        )
        .drop("__mean")
        .select(*vectors.columns)
    )


def restrict_entries(vectors: DataFrame, entries: DataFrame) -> DataFrame:
    return vectors.join(entries.select("feature"), "feature", "left_semi")


def contains(features: DataFrame, vectors: DataFrame) -> DataFrame:
    """The given features that have a row in any of the sources."""
    return features.join(vector_entries(vectors), "feature", "left_semi")


def vector_entries(vectors: DataFrame) -> DataFrame:
    return vectors.select("feature").distinct()


def get_vector(vectors: DataFrame, features: DataFrame) -> DataFrame:
    """Whole vectors of the given features ``(feature, at, ctx, weight)``; unknown features give no row.

    ``at`` counts the entries of a vector in context order from 0.  An entry is a row, so a vector may have any length.
    """
    asked = materialize(vectors.join(features.select("feature"), "feature", "left_semi"), "asked")
    placed = global_rank(asked, F.col("ctx"), ["feature"], name="at", total="__size")
    return placed.select("feature", "at", "ctx", "weight")


def random_neighbours(
    lookups: DataFrame, indexed_vocab: DataFrame, k: int, seed: int, key: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """k different vocabulary entries per lookup, similarity 1.

    A hashed start and a stride short enough not to wrap give k distinct column numbers,
    fetched by an equi-join; the same seed draws the same entries on any cluster.
    """
    drawn = _draws(lookups, indexed_vocab, k, seed, key, by)
    names = indexed_vocab.select(*by, "idx", F.col("feature").alias("neighbour"))
    return drawn.join(names, [*by, "idx"]).drop("idx", "__step", "__size").withColumn("sim", F.lit(1.0))


def _draws(lookups: DataFrame, indexed_vocab: DataFrame, k: int, seed: int, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The lookups with the column number ``idx`` of each draw."""
    sizes = indexed_vocab.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))
    rows = lookups.join(F.broadcast(sizes), list(by)) if by else lookups.select("*", sizes.scalar().alias("__size"))
    start = F.pmod(draw(seed, F.lit("start"), *key), F.col("__size"))
    longest = F.greatest(F.lit(1), F.floor((F.col("__size") - 1) / F.lit(k)))
    stride = F.pmod(draw(seed, F.lit("stride"), *key), longest) + 1
    steps = F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("__size").cast("int")) - 1))
    drawn = rows.withColumn("__step", steps).withColumn("idx", F.pmod(start + F.col("__step") * stride, F.col("__size")))
    return drawn


#: Parts of the vocabulary of a fold, and its entries in a part at most.
NAME_PARTS, NAMES_PER_PART = 128, 1 << 16


def count_random_neighbours(
    lookups: DataFrame, indexed_vocab: DataFrame, k: int, seed: int, key: Sequence[str], count_by: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """``(count_by, feature, weight)``: how often ``random_neighbours`` draws each entry; ``count_by`` has the columns of ``by``.

    The draws of a document travel to their names as arrays, one for each part of the vocabulary, and not as rows.
    """
    drawn = _draws(lookups, indexed_vocab, k, seed, key, by)
    per = indexed_vocab.groupBy(*by).agg(F.greatest(F.ceil(F.count(F.lit(1)) / NAME_PARTS), F.lit(1)).alias("__per"))
    per = per.withColumn("__per", F.least("__per", F.lit(NAMES_PER_PART)).cast("int"))
    with_size = lambda df: df.join(F.broadcast(per), list(by)) if by else df.select("*", per.scalar().alias("__per"))
    part, place = F.floor(F.col("idx") / F.col("__per")).cast("int").alias("__part"), F.pmod("idx", "__per").cast("int").alias("__at")
    entry = F.struct(place, F.col("feature").alias("f"))
    names = with_size(indexed_vocab.select(*by, "idx", "feature")).groupBy(*by, part).agg(F.sort_array(F.collect_list(entry))["f"].alias("__names"))
    keep = list(dict.fromkeys(count_by))
    rows = with_size(drawn.select(*dict.fromkeys([*by, *keep, "idx"]))).groupBy(*dict.fromkeys([*by, *keep]), part).agg(F.collect_list(place).alias("__ats"))
    found = rows.join(names, [*by, "__part"]).select(*keep, "__part", F.transform("__ats", lambda i: F.get("__names", i)).alias("__drawn"))
    each = found.select(*keep, "__part", F.explode("__drawn").alias("feature"))
    # a name lies in one part, and the rows of a part are already together
    counts = each.groupBy(*keep, "__part", "feature").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return counts.select(*keep, "feature", "weight")


def combine_neighbours(
    sets: DataFrame, entries: DataFrame | None = None, by: Sequence[str] = (), per_source: int | None = None, k: int | None = None,
    rows_together: int | None = None,
) -> DataFrame:
    """Merge the neighbours of several vector sets ``(by, source_id, feature, neighbour, sim)``.

    Entries in fewer than two sets have no neighbours; ``entries (source_id, feature)`` says
    what each set contains where that is more than what has neighbours.  The combined weight
    is 1/(1 + mean rank).  ``sets`` is read three times: store it where it is dear.  ``per_source`` takes only the best of each set into account, ``k``
    keeps the best of the result.  Only features of more than ``rows_together`` rows are ranked in parts (``ranked_heads``)
    or, without these limits, by ranges (``global_rank``), never in one task; the others are moved once.
    """
    by = list(by)
    several = (F.min("source_id") != F.max("source_id")).alias("__several")
    trusted = (sets if entries is None else entries).groupBy("feature").agg(several).where("__several")
    if per_source is not None:
        placed = ranked_heads(sets, [F.desc("sim"), F.asc("neighbour")], per_source, [*by, "source_id", "feature"], "__rank")
        return _ranked_apart(_merged(placed, trusted, by), by, k)
    sizes = materialize(sets.groupBy("feature").agg(F.count(F.lit(1)).alias("__n"), several), "sizes")
    if entries is None:
        trusted = sizes.where("__several").select("feature")
    large = sizes.where(F.col("__n") > (rows_together or ROWS_PER_RANGE)).select("feature")
    if large.isEmpty():
        return _ranked_together(sets, trusted, by, k)
    large = F.broadcast(large)  # at most a row for each ROWS_PER_RANGE rows of the sets
    hot = sets.join(large, "feature", "left_semi")
    nearest_first = F.struct((-F.col("sim")).alias("s"), F.col("neighbour").alias("n"))
    placed = global_rank(hot, nearest_first, [*by, "source_id", "feature"], name="__rank", total="__size").drop("__size")
    rest = _ranked_together(sets.join(large, "feature", "left_anti"), trusted, by, k)
    return rest.unionByName(_ranked_apart(_merged(placed, trusted, by), by, k))


def _merged(placed: DataFrame, trusted: DataFrame, by: list[str]) -> DataFrame:
    return (
        placed.join(trusted, "feature", "left_semi")
        .groupBy(*by, "feature", "neighbour")
        .agg(
            F.count(F.lit(1)).alias("contained_in"),
            F.avg("__rank").alias("mean_rank"),
            F.avg(1 - F.col("sim")).alias("mean_dist"),
        )
    )


def _combined(merged: DataFrame, ranked: DataFrame) -> DataFrame:
    return ranked.select(*merged.columns, (1 / (1 + F.col("mean_rank"))).alias("sim"), "rank")


def _by_feature(sets: DataFrame) -> DataFrame:
    """Rows of a feature in one task: a window over features alone, which leaves rows where a source's own window has put them."""
    return sets.withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy("feature"))).where(F.col("__all") > 0).drop("__all")


def _ranked_together(sets: DataFrame, trusted: DataFrame, by: list[str], k: int | None) -> DataFrame:
    """Features whose rows fit a task: moved once, by feature, which serves both rankings and the sums between them."""
    inside = Window.partitionBy(*by, "source_id", "feature").orderBy(F.desc("sim"), F.asc("neighbour"))
    placed = _by_feature(sets).withColumn("__rank", (F.row_number().over(inside) - 1).cast("long"))
    merged = _merged(placed, trusted, by)
    order = [F.desc("contained_in"), F.round("mean_rank", 9).asc(), F.round("mean_dist", 9).asc(), F.asc("neighbour")]
    place = F.row_number().over(Window.partitionBy(*by, "feature").orderBy(*order))
    ranked = merged.withColumn("__place", place)
    if k is not None:
        ranked = ranked.where(F.col("__place") <= k)
    rank = (F.col("__place") - 1).cast("long" if k is None else "int")
    return _combined(merged, ranked.withColumn("rank", rank))


def _ranked_apart(merged: DataFrame, by: list[str], k: int | None) -> DataFrame:
    """Features of any size: ranked in parts (``ranked_heads``) or, without a limit, by ranges (``global_rank``)."""
    rank, dist = F.round("mean_rank", 9), F.round("mean_dist", 9)
    if k is None:
        best_first = F.struct((-F.col("contained_in")).alias("c"), rank.alias("r"), dist.alias("d"), F.col("neighbour").alias("n"))
        ranked = global_rank(materialize(merged, "merged"), best_first, [*by, "feature"], total="__size")
    else:
        order = [F.desc("contained_in"), rank.asc(), dist.asc(), F.asc("neighbour")]
        ranked = ranked_heads(merged, order, k, [*by, "feature"])
    return _combined(merged, ranked)
