"""Vector tables, neighbours, clusters and reduction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wordfold.catalog import inputs as i
from wordfold.catalog.matrices import THESAURUS, dtm, thesaurus
from wordfold.catalog.registry import query, with_ctes
from wordfold.functions.draws import draw_sql, share_sql
from wordfold.operators import neighbours as nb, reduce as rd, vectorize as vz
from wordfold.storage import materialize

MIN_DF = 20  # all words are looked up among vocabulary entries of this document frequency


def _sim(df, *extra):
    return df.select("feature", "neighbour", F.round("sim", 6).alias("sim"), *extra)


@query(
    "knn_cosine",
    with_ctes(
        i.DENSE,
        "pairs AS (SELECT a.feature, b.feature AS neighbour, round(list_cosine_similarity(a.embedding, b.embedding), 9) AS sim "
        "FROM dense a JOIN dense b ON a.feature <> b.feature)",
        select="""SELECT feature, neighbour, round(sim, 6) AS sim FROM pairs
QUALIFY row_number() OVER (PARTITION BY feature ORDER BY sim DESC, neighbour) <= 16""",
    ),
)
def knn_cosine(spark, d):
    return _sim(nb.knn_cosine(i.dense_vectors(spark, d).drop("cluster"), 2))


_SPARSE = f"""{i.VECTORS},
dtm AS (SELECT doc_id, w AS feature, count(*) AS weight FROM word_places GROUP BY ALL),
terms AS (SELECT feature FROM dtm GROUP BY feature HAVING count(*) >= {MIN_DF}),
own AS (SELECT v.* FROM vectors v JOIN terms t ON v.feature = t.feature),
norms AS (SELECT feature, sqrt(sum(weight * weight)) AS norm FROM vectors GROUP BY feature),
dots AS (SELECT a.feature, b.feature AS neighbour, sum(a.weight * b.weight) AS dot
  FROM vectors a JOIN own b ON a.ctx = b.ctx AND a.feature <> b.feature GROUP BY ALL),
sims AS (SELECT d.feature, d.neighbour, round(dot / sqrt((x.norm * x.norm) * (y.norm * y.norm)), 9) AS sim
  FROM dots d JOIN norms x ON d.feature = x.feature JOIN norms y ON d.neighbour = y.feature)"""


def sparse_neighbours(spark, d, k: int = 1):
    vocab = vz.limit_df(vz.build_vocab(dtm(spark, d)), MIN_DF)
    return nb.knn_cosine(i.context_vectors(spark, d), k, vocab)


@query(
    "knn_cosine_sparse",
    with_ctes(
        _SPARSE,
        select="""SELECT feature, neighbour, floor((round(sim * 1e9)::BIGINT + 500) / 1000) / 1e6 AS sim FROM sims
QUALIFY row_number() OVER (PARTITION BY feature ORDER BY sim DESC, neighbour) <= 8""",
    ),
)
def knn_cosine_sparse(spark, d):
    # from nine digits to six in whole numbers, since some of so many similarities lie between two of six digits
    found = sparse_neighbours(spark, d)
    digits = F.round(F.col("sim") * 1e9).cast("bigint")
    return found.select("feature", "neighbour", (F.floor((digits + 500) / 1000) / 1e6).alias("sim"))


@query("sim_threshold", with_ctes(THESAURUS, select="SELECT feature, neighbour, round(sim, 6) AS sim FROM thesaurus WHERE sim >= 0.3"))
def sim_threshold(spark, d):
    return _sim(nb.sim_threshold(thesaurus(spark, d), 0.3))


@query(
    "max_neighbours",
    with_ctes(
        THESAURUS,
        select="""SELECT feature, neighbour, round(sim, 6) AS sim FROM thesaurus
QUALIFY row_number() OVER (PARTITION BY feature ORDER BY sim DESC, neighbour) <= 2""",
    ),
)
def max_neighbours(spark, d):
    return _sim(nb.max_neighbours(thesaurus(spark, d), 2))


@query(
    "include_self",
    with_ctes(
        THESAURUS,
        "others AS (SELECT * FROM thesaurus WHERE feature <> neighbour)",
        "both_kinds AS (SELECT * FROM others UNION ALL SELECT DISTINCT feature, feature, 1.0 FROM thesaurus)",
        select="SELECT feature, count(*) AS n, round(sum(sim), 6) AS sim, bool_or(feature = neighbour) AS own FROM both_kinds GROUP BY feature",
    ),
)
def include_self(spark, d):
    rows = nb.include_self(thesaurus(spark, d), True)
    return rows.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("sim"), 6).alias("sim"),
        F.bool_or(F.col("feature") == F.col("neighbour")).alias("own"),
    )


_OVERLAP = f"""{i.WORD_LISTS},
word_places AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM word_lists),
runs AS (SELECT w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word_places WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
near AS (SELECT w || '_' || w2 AS feature, w2 || '_' || w3 AS neighbour, 1.0::DOUBLE AS sim FROM runs WHERE w3 IS NOT NULL
  UNION ALL SELECT w || '_' || w2, w3, 0.5::DOUBLE FROM runs WHERE w3 IS NOT NULL)"""


@query(
    "drop_lexical_overlap",
    with_ctes(
        _OVERLAP,
        "parts AS (SELECT *, string_split(feature, '_') AS a, string_split(neighbour, '_') AS b FROM near)",
        select="SELECT neighbour, count(*) AS n, sum(sim) AS sim FROM parts WHERE NOT list_has_any(a, b) GROUP BY ALL",
    ),
)
def drop_lexical_overlap(spark, d):
    docs = i.documents(spark, d).select(i.word_array().alias("ws"))
    three = F.transform(
        F.when(F.size("ws") > 2, F.sequence(F.lit(0), F.size("ws") - 3)).otherwise(F.array().cast("array<int>")),
        lambda at: F.struct(F.get("ws", at).alias("w"), F.get("ws", at + 1).alias("w2"), F.get("ws", at + 2).alias("w3")),
    )
    runs = docs.select(F.inline_outer(three)).where("w is not null")
    near = runs.select(
        F.concat_ws("_", "w", "w2").alias("feature"),
        F.inline(F.array(
            F.struct(F.concat_ws("_", "w2", "w3").alias("neighbour"), F.lit(1.0).alias("sim")),
            F.struct(F.col("w3").alias("neighbour"), F.lit(0.5).alias("sim")),
        )),
    )
    return nb.drop_lexical_overlap(near).groupBy("neighbour").agg(F.count(F.lit(1)).alias("n"), F.sum("sim").alias("sim"))


@query(
    "neighbour_strategy",
    with_ctes(
        THESAURUS,
        "s1 AS (SELECT feature, neighbour AS n1, sim AS m1 FROM thesaurus WHERE neighbour <> feature "
        "QUALIFY row_number() OVER (PARTITION BY feature ORDER BY sim DESC, neighbour) = 1)",
        "s2 AS (SELECT s.feature, n1, t.neighbour AS n2, t.sim AS m2 FROM s1 s JOIN thesaurus t ON t.feature = s.n1 "
        "WHERE t.neighbour NOT IN (s.feature, n1) QUALIFY row_number() OVER (PARTITION BY s.feature ORDER BY t.sim DESC, t.neighbour) = 1)",
        "s3 AS (SELECT s.feature, t.neighbour AS n3, t.sim AS m3 FROM s2 s JOIN thesaurus t ON t.feature = s.n2 "
        "WHERE t.neighbour NOT IN (s.feature, n1, n2) QUALIFY row_number() OVER (PARTITION BY s.feature ORDER BY t.sim DESC, t.neighbour) = 1)",
        select="""SELECT feature, 0 AS rank, n1 AS neighbour, round(m1, 6) AS sim FROM s1
UNION ALL SELECT feature, 1, n2, round(m2, 6) FROM s2 UNION ALL SELECT feature, 2, n3, round(m3, 6) FROM s3""",
    ),
)
def neighbour_strategy(spark, d):
    return _sim(nb.neighbour_strategy(thesaurus(spark, d), 3, "skipping"), "rank")


@query(
    "neighbour_strategy_linear",
    with_ctes(
        THESAURUS,
        select="""SELECT feature, neighbour, round(sim, 6) AS sim, row_number() OVER (PARTITION BY feature ORDER BY sim DESC, neighbour) - 1 AS rank
FROM thesaurus QUALIFY rank < 3""",
    ),
)
def neighbour_strategy_linear(spark, d):
    return _sim(nb.neighbour_strategy(thesaurus(spark, d), 3, "linear"), "rank")


NOISE, NOISE_SEED = 0.1, 7


@query(
    "add_noise",
    with_ctes(
        i.DENSE,
        "cells AS (SELECT feature, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place FROM dense)",
        "means AS (SELECT feature, avg(x) FILTER (x <> 0) AS mean FROM cells GROUP BY feature)",
        select=f"""SELECT feature, place, round(CASE WHEN x <> 0 THEN x + mean * {NOISE} * {share_sql(NOISE_SEED, 'feature', 'place')} ELSE x END, 6) AS x
FROM cells JOIN means USING (feature)""",
    ),
)
def add_noise(spark, d):
    noisy = nb.add_noise(i.dense_vectors(spark, d).drop("cluster"), NOISE, NOISE_SEED)
    return noisy.select("feature", F.posexplode("embedding").alias("place", "x")).withColumn("x", F.round("x", 6))


@query(
    "add_noise_sparse",
    with_ctes(
        i.VECTORS,
        "means AS (SELECT feature, avg(weight) AS mean FROM vectors GROUP BY feature)",
        select=f"""SELECT feature, ctx, round(weight + mean * {NOISE} * {share_sql(NOISE_SEED, 'feature', 'ctx')}, 6) AS weight
FROM vectors JOIN means USING (feature)""",
    ),
)
def add_noise_sparse(spark, d):
    vectors = materialize(i.context_vectors(spark, d), "contexts")
    return nb.add_noise(vectors, NOISE, NOISE_SEED).withColumn("weight", F.round("weight", 6))


_RESTRICT = f"""{i.VECTORS},
listed AS (SELECT feature FROM (SELECT doc_id, w AS feature FROM word_places GROUP BY ALL) GROUP BY feature HAVING count(*) >= 5)"""


@query(
    "restrict_entries",
    with_ctes(_RESTRICT, select="SELECT feature, count(*) AS contexts, sum(weight) AS weight FROM vectors WHERE feature IN (FROM listed) GROUP BY ALL"),
)
def restrict_entries(spark, d):
    listed = vz.limit_df(vz.build_vocab(dtm(spark, d)), 5)
    kept = nb.restrict_entries(i.context_vectors(spark, d), listed)
    return kept.groupBy("feature").agg(F.count(F.lit(1)).alias("contexts"), F.sum("weight").alias("weight"))


_START, _STRIDE = draw_sql(11, "'start'", "feature"), draw_sql(11, "'stride'", "feature")


@query(
    "random_neighbours",
    with_ctes(
        i.DTM,
        "indexed AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM (SELECT DISTINCT feature FROM dtm))",
        "size AS (SELECT count(*) AS n FROM indexed)",
        f"starts AS (SELECT feature, n, {_START} % n AS first, {_STRIDE} % greatest(1, (n - 1) // 3) + 1 AS stride FROM indexed, size)",
        "drawn AS (SELECT feature, (first + step * stride) % n AS idx FROM starts, range(3) r(step) WHERE step < n)",
        select="SELECT d.feature, i.feature AS neighbour, 1.0::DOUBLE AS sim FROM drawn d JOIN indexed i USING (idx)",
    ),
)
def random_neighbours(spark, d):
    vocab = vz.index_vocab(materialize(vz.build_vocab(dtm(spark, d)), "vocab"))
    indexed = materialize(vocab, "indexed")
    return nb.random_neighbours(indexed.select("feature"), indexed, 3, 11, ["feature"])


_RIGHT_LEFT = f"""{THESAURUS},
back AS (SELECT w2 AS feature, w AS neighbour, count(*) AS n FROM word_pairs WHERE w2 IS NOT NULL GROUP BY ALL),
sets AS (
  SELECT 0 AS source_id, feature, neighbour, sim FROM thesaurus
  UNION ALL SELECT 1, feature, neighbour, n / sum(n) OVER (PARTITION BY feature) FROM back)"""


def two_sets(spark, d):
    pairs = materialize(i.followers(spark, d), "followers")
    # each pair seen from its left and from its right word
    word = F.substring("ctx", 3, 1 << 20)
    side = lambda n, f, x: F.struct(F.lit(n).alias("source_id"), f.alias("feature"), x.alias("neighbour"))
    rows = pairs.select(F.inline(F.array(side(0, F.col("feature"), word), side(1, word, F.col("feature")))), "weight")
    of = lambda n: F.sum(F.when(F.col("source_id") == n, F.col("weight"))).over(Window.partitionBy("feature"))
    # as two calls of `thesaurus` would give them, but moved once for both sides
    sim = F.col("weight") / F.when(F.col("source_id") == 0, of(0)).otherwise(of(1))
    return rows.select("feature", "neighbour", sim.alias("sim"), "source_id")


def _combined(per_source: str, k: str) -> str:
    return with_ctes(
        _RIGHT_LEFT,
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id, feature ORDER BY sim DESC, neighbour) - 1 AS r FROM sets{per_source})",
        "several AS (SELECT feature FROM sets GROUP BY feature HAVING count(DISTINCT source_id) > 1)",
        "merged AS (SELECT feature, neighbour, count(*) AS contained_in, avg(r) AS mean_rank, avg(1 - sim) AS mean_dist "
        "FROM ranked WHERE feature IN (FROM several) GROUP BY ALL)",
        select=f"""SELECT feature, neighbour, contained_in, round(1 / (1 + mean_rank), 6) AS sim,
  row_number() OVER (PARTITION BY feature ORDER BY contained_in DESC, round(mean_rank, 9), round(mean_dist, 9), neighbour) - 1 AS rank
FROM merged{k}""",
    )


@query("combine_neighbours", _combined("", " QUALIFY rank < 3"))
def combine_neighbours(spark, d):
    return _sim(nb.combine_neighbours(two_sets(spark, d), k=3), "contained_in", "rank")


@query("combine_neighbours_all", _combined("", ""))
def combine_neighbours_all(spark, d):
    return _sim(nb.combine_neighbours(two_sets(spark, d)), "contained_in", "rank")


@query("combine_neighbours_limited", _combined(" QUALIFY r < 5", " QUALIFY rank < 3"))
def combine_neighbours_limited(spark, d):
    return _sim(nb.combine_neighbours(materialize(two_sets(spark, d), "sets"), per_source=5, k=3), "contained_in", "rank")


@query(
    "contains",
    with_ctes(
        _RIGHT_LEFT,
        f"{i.QDOCS}",
        select="""SELECT DISTINCT feature FROM (SELECT unnest(ws) AS feature FROM word_lists WHERE doc_id IN (SELECT doc_id FROM qdocs))
WHERE feature IN (SELECT feature FROM sets)""",
    ),
)
def contains(spark, d):
    asked = i.words(spark, d).join(i.quality_docs(spark, d).select("doc_id"), "doc_id", "left_semi").select("feature").distinct()
    return nb.contains(asked, two_sets(spark, d))


_ASKED = ", ".join(f"'{w}'" for w in (*i.STOPWORDS, "qqqqq"))


@query(
    "get_vector",
    with_ctes(
        i.VECTORS,
        select=f"""SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY ctx) - 1 AS at, ctx, weight
FROM vectors WHERE feature IN ({_ASKED})""",
    ),
)
def get_vector(spark, d):
    vectors = i.context_vectors(spark, d)
    asked = spark.createDataFrame([(w,) for w in sorted({*i.STOPWORDS, "qqqqq"})], "feature string")
    return nb.get_vector(vectors, asked)


# ---------------------------------------------------------------- clusters and reduction


@query("cluster_vectors")
def cluster_vectors(spark, d):
    vectors = i.dense_vectors(spark, d).drop("cluster")
    return rd.cluster_vectors(vectors, 10, seed=0)


@query(
    "assign_clusters",
    with_ctes(
        i.DENSE,
        "cells AS (SELECT feature, cluster, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM dense)",
        "means AS (SELECT cluster, place, avg(x) AS x FROM cells GROUP BY ALL)",
        "dist AS (SELECT c.feature, m.cluster, round(sum((c.x - m.x) * (c.x - m.x)), 9) AS dist FROM cells c JOIN means m ON c.place = m.place GROUP BY ALL)",
        select="SELECT feature, cluster FROM dist QUALIFY row_number() OVER (PARTITION BY feature ORDER BY dist, cluster) = 1",
    ),
)
def assign_clusters(spark, d):
    vectors = i.dense_vectors(spark, d)
    return rd.assign_clusters(vectors, rd.mean_centroids(vectors))


def dense_as_sparse(spark, d):
    """The embeddings as entries ``(feature, ctx, weight)``, one context per position."""
    cells = i.dense_vectors(spark, d).select("feature", F.posexplode("embedding").alias("at", "x"))
    return cells.select("feature", F.format_string("c%02d", "at").alias("ctx"), F.col("x").cast("double").alias("weight"))


@query("svd_fit")
def svd_fit(spark, d):
    fit = rd.svd_fit(dense_as_sparse(spark, d), 8, iterations=3)
    return fit.select("ctx", F.posexplode("v").alias("dim", "loading"))


@query(
    "svd_project",
    with_ctes(
        i.DENSE,
        "cells AS (SELECT feature, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM dense)",
        "means AS (SELECT cluster, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM dense)",
        "loadings AS (SELECT place, cluster AS dim, avg(x) AS loading FROM means GROUP BY ALL)",
        select="SELECT feature, dim, round(sum(x * loading), 6) AS value FROM cells c JOIN loadings l ON c.place = l.place GROUP BY ALL",
    ),
)
def svd_project(spark, d):
    # a given projection: the mean vector of each label as a direction
    means = rd.mean_centroids(i.dense_vectors(spark, d)).select(F.col("cluster").alias("dim"), F.posexplode("centroid").alias("at", "loading"))
    loadings = means.select(F.format_string("c%02d", "at").alias("ctx"), "dim", "loading")
    return rd.svd_project(dense_as_sparse(spark, d), loadings).select("feature", "dim", F.round("value", 6).alias("value"))


@query(
    "align_columns",
    with_ctes(
        i.VECTORS,
        f"{i.QDOCS}",
        "known AS (SELECT DISTINCT 'r:' || w AS ctx FROM word_places WHERE doc_id IN (SELECT doc_id FROM qdocs))",
        select="SELECT feature, count(*) AS contexts, sum(weight) AS weight FROM vectors WHERE ctx IN (FROM known) GROUP BY ALL",
    ),
)
def align_columns(spark, d):
    labelled = i.words(spark, d).join(i.quality_docs(spark, d).select("doc_id"), "doc_id", "left_semi")
    columns = labelled.select(F.concat(F.lit("r:"), "feature").alias("ctx")).distinct()
    kept = rd.align_columns(i.context_vectors(spark, d), columns)
    return kept.groupBy("feature").agg(F.count(F.lit(1)).alias("contexts"), F.sum("weight").alias("weight"))
