"""Clustering and dimensionality reduction of vector tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordfold.functions import grammar as g
from wordfold.operators.neighbours import add_noise
from wordfold.storage import materialize

SVD_DIMENSIONS = 100  # fixed value


def cluster_vectors(vectors: DataFrame, k: int = 100, noise: float = 0.0, seed: int = 0, max_iter: int = 20) -> DataFrame:
    """k-means over all vectors -> ``(feature, cluster)``."""
    rows = add_noise(vectors, noise, seed).select(
        "feature", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows).select("feature", "cluster")


def assign_clusters(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Nearest given centroid ``(cluster, centroid)`` of every vector; ties to the smaller cluster.

    All centroids travel as one array value: their number is a parameter, not data.
    """
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("__c"))
    rows = vectors.select("*", packed.scalar().alias("__c"))
    distance = lambda c: F.aggregate(
        F.zip_with(F.col("embedding").cast("array<double>"), c["centroid"], lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    best = F.array_min(F.transform("__c", lambda c: F.struct(F.round(distance(c), 9).alias("d"), c["cluster"].alias("cluster"))))
    return rows.select("feature", best["cluster"].alias("cluster"))


def mean_centroids(vectors: DataFrame, group: str = "cluster") -> DataFrame:
    """Component-wise mean vector per group -> ``(group, centroid)``."""
    means = (
        vectors.select(group, F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
        .groupBy(group, "i")
        .agg(F.avg("x").alias("x"))
    )
    return means.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid")
    )


def only_unigrams(vectors: DataFrame, separator: str = g.SEPARATOR, require_pos: bool = True) -> DataFrame:
    return vectors.where(g.feature_type(F.col("feature"), separator, require_pos) == g.UNIGRAM)


def align_columns(vectors: DataFrame, columns: DataFrame) -> DataFrame:
    """Drop contexts that the reference column set lacks."""
    return vectors.join(columns.select("ctx"), "ctx", "left_semi").select(*vectors.columns)


def _scaled(column: str, weight: str) -> Column:
    return array_to_vector(F.transform(column, lambda x: x * F.col(weight)))


def _apply(vectors: DataFrame, basis: DataFrame, source: str, target: str) -> DataFrame:
    """Sparse matrix times a tall basis ``(source, v)`` -> ``(target, v)``.

    One join on the source side of the entries and one sum of arrays per target, combined
    map-side.  Neither the matrix nor the basis ever leaves the executors.
    """
    rows = vectors.join(basis, source)
    return rows.groupBy(target).agg(vector_to_array(Summarizer.sum(_scaled("v", "weight"))).alias("v"))


def _gram(basis: DataFrame, r: int) -> np.ndarray:
    """Inner products of the r columns of a basis: r x r numbers are all that reaches the driver."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((r, r))
        for batch in batches:
            if len(batch):
                block = np.stack(batch["v"].to_numpy())
                total += block.T @ block
        yield pd.DataFrame({"i": np.arange(r), "row": list(total)})

    rows = (
        basis.select("v")
        .mapInPandas(partial, "i int, row array<double>")
        .groupBy("i")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
        .collect()
    )
    out = np.zeros((r, r))
    for row in rows:
        out[row["i"]] = row["row"]
    return (out + out.T) / 2


def _rotate(basis: DataFrame, key: str, rotation: np.ndarray) -> DataFrame:
    """Multiply every row of a basis by a small matrix."""
    schema = f"`{key}` {basis.schema[key].dataType.simpleString()}, v array<double>"

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({key: batch[key], "v": list(np.stack(batch["v"].to_numpy()) @ rotation)})

    return basis.select(key, "v").mapInPandas(multiply, schema)


def _orthonormal(basis: DataFrame, key: str, r: int) -> tuple[DataFrame, int]:
    """The same column space with orthonormal columns; directions without weight are dropped."""
    basis = materialize(basis, "svd-basis")
    for _ in range(2):  # the second pass removes what rounding left over
        values, vectors = np.linalg.eigh(_gram(basis, r))
        keep = values > max(values.max(), 0.0) * 1e-12
        if not keep.any():
            raise ValueError("the matrix has no non-zero entry")
        rotation = vectors[:, keep] / np.sqrt(values[keep])
        basis, r = materialize(_rotate(basis, key, rotation), "svd-basis"), int(keep.sum())
    return basis, r


def svd_fit(
    vectors: DataFrame, d: int = SVD_DIMENSIONS, oversample: int = 10, iterations: int = 5, seed: int = 0
) -> DataFrame:
    """Uncentred truncated SVD of sparse row vectors by randomised subspace iteration.

    Returns ``(ctx, v, sigma)``: row ``ctx`` of the right singular vectors and the singular
    values, largest first.  The sign of each direction makes its largest component positive.
    """
    r = d + oversample
    vectors = vectors.select("feature", "ctx", "weight").persist()
    try:
        start = F.transform(
            F.sequence(F.lit(1), F.lit(r)),
            lambda i: F.pmod(F.xxhash64("ctx", i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 29) - 1.0,
        )
        basis = vectors.select("ctx").distinct().withColumn("v", start)
        basis, r = _orthonormal(basis, "ctx", r)
        for _ in range(iterations):
            left, r = _orthonormal(_apply(vectors, basis, "ctx", "feature"), "feature", r)
            basis, r = _orthonormal(_apply(vectors, left, "feature", "ctx"), "ctx", r)
        image = materialize(_apply(vectors, basis, "ctx", "feature"), "svd-image")
        values, rotation = np.linalg.eigh(_gram(image, r))
    finally:
        vectors.unpersist()
    order = np.argsort(-values)[: min(d, r)]
    sigma = np.sqrt(np.maximum(values[order], 0.0))
    out = _rotate(basis, "ctx", rotation[:, order])
    width = len(order)
    # one row: per direction the value of largest magnitude
    peaks = out.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.max_by("x", F.struct(F.abs("x"), "x")).alias("x"))
    signs = peaks.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: F.signum(p["x"])).alias("s"))
    return out.select("ctx", "v", signs.scalar().alias("s")).select(
        "ctx",
        F.zip_with("v", "s", lambda x, s: x * s).alias("v"),
        F.lit([float(x) for x in sigma[:width]]).alias("sigma"),
    )


def long_loadings(fit: DataFrame) -> DataFrame:
    """``(ctx, dim, loading)`` from the result of ``svd_fit``."""
    return fit.select("ctx", F.posexplode("v").alias("dim", "loading"))


def svd_project(vectors: DataFrame, loadings: DataFrame) -> DataFrame:
    """Rows in the reduced space -> ``(feature, dim, value)``.

    ``loadings`` is ``(ctx, dim, loading)``; contexts without a loading are ignored.
    """
    return (
        vectors.join(loadings, "ctx")
        .groupBy("feature", "dim")
        .agg(F.sum(F.col("weight") * F.col("loading")).alias("value"))
    )


def pack_reduced(projected: DataFrame) -> DataFrame:
    """``(feature, embedding)`` with one position per dimension."""
    return projected.groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda e: e["value"]).alias("embedding")
    )


def dimension_name(dim: int) -> str:
    return f"SVD:feat{dim:03d}"
