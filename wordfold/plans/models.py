"""Preparing distributional models: clusters, and one reduced space for words and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wordfold.operators import reduce as rd
from wordfold.sources import sinks


def build_clusters(vectors: DataFrame, output: str, k: int = 100, noise: float = 0.0, seed: int = 0) -> None:
    rd.cluster_vectors(vectors, k, noise, seed).sortWithinPartitions("feature").write.parquet(output)


def merge_vectors(
    unigrams: DataFrame, composed: DataFrame, output: str | None = None, d: int = rd.SVD_DIMENSIONS, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Reduce unigram vectors and project composed phrases into the same space.

    Only unigram entries shape the space; contexts they do not have are dropped from phrases.
    """
    unigrams = rd.only_unigrams(unigrams)
    loadings = rd.long_loadings(rd.svd_fit(unigrams, d, seed=seed))
    words = rd.pack_reduced(rd.svd_project(unigrams, loadings))
    phrases = rd.pack_reduced(rd.svd_project(rd.align_columns(composed, loadings.select("ctx").distinct()), loadings))
    if output:
        root = output.rstrip("/")
        sinks.write_reduced_vectors(words, f"{root}-unigrams-SVD{d}")
        sinks.write_reduced_vectors(phrases, f"{root}-phrases-SVD{d}")
    return words, phrases
