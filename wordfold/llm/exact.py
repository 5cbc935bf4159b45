"""Exact duplicates by two passes of a Bloom filter.

The first pass records which filter slots are hit twice; a text whose slots were not is unique, and its row passes straight
through the second pass.  Only the possibly repeated rest is shuffled and grouped by digest, with map-side combining, so a
group of any size costs one row per task.

Texts are equal if identical after lower-casing A-Z; null counts as empty.  The row with the largest id stays (a null id is
smaller than any other); of rows that also share the id, one.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordfold.llm import bloom, rows
from wordfold.storage import materialize


@F.arrow_udf(T.BinaryType())
def digest(text: pa.Array) -> pa.Array:
    """SHA-256 of the text with A-Z in lower case."""
    return pa.array([hashlib.sha256(t.lower()).digest() for t in rows.bytes_of(text)], pa.binary())


def _repeats(digests: DataFrame, key: str) -> bloom.Filter:
    return bloom.build(F.col(key), digests, bloom.bits_for(digests.count()), times=2)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    digests = materialize(docs.select(F.col(id_col).alias("__id"), digest(F.col(text_col)).alias("__sha")), "digests")
    marked = bloom.probe(digests, F.col("__sha"), _repeats(digests, "__sha"), "__maybe")
    hits = marked.where("__maybe")
    groups = materialize(hits.groupBy("__sha").agg(F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    copies = hits.groupBy("__sha", "__id").agg(F.count(F.lit(1)).alias("__n"))
    grouped = copies.join(groups, "__sha").select("*", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__i"))
    sha = F.lower(F.hex("__sha")).alias("text_sha256")
    return (
        marked.where(~F.col("__maybe"))
        .select(F.col("__id").alias(id_col), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
        .unionByName(
            grouped.select(
                F.col("__id").alias(id_col), "keep_id", "group_size", (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__i") == 1)).alias("kept"), sha
            )
        )
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group; texts that occur once are not shuffled.  Columns may have any names."""
    return rows.unpacked(_first_rows(rows.packed(docs, id_col, text_col), id_col, text_col))


def _first_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    marked = docs.withColumn("__sha", digest(F.col(text_col)))
    filt = _repeats(materialize(marked.select("__sha"), "digests"), "__sha")
    marked = bloom.probe(marked, F.col("__sha"), filt, "__maybe")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    last = F.struct(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    kept = marked.where("__maybe").groupBy("__sha").agg(F.max_by(F.struct(*columns), last).alias("__row"))
    return marked.where(~F.col("__maybe")).select(*columns).unionByName(kept.select("__row.*"))
