"""Bringing decisions on documents back to their rows without moving every text.

A document is known by its id and a hash of its text.  Rows that agree in both are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordfold.llm import bloom

ID, HASH, ROW = "__id", "__th", "__packed"
#: Texts taken out of a column at once.
_TEXTS = 128


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key and the text, null texts as empty ones."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias(ID), F.xxhash64(text).alias(HASH), text.alias("__text"))


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """Each row as one struct, and beside it only the columns that are worked on, so that no helper column meets one of the user's."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias(ROW), *[F.col(f"`{c}`").alias(c) for c in dict.fromkeys(columns)])


def unpacked(docs: DataFrame) -> DataFrame:
    return docs.select(f"{ROW}.*")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def split(docs: DataFrame, info: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows certainly without ``info``, and the rest joined with it (left; columns of ``info`` but the key).

    ``info`` is a stored table with one row for each (``ID``, ``HASH``).  Only the second part is shuffled.
    """
    key = F.xxhash64(ID, HASH)
    filt = bloom.build(key, info, bloom.bits_for(info.count()))
    marked = bloom.probe(docs.withColumns({ID: F.col(id_col), HASH: text_hash(text_col)}), key, filt, "__maybe")
    hits = marked.where("__maybe").drop("__maybe").alias("d")
    same = F.col(f"d.{ID}").eqNullSafe(F.col(f"i.{ID}")) & (F.col(f"d.{HASH}") == F.col(f"i.{HASH}"))
    keep = [c for c in info.columns if c not in (ID, HASH)]
    joined = hits.join(info.alias("i"), same, "left").select("d.*", *[f"i.`{c}`" for c in keep])
    return marked.where(~F.col("__maybe")).drop("__maybe"), joined


def attach(docs: DataFrame, info: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``ID``, ``HASH`` and the columns of ``info`` (null where it has no row)."""
    without, joined = split(docs, info, id_col, text_col)
    blank = {f.name: F.lit(None).cast(f.dataType) for f in info.schema.fields if f.name not in (ID, HASH)}
    return without.withColumns(blank).unionByName(joined)


def retain(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows without a decision or with ``__keep`` true; of the latter one for each document."""
    without, joined = split(docs, decisions, id_col, text_col)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = joined.where(F.col("__keep")).groupBy(ID, HASH).agg(F.first(F.struct(*columns)).alias("__row"))
    undecided = joined.where(F.col("__keep").isNull()).select(*columns)
    return without.select(*columns).unionByName(undecided).unionByName(once.select("__row.*"))


def buffer_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column and where each text starts (one more entry for the end); nulls are empty."""
    array = pc.fill_null(text.cast(pa.large_binary()), b"")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def bytes_of(text: pa.Array) -> Iterator[bytes]:
    """The texts of a column one after another, nulls as empty ones; few of them are held as Python objects at once."""
    for at in range(0, len(text), _TEXTS):
        yield from pc.fill_null(text.slice(at, _TEXTS).cast(pa.large_binary()), b"").to_pylist()
