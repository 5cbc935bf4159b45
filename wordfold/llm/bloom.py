"""Bloom filters as tables of chunks, built and probed with DataFrame functions only.

A chunk is an array of ``CHUNK_WORDS`` 64-bit words, and a key has all its slots in one chunk, so a probe is one join with a broadcast
table of few rows, whose words are read in place.  A filter has at most ``MAX_BITS`` bits, so at most 8 MB are broadcast
whatever the size of the data.  A full filter lets more rows through to the exact step that follows; it never loses one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordfold.storage import materialize

MAX_BITS = 1 << 26
BITS_PER_KEY = 16
CHUNK_WORDS = 64
_CHUNK_BITS = 64 * CHUNK_WORDS
_SLOTS, _SLOT_BITS = 2, 12  # a hash gives each slot as many bits, and the rest to the chunk
_SEED = 0x51ED27


@dataclass(frozen=True)
class Filter:
    chunks: DataFrame  # chunk, words
    bits: int


def bits_for(keys: int) -> int:
    return min(MAX_BITS, max(1 << 16, 1 << (BITS_PER_KEY * max(keys, 1) - 1).bit_length()))


def _chunk(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, _SLOTS * _SLOT_BITS).bitwiseAND(F.lit(bits // _CHUNK_BITS - 1).cast("long"))


def _slots(h: Column) -> list[Column]:
    """Places in the chunk, from 0 to ``_CHUNK_BITS - 1``."""
    mask = F.lit(_CHUNK_BITS - 1).cast("long")
    return [F.shiftrightunsigned(h, _SLOT_BITS * i).bitwiseAND(mask).cast("int") for i in range(_SLOTS)]


def build(keys: Column, df: DataFrame, bits: int, times: int = 1) -> Filter:
    """Marks the slots that at least ``times`` rows of ``df`` fall on.

    With ``times=1`` this is a plain filter of the keys.  With ``times=2`` a key passes only if each of its slots was hit
    twice, as those of every repeated key are.
    """
    h = F.col("h")
    places = [_chunk(h, bits) * _CHUNK_BITS + slot for slot in _slots(h)]
    slots = df.select(F.xxhash64(keys, F.lit(_SEED)).alias("h")).select(F.explode(F.array(*places)).alias("slot"))
    counted = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = counted.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    word = F.struct(F.pmod("word", F.lit(CHUNK_WORDS)).cast("int"), "bits")
    marked = words.groupBy(F.floor(F.col("word") / CHUNK_WORDS).alias("chunk")).agg(F.map_from_entries(F.collect_list(word)).alias("marked"))
    every = F.transform(F.sequence(F.lit(0), F.lit(CHUNK_WORDS - 1)), lambda i: F.coalesce(F.col("marked")[i], F.lit(0).cast("long")))
    return Filter(materialize(marked.select("chunk", every.alias("words")), "filter"), bits)


def probe(df: DataFrame, key: Column, filt: Filter, name: str) -> DataFrame:
    """Adds a boolean: false only if the key is certainly not in the filter."""
    h, chunk, words = (_fresh(df, c) for c in ("h", "chunk", "words"))
    out = df.withColumn(h, F.xxhash64(key, F.lit(_SEED)))
    table = F.broadcast(filt.chunks.select(F.col("chunk").alias(chunk), F.col("words").alias(words)))
    out = out.join(table, _chunk(F.col(h), filt.bits) == F.col(chunk), "left")
    hit = F.lit(True)
    for slot in _slots(F.col(h)):
        word = F.get(words, F.shiftright(slot, 6))
        hit = hit & F.coalesce(F.call_function("getbit", word, slot.bitwiseAND(F.lit(63))) == 1, F.lit(False))
    return out.withColumn(name, hit).drop(h, chunk, words)


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
