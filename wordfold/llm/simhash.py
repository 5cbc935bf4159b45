"""Near duplicates by SimHash fingerprints.

Texts in lower case (A-Z only) give word shingles; bit b of a fingerprint is set if it is set in over half of the shingles'
hashes.  Fingerprints that differ in at most two of 64 bits are linked.  Cut into four blocks of 16 bits, such a pair agrees in at least two,
so fingerprints are joined on each of the six pairs of blocks and the Hamming distance is verified.

Equal fingerprints are one node, so copies add no pairs.  Buckets with more than ``BUCKET`` different fingerprints are not
paired up: each of their members meets its neighbours at the 65 values within one bit of it.  Two fingerprints
share such a value exactly if they differ in at most two bits, so this finds the same components at a cost that grows with
the members, not their square.

A null or empty text, or one without words, has fingerprint zero.  A null id never is a component's id unless there is no
other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from wordfold.llm import rows
from wordfold.llm.graph import components
from wordfold.storage import materialize

SHINGLE = 3
SEED = 42
BUCKET = 64
#: Words taken apart at once, so that a long text needs bounded memory.
_CHUNK = 1 << 16

_byte = np.arange(256, dtype=np.uint64)
#: For each byte its eight bits in eight bytes.
_SPREAD = sum(((_byte >> np.uint64(b)) & np.uint64(1)) << np.uint64(8 * b) for b in range(8))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    full = np.zeros((-(-len(hashes) // 255) * 255, 8), np.uint8)  # a byte holds sums up to 255
    full[: len(hashes)] = hashes.view(np.uint8).reshape(-1, 8)
    sums = _SPREAD[full].reshape(-1, 255, 8).sum(axis=1)
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def shingle_hashes(text: bytes, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles in order, in parts; one of the whole text if it is shorter, none without words."""
    words = text.lower().split()  # bytes split at \x20 and \x09-\x0D
    if not words:
        return
    if len(words) <= shingle:
        yield np.array([xxh64_intdigest(b" ".join(words), seed)], "<u8")
        return
    n = len(words) - shingle + 1
    for at in range(0, n, _CHUNK):
        part = words[at : min(at + _CHUNK, n) + shingle - 1]
        ends = np.cumsum([len(w) + 1 for w in part])
        line = b" ".join(part)
        first = [0, *ends[: len(part) - shingle].tolist()]
        last = (ends[shingle - 1 :] - 1).tolist()
        yield np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(first, last, strict=True)], "<u8")


def fingerprint_of(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number."""
    total, n = np.zeros(64, np.int64), 0
    for part in shingle_hashes(text, shingle, seed):
        total += _bit_counts(part)
        n += len(part)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view("<i8")[0])


@F.arrow_udf(T.LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(t) for t in rows.bytes_of(text)], pa.int64())


def _block_pairs(fp: Column) -> Column:
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    return F.array(*[F.lit(n << 32) + F.shiftleft(block[i], 16) + block[j] for n, (i, j) in enumerate(combinations(range(4), 2))])


def _links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the same fingerprints as all pairs within two bits do."""
    members = prints.select("fp", F.explode(_block_pairs(F.col("fp"))).alias("bucket"))
    sizes = materialize(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = materialize(members.join(sizes, "bucket"), "members")
    few = members.where(F.col("n") <= BUCKET)
    a, b = few.select("bucket", F.col("fp").alias("u")), few.select("bucket", F.col("fp").alias("v"))
    near = (F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)
    pairs = a.join(b, (a["bucket"] == b["bucket"]) & near).select("u", "v")

    many = members.where(F.col("n") > BUCKET).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.expr(f"fp ^ shiftleft(1L, {i})") for i in range(64)])
    meeting = materialize(many.select("fp", F.explode(flips).alias("value")), "meeting")
    centres = materialize(meeting.groupBy("value").agg(F.min("fp").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "centres")
    stars = meeting.join(centres, "value").where("fp <> centre").select(F.col("fp").alias("u"), F.col("centre").alias("v"))
    return pairs.unionByName(stars).distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows (``ID``, ``HASH``, ``fp``), and for each fingerprint its component ``root``."""
    marked = rows.keyed(docs, id_col, text_col)
    prints = materialize(marked.select(rows.ID, rows.HASH, fingerprint(F.col("__text")).alias("fp")), "fingerprints")
    distinct = materialize(prints.select("fp").distinct(), "distinct")
    roots = distinct.join(components(_links(distinct)), F.col("fp") == F.col("node"), "left")
    return prints, materialize(roots.select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable)."""
    prints, roots = _classes(docs, id_col, text_col)
    least = prints.groupBy("fp").agg(F.min(rows.ID).alias("least"))
    whole = materialize(least.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = materialize(roots.join(whole, "root").select("fp", "component_id"), "named")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(named, "fp").select(F.col(rows.ID).alias(id_col), text, "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the smallest id, a null id only if there is no other.

    Rows that agree in id and text are one document.  Columns may have any names.
    """
    docs = rows.packed(docs, id_col, text_col)
    return rows.unpacked(first_of_each(docs, *_classes(docs, id_col, text_col), id_col, text_col))


def first_of_each(docs: DataFrame, prints: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay if each ``root`` keeps the first of its documents."""
    counted = materialize(prints.groupBy(rows.ID, rows.HASH, "fp").agg(F.count(F.lit(1)).alias("n")).join(roots, "fp"), "counted")
    order = F.struct(F.col(rows.ID).isNull().alias("none"), F.col(rows.ID).alias("id"), F.col(rows.HASH).alias("th"))
    firsts = materialize(
        counted.groupBy("root").agg(F.min(order).alias("first"), F.sum("n").alias("rows")).where("rows > 1").drop("rows"), "firsts"
    )
    keep = order == F.col("first")
    decisions = counted.join(firsts, "root").select(rows.ID, rows.HASH, keep.alias("__keep"), "n").where("n > 1 or not __keep").drop("n")
    return rows.retain(docs, materialize(decisions, "decisions"), id_col, text_col)
