"""Substrings of a fixed length that occur more than once, by a depth-limited radix sort of suffixes.

Suffixes matter only through their first ``length`` bytes, so the sort stops there and its equal groups are exactly the
repeated windows.  The passes take the most significant digit first, and a suffix leaves as soon as it is alone:

1. The first digit of a window is its *anchor*: of the ``gram``-byte strings in it the one with the smallest hash
   (leftmost on ties).  Equal windows have equal anchors at equal offsets.  Neighbouring windows mostly share their anchor,
   so this pass moves one row per anchor, not one per byte.  All windows of one anchor form a *zone*.
2. The second digit is the whole zone.  Where two zones are equal, all their windows are repeated at once; where an anchor
   is repeated but its zone is not, the edge of a repeat may run through the zone.
3. Only the anchors of such edge zones are taken apart, one example of each kind of zone.  Blocks of ``BLOCK`` neighbouring windows are compared by the bytes all of them share (unique: none is
   repeated) and by the bytes any of them covers (repeated: all are).  The windows of undecided blocks are compared one by one.

Digits travel as 64-bit or 128-bit hashes.

Rows that agree in id and text share one key and get the same answer; each counts as "elsewhere" for the other.
Null texts are empty, null ids are allowed, texts shorter than ``length`` lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordfold.llm import bloom, rows
from wordfold.storage import materialize

LENGTH = 400
GRAM = 64
BLOCK = 16
#: Windows handled at once in a task; longer texts are cut with an overlap.
SEGMENT = 1 << 17
#: Blocks of a text that leave a task together, and texts that are cut together.
BLOCKS_TOGETHER, TEXTS_TOGETHER = 1 << 14, 128
_POSITION_BITS = 18
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, SEGMENT + LENGTH + 1)
_DOWN = _powers(np.uint64(pow(int(_BASE), -1, 2**64)), SEGMENT + LENGTH + 1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed rolling hash of every ``gram`` bytes."""
    terms = _BYTE[data]
    terms *= _UP[: len(data)]
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(terms, out=total[1:])
    h = total[gram:] - total[:-gram]
    h *= _DOWN[: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by doubling."""
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def zones_of(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Zones of the texts that begin at ``starts`` in ``data`` (the last entry is the end).

    Returns text number, first window, number of windows, anchor (positions in ``data``).
    """
    if len(data) < length:
        return (np.empty(0, np.int64),) * 4
    h = _gram_hashes(data, gram)
    keys = ((h >> np.uint64(_POSITION_BITS)) << np.uint64(_POSITION_BITS)) | np.arange(len(h), dtype=np.uint64)
    lowest = _window_minimum(keys, length - gram + 1)  # one for each window
    window = np.arange(len(lowest))
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(lowest)]
    inside = window + length <= starts[text + 1]
    anchor = (lowest & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    window, text, anchor = window[inside], text[inside], anchor[inside]
    if not len(window):
        return (np.empty(0, np.int64),) * 4
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    return text[first], window[first], np.diff(np.concatenate((first, [len(window)]))), anchor[first]


_ZONES = "__th bigint, first bigint, n int, offset int, gram bigint, zone bigint"
_BLOCKS = "__th bigint, first bigint, core binary, left binary, right binary"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _segments(data: np.ndarray, starts: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of at most about SEGMENT bytes: first text, last text, begin, end.  A longer text alone is cut with an overlap."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + SEGMENT, "right")) - 1)
        if starts[last] - starts[first] <= SEGMENT:
            yield first, last, int(starts[first]), int(starts[last])
        else:
            begin, stop = int(starts[first]), int(starts[last])
            while begin < stop:
                yield first, last, begin, min(begin + SEGMENT, stop)
                begin += SEGMENT - length + 1
                if begin + length - 1 >= stop:
                    break
        first = last


def _zone_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = rows.buffer_of(batch.column(2))
            raw = memoryview(data)
            ids, hashes = batch.column(0), batch.column(1)
            for lo, hi, begin, end in _segments(data, starts, length):
                inner = np.clip(starts[lo : hi + 1] - begin, 0, end - begin)
                text, window, count, anchor = zones_of(data[begin:end], inner, length)
                if not len(text):
                    continue
                window, anchor, of = window + begin, anchor + begin, text + lo
                grams = [_signed(xxhash.xxh3_64_intdigest(raw[a : a + GRAM])) for a in anchor.tolist()]
                zones = [
                    _signed(xxhash.xxh3_64_intdigest(raw[w : w + k + length - 1], seed=a - w))
                    for w, k, a in zip(window.tolist(), count.tolist(), anchor.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(of)),
                        hashes.take(pa.array(of)),
                        pa.array(window - starts[of], pa.int64()),
                        pa.array(count, pa.int32()),
                        pa.array(anchor - window, pa.int32()),
                        pa.array(grams, pa.int64()),
                        pa.array(zones, pa.int64()),
                    ],
                    ["__id", "__th", "first", "n", "offset", "gram", "zone"],
                )

    return run


def _block_rows(length: int):
    """Blocks of the edge zones of a text.  Block boundaries are fixed relative to the anchor, so equal surroundings give equal blocks."""
    names = ["__id", "__th", "first", "core", "left", "right"]

    def blocks(text: bytes, edges: Iterator[tuple[int, int, int]]) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        seen: set[tuple[int, int]] = set()  # a zone of a long text can come in two parts
        for start, n, offset in edges:
            anchor = start + offset
            for block in range((offset - n + 1) // BLOCK, offset // BLOCK + 1):
                first = anchor - block * BLOCK - (BLOCK - 1)  # of its windows
                core = text[first + BLOCK - 1 : first + length] if first + BLOCK > 0 else b""
                if len(core) < length - BLOCK + 1 or (first, anchor) in seen:
                    continue
                seen.add((first, anchor))
                digest = xxhash.xxh3_128_digest(core, seed=block & 0xFFFF)
                yield first, digest, text[max(first, 0) : first + BLOCK - 1], text[first + length : first + length + BLOCK - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(rows.bytes_of(batch.column(2))):
                edges = batch.column(3)[at].values
                fields = [edges.field(f).to_numpy(zero_copy_only=False).tolist() for f in ("first", "n", "offset")]
                found = blocks(text, zip(*fields, strict=True))
                while part := list(islice(found, BLOCKS_TOGETHER)):
                    key = batch.slice(at, 1)
                    same = pa.array(np.zeros(len(part), np.int64))
                    columns = [pa.array(x, k) for x, k in zip(zip(*part, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)]
                    yield pa.RecordBatch.from_arrays([key.column(0).take(same), key.column(1).take(same), *columns], names)

    return run


def _repeated_twice(df: DataFrame, key: str) -> DataFrame:
    """Rows of a stored table whose key may occur again; the others leave without being shuffled."""
    filt = bloom.build(F.col(key), df, bloom.bits_for(df.count()), times=2)
    return bloom.probe(df, F.col(key), filt, "__maybe").where("__maybe").drop("__maybe")


def repeated_windows(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ID``, ``HASH``, ``first``, ``n``: runs of window starts (in bytes) whose windows occur again.

    ``length`` is in bytes and at least ``GRAM + BLOCK``.  Runs of one text may overlap.
    """
    texts = rows.keyed(docs, id_col, text_col)
    kind = dict(docs.dtypes)[id_col]
    key = f"__id {kind}, "
    place = ["__id", "__th", "first"]

    # first digit: the anchor
    zones = materialize(texts.mapInArrow(_zone_rows(length), key + _ZONES), "zones")
    zones = materialize(_repeated_twice(zones, "gram"), "repeated-anchors")

    # second digit: the zone
    at = F.min(F.struct(*place, "n", "offset")).alias("at")  # one example of each kind
    kinds = materialize(zones.groupBy("gram", "zone").agg(F.count(F.lit(1)).alias("times"), at), "zone-kinds")
    grams = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1")
    grams = materialize(grams.select("gram"), "anchors")
    whole = zones.join(kinds.where("times > 1").drop("at"), ["gram", "zone"]).select(*place, "n")
    edges = kinds.join(grams, "gram").select("at.*").groupBy("__id", "__th").agg(F.collect_list(F.struct("first", "n", "offset")).alias("edges"))
    edges = materialize(edges, "edges")

    # third digit: blocks of the edge zones, then their windows
    _, hit = rows.split(docs, edges, id_col, text_col)
    told = hit.where("edges is not null").select(rows.ID, rows.HASH, F.coalesce(F.col(text_col), F.lit("")).alias("__text"), "edges")
    blocks = materialize(told.mapInArrow(_block_rows(length), key + _BLOCKS), "blocks")
    blocks = materialize(_repeated_twice(blocks, "core"), "repeated-cores")
    sides = ["core", "left", "right"]
    kind = [F.xxhash64(*sides).alias("k1"), F.xxhash64(*reversed(sides), F.lit(1)).alias("k2")]  # 128 bits in place of the three
    blocks = blocks.select(*place, (F.length("left") + F.length("right")).alias("around"), *sides, *kind)
    same = materialize(blocks.groupBy(*sides, "k1", "k2").agg(F.count(F.lit(1)).alias("times")), "block-kinds")
    cores = materialize(same.groupBy("core").agg(F.sum("times").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1 and kinds > 1").select("core"), "cores")
    windows = (
        same.join(cores, "core")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1))).alias("i"))  # the i-th window lacks i bytes on the left
        .where(f"length(left) >= {BLOCK - 1} - i and length(right) >= i")
        .select("core", "k1", "k2", "times", "i", F.expr(f"substring(left, length(left) - ({BLOCK - 1} - i) + 1, {BLOCK - 1} - i)").alias("l"), F.expr("substring(right, 1, i)").alias("r"))
        .select("k1", "k2", "times", "i", F.xxhash64("core", "i", "l", "r").alias("d1"), F.xxhash64("r", "l", "i", "core", F.lit(1)).alias("d2"))
    )
    windows = materialize(windows, "windows")
    again = materialize(windows.groupBy("d1", "d2").agg(F.sum("times").alias("all")).where("all > 1").drop("all"), "repeated")
    single = windows.where("times = 1").join(again, ["d1", "d2"]).groupBy("k1", "k2").agg(F.collect_list("i").alias("at"))
    single = materialize(single, "single")
    found = blocks.select(*place, "around", "k1", "k2")
    full = found.join(same.where("times > 1").select("k1", "k2"), ["k1", "k2"])
    first = F.greatest(F.col("first"), F.lit(0))
    full = full.select("__id", "__th", first.alias("first"), (F.col("around") - (BLOCK - 2)).cast("int").alias("n"))
    some = found.join(single, ["k1", "k2"]).select("__id", "__th", "first", F.explode("at").alias("i")).select("__id", "__th", (F.col("first") + F.col("i")).alias("first"), F.lit(1).alias("n"))
    return whole.unionByName(full.where("n > 0")).unionByName(some)


@F.arrow_udf(T.StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary"))
def _cut(texts: pa.Array, covers: pa.Array) -> pa.Array:
    kinds = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    return pa.concat_arrays([pa.array([], kinds), *[
        pa.array(list(map(_without, rows.bytes_of(texts.slice(at, TEXTS_TOGETHER)), covers.slice(at, TEXTS_TOGETHER).to_pylist())), kinds)
        for at in range(0, len(texts), TEXTS_TOGETHER)
    ]])


def _without(text: bytes, cover: list[dict] | None) -> tuple[int, int, int, bytes]:
    """Bytes of a text, bytes in ``cover``, the runs they make, and the other bytes."""
    kept, removed, spans, at = [], 0, 0, -1
    begin = 0
    for a, b in sorted((c["first"], c["stop"]) for c in cover or ()):
        if a > at:  # a new run: not even touching the one before
            kept.append(text[begin:a])
            spans += 1
            removed += b - a
            at = begin = b
        elif b > at:
            removed += b - at
            at = begin = b
    kept.append(text[begin:])
    return len(text), removed, spans, b"".join(kept)


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__id``, ``__th`` and ``__cut``: ``n_bytes``, ``n_removed``, ``n_spans`` and the bytes ``kept``.

    Texts that lose nothing do not pass through Python again.
    """
    found = repeated_windows(docs, length, id_col, text_col)
    stop = (F.col("first") + F.col("n") + (length - 1)).alias("stop")
    covers = materialize(found.groupBy("__id", "__th").agg(F.collect_list(F.struct("first", stop)).alias("cover")), "covers")
    without, joined = rows.split(docs, covers, id_col, text_col)
    raw, none = F.coalesce(F.col(text_col), F.lit("")).cast("binary"), F.lit(0).cast("long")
    uncut = F.struct(F.octet_length(raw).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), raw.alias("kept"))
    return without.withColumn("__cut", uncut).unionByName(joined.withColumn("__cut", _cut(F.col(text_col), F.col("cover"))).drop("cover"))
