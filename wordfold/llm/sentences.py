"""Repeated passages, found as runs of consecutive sentences.

A sentence ends after ``.``, ``!`` or ``?`` before white space or at a line end.  One of more than ``LONGEST`` words is cut where its
words say so (see ``pieces``), alike wherever a passage starts; pieces count as sentences.  From every
sentence on, and up to every sentence, the shortest run of at least ``RUN`` sentences and ``WORDS`` words is hashed (words in lower case, A-Z
only, white space aside).  Of equal runs in all texts the first stays, by id (null first) and position; sentences covered by any other are removed.

Each run is one small row; runs are joined globally by their hash, with map-side combining for the counts, and a document gets back
only its covered ranges.  Null and empty texts have no sentences; rows that agree in id and text are one document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from wordfold.llm import rows
from wordfold.storage import materialize

RUN, WORDS, LONGEST, NEAR = 3, 20, 16, 3
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def pieces(words: list[bytes]) -> list[int]:
    """Where a sentence of more than ``LONGEST`` words is cut, with its end.

    After each word whose hash, with the word before, is the least among the ``NEAR`` words on either side.  Such words are over ``NEAR``
    apart; where the next is more than ``LONGEST`` away, cuts are ``LONGEST`` apart from the last one.
    """
    h = [crc32(b, crc32(a)) for a, b in zip(words, words[1:])]
    h.insert(0, 1 << 32)
    cuts, last, size = [], 0, len(words)
    for i in range(NEAR, size - NEAR):
        x = h[i]
        if x < min(h[i - NEAR : i]) and x <= min(h[i + 1 : i + 1 + NEAR]):
            cuts += range(last + LONGEST, i + 1, LONGEST)
            if not cuts or cuts[-1] <= i:
                cuts.append(i + 1)
            last = i + 1
    cuts += range(last + LONGEST, size, LONGEST)
    cuts.append(size)
    return cuts


def sentences(text: bytes) -> tuple[list[int], list[bytes], list[int]]:
    """Ends of the sentences in bytes, their words in lower case joined by spaces, and the number of words.

    White space belongs to the sentence before it; white space in front of a text to the first.
    """
    ends: list[int] = []
    contents: list[bytes] = []
    sizes: list[int] = []
    at = 0
    for line in text.split(b"\n"):
        stop = min(at + len(line) + 1, len(text))
        words = line.lower().split()
        if not words:
            if ends:
                ends[-1] = stop
            at = stop
            continue
        first = len(ends)
        counts: list[int] = []
        stops = [k for k, word in enumerate(words, 1) if word[-1] in b".!?"]
        if not stops or stops[-1] < len(words):
            stops.append(len(words))
        for a, b in zip([0, *stops], stops):
            part = words[a:b]
            done = 0
            for k in pieces(part) if b - a > LONGEST else (b - a,):
                contents.append(b" ".join(part[done:k]))
                counts.append(k - done)
                done = k
        if len(counts) == 1:
            ends.append(stop)
        else:  # where each word begins gives where the sentence before it ends
            begins = [m.start() for m in _WORD.finditer(line)]
            k = 0
            for n in counts[:-1]:
                k += n
                ends.append(at + begins[k])
            ends.append(stop)
        sizes += counts
        at = stop
        assert len(ends) - first == len(counts)
    return ends, contents, sizes


def runs(text: bytes) -> Iterator[tuple[int, int, int]]:
    """Hash, first sentence and number of sentences of every run."""
    _, contents, sizes = sentences(text)
    before = [0, *accumulate(sizes)]
    found = set()
    n, j = len(contents), 0
    for i in range(n):  # the shortest from i on
        while j <= n and (j - i < RUN or before[j] - before[i] < WORDS):
            j += 1
        if j > n:
            break
        found.add((i, j))
    i = 0
    for j in range(n + 1):  # the shortest up to j
        while j - (i + 1) >= RUN and before[j] - before[i + 1] >= WORDS:
            i += 1
        if j - i >= RUN and before[j] - before[i] >= WORDS:
            found.add((i, j))
    for i, j in sorted(found):
        h = xxh3_64_intdigest(b" ".join(contents[i:j]))
        yield (h - (1 << 64) if h >> 63 else h), i, j - i


_RUNS = "__id bigint, __th bigint, run bigint, first int, n int"


def _rows_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])

        def flush(out=out):
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int32(), pa.int32())
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["__id", "__th", "run", "first", "n"])
            for x in out:
                x.clear()
            return made

        for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), rows.bytes_of(batch.column(2)), strict=True):
            for h, first, n in runs(text):
                for x, v in zip(out, (doc, th, h, first, n), strict=True):
                    x.append(v)
                if len(out[0]) >= 1 << 16:
                    yield flush()
        yield flush()


@F.arrow_udf(T.StructType().add("n_sentences", "integer").add("n_removed", "integer").add("kept", "string"))
def _without(texts: pa.Array, covers: pa.Array) -> pa.Array:
    found = []
    for text, cover in zip(rows.bytes_of(texts), covers.to_pylist(), strict=True):
        ends = sentences(text)[0]
        if not cover:
            found.append((len(ends), 0, text.decode()))
            continue
        gone = np.zeros(len(ends) + 1, np.int64)
        for c in cover:
            gone[c["first"]] += 1
            gone[c["first"] + c["n"]] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        starts = [0, *ends[:-1]]
        kept = b"".join(text[a:b] for a, b, g in zip(starts, ends, gone, strict=True) if not g)
        found.append((len(ends), int(gone.sum()), kept.decode()))
    kinds = (pa.int32(), pa.int32(), pa.string())
    return pa.StructArray.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["n_sentences", "n_removed", "kept"])


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__id``, ``__th`` and ``__found`` (``n_sentences``, ``n_removed``, ``kept``: the text that stays)."""
    kind = dict(docs.dtypes)[id_col]
    all_runs = materialize(rows.keyed(docs, id_col, text_col).mapInArrow(_rows_of_runs, _RUNS.replace("__id bigint", f"__id {kind}")), "runs")
    place = F.struct("__id", "__th", "first")
    repeated = materialize(
        all_runs.groupBy("run").agg(F.min(place).alias("origin"), F.max(place).alias("other")).where("origin <> other").drop("other"), "repeated"
    )
    later = all_runs.join(repeated, "run").where(place != F.col("origin"))
    covers = later.groupBy("__id", "__th").agg(F.collect_set(F.struct("first", "n")).alias("cover"))
    found = rows.attach(docs, materialize(covers, "covers"), id_col, text_col)
    return found.withColumn("__found", _without(F.col(text_col), F.col("cover"))).drop("cover")
