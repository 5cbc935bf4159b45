"""Encoding into SentencePiece pieces and back.

An Aho-Corasick automaton over all pieces runs once over the text.  At every position its output links give the
pieces that end there, longest first, and each relaxes the best score of a segmentation up to that position (Viterbi).  Of
equal scores the one with the longer last piece stays.  This is the unigram rule on the pieces and scores of a model file; a file
trained by merges has the same pieces and decodes alike, but its own rule can cut words differently.

Spaces become U+2581, with one in front of a text; characters without a piece become byte pieces (or the unknown id).
Where no piece of the model goes across, texts are cut before each run of U+2581 and around line ends, and the encoding of a word is
kept in a bounded cache.  Null and empty texts have no pieces.
Decoding gives the text back unless it holds U+2581 itself or the model has no byte pieces for an unknown character.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "\u2581"
#: Entries of each of the two generations of a worker's cache, and the longest word it holds.
CACHE, CACHED_CHARS = 60_000, 64
#: Texts taken out of a column at once.
_TEXTS = 128
#: Longer texts are taken apart one word at a time instead of all at once.
_LONG = 1 << 20
UNKNOWN_PENALTY = 10.0
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n")


class Codec:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.unknown = model.unk_id()
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i in ids if model.is_control(i)}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unused(i) or model.is_unknown(i))]
        scores = {i: model.get_score(i) for i in plain}
        self.unknown_score = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.singles = {self.pieces[i] for i in plain if len(self.pieces[i]) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i, scores[i]))
        self.automaton.make_automaton()
        self.by_word = not any(SPACE in self.pieces[i].lstrip(SPACE) or "\n" in self.pieces[i] for i in plain)
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        text = {i: bytes((b,)) for i, b in self.bytes_of.items()} | dict.fromkeys(self.silent, b"") | {self.unknown: " \u2047 ".encode()}
        self.raw = [text.get(i, p.encode()) for i, p in enumerate(self.pieces)]

    def segment(self, word: str) -> list[int]:
        """The best pieces of a string without further cuts."""
        if len(word) <= CACHED_CHARS and self.singles.issuperset(word):
            return self._segment_known(word)
        n = len(word)
        best, came = array("d", [float("-inf")]) * (n + 1), array("i", [0]) * (n + 1)
        best[0] = 0.0
        done = 0
        singles, unknown = self.singles, self.unknown_score

        def settle(upto: int) -> int:
            for e in range(done + 1, upto + 1):
                if word[e - 1] not in singles and best[e - 1] + unknown > best[e]:
                    best[e], came[e] = best[e - 1] + unknown, -1
            return max(upto, done)

        for end, (length, piece, score) in self.automaton.iter(word):
            if end > done:
                done = settle(end)
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], came[end + 1] = total, piece
        settle(n)
        out: list[int] = []
        at = n
        while at:
            if came[at] >= 0:
                out.append(came[at])
                at -= len(self.pieces[came[at]])
            else:
                raw = word[at - 1].encode("utf-8", "surrogatepass")
                out += [self.byte_ids[b] for b in reversed(raw)] if self.byte_ids else [self.unknown]
                at -= 1
        out.reverse()
        return out

    def _segment_known(self, word: str) -> list[int]:
        """The same for a short string of known characters."""
        best, came = [float("-inf")] * (len(word) + 1), [0] * (len(word) + 1)
        best[0] = 0.0
        for end, (length, piece, score) in self.automaton.iter(word):
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], came[end + 1] = total, piece
        out, at = [], len(word)
        while at:
            out.append(came[at])
            at -= len(self.pieces[came[at]])
        out.reverse()
        return out

    def _word(self, word: str) -> tuple[int, ...]:
        """Pieces of a word that was not seen recently."""
        ids = self.older.get(word)
        if ids is None:
            ids = tuple(self.segment(word))
        if len(word) <= CACHED_CHARS:
            if len(self.recent) >= CACHE:
                self.older, self.recent = self.recent, {}
            self.recent[word] = ids
        return ids

    def encode(self, text: str) -> array:
        out = array("i")
        if not text:
            return out
        text = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            out.extend(self.segment(text))
            return out
        words = _WORDS.findall(text) if len(text) < _LONG else (m.group() for m in _WORDS.finditer(text))
        for word in words:
            out.extend(self.recent.get(word) or self._word(word))
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(encoded: list[array]) -> pa.Array:
    ends = np.cumsum([0, *[len(x) for x in encoded]])
    flat = np.concatenate([np.frombuffer(x, np.int32) for x in encoded if len(x)] or [np.empty(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode(text: Column, path: str) -> Column:
    """Piece ids as an array."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        c = codec(path)
        sizes, ids = [0], array("i")
        for at in range(0, len(texts), _TEXTS):
            for t in texts.slice(at, _TEXTS).to_pylist():
                ids.extend(c.encode(t or ""))
                sizes.append(len(ids))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))

    return run(text)


def with_pieces(docs: DataFrame, path: str, text_col: str = "text", name: str = "pieces") -> DataFrame:
    """``docs`` with piece ids as the last column, in place of a column of that name.

    Rows pass through a task few at a time, so the ids of only few texts are held at once.
    """
    names = [c for c in docs.columns if c != name]
    at = names.index(text_col)
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # names with dots cannot go to mapInArrow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(start, _TEXTS)
                ids = _lists([c.encode(t or "") for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])

    made = T.StructType([*numbered.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return numbered.mapInArrow(run, made).toDF(*names, name)


def decode(ids: Column, path: str) -> Column:
    """The text of an array of piece ids; null for null."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([None if x is None else c.decode(x) for x in lists.to_pylist()], pa.string())

    return run(ids)


def encode_checked(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_pieces``, ``pieces_sha256`` (of the ids as little-endian 32-bit numbers), ``decoded_sha256``, ``round_trip``.

    Encodes and decodes in one task, so the ids need not leave it.
    """

    @F.arrow_udf("struct<n_pieces:bigint,pieces_sha256:string,decoded_sha256:string,round_trip:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        c = codec(path)
        found: list[tuple] = []
        for t in texts.to_pylist():
            t = t or ""
            ids = c.encode(t)
            back = c.decode(ids)
            found.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == t))
        names = ["n_pieces", "pieces_sha256", "decoded_sha256", "round_trip"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names)

    return docs.select(F.col(id_col), run(F.col(text_col)).alias("__r")).select(id_col, "__r.*")
