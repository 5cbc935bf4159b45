"""Packing of documents into sequences of bounded length, as few as possible.

Only the number of pieces of each length matters for the packing, so that is all the driver sees: at most ``capacity`` counts,
whatever the size of the data.  On them

1. **Dominance reduction** (Martello and Toth): for a piece of each length, the longest first, a set of at most three pieces is fixed
   as a sequence if no other set with that piece can do better, that is if the pieces of every other set fit, one or
   several at a time, into the places of this one.  Some packing with fewest sequences then holds this set, so it can be
   taken out.  Equal sets are taken out as often as their pieces last, and passes repeat until nothing more can be fixed.
2. **Best fit** packs the rest, the longest first, each piece into the open sequence with the least room that it fits in.

Both work on counts: a step fixes or fills all sequences of one kind at once, and the plan has a few kinds of sequences for each
length.  On Spark the pieces are numbered in order of length (`global_rank`, no length is ever in one task), and the plan,
a row for each length, turns a number into a sequence and a place.

A null or empty text is the end token alone.  Only documents longer than ``capacity`` are cut.  Repeated rows, also with the same
or without an id, are pieces of their own.  Equal lengths are numbered in order of id (null first), place and ids.  An
empty table gives an empty plan.  Other columns, whatever they are called, play no part.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.operators.ranking import global_rank
from wordfold.storage import materialize

CAPACITY = 4096
#: Words in one generation of a worker's cache, and the longest word it holds.
CACHE, CACHED_BYTES = 300_000, 64
#: Bytes of text whose words are looked up together.
_PART = 1 << 23
#: Between these a word ends for the tokenizer, with or without a space.
_BEFORE_SIGN = r"([a-zA-Z0-9])([.,])"
#: Words of ASCII and Latin-1 letters, which the tokenizer takes as one.
_LETTERS = re.compile(rb"(?:[a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: More runs than this for one length are an error; there are fewer than sequences of different contents, a few for each length.
_MOST_RUNS = (1 << 20) - 1


# ---------------------------------------------------------------- ids


class WordIds:
    """The ids of texts by a tokenizer that drops white space: each word is encoded once while the cache holds it.

    The tokenizer must lower-case, cut at white space and mark the last token of a word, as ``word_bpe_49k.json`` does; then a
    text's ids are those of its words, one after another.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.openings = {a[:2] for a in added}
        vocab, suffix = self.library.get_vocab(), self.library.model.end_of_word_suffix
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _by_library(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain = [w for w in words if w.isalpha() or _LETTERS.fullmatch(w)]
        out: dict[bytes, bytes] = {}
        if plain:
            # one call for all of them: each ends at a token that ends a word
            (ids,) = self._by_library([b" ".join(plain)])
            data, at = ids.tobytes(), [0, *(4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()]
            out.update(zip(plain, [data[a:b] for a, b in itertools.pairwise(at)], strict=True))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, [ids.tobytes() for ids in self._by_library(rest)], strict=True))
        return out

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        found = list(map(self.young.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        before = [self.old.get(words[i]) for i in missing]
        new = self._encode([words[i] for i, ids in zip(missing, before, strict=True) if ids is None])
        for i, ids in zip(missing, before, strict=True):
            found[i] = new[words[i]] if ids is None else ids
        if len(self.young) + len(missing) > CACHE:
            self.young, self.old = {}, self.young
        self.young.update([(words[i], found[i]) for i in missing if len(words[i]) <= CACHED_BYTES])
        return found

    def ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and where those of each text begin (one more entry for the end).

        Each different word is looked up once.
        """
        special = pc.match_substring_regex(text, "|".join(map(re.escape, self.openings))) if self.openings else pa.scalar(False)
        # special strings are found before lower-casing, so such texts keep their case
        text = pc.if_else(special, text, pc.ascii_lower(text))
        # words with and without a full stop or comma behind them are one word to the cache
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(text, _BEFORE_SIGN, r"\1 \2"))
        encoded = split.flatten().dictionary_encode()
        found = self._of_words(encoded.dictionary.cast(pa.large_binary()).to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = np.frombuffer(b"".join(found), "<u4")
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(each, pa.uint32()))
        at = split.offsets.to_numpy()
        tokens = np.concatenate([[0], np.cumsum(sizes[encoded.indices.to_numpy()])])
        return lists.take(encoded.indices).flatten().to_numpy(), tokens[at - at[0]]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _parts(text: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in slices of about ``_PART`` bytes; nulls are empty."""
    text = pc.fill_null(text, "")
    at = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy())])
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(at, at[low] + _PART, side="right")) - 1)
        yield text.slice(low, high - low)
        low = high


def piece_columns(text_col: str, path: str, capacity: int, end_id: int, with_ids: bool) -> Column:
    """An array of the pieces of a text: ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids`` (32-bit, little-endian)."""
    kind = "start:bigint,length:bigint,ids_crc32:bigint" + (",ids:binary" if with_ids else "")

    @F.arrow_udf(f"array<struct<{kind}>>")
    def run(text: pa.Array) -> pa.Array:
        encoder, end = word_ids(path), np.array([end_id], "<u4").tobytes()
        offsets, start, length, crc, ids = [0], [], [], [], []
        for part in _parts(text):
            tokens, at = encoder.ids(part)
            for a, b in itertools.pairwise(at.tolist()):
                for first in range(a, b + 1, capacity):  # the end token is one more
                    piece = tokens[first : min(first + capacity, b)].tobytes() + (end if first + capacity > b else b"")
                    start.append(first - a)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    if with_ids:
                        ids.append(piece)
                offsets.append(len(start))
        columns = [pa.array(c, pa.int64()) for c in (start, length, crc)] + ([pa.array(ids, pa.binary())] if with_ids else [])
        names = ["start", "length", "ids_crc32", "ids"][: len(columns)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names))

    return run(F.col(f"`{text_col}`"))


# ---------------------------------------------------------------- plan


@dataclass(frozen=True)
class Run:
    """Pieces ``at``, ``at + 1``, ... of one length, ``each`` of them side by side from ``offset`` on in sequences ``first``, ``first + 1``, ..."""

    at: int
    first: int
    each: int
    offset: int


@dataclass
class Kind:
    """Sequences with the same contents: ``runs`` has (length, pieces in each sequence) in order of their places."""

    n: int
    room: int
    parts: tuple[tuple[int, int], ...]


@dataclass
class Plan:
    capacity: int
    kinds: list[Kind] = field(default_factory=list)
    fixed: int = 0  # sequences that the reduction took out

    @property
    def sequences(self) -> int:
        return sum(k.n for k in self.kinds)

    def runs(self) -> dict[int, list[Run]]:
        """For each length its pieces' places, in order of their numbers (from 0 for each length)."""
        out: dict[int, list[Run]] = {}
        used: Counter[int] = Counter()
        first = 0
        for kind in self.kinds:
            offset = 0
            for length, each in kind.parts:
                out.setdefault(length, []).append(Run(used[length], first, each, offset))
                used[length] += each * kind.n
                offset += length * each
            first += kind.n
        return out


def _longest_pair(sizes: np.ndarray, double: np.ndarray, room: int, above: int = 0) -> int:
    """The greatest sum within ``room`` of two pieces longer than ``above``; 0 if there is none.

    ``sizes`` are the lengths at hand in rising order, ``double`` says which of them are there twice.
    """
    sizes, double = sizes[(low := bisect_right(sizes, above)) :], double[low:]
    if not len(sizes):
        return 0
    # the longest partner of each that is not longer than itself
    at = np.searchsorted(sizes, np.minimum(room - sizes, sizes), side="right") - 1
    own = np.arange(len(sizes))
    at = np.where((at == own) & ~double, at - 1, at)
    sums = np.where(at >= 0, sizes + sizes[np.maximum(at, 0)], 0)
    return int(sums.max())


def dominant_set(counts: Counter[int], sizes: list[int], j: int, capacity: int) -> tuple[int, ...] | None:
    """A set of pieces with one of length ``j`` that dominates all other such sets, if one of at most three pieces is known to.

    ``sizes`` are the lengths with a count above zero, in rising order.
    """
    room = capacity - j
    rest = sizes if counts[j] > 1 else [s for s in sizes if s != j]
    if not rest or rest[0] > room:
        return (j,)  # nothing else fits
    have = lambda s: counts[s] - (s == j)
    k = rest[bisect_right(rest, room) - 1]
    if k == room:
        return j, k  # no room is left, and whatever else fits would fit into the place of k
    least = [s for s in rest[:3] for _ in range(min(3, have(s)))][:3]
    if len(least) < 2 or least[0] + least[1] > room:
        return j, k  # only single pieces fit beside j, and k is the longest
    if len(least) == 3 and sum(least) <= room:
        return None
    # at most two pieces fit beside j
    values, double = np.array(rest), np.array([have(s) > 1 for s in rest])
    if _longest_pair(values, double, room) <= k:
        return j, k  # every pair fits into the place of k
    partners = [s for s in rest[: bisect_right(rest, room - k)] if s != k or have(k) > 1]
    if not partners:
        return None
    b = partners[-1]
    # a pair either fits piece by piece (the shorter one into b), or as a whole into k
    return (j, k, b) if _longest_pair(values, double, room, above=b) <= k else None


def reduce_dominated(counts: Counter[int], capacity: int) -> list[Kind]:
    """Takes the sets that a best packing may be assumed to hold out of ``counts``."""
    fixed: list[Kind] = []
    sizes = sorted(s for s, n in counts.items() if n)
    again = True
    while again:
        again = False
        for j in sizes[::-1]:
            while counts[j]:
                found = dominant_set(counts, sizes, j, capacity)
                if found is None:
                    break
                need = Counter(found)
                n = min(counts[s] // m for s, m in need.items())
                for s, m in need.items():
                    counts[s] -= n * m
                    if not counts[s]:
                        sizes.remove(s)
                fixed.append(Kind(n, capacity - sum(found), tuple(sorted(need.items(), reverse=True))))
                again = True
    return fixed


def best_fit(counts: Counter[int], capacity: int) -> list[Kind]:
    """Best fit, the longest first; equal pieces and equal sequences are handled at once."""
    by_room: dict[int, list[Kind]] = {}
    rooms: list[int] = []

    def put(kind: Kind) -> None:
        if kind.room not in by_room:
            by_room[kind.room] = []
            insort(rooms, kind.room)
        by_room[kind.room].append(kind)

    def fill(kind: Kind, length: int, each: int, n: int) -> None:
        """``n`` sequences of a kind get ``each`` pieces more."""
        put(Kind(n, kind.room - each * length, (*kind.parts, (length, each))))
        kind.n -= n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                # as many new sequences as it takes to hold the rest
                put(Kind(-(-left // (capacity // length)), capacity, ()))
                continue
            room = rooms[at]
            kind = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            # a sequence that took one has less room than before, so the next piece goes there, too
            each = room // length
            full = min(kind.n, left // each)
            if full:
                fill(kind, length, each, full)
                left -= full * each
            if kind.n and 0 < left < each:
                fill(kind, length, left, 1)
                left = 0
            if kind.n:
                put(kind)
    kinds = [k for group in by_room.values() for k in group if k.n]
    return [k for k in kinds if k.parts]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The sequences for so many pieces of each length."""
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"pieces must have between 1 and {capacity} tokens")
    left = Counter({s: n for s, n in counts.items() if n})
    fixed = reduce_dominated(left, capacity)
    out = Plan(capacity, fixed, sum(k.n for k in fixed))
    out.kinds = fixed + best_fit(Counter({s: n for s, n in left.items() if n}), capacity)
    return out


def plan_table(spark: SparkSession, plan: Plan, counts: dict[int, int]) -> DataFrame:
    """A row for each length: how many shorter pieces there are, and the runs as arrays in order of their start."""
    table, shorter = [], 0
    runs = plan.runs()
    for length in sorted(counts):
        own = runs.get(length, [])
        assert len(own) <= _MOST_RUNS
        table.append((length, shorter, *([getattr(r, name) for r in own] for name in ("at", "first", "each", "offset"))))
        shorter += counts[length]
    many = "array<bigint>"
    return spark.createDataFrame(table, f"length bigint, shorter bigint, at {many}, first {many}, each {many}, offset {many}")


# ---------------------------------------------------------------- jobs


def pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """The pieces of every document: id, ``piece`` (from 0), ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""
    cut = docs.select(F.col(f"`{id_col}`").alias("id"), piece_columns(text_col, path, capacity, end_id, with_ids).alias("pieces"))
    # every text has a piece; the outer form keeps Spark from testing for that, with a second run of the function
    each = cut.select("id", F.posexplode_outer("pieces").alias("piece", "p"))
    return each.select(F.col("id").alias(id_col), "piece", "p.*")


def _runs_up_to(at: Column, number: Column) -> Column:
    """The last of the ordered starts that is not above a number, by halving."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(_MOST_RUNS.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda i, step: F.when(F.coalesce(F.get(at, i + step) <= number, F.lit(False)), i + step).otherwise(i))


def place(found: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``found`` (pieces, a stored table) with ``sequence_id`` and ``offset``."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    table = F.broadcast(plan_table(spark, plan(counts, capacity), counts))  # at most capacity rows
    order = F.struct("length", F.col(id_col), "start", "ids_crc32")
    joined = global_rank(found, order, name="__number", total="__all").join(table, "length")
    number = F.col("__number") - F.col("shorter")
    run = joined.withColumn("__n", number).withColumn("__run", _runs_up_to(F.col("at"), F.col("__n")))
    of = lambda name: F.get(F.col(name), F.col("__run"))
    nth = F.col("__n") - of("at")
    return run.select(
        *[F.col(f"`{c}`") for c in found.columns],
        (of("first") + (nth - nth % of("each")) / of("each")).cast("bigint").alias("sequence_id"),
        (of("offset") + nth % of("each") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Every piece with its place: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    return place(materialize(pieces(docs, path, id_col, text_col, capacity, end_id), "pieces"), id_col, capacity)


def sequences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``ids`` (32-bit, little-endian) and ``parts`` (id, piece, offset, length) in order.

    A row has at most ``capacity`` tokens.
    """
    found = materialize(pieces(docs, path, id_col, text_col, capacity, end_id, with_ids=True), "pieces")
    part = F.struct("offset", F.col(id_col).alias("id"), "piece", "length", "ids")
    whole = place(found, id_col, capacity).groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    parts = F.transform("p", lambda x: F.struct(x["id"].alias(id_col), x["piece"], x["offset"], x["length"]))
    return whole.select("sequence_id", ids.alias("ids"), parts.alias("parts"))
