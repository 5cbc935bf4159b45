"""Fill-in-the-middle: texts cut at two token ends and put together in another order.

A token is a run of white space with the word after it; white space at the end of a text is a token of its own.  So every
token ends at the last character of a word, or at the last character of the text.  The characters fall into four classes by
that, and a wavelet matrix over the classes answers how many of the first p characters have a class.  The ranks of the two
ending classes add up to the number of token ends in a prefix; the k-th end is found by bisection on these sums.

Where the cuts fall, and which texts are rearranged at all, follows from a hash of the id, so reruns agree.  The matrix of a
text exists only while its row is handled, and takes a quarter of a byte for each character besides the text.

A null or empty text has no tokens and stays as it is (form ``plain``, an empty output).  A text that contains one of the marks
stays as it is, too.  A null id draws as the empty string does.  Rows are independent: repeated ones give equal results, an
empty table an empty one.  Other columns stay; one called like a column that is added is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Classes of characters: one of a word, the last of a word, white space, and white space that ends the text.
WORD, WORD_END, SPACE, SPACE_END = range(4)
_BLOCK = 64  # bytes of a bit vector between two stored counts
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Marks:
    """The strings before the three parts; none may begin as another one, or itself, ends."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def classes_of(text: str) -> np.ndarray:
    """The class of every code point."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    out = np.where(space, SPACE, WORD).astype(np.uint8)
    if len(points):
        out[:-1][~space[:-1] & space[1:]] = WORD_END
        out[-1] = SPACE_END if space[-1] else WORD_END
    return out


class Bits:
    """A bit vector that counts the ones before a position in constant time."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        counts = _POPCOUNT[packed].astype(np.int64)
        per_block = np.add.reduceat(counts, np.arange(0, len(counts), _BLOCK)) if len(counts) else counts
        self.before = [0, *np.cumsum(per_block).tolist()]
        self.packed = packed.tobytes()

    def ones(self, end: int) -> int:
        block = end // (8 * _BLOCK)
        rest = end - block * 8 * _BLOCK
        if not rest:
            return self.before[block]
        part = int.from_bytes(self.packed[block * _BLOCK : block * _BLOCK + (rest + 7) // 8], "little")
        return self.before[block] + (part & ((1 << rest) - 1)).bit_count()


class WaveletMatrix:
    """Ranks of symbols below ``2 ** levels``: level by level the zeros of one bit go before the ones, in their order."""

    def __init__(self, symbols: np.ndarray, levels: int = 2):
        self.size, self.rows, self.zeros = len(symbols), [], []
        for level in reversed(range(levels)):
            bit = (symbols >> level) & 1
            self.rows.append(Bits(bit))
            self.zeros.append(self.size - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: int, end: int) -> int:
        """How many of the first ``end`` symbols are ``symbol``."""
        start, last = 0, len(self.rows) - 1
        for level, (row, zeros) in enumerate(zip(self.rows, self.zeros, strict=True)):
            lo, hi = row.ones(start), row.ones(end)
            start, end = (zeros + lo, zeros + hi) if symbol >> (last - level) & 1 else (start - lo, end - hi)
        return end - start


class TokenEnds:
    """Where the tokens of a text end."""

    def __init__(self, text: str):
        self.matrix = WaveletMatrix(classes_of(text))

    def count(self, end: int) -> int:
        """Tokens that end within the first ``end`` characters."""
        return self.matrix.rank(WORD_END, end) + self.matrix.rank(SPACE_END, end)

    def find(self, k: int, low: int = 0) -> int:
        """The end of the k-th token, counted from 1; 0 for k = 0.  It lies behind ``low``."""
        if k == 0:
            return 0
        high = self.matrix.size
        while high - low > 1:
            half = (low + high) // 2
            low, high = (low, half) if self.count(half) >= k else (half, high)
        return high


def cuts_of(text: str, first: int, second: int) -> tuple[int, int, int]:
    """The number of tokens, and the characters before the earlier and the later of two cuts drawn by numbers."""
    ends = TokenEnds(text)
    n = ends.count(ends.matrix.size)
    a, b = sorted((first % (n + 1), second % (n + 1)))
    start = ends.find(a)
    return n, start, start if a == b else ends.find(b, start)


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "start", "stop")]))
def _cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    found = [cuts_of(t.as_py() or "", a, b) for t, a, b in zip(text, first.to_pylist(), second.to_pylist(), strict=True)]
    columns = zip(*found, strict=True) if found else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "start", "stop"])


def draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers below 2^32 from a hash of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(key, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def rearrange(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: Marks = Marks()
) -> DataFrame:
    """``docs`` with ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    ``percent`` of the texts are rearranged, ``spm_percent`` of these with the suffix first.
    """
    added = {"n", "form", "prefix_chars", "middle_chars", "output"}
    if clash := added & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    h1, h2, h3, h4 = draws(f"`{id_col}`", seed)
    marked = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks.all])
    form = (
        F.when((text == "") | marked | (h3 % 100 >= percent), "plain")
        .when(h4 % 100 < spm_percent, "spm")
        .otherwise("psm")
    )
    cut = F.struct(form.alias("form"), _cuts(text, h1, h2).alias("at"))
    # the row is packed, so that no helper column can meet a user's
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), cut.alias("cut"))
    form, start, stop = F.col("cut.form"), F.col("cut.at.start"), F.col("cut.at.stop")
    part = lambda at, n: F.substr(F.col("text"), (at + 1).cast("int"), n.cast("int"))
    prefix, middle = part(F.lit(0), start), part(start, stop - start)
    suffix = part(stop, F.char_length("text") - stop)
    p, s, m = (F.lit(x) for x in marks.all)
    output = (
        F.when(form == "plain", F.col("text"))
        .when(form == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    return held.select(
        "row.*",
        F.col("cut.at.n").alias("n"),
        form.alias("form"),
        F.when(form != "plain", start).alias("prefix_chars"),
        F.when(form != "plain", stop - start).alias("middle_chars"),
        output.alias("output"),
    )


def restore(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that was rearranged, from the output and the form alone."""
    any_mark = "|".join(re.escape(m) for m in marks.all)
    # a part holds no mark, and none can arise where a part meets one
    parts = F.split(output, any_mark, -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
