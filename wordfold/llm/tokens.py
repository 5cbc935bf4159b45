"""Token counts by a two-tier lookup of pre-tokens in the map side.

The first tier is a broadcast table with the token counts of the pre-tokens that are frequent in a bounded sample (about
``SAMPLE_ROWS`` rows and never more than twice as many, ``SAMPLE_CHARS`` characters of each; at most ``FREQUENT`` entries).  The second is a
bounded cache in each worker that the tokenizer fills.  Counts do not depend on either, and no pre-token is ever shuffled.

The tokenizer file must be byte-level BPE without a normalizer.  Null and empty texts have no tokens.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS, SAMPLE_CHARS = 4096, 4096
FREQUENT = 65_536
#: Entries of a worker's cache of misses, and the longest pre-token it holds.
CACHE, CACHED_CHARS = 300_000, 63
#: Longer texts are taken apart one pre-token at a time instead of all at once.
_LONG = 1 << 20

#: Fixed value: how byte-level BPE of this family cuts a text into pre-tokens.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters outside these ranges may be classed by another Unicode version in the tokenizer, which then cuts itself.
RARE = regex.compile(
    "[^\\x00-\\u0557\\u1e00-\\u200f\\u2013-\\u2027\\u2030-\\u205e\\u20a0-\\u20be\\u2100-\\u218b\\u2190-\\u23fe\\u2500-\\u2b73"
    "\\u3000-\\u303f\\u3041-\\u3096\\u3099-\\u30ff\\u4e00-\\u9fea\\uac00-\\ud7a3\\uff01-\\uffbe\\U0001f300-\\U0001f5ff\\U0001f600-\\U0001f64f]"
)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Lengths(dict):
    """Token counts of pre-tokens: frequent ones given, others found by the tokenizer and kept for a while."""

    def __init__(self, path: str, words: list[str], counts: np.ndarray):
        super().__init__(zip(words, counts.tolist(), strict=True))
        self.path, self.frequent, self.given = path, dict(self), len(self)
        specials = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def __missing__(self, word: str) -> int:
        n = self.by_library(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= self.given + CACHE:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n

    def by_library(self, text: str) -> int:
        return len(tokenizer(self.path).encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if RARE.search(text) or (self.special and self.special.search(text)):
            return self.by_library(text)
        if len(text) < _LONG:
            return sum(map(self.__getitem__, PRE_TOKEN.findall(text)))
        return sum(self[m.group()] for m in PRE_TOKEN.finditer(text))


@lru_cache(maxsize=2)
def _lengths(path: str, words: str, counts: bytes) -> Lengths:
    return Lengths(path, words.split("\x00") if counts else [], np.frombuffer(counts, np.uint8))


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text") -> tuple[str, bytes]:
    """The pre-tokens most frequent in a bounded sample, joined by NUL, and their token counts, one byte each."""
    text = F.col(text_col)
    share = min(1.0, SAMPLE_ROWS / max(docs.count(), 1))
    sample = docs.where(text.isNotNull()).select(F.substring(text, 1, SAMPLE_CHARS).alias("t")).sample(share, seed=5).limit(2 * SAMPLE_ROWS)
    seen: Counter[str] = Counter()
    for row in sample.select("t").collect():
        seen.update(PRE_TOKEN.findall(row["t"]))
    words = [w for w, _ in seen.most_common(FREQUENT) if len(w) <= CACHED_CHARS and "\x00" not in w and not RARE.search(w)]
    counts = [len(e.ids) for e in tokenizer(path).encode_batch(words, add_special_tokens=False)]
    return "\x00".join(words), bytes(counts)  # at most 4 bytes a character, so below 256


def count_tokens(docs: DataFrame, path: str, text_col: str = "text") -> Column:
    """A column with the number of tokens of ``text_col``, without begin, end or padding."""
    spark = docs.sparkSession
    words, counts = frequent_lengths(docs, path, text_col)
    table = spark.sparkContext.broadcast((path, words, counts))

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        lengths = _lengths(*table.value)
        return pa.array([lengths.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    return run(F.col(text_col))
