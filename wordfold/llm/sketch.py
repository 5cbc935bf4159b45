"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: lines, and pieces of 120 to 300 characters of longer lines, at a sentence end where there is one.
Each different paragraph is a 64-bit digest.  A sketch has three rows of cells; a digest goes to one cell of each row, where it adds one to
the count and is XORed, as is a check hash of it, into the sums.  Subtracting two sketches cancels what they share; cells that then hold a
single digest give it away and are peeled off, until nothing is left.  If that fails, sketches that are larger for the
number of paragraphs at hand (the digests divided over sub-sketches by their leading bits) are subtracted, and a part that fails there
is retried with 4, 16 and 64 times the cells, in the end by comparing its few digests themselves.

The likeness of two fingerprints is shared / all different paragraphs (1 if there are none).  The fingerprint string is the smallest sketch in hex.

Only DataFrame functions are used.  Null texts are empty; repeated paragraphs count once; ids may be null (first in order) or repeat
(then ordered by text).
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordfold.functions.text import let
from wordfold.storage import materialize

PARAGRAPH = r"[^\n]{120,300}?[.!?]|[^\n]{1,300}"
ROWS, CELLS = 3, 4
#: Digests of both texts that share a sub-sketch, on average.
PER_PART = 6
RETRIES = (CELLS, 4 * CELLS, 16 * CELLS, 64 * CELLS)
ROUNDS = 6
#: Texts (in characters) that share a range of ids, and the most ranges.
RANGE_CHARS, MAX_RANGES = 16_000_000, 100_000


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest)


def _slot(digest: Column, row: int, cells: int) -> Column:
    return F.shiftrightunsigned(digest, 10 * row).bitwiseAND(F.lit(cells - 1))


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _cell(count: Column, key: Column, check: Column) -> Column:
    return F.struct(count.cast("int").alias("n"), key.alias("key"), check.alias("check"))


def _entries(digests_: Column, sign: int) -> Column:
    return F.transform(digests_, lambda d: F.struct(d.alias("key"), F.lit(sign).alias("n"), _check(d).alias("check")))


def sketch(entries: Column, cells: int) -> Column:
    """An array of ``ROWS * cells`` cells (cells: a power of two) from signed entries."""

    def filled(row: int, slot: Column) -> Column:
        mine = F.filter(entries, lambda e: _slot(e["key"], row, cells) == slot)
        return F.aggregate(mine, _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")), _plus)

    slots = F.sequence(F.lit(0), F.lit(cells - 1))
    by_row = [partial(filled, row) for row in range(ROWS)]
    return F.concat(*[F.transform(slots, lambda s: fill(s)) for fill in by_row])  # noqa: B023  applied at once


def _plus(a: Column, b: Column) -> Column:
    return _cell(a["n"] + b["n"], a["key"].bitwiseXOR(b["key"]), a["check"].bitwiseXOR(b["check"]))


def _minus(a: Column, b: Column) -> Column:
    return _cell(a["n"] - b["n"], a["key"].bitwiseXOR(b["key"]), a["check"].bitwiseXOR(b["check"]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, _minus)


def peel(difference: Column, cells: int) -> Column:
    """The number of digests recovered from a subtracted sketch, or null if something is left."""

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["check"]))
        places = lambda c: [(F.lit(row * cells) + _slot(c["key"], row, cells)).alias(f"at{row}") for row in range(ROWS)]
        found = F.array_distinct(F.transform(pure, lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key"), c["check"].alias("check"), *places(c))))

        def without(gone: Column, cell: Column, at: Column) -> Column:
            return F.aggregate(F.filter(gone, lambda g: (g["at0"] == at) | (g["at1"] == at) | (g["at2"] == at)), cell, _minus)

        def after(gone: Column) -> Column:
            left = F.transform(state["cells"], lambda c, i: without(gone, c, i))
            moved = F.struct(left.alias("cells"), (state["found"] + F.size(gone)).alias("found"))
            return F.when(F.size(gone) > 0, moved).otherwise(state)

        return let(found, after)

    start = F.struct(difference.alias("cells"), F.lit(0).alias("found"))
    clean = lambda cs: F.forall(cs, lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(clean(s["cells"]), s["found"]))


def _below(sorted_: Column, bound: Column, field: str | None = None) -> Column:
    """How many entries of an ascending array are below the bound, by halving."""
    value = (lambda x: x[field]) if field else (lambda x: x)
    bits = F.when(F.size(sorted_) > 0, F.length(F.bin(F.size(sorted_)))).otherwise(1)
    steps = F.transform(F.sequence(bits - 1, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(
        steps, F.lit(0), lambda at, s: F.when(F.coalesce(value(F.get(sorted_, at + s - 1)) < bound, F.lit(False)), at + s).otherwise(at)
    )


def _part_difference(part: Column) -> Column:
    """Different digests among a few signed entries: ever larger sketches, in the end the digests themselves."""
    one = lambda sign: F.transform(F.filter(part, lambda e: e["n"] == sign), lambda e: e["key"])
    tries = [peel(sketch(part, cells), cells) for cells in RETRIES]
    return F.coalesce(*tries, F.size(F.array_except(one(1), one(-1))) + F.size(F.array_except(one(-1), one(1))))


def with_difference(df: DataFrame, a: str, b: str, sketch_a: str, sketch_b: str, name: str) -> DataFrame:
    """Adds how many digests are in only one of the arrays a and b, whose smallest sketches are given.

    A sketch of the entries of both, those of b with negative counts, is the difference of their sketches.
    """
    count, failed, entries, cuts = F.col("__count"), F.col("__first").isNull(), F.col("__entries"), F.col("__cuts")
    size = F.size(a) + F.size(b)
    power = F.when(size > PER_PART, F.ceil(F.log2(size / PER_PART))).otherwise(0)
    both = F.array_sort(F.concat(_entries(F.col(a), 1), _entries(F.col(b), -1)))

    def begin(at: Column) -> Column:  # the digests are divided evenly by their value
        bound = (at * (F.lit(2.0**64) / count) - 2.0**63).cast("long")
        return F.when(at == 0, 0).when(at == count, F.size(entries)).otherwise(_below(entries, bound, "key"))

    return (
        df.withColumn("__first", peel(subtract(F.col(sketch_a), F.col(sketch_b)), CELLS))
        .withColumn("__count", F.pow(F.lit(2), power).cast("int"))
        .withColumn("__entries", F.when(failed, both))
        .withColumn("__cuts", F.when(failed, F.transform(F.sequence(F.lit(0), count), begin)))
        .withColumn("__parts", F.when(failed, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(entries, F.get(cuts, i) + 1, F.get(cuts, i + 1) - F.get(cuts, i)))))
        .withColumn(name, F.coalesce("__first", F.aggregate(F.col("__parts"), F.lit(0), lambda n, p: n + _part_difference(p))))
        .drop("__first", "__count", "__entries", "__cuts", "__parts")
    )


def likeness(a: Column, b: Column, differing: Column) -> Column:
    entries = F.size(a) + F.size(b)
    return F.when(entries + differing == 0, 1.0).otherwise((entries - differing) / (entries + differing)).cast("double")


def text_of(sketched: Column) -> Column:
    cells = F.transform(sketched, lambda c: F.concat(F.lpad(F.hex(c["n"]), 4, "0"), F.lpad(F.hex(c["key"]), 16, "0"), F.lpad(F.hex(c["check"]), 16, "0")))
    return F.lower(F.array_join(cells, ""))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__id``, ``text`` and ``next``: the text of the next row by id, of the first row after the last.

    Rows are dealt out by ranges of ids and ordered within each; a copy of the first row of every range closes the one before it.
    """
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    at = F.coalesce(F.col("__id").cast("long"), F.lit(-(2**63)))
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    wanted = min(MAX_RANGES, 1 + chars // RANGE_CHARS)
    shares = [i / wanted for i in range(1, wanted)]
    points = sorted(set(base.agg(F.percentile_approx(at, shares, 10 * wanted)).first()[0] or [])) if shares else []
    dealt = base.withColumn("at", at)
    bound = F.array(*[F.lit(int(p)) for p in points]) if points else F.array().cast("array<bigint>")
    dealt = dealt.withColumn("range", let(F.col("at"), lambda x: _below(bound, x)))
    heads = dealt.groupBy("range").agg(F.min("at").alias("at"))  # at most MAX_RANGES rows
    order = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy()))
    heads = materialize(heads.select("at", before.alias("into")), "heads")
    ghosts = dealt.join(F.broadcast(heads), "at").groupBy("into").agg(F.min("text").alias("text"))
    rows = dealt.withColumn("ghost", F.lit(False)).unionByName(
        ghosts.select(F.lit(None).cast(dict(base.dtypes)["__id"]).alias("__id"), "text", F.lit(0).cast("long").alias("at"), F.col("into").alias("range"), F.lit(True).alias("ghost"))
    )
    following = F.lead("text").over(Window.partitionBy("range").orderBy("ghost", "at", "text"))
    return rows.withColumn("next", following).where(~F.col("ghost")).select("__id", "text", "next")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text is the text with its last quarter replaced by as many first characters of the next text, or all it has.
    """
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - quarter), F.substring("next", F.lit(1), quarter))
    texts = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text")).withColumn("edited", edited)
    cut = texts.select(
        "__id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        *[digests(F.col(t)).alias(name) for t, name in (("text", "a"), ("edited", "e"), ("next", "x"))],
    )
    drawn = cut.select("*", *[sketch(_entries(F.col(c), 1), CELLS).alias("s" + c) for c in "aex"])
    a, e, x = F.col("a"), F.col("e"), F.col("x")
    compared = with_difference(with_difference(drawn, "a", "e", "sa", "se", "de"), "a", "x", "sa", "sx", "dx")
    return compared.select(
        F.col("__id").alias(id_col), "n_chars", "edited_sha256", text_of(F.col("sa")).alias("fingerprint"), text_of(F.col("se")).alias("edited_fingerprint"),
        likeness(a, e, F.col("de")).alias("near_edited"), likeness(a, x, F.col("dx")).alias("near_next"),
    )
