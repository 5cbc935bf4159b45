"""A trie over the turns of conversations, built as a burst trie.

Every turn gets a 128-bit number made of its role, its text and its place.  A conversation is cut into segments of at most
``SEGMENT`` turns, and the exclusive or of the numbers before a segment is the trie node, the *head*, below which the rest, a
*suffix*, belongs.  Equal suffixes below a head are one row with a count, however many copies a conversation has.

1. **Burst**: suffixes are held in containers, one for each head.  A container with more than ``CONTAINER`` suffixes is burst: each
   different first turn becomes a node, that is a head with a container of its own, and the suffixes move there without
   that turn.  This repeats until all containers are small, at most ``SEGMENT`` times.
2. **Sweep**: each remaining container is sorted, and one pass over it with a stack of open nodes gives its nodes.
3. **Sums over subtrees** by doubling: round i adds to each node what its descendants 2^i levels below have gathered.

No container, segment or window grows with the data: a conversation of any length is numbered by `global_rank`, and its segments are
chained in two levels.  The ids of the conversations that end at a node are listed in blocks of ``1 << BLOCK`` consecutive ids, and
one pass over the blocks feeds them to the hash.

Turns come in order of their turn number (null first; equal ones in order of a hash of role and text).  Null roles and texts are
empty.  Rows with a null conversation id are one conversation that never is a node's smallest member unless there is no other, and that is
not listed among the ends.  Repeated rows are turns of their own.  An empty table has no nodes, not even the root.  Other
columns, whatever they are called, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordfold.operators.ranking import global_rank
from wordfold.storage import materialize

SEGMENT = 64
CONTAINER = 1024
#: Segments whose heads one window chains; above that, blocks of as many are chained.
CHAIN = 1024
BLOCK = 16
_FLUSH = 1 << 14  # nodes in a batch

_NODE = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, words bigint, n bigint, least bigint"


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def numbered(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One stored row for each turn: ``c`` (the conversation), ``k`` (its id as text, empty for null), ``pos`` (from 0), ``turns``, ``digest``, ``words``."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    turn = F.col(f"`{turn_col}`")
    rows = convs.select(
        F.col(f"`{conv_col}`").cast("bigint").alias("c"),
        F.coalesce(F.col(f"`{conv_col}`").cast("string"), F.lit("")).alias("k"),
        F.struct(turn.isNotNull(), F.coalesce(turn, F.lit(0))).alias("turn"),
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        words_of(text).alias("words"),
    )
    rows = materialize(rows, "turns")
    return materialize(global_rank(rows, F.struct("k", "turn", "digest"), ["k"], "pos", "turns").drop("turn"), "numbered")


def grafted(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations as if branched off: c begins with the first h turns of c - c % ``every``, and goes on with its own from its h-th on.

    h is crc32(c) % ``most``.  Conversations that have no turns left do not appear.
    """
    id_of = F.col("c") % every == 0
    convs = turns.where("pos = 0").select("c", "k", "turns", (F.col("c") - F.col("c") % every).alias("base"))
    h = F.when(F.col("c").isNull(), 0).otherwise(F.crc32(F.col("k").cast("binary")) % most)
    sizes = convs.where(id_of).select(F.col("c").alias("base"), F.col("turns").alias("base_turns"))
    info = convs.join(sizes, "base", "left").select("c", "k", "base", h.alias("h"), F.least(h, F.coalesce("base_turns", F.lit(0))).alias("taken"))
    info = materialize(info, "grafts")
    own = turns.join(info.select("k", "h", "taken"), "k").where("pos >= h")
    own = own.select("c", "k", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "digest", "words")
    # fewer than ``most`` turns of a base, for at most ``every`` conversations
    heads = turns.where(id_of & (F.col("pos") < most - 1)).select(F.col("c").alias("base"), "pos", "digest", "words")
    taken = info.join(heads, "base").where("pos < h").select("c", "k", "pos", "digest", "words")
    return own.unionByName(taken)


def _chained(parts: DataFrame) -> DataFrame:
    """Adds ``h1`` and ``h2``, the exclusive or of all segments before, in two levels of windows."""
    inside = Window.partitionBy("k", "block").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("block", F.floor(F.col("seg") / CHAIN))
    blocks = parts.groupBy("k", "block").agg(*[F.bit_xor(f"x{i}").alias(f"b{i}") for i in (1, 2)])
    blocks = blocks.select("k", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(across), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    here = lambda i: F.coalesce(F.bit_xor(f"x{i}").over(inside), F.lit(0))
    parts = parts.select("*", *[here(i).alias(f"i{i}") for i in (1, 2)])
    heads = [F.col(f"i{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)]
    return parts.join(blocks, ["k", "block"]).select("c", "k", "seg", "suffix", "x1", "x2", *heads)


def segments(turns: DataFrame) -> DataFrame:
    """The segments of every conversation, stored: ``c``, ``k``, ``seg``, ``suffix``, their own number and their head's."""
    number = [F.xxhash64("digest", "pos", F.lit(i)).alias(f"z{i}") for i in (1, 2)]
    rows = turns.select("c", "k", "pos", "words", *number)
    entry = F.struct("pos", "z1", "z2", "words")
    parts = rows.groupBy("k", F.floor(F.col("pos") / SEGMENT).alias("seg")).agg(
        F.min("c").alias("c"),
        F.array_sort(F.collect_list(entry)).alias("suffix"),
        F.bit_xor("z1").alias("x1"),
        F.bit_xor("z2").alias("x2"),
    )
    parts = parts.withColumn("suffix", F.transform("suffix", lambda e: F.struct(e["z1"], e["z2"], e["words"])))
    return materialize(_chained(parts), "segments")


def _moved(x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y)


def burst(held: DataFrame, container: int = CONTAINER) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of containers that were too large, and all suffixes in small ones.

    ``held`` (a stored table) has ``h1``, ``h2``, ``depth``, ``suffix``, ``n`` and ``least``, no two rows with equal head and suffix.
    """
    nodes, small = [], []
    while True:
        sizes = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > container)
        large = materialize(sizes.drop("rows"), "large")
        if large.isEmpty():
            return nodes, _union([*small, held])
        small.append(held.join(large, ["h1", "h2"], "left_anti"))
        first = F.col("suffix")[0]
        key = [_moved(F.col(f"h{i}"), first[f"z{i}"]).alias(f"k{i}") for i in (1, 2)]
        full = held.join(large, ["h1", "h2"], "left_semi").select("*", *key)
        made = full.groupBy("k1", "k2", F.col("h1").alias("p1"), F.col("h2").alias("p2"), (F.col("depth") + 1).alias("depth")).agg(
            F.max(first["words"]).alias("words"), F.sum("n").alias("n"), F.min("least").alias("least")
        )
        nodes.append(materialize(made, "burst"))
        rest = full.where(F.size("suffix") > 1).select(
            F.col("k1").alias("h1"), F.col("k2").alias("h2"), (F.col("depth") + 1).alias("depth"), F.slice("suffix", 2, SEGMENT).alias("suffix"), "n", "least"
        )
        held = materialize(rest, "held")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _least(a: int | None, b: int | None) -> int | None:
    return a if b is None else b if a is None else min(a, b)


class Sweep:
    """Takes sorted suffixes and gives the nodes on them, each once all suffixes below it were seen."""

    def __init__(self) -> None:
        self.head: tuple | None = None
        self.path: list[tuple[int, int]] = []
        self.open: list[list] = []  # rows of _NODE
        self.done: list[list] = []

    def close(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            self.path.pop()
            if self.open:
                above = self.open[-1]
                above[6] += node[6]
                above[7] = _least(above[7], node[7])
            self.done.append(node)

    def add(self, head: tuple[int, int], depth: int, suffix: list[tuple[int, int]], words: list[int], n: int, least: int | None) -> None:
        shared = 0
        if head == self.head:
            while shared < min(len(self.path), len(suffix)) and self.path[shared] == suffix[shared]:
                shared += 1
        self.close(shared)
        self.head = head
        above = tuple(self.open[-1][:2]) if self.open else head
        for at in range(shared, len(suffix)):
            z = suffix[at]
            key = above[0] ^ z[0], above[1] ^ z[1]
            self.open.append([*key, *above, depth + at + 1, words[at], 0, None])
            self.path.append(z)
            above = key
        self.open[-1][6] += n
        self.open[-1][7] = _least(self.open[-1][7], least)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.done, strict=True)) or [()] * 8
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in _NODE.split(", ")])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = Sweep()
    for batch in batches:
        h1, h2, depth, n, least = (batch.column(c).to_pylist() for c in ("h1", "h2", "depth", "n", "least"))
        suffix = batch.column("suffix")
        at = suffix.offsets.to_pylist()
        z1, z2, words = (suffix.values.field(c).to_pylist() for c in ("z1", "z2", "words"))
        for row in range(batch.num_rows):
            a, b = at[row], at[row + 1]
            sweep.add((h1[row], h2[row]), depth[row], list(zip(z1[a:b], z2[a:b], strict=True)), words[a:b], n[row], least[row])
            if len(sweep.done) >= _FLUSH:
                yield sweep.batch()
    sweep.close(0)
    yield sweep.batch()


def swept(held: DataFrame) -> DataFrame:
    """The nodes of small containers."""
    ordered = held.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "suffix")
    return ordered.select("h1", "h2", "depth", "suffix", "n", "least").mapInArrow(_sweep, _NODE)


def _ends_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, running = None, None

    def result(out: list) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 3
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["k1", "k2", "ends_sha256"])

    for batch in batches:
        out = []
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) == key:
                running.update(b",")
            else:
                if key is not None:
                    out.append((*key, running.hexdigest()))
                key, running = (k1, k2), hashlib.sha256()
            running.update(ids.encode())
        yield result(out)
    if key is not None:
        yield result([(*key, running.hexdigest())])


def ends(convs: DataFrame, parts: DataFrame) -> DataFrame:
    """For each node at which conversations end: ``k1``, ``k2``, ``ends_sha256`` of their ids in numerical order, joined by commas.

    ``convs`` lists all conversations (``c``, ``k``), also those without a segment, which end at the root.
    """
    last = parts.groupBy("k").agg(F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"))
    at = convs.where("c is not null").join(last, "k", "left").select("c", *[F.coalesce(f"k{i}", F.lit(0)).alias(f"k{i}") for i in (1, 2)])
    # at most 1 << BLOCK different ids in a row
    blocks = at.groupBy("k1", "k2", F.shiftright("c", BLOCK).alias("block")).agg(F.sort_array(F.collect_list("c")).cast("array<string>").alias("ids"))
    blocks = blocks.select("k1", "k2", "block", F.array_join("ids", ",").alias("ids"))
    ordered = blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block")
    return ordered.mapInArrow(_ends_hashes, "k1 bigint, k2 bigint, ends_sha256 string")


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``k1``, ``k2`` and the sums of columns over each node's subtree.

    In round i a node adds what the nodes 2^i levels below have gathered over 2^i levels, and then looks 2^(i+1) levels up.
    """
    key, up = ["k1", "k2"], ["a1", "a2"]
    now = nodes.select(*key, F.col("p1").alias("a1"), F.col("p2").alias("a2"), "depth", *sums)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    step = 1
    while step <= deepest:
        gathered = now.where(F.col("depth") >= step).groupBy(*[F.col(a).alias(k) for a, k in zip(up, key, strict=True)])
        gathered = gathered.agg(*[F.sum(s).alias(f"more_{s}") for s in sums])
        added = [(F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums]
        grown = materialize(now.join(gathered, key, "left").select(*key, *up, "depth", *added), "grown")
        further = now.where(F.col("depth") >= step).select(*[F.col(k).alias(a) for a, k in zip(up, key, strict=True)], *[F.col(a).alias(f"b{a}") for a in up])
        # only nodes deep enough look further up, so nobody is joined with the root
        deep = grown.where(F.col("depth") >= 2 * step).join(further, up).select(*key, *[F.col(f"b{a}").alias(a) for a in up], "depth", *sums)
        now = materialize(deep.unionByName(grown.where(F.col("depth") < 2 * step)), "sums")
        step *= 2
    return now.select(*key, *sums)


def nodes(turns: DataFrame, convs: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The trie of conversations given as rows of ``c``, ``k``, ``pos``, ``digest`` and ``words``.

    ``convs`` lists all conversations (``c``, ``k``), also those without turns.  A row for each node: ``node_id`` and ``parent_id``
    (32 hex digits), ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``.  A node's turn is turn ``depth`` (from 1) of conversation ``conv_id``.
    """
    parts = segments(turns)
    held = parts.groupBy("h1", "h2", "seg", "x1", "x2").agg(
        F.first("suffix").alias("suffix"), F.count(F.lit(1)).alias("n"), F.min("c").alias("least")
    )
    held = materialize(held.select("h1", "h2", (F.col("seg") * SEGMENT).alias("depth"), "suffix", "n", "least"), "suffixes")
    made, small = burst(held, container)
    null = F.lit(None).cast("bigint")
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).where("n > 0")
    root = root.select(*[F.lit(0).cast("bigint").alias(f"k{i}") for i in (1, 2)], null.alias("p1"), null.alias("p2"), *[F.lit(0).cast("bigint").alias(c) for c in ("depth", "words")], "n", "least")
    found = materialize(_union([swept(small), root, *made]), "nodes")

    children = found.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    own = found.join(children, ["k1", "k2"], "left").withColumns(
        {
            "n_children": F.coalesce("n_children", F.lit(0)),
            "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint"),
            "saved_tokens": (F.col("n") - 1) * F.col("words"),
        }
    )
    own = materialize(own, "own")
    sums = subtree_sums(own, ["n_leaves", "saved_tokens"])
    parents = found.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent_conv_id"))
    whole = own.drop("n_leaves", "saved_tokens").join(sums, ["k1", "k2"]).join(ends(convs, parts), ["k1", "k2"], "left").join(parents, ["p1", "p2"], "left")
    name = lambda a, b: F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in (a, b)])
    return whole.select(
        name("k1", "k2").alias("node_id"),
        F.when(F.col("depth") > 0, name("p1", "p2")).alias("parent_id"),
        F.col("least").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of conversations as they are; see `nodes`."""
    turns = numbered(convs, conv_col, turn_col, role_col, text_col)
    return nodes(turns, turns.where("pos = 0").select("c", "k"))


def grafted_trie(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of conversations that share the beginning of another one; see `grafted` and `nodes`."""
    turns = numbered(convs, conv_col, turn_col, role_col, text_col)
    return nodes(grafted(turns), turns.where("pos = 0").select("c", "k"))
