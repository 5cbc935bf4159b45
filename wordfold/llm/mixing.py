"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are summed by membership pattern; a flow routes the words of
patterns to the quotas of the sources, where each further pass over the same words costs more than the one before
(convex), and as many words are routed as possible.  A pattern's words are then taken from its documents in an order drawn
by a seeded hash: everybody gets the whole passes, the documents up to a threshold one more.  Behind the one that does not
fit any more, this goes on with the documents that fit into the words left, and the largest one that fits may end it.

Only one row per pattern and step comes to the driver, and its thresholds go back, so documents are
decided where they are read.  The threshold is found from sums over ``BUCKETS`` ranges of the hash and then inside a
single range.  A driver that solves for more than ``MAX_PATTERNS`` patterns is refused with an error rather than run partly.

Null texts have size 0 and null sources are a source of their own, last in order.  Documents of size 0 are taken once, at no words.
Rows that agree in id and text get the same answer.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordfold.llm import rows
from wordfold.storage import materialize

SEED = 20240607
PASSES = 2
BUCKETS = 1 << 12
MAX_PATTERNS = 200_000
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
#: A pattern is filled up to this share of its words, if documents are left that fit.
ENOUGH = 0.001

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def targets(sizes: dict, order: list, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> dict:
    """The words wanted of each source: shares by weight, none above ``passes`` times its size, the excess reshared."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, left, out = list(order), share * sum(sizes.values()), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit >= passes * sizes[s]]
        if not full:
            out |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            out[s] = float(passes * sizes[s])
            left -= out[s]
        left = max(left, 0.0)
        open_ = [s for s in open_ if s not in out]
    return out


def route(patterns: dict[tuple, int], quotas: dict, passes: int = PASSES) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources.

    Successive shortest paths from quotas left to patterns with words left: pass k of a pattern costs k.  Pattern and source
    nodes only; paths may take words back from another source of a pattern.
    """
    flow: dict[tuple, dict] = {p: defaultdict(int) for p in patterns}
    used = dict.fromkeys(patterns, 0)
    left = {s: int(round(q)) for s, q in quotas.items()}
    of_source = defaultdict(list)
    for p in patterns:
        for s in set(p):
            of_source[s].append(p)

    def give(s, cost: int) -> int:
        """Route words to s over patterns whose current pass costs at most ``cost``; 0 if there is no path."""
        came = {("s", s): None}
        queue = [("s", s)]
        for node in queue:
            kind, x = node
            if kind == "s":
                following = [("p", p) for p in of_source[x] if patterns[p]]
            else:
                if used[x] < (cost + 1) * patterns[x]:
                    path = [node]
                    while came[path[-1]] is not None:
                        path.append(came[path[-1]])
                    path.reverse()  # source, pattern, source, pattern, ..., pattern with words left
                    amount = min(left[s], (cost + 1) * patterns[x] - used[x])
                    for a, b in zip(path[1:-1:2], path[2:-1:2], strict=True):
                        amount = min(amount, flow[a[1]][b[1]])
                    for a, b in zip(path[0::2], path[1::2], strict=True):
                        flow[b[1]][a[1]] += amount
                    for a, b in zip(path[1:-1:2], path[2:-1:2], strict=True):
                        flow[a[1]][b[1]] -= amount
                    used[x] += amount
                    left[s] -= amount
                    return amount
                following = [("s", o) for o, n in flow[x].items() if n > 0]
            for f in following:
                if f not in came:
                    came[f] = node
                    queue.append(f)
        return 0

    for cost in range(passes):  # cheap passes first keeps the total cost least, since costs depend on the pattern alone
        for s in quotas:
            while left[s] > 0 and give(s, cost):
                pass
    return flow


def sized(docs: DataFrame, id_col: str, text_col: str, members: Column, seed: int = SEED) -> DataFrame:
    """The narrow table everything is decided on: id, pattern (sources in order, null last), size, hash."""
    pattern = F.array_sort(F.array_distinct(members))
    return docs.select(F.col(id_col).alias("__id"), pattern.alias("pattern"), size_of(text_col).alias("size"), draw(id_col, text_col, seed).alias("h"))


_HERE = "size between least and fit and not ((h ^ shiftleft(1L, 63)) < (cut ^ shiftleft(1L, 63)) or (closed and h = cut))"


def _cut(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """For each pattern the last hash whose documents get one more pass, so that they sum up to at most ``words``.

    ``extra`` has the documents that are looked at: those beyond ``cut`` with ``least`` to ``fit`` words.  Comes back with the words left
    (``room``) and the largest document beyond the new cut that fits into these.
    """
    extra = F.broadcast(extra)
    rows = rows.join(extra, "pattern").where(_HERE).select("pattern", "size", "h")
    bucket = F.shiftrightunsigned("h", 64 - (BUCKETS.bit_length() - 1))
    sums = materialize(rows.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("n")), "hash-sums")
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    placed = sums.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0))).join(extra, "pattern")
    edge = placed.where("below <= words and below + n > words").select("pattern", "bucket", "below", "words")
    inside = rows.withColumn("bucket", bucket).join(F.broadcast(edge), ["pattern", "bucket"])
    upto = Window.partitionBy("pattern").orderBy(F.expr("shiftrightunsigned(h, 1)"), "h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = inside.withColumn("sum", F.col("below") + F.sum("size").over(upto)).where("sum <= words")
    last = taken.groupBy("pattern").agg(F.max(F.struct(F.expr("shiftrightunsigned(h, 1)").alias("a"), "h")).alias("last"), F.max("sum").alias("sum"))
    start = F.shiftleft(F.col("bucket"), 64 - (BUCKETS.bit_length() - 1)).alias("start")
    whole = sums.groupBy("pattern").agg(F.sum("n").alias("all")).join(extra, "pattern").select("pattern", "all", "words")
    cuts = whole.join(edge.select("pattern", "below", start), "pattern", "left").join(last, "pattern", "left")
    everything = F.col("start").isNull()  # all documents that are looked at fit
    room = F.col("words") - F.when(everything, F.col("all")).otherwise(F.coalesce("sum", "below"))
    cuts = materialize(
        cuts.select(
            "pattern",
            F.when(everything, F.lit(-1)).otherwise(F.coalesce("last.h", "start")).alias("cut"),
            (everything | F.col("last").isNotNull()).alias("closed"),
            room.alias("room"),
        ),
        "cuts",
    )
    beyond = rows.join(F.broadcast(cuts.withColumnsRenamed({"room": "fit"}).withColumn("least", F.lit(1))), "pattern").where(_HERE)
    filler = beyond.groupBy("pattern").agg(F.max(F.struct("size", "h")).alias("filler"))
    return cuts.join(filler, "pattern", "left").select("pattern", "cut", "closed", "room", F.col("filler.size").alias("size"), F.col("filler.h").alias("filler"))


def _cuts(rows: DataFrame, words: dict[tuple, int], enough: dict[tuple, int]) -> dict[tuple, tuple[list, int | None]]:
    """For each pattern the steps (cut, closed, least, fit) and the filler that reach its words.

    Each step goes on in the order of the hashes behind the document that did not fit, with those that fit into the words still left, until
    none does or at most ``enough`` words are missing.  Of all steps, the one that comes closest together with its largest document beyond is the last.
    """
    spark = rows.sparkSession
    steps: dict[tuple, list] = {p: [] for p in words}
    best: dict[tuple, tuple] = {}
    # the unsigned hash 0, not closed: all documents are beyond it
    now = [(list(p), 0, False, 0, (1 << 63) - 1, n) for p, n in words.items()]
    while now:
        at = {tuple(x[0]): x for x in now}
        found = _cut(rows, spark.createDataFrame(now, "pattern array<string>, cut bigint, closed boolean, least bigint, fit bigint, words bigint")).collect()
        now = []
        for r in found:
            p = tuple(r["pattern"])
            steps[p].append((r["cut"], r["closed"], *at[p][3:5]))
            missing = r["room"] - (r["size"] or 0)
            if p not in best or missing < best[p][0]:
                best[p] = (missing, len(steps[p]), r["filler"])
            if r["size"] and best[p][0] > enough[p]:
                now.append((r["pattern"], r["cut"], r["closed"], 1, r["room"], r["room"]))
    return {p: (steps[p][:n], filler) for p, (_, n, filler) in best.items()}


def plan(docs: DataFrame, id_col: str, text_col: str, members: Column, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = SEED):
    """The narrow table, and per pattern: whole passes, threshold of one more, and per source size and target."""
    spark = docs.sparkSession
    rows = materialize(sized(docs, id_col, text_col, members, seed), "sizes")
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} combinations of sources")
    patterns = {tuple(r["pattern"]): r["n"] for r in sums if r["pattern"]}
    sizes: dict = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = targets(sizes, order, weights, share, passes)
    flow = route(patterns, wanted, passes)
    routed = {p: sum(flow[p].values()) for p in patterns}
    whole = {p: min(routed[p] // n, passes) if n else 1 for p, n in patterns.items()}
    left = {p: routed[p] - whole[p] * n for p, n in patterns.items() if n and routed[p] > whole[p] * n}
    cuts = _cuts(rows, left, {p: int(routed[p] * ENOUGH) for p in left})
    table = [(list(p), whole[p], *cuts.get(p, (None, None)), [(s, sizes[s], wanted[s]) for s in p]) for p in patterns]
    steps = "array<struct<cut:bigint,closed:boolean,least:bigint,fit:bigint>>"
    schema = f"pattern array<string>, whole bigint, steps {steps}, filler bigint, sources array<struct<source:string,source_size:bigint,target:double>>"
    return rows, spark.createDataFrame(table, schema)


def copies(h: str = "h", size: str = "size") -> Column:
    """How often a document is taken, after its row was joined with the plan of its pattern.  Hashes are ordered as unsigned numbers."""
    before = f"({h} ^ shiftleft(1L, 63)) < (s.cut ^ shiftleft(1L, 63)) or (s.closed and {h} = s.cut)"
    more = F.expr(f"exists(steps, s -> {size} between s.least and s.fit and ({before}))") | F.coalesce(F.expr(f"{h} = filler"), F.lit(False))
    return F.coalesce(F.col("whole"), F.lit(0)) + F.when(F.col("steps").isNotNull() & more, 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted)."""
    rows, plans = plan(docs, id_col, text_col, F.array(F.col(source_col)))
    found = rows.join(F.broadcast(plans), "pattern", "left")
    first = F.col("sources")[0]
    return found.select(
        F.col("__id").alias(id_col), "size", first["source_size"].alias("source_size"), first["target"].alias("target"), (copies() * F.col("size")).alias("taken")
    )


def take_mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: rows left out, once or repeated.  Columns may have any names."""
    _, plans = plan(docs, id_col, text_col, F.array(F.col(source_col)))
    docs = rows.packed(docs, id_col, text_col, source_col)
    marked = docs.select(
        rows.ROW, draw(id_col, text_col, SEED).alias("h"), size_of(text_col).alias("words"), F.array(F.col(source_col)).alias("of")
    )
    found = marked.join(F.broadcast(plans), F.col("of").eqNullSafe(F.col("pattern")), "left")
    times = found.withColumn("times", copies("h", "words").cast("int")).where("times > 0")
    return rows.unpacked(times.select(rows.ROW, F.explode(F.sequence(F.lit(1), F.col("times")))))
