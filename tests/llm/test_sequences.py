"""Packing, fill-in-the-middle and the conversation trie against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from wordfold.llm import fim, packing, trie  # noqa: E402
from wordfold.llm.queries import tokenizer_path  # noqa: E402

PATH = "word_bpe_49k.json"
DOCS = "doc_id bigint, text string, `a.b` string, length string, start int, pieces int, id string, `row` string, cut int, __k int, rank int, total int"
CLASHES = ("y", "z", 1, 2, "i", "r", 3, 4, 5, 6)
WORDS = "alpha Beta gamma's été, STRASSE straße ñandú! 東京 مرحبا नमस्ते Ünï ﬁne x9 --- <|endoftext|> İstanbul ΣΑΣ éa".split(" ")


def texts():
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", "\t ", "  "]) for _ in range(n))
    rows = [(i, some(rng.randint(1, 120))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n"), (63, " x"), (64, "x "), (65, "a <P> b c d"), (66, "<M>"), (67, "<P <S >M>"), (None, rows[3][1]), (None, None)]
    rows += [(68, rows[5][1]), (68, rows[5][1]), (69, some(9000)), (70, "nospace" * 5000), (71, "ab " * 300_000), (-3, some(30))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, *CLASHES) for d, t in texts()], DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def count(rows):
    return collections.Counter(tuple(r) for r in rows)


# ---------------------------------------------------------------- packing


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(PATH))


def test_packing(spark, docs, empty):
    capacity = 512
    tok = library()
    want = collections.Counter()
    for d, t in texts():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[(d, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    found = packing.pack(docs, tokenizer_path(PATH), capacity=capacity).collect()
    assert count(r[:5] for r in found) == want
    placed = collections.defaultdict(list)
    for r in found:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in placed.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(k[3] * n for k, n in want.items())
    assert len(placed) <= -(-total // capacity) + 1
    none = packing.pack(empty, tokenizer_path(PATH))
    assert none.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and none.count() == 0


def test_sequences(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "four " * 30), (4, "five six")], "doc_id bigint, text string")
    tok = library()
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs.collect()}
    seen = collections.defaultdict(dict)
    rows = packing.sequences(docs, tokenizer_path(PATH), capacity=12).collect()
    for r in rows:
        whole = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(whole) == sum(p["length"] for p in r["parts"]) <= 12
        for p in r["parts"]:
            seen[p["doc_id"]][p["piece"]] = whole[p["offset"] : p["offset"] + p["length"]]
    assert {d: [x for _, part in sorted(p.items()) for x in part] for d, p in seen.items()} == ids


def fewest(lengths, capacity):
    """The fewest sequences, by trying where each piece goes."""
    best = [len(lengths)]

    def go(rest, rooms):
        if len(rooms) >= best[0]:
            return
        if not rest:
            best[0] = len(rooms)
            return
        head, *tail = rest
        for at in range(len(rooms)):
            if rooms[at] >= head and rooms[at] not in rooms[:at]:
                go(tail, [*rooms[:at], rooms[at] - head, *rooms[at + 1 :]])
        go(tail, [*rooms, capacity - head])

    go(sorted(lengths, reverse=True), [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(11)
    fixed_some = 0
    for _ in range(400):
        capacity = rng.randint(6, 30)
        low = rng.choice([1, 1, capacity // 4 or 1, capacity // 3 or 1])
        lengths = [rng.randint(low, capacity) for _ in range(rng.randint(1, 9))]
        left = collections.Counter(lengths)
        fixed = packing.reduce_dominated(left, capacity)
        n = sum(k.n for k in fixed)
        assert n + fewest(list(left.elements()), capacity) == fewest(lengths, capacity), (capacity, lengths)
        fixed_some += n
        made = packing.plan(collections.Counter(lengths), capacity)
        assert collections.Counter(x for k in made.kinds for _ in range(k.n) for x, m in k.parts for _ in range(m)) == collections.Counter(lengths)
        assert all(sum(x * m for x, m in k.parts) + k.room == capacity and k.room >= 0 for k in made.kinds)
        assert made.sequences <= fewest(lengths, capacity) + 1
    assert fixed_some > 400


def test_plan_in_bulk():
    """Counts far above what could be handled piece by piece, next to plain best fit on a small multiple."""
    rng = random.Random(2)
    counts = {s: rng.randint(1, 6) for s in rng.sample(range(1, 4097), 700)}
    rooms: list[int] = []
    for s in sorted(collections.Counter(counts).elements(), reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(4096 - s)
    assert sum(k.n for k in packing.best_fit(collections.Counter(counts), 4096)) == len(rooms)
    many = {s: n * 1_000_000_000 for s, n in counts.items()}
    made = packing.plan(many)
    assert made.sequences <= len(rooms) * 1_000_000_000 and len(made.kinds) < 4 * 4096
    for length, runs in made.runs().items():
        assert runs[0].at == 0 and all(a.at < b.at for a, b in itertools.pairwise(runs)) and many[length] > runs[-1].at
    with pytest.raises(ValueError):
        packing.plan({4097: 1})


# ---------------------------------------------------------------- fill in the middle


def rearranged(d, t, seed=42):
    t = t or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("seed", [42, 7])
def test_fill_in_middle(docs, empty, seed):
    found = fim.rearrange(docs, seed=seed)
    rows = found.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", fim.restore(F.col("output"), F.col("form")).alias("back"))
    assert found.columns == [*docs.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    got = rows.collect()
    assert count(r[:7] for r in got) == count((d, t, *rearranged(d, t, seed)) for d, t in texts())
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.rearrange(empty).count() == 0
    with pytest.raises(ValueError):
        fim.rearrange(docs.withColumn("n", F.lit(1)))


def test_other_marks(docs):
    marks = fim.Marks("(", "[", "*")
    rows = fim.rearrange(docs, percent=100, spm_percent=50, marks=marks)
    got = rows.select("text", "form", fim.restore(F.col("output"), F.col("form"), marks).alias("back")).collect()
    assert all(r["back"] == (r["text"] or "") for r in got) and {"psm", "spm"} <= {r["form"] for r in got}


def test_wavelet_matrix():
    rng = random.Random(1)
    for size in (0, 1, 7, 511, 512, 513, 5000):
        symbols = np.array([rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(size)], np.uint8)
        matrix = fim.WaveletMatrix(symbols)
        for end in sorted({0, size, *(rng.randint(0, size) for _ in range(60))}):
            assert [matrix.rank(s, end) for s in range(4)] == np.bincount(symbols[:end], minlength=4).tolist()


# ---------------------------------------------------------------- conversation trie

CONVS = "conv_id bigint, turn bigint, role string, text string, k string, c int, pos int, words string, seg int"


def conversations():
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 47), 60, 61, 62, 101, 115, -7]:
        if c in (20, 33):
            continue
        for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hi there", "x  y\tz", "", None, "東京 é"])))
    rows += [(5, None, None, None), (5, 0, "user", "again"), (6, 0, "user", "hi"), (None, 1, "user", "hi"), (None, 0, None, None)]
    # long ones that agree for a while, and copies
    long = [("user", f"turn {i}") for i in range(70)]
    for c, n in ((200, 70), (220, 70), (240, 40), (260, 65), (280, 70)):
        rows += [(c, i, *long[i]) for i in range(n)] + [(c, n, "user", f"{c % 40}")]
    return rows


def plain_trie(rows, graft):
    by_conv = collections.defaultdict(list)
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    for c, t, r, x in rows:
        by_conv[c].append(((t is not None, t or 0, digest(r or "", x or "")), (r or "", x or "")))
    turns = {c: [x for _, x in sorted(own)] for c, own in by_conv.items()}
    rebuilt = {}
    for c, own in turns.items():
        if not graft or c is None:
            rebuilt[c] = own
            continue
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / 20) * 20 if c < 0 else c % 20
        rebuilt[c] = turns.get(c - base, [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, ids in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(ids) - 1) * words
    out = []
    for p, ids in members.items():
        ends = sorted(c for c in ids if c is not None and len(rebuilt[c]) == len(p))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((least(ids), len(p), least(members[p[:-1]]) if p else None, len(ids), kids[p], leaves[p], saved[p], sha))
    return collections.Counter(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def convs(spark):
    return spark.createDataFrame([(*r, "k", 1, 2, "w", 3) for r in conversations()], CONVS).repartition(3).persist()


@pytest.mark.parametrize("graft", [True, False])
def test_trie(convs, graft):
    found = (trie.grafted_trie if graft else trie.prefix_trie)(convs)
    assert count(found.select(*COLUMNS).collect()) == plain_trie(conversations(), graft)


def test_trie_that_bursts(convs, monkeypatch):
    """Small containers, segments, chains and blocks of ids, so that every step has much to do."""
    for name, value in (("SEGMENT", 3), ("CHAIN", 2), ("BLOCK", 2)):
        monkeypatch.setattr(trie, name, value)
    turns = trie.numbered(convs)
    found = trie.nodes(trie.grafted(turns), turns.where("pos = 0").select("c", "k"), container=2)
    rows = found.collect()
    assert count([r[c] for c in COLUMNS] for r in rows) == plain_trie(conversations(), True)
    ids = {r["node_id"]: r for r in rows}
    assert len(ids) == len(rows)
    assert all(ids[r["parent_id"]]["depth"] == r["depth"] - 1 for r in rows if r["depth"])


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], CONVS)
    assert trie.grafted_trie(none).select(*COLUMNS).count() == 0
    # a conversation whose turns are all replaced by those of an absent one
    gone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    one = spark.createDataFrame([(gone, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r) for r in trie.grafted_trie(one).select(*COLUMNS).collect()] == [(gone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())]
