"""The dealt operators against brute force, on rows with nulls, ties, empty and long texts, and on an empty table."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from wordfold.llm import bloom, exact, graph, langid, mixing, pieces, queries, radix, sample, sentences, simhash, sketch, tokens, urls  # noqa: E402
from wordfold.llm.queries import tokenizer_path  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, pieces int, __extra string"
WORDS = "alpha beta Gamma delta epsilon zeta eta theta iota kappa lambda mu été straße ñandú 東京".split()


def _texts():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.15 else "") + ("\n" if rng.random() < 0.05 else "") for _ in range(n))
    passage = text(90)
    rows = [(i, text(rng.randint(1, 120))) for i in range(30)]
    rows += [(30 + i, text(40) + "\n" + passage + "\n" + text(30)) for i in range(4)]
    rows += [(40, rows[3][1]), (41, rows[3][1].upper().replace("É", "é")), (42, rows[5][1] + " tail"), (43, None), (44, ""), (45, " \n\t "), (46, "..!!"), (None, rows[7][1])]
    rows += [(47, passage), (47, passage), (48, "x" * 3000), (49, "<|endoftext|> it's <|endoftext|>"), (50, "\u0558 a\u1c8a \U000323b0 \u2581 b"), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en" if (d or 0) % 2 else None, [None, "a", "b"][(d or 0) % 3], 0, "x", 1, "y") for d, t in _texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def count(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_exact(docs, empty):
    groups = collections.defaultdict(list)
    for d, t in _texts():
        groups[lower(t)].append(d)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        for i, d in enumerate(sorted(ids, key=lambda d: (d is None, -(d or 0)))):
            want[(d, keep, len(ids), i == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert count(exact.exact_groups(docs).collect()) == want
    kept = exact.drop_exact(docs)
    assert kept.columns == docs.columns
    assert count(kept.select("doc_id").collect()) == count((k[0],) for k in want.elements() if k[3])
    assert exact.exact_groups(empty).count() == 0 and exact.drop_exact(empty).count() == 0


def _print(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(prints):
    """prints: (id, fingerprint) rows; the smallest id reachable of each row."""
    values = sorted({f for _, f in prints})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f, least.get(find(f))) for d, f in prints]


def test_simhash(docs, empty):
    want = _components([(d, _print(t)) for d, t in _texts()])
    assert count(simhash.near_groups(docs).collect()) == count((d, f"{f:016x}", c) for d, f, c in want)
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns and kept.count() == len({(c, f if c is None else 0) for _, f, c in want})
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near(empty).count() == 0


def test_simhash_long_text():
    text = " ".join(random.Random(1).choice(WORDS) for _ in range(70_000))
    value = simhash.fingerprint_of(text.encode())
    assert value % (1 << 64) == _print(text)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_links_of_crowded_buckets(spark, monkeypatch, bucket):
    """Paired up or met at flipped bits, the same components."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    prints = spark.createDataFrame(signed, "fp bigint")
    roots = dict(graph.components(simhash._links(prints)).collect())
    got = collections.Counter(roots.get(v, v) for (v,) in signed)
    want = collections.Counter(c for _, _, c in _components([(v, v) for v in values]))
    assert sorted(got.values()) == sorted(want.values())


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    roots = dict(graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert roots == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_gradients():
    rng = np.random.default_rng(0)
    w = langid._initial(rng, 3)
    x = rng.integers(97, 103, (6, 5)).astype(np.uint8)
    mask = np.ones((6, 5), np.float32)
    mask[4:, 2] = 0
    label = np.array([0, 1, 2, 1, 0])
    _, g = langid.gradients(w, x, mask, label)
    for name, value in w.items():
        flat = value.reshape(-1)
        at = int(np.abs(g[name]).argmax())
        old = flat[at]
        flat[at] = old + 1e-2
        above, _ = langid.gradients(w, x, mask, label)
        flat[at] = old - 1e-2
        below, _ = langid.gradients(w, x, mask, label)
        flat[at] = old
        assert abs((above - below) / 2e-2 - g[name].reshape(-1)[at]) < 1e-3


def test_samples_are_the_smallest_hashes(spark):
    many = [("a", k, f"a{k}") for k in range(-(2**63), 2**63, 2**64 // 5000)]
    table = [*many, *[("a", -(2**61), "z")] * 3000, *[("b", 7, "y"), ("b", 7, "x"), ("b", 3, "w"), (None, 1, "v")]]
    found = sample.smallest_hashes(spark.createDataFrame(table, "g string, h long, v string").repartition(7), "g", "h", F.col("v"), 100)
    want = [(g, h) for g, h in sorted({r[:2] for r in table if r[0]}) if g == "b"] + sorted({r[:2] for r in table if r[0] == "a"})[:100]
    got = found.collect()
    assert sorted((r["g"], r["h"]) for r in got) == sorted(want)
    assert {r["value"] for r in got if r["g"] == "b"} == {"w", "x"}
    assert sample.smallest_hashes(spark.createDataFrame([], "g string, h long, v string"), "g", "h", F.col("v"), 2).count() == 0


def test_language_id(spark, docs, empty):
    rng = random.Random(1)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    kinds = {"x": ["ba", "lo", "mi", "ru"], "y": ["str", "kn", "oet", "zu"]}
    rows = [(i, make(kinds["xy"[i % 2]], 40), "xy"[i % 2]) for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = langid.identify(table, langid.fit(table)).select("doc_id", "lang_pred", "score", langid.held_out().alias("h")).collect()
    assert all(r["lang_pred"] == "xy"[r["doc_id"] % 2] and 0 <= r["score"] <= 1 for r in found if r["h"])
    assert {r["doc_id"] for r in found if r["h"]} == {i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2}
    odd = langid.identify(docs, langid.fit(table)).collect()
    for r in odd:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    assert langid.fit(empty) is None and langid.identify(empty, None).count() == 0
    kept = langid.drop_unidentified(table)
    assert kept.columns == table.columns and kept.count() == 120


def test_pieces(docs, empty):
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = tokenizer_path("piece_bpe_32k.model")
    model = pb.ModelProto()
    model.ParseFromString(open(path, "rb").read())
    model.trainer_spec.model_type = 1  # the same pieces and scores under the unigram rule
    library = sp.SentencePieceProcessor(model_proto=model.SerializeToString())
    codec = pieces.codec(path)
    score = lambda ids: sum(library.get_score(i) for i in ids)
    for _, t in _texts()[:30]:
        line = t[:120].replace("\n", " ")
        got, want = list(codec.encode(line)), library.piece_to_id(library.nbest_encode_as_pieces(line, 1)[0])
        # the library adds scores in 32 bits, which are exact up to 2**24; beyond, ours must be at least as good
        if not any(library.is_byte(i) for i in got):
            assert score(got) == score(want) if abs(score(got)) < 2**24 else score(got) >= score(want)
    for r in pieces.encode_checked(docs, path).collect():
        assert r["round_trip"] or r["doc_id"] == 50  # holds U+2581 itself
    both = docs.select("text", pieces.encode(docs["text"], path).alias("ids")).withColumn("back", pieces.decode(pieces.F.col("ids"), path))
    assert all(r["back"] == (r["text"] or "") for r in both.collect() if "\u2581" not in (r["text"] or ""))
    assert pieces.encode_checked(empty, path).count() == 0
    word = "\u2581" + "ab東\U0001f9ff" * 30  # longer than the cache holds, with characters that have no piece
    assert codec.decode(codec.segment(word)) == word[1:]


def test_viterbi_by_brute_force():
    codec = pieces.codec(tokenizer_path("piece_bpe_32k.model"))
    import sentencepiece as sp

    model = sp.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    known = {p: model.get_score(i) for i, p in enumerate(codec.pieces) if i > 258}

    def best(word):
        top = [0.0] + [float("-inf")] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(e):
                if word[s:e] in known:
                    top[e] = max(top[e], top[s] + known[word[s:e]])
        return top[-1]

    for word in ("\u2581the", "\u2581straße", "\u2581internationalization", "theththe"):
        assert sum(known[codec.pieces[i]] for i in codec.segment(word)) == best(word)


def test_tokens(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in docs.withColumn("n", tokens.count_tokens(docs, path)).collect():
        assert r["n"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
    assert empty.withColumn("n", tokens.count_tokens(empty, path)).count() == 0


def test_cuts_agree_on_usual_characters():
    from tokenizers import pre_tokenizers

    library = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for c in range(0x20000):
        if 0xD800 <= c < 0xE000 or tokens.RARE.search(chr(c)):
            continue
        text = f"a{chr(c)}1{chr(c)}"
        assert [o for _, o in library.pre_tokenize_str(text)] == [m.span() for m in tokens.PRE_TOKEN.finditer(text)], hex(c)


def test_windows(spark, docs, empty):
    length = 100  # enough repeats in small texts
    seen = collections.Counter()
    raw = [(d, (t or "").encode()) for d, t in _texts()]
    for _, b in raw:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    want = collections.Counter()
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        want[(d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g))] += 1
    got = radix.remove_repeated_bytes(docs, length).select("doc_id", "__cut.*")
    assert count((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.collect()) == want
    assert radix.remove_repeated_bytes(empty).count() == 0


def test_zones_cover_every_window():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    starts = np.array([0, 1200, 1200, 1500, 5000])
    text, first, n, _ = radix.zones_of(data, starts)
    got = {(int(t), w) for t, f, k in zip(text, first, n) for w in range(int(f), int(f + k))}
    assert got == {(t, w) for t in range(4) for w in range(starts[t], starts[t + 1] - radix.LENGTH + 1)}


def test_sentences(docs, empty):
    found = {r["doc_id"]: r for r in sentences.remove_repeated(docs).select("doc_id", "text", "__found.*").collect() if r["doc_id"] is not None}
    assert found[30]["n_removed"] == 0 and all(found[i]["n_removed"] >= 4 for i in (31, 32, 33))
    assert found[40]["n_removed"] == found[40]["n_sentences"] or len(words(found[40]["text"])) < sentences.WORDS
    for r in found.values():
        assert r["n_removed"] or r["kept"] == (r["text"] or "")
    for _, t in _texts():
        ends = sentences.sentences((t or "").encode())[0]
        assert not ends or ends[-1] == len((t or "").encode())
    assert sentences.remove_repeated(empty).count() == 0


def test_passages_inside_long_lines(spark):
    """A passage without sentence ends that starts at another word of a line each time."""
    rng = random.Random(4)
    line = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts, size = [], {}
    for p in range(20):
        passage = line(60)
        texts.append((2 * p, " ".join(line(rng.randrange(1, 40)) + passage + line(30))))
        texts.append((2 * p + 1, " ".join(line(rng.randrange(1, 40)) + passage + line(30))))
        size[2 * p + 1] = set(passage)
    for r in sentences.remove_repeated(spark.createDataFrame(texts, "doc_id bigint, text string")).select("doc_id", "text", "__found.*").collect():
        gone = set(words(r["text"])) - set(words(r["kept"]))
        assert gone <= size.get(r["doc_id"], set())
        if r["doc_id"] % 2:
            assert len(gone) >= sentences.WORDS, r["doc_id"]


def test_pieces_of_sentences():
    rng = random.Random(6)
    for n in (17, 40, 3000):
        for kinds in (1, 2, 5000):
            cuts = sentences.pieces([b"w%d" % rng.randrange(kinds) for _ in range(n)])
            assert cuts[-1] == n and all(0 < b - a <= sentences.LONGEST for a, b in zip([0, *cuts], cuts))


def test_mix(docs, empty):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    assert count(rows) == count(again) and len(rows) == len(_texts())
    sums = collections.defaultdict(lambda: [0, 0])
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sums[(r["source_size"], r["target"])][0] += r["taken"]
        sums[(r["source_size"], r["target"])][1] += r["size"]
    for (size, target), (taken, own) in sums.items():
        assert own == size and abs(taken - target) <= 0.2 * target
    taken = mixing.take_mixed(docs)
    assert taken.columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.take_mixed(empty).count() == 0


def test_mix_goes_on_behind_a_long_document(spark):
    """Each source has documents of many sizes, and the first that does not fit is often a long one."""
    rng = random.Random(2)
    sizes = [(s, n) for s in range(6) for n in [300, 200, *(rng.choice((3, 5, 8, 13, 40)) for _ in range(100))]]
    table = spark.createDataFrame([(i, "w " * n, f"s{s}") for i, (s, n) in enumerate(sizes)], "doc_id bigint, text string, source string")
    rows = mixing.mix(table).join(table, "doc_id").collect()
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    assert {r["taken"] // r["size"] for r in rows} == {0, 1, 2}
    for own in by_source.values():
        short = own[0]["target"] - sum(r["taken"] for r in own)
        least, most = min(r["taken"] // r["size"] for r in own), max(r["taken"] // r["size"] for r in own)
        fitting = [r["size"] for r in own if most > least == r["taken"] // r["size"] and r["size"] <= short]
        assert -1 <= short and (not fitting or short <= 0.001 * own[0]["target"] + 1)
    assert mixing.take_mixed(table).selectExpr("sum(size(split(trim(text), ' ')))").first()[0] == sum(r["taken"] for r in rows)


def test_targets_and_flow():
    got = mixing.targets({"a": 10, "b": 1000, "c": 990}, ["a", "b", "c"])
    assert got["a"] == 20 and abs(sum(got.values()) - 3000) < 1e-6 and got["b"] <= 2000
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 20, "b": 15})
    assert sum(flow[("a",)].values()) + sum(flow[("a", "b")].values()) + sum(flow[("b",)].values()) == 35
    assert flow[("a", "b")]["a"] + flow[("a", "b")]["b"] <= 20 and flow[("a",)]["a"] <= 20 and flow[("b",)]["b"] <= 10


def test_sketches(docs, empty):
    found = sketch.fingerprints(docs).collect()
    rows = sorted(_texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = collections.Counter()
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        t, following = t or "", following or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        cut = lambda s: set(re.findall(sketch.PARAGRAPH, s))
        near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        want[(d, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(near(cut(t), cut(edited)), 9), round(near(cut(t), cut(following)), 9))] += 1
    assert count((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found) == want
    by_edited = {r["edited_sha256"]: r["edited_fingerprint"] for r in found}
    assert all(by_edited[r["edited_sha256"]] == r["edited_fingerprint"] for r in found)
    assert sketch.fingerprints(empty).count() == 0


def test_urls(spark):
    cases = {
        "http://A.Example.NET/en/1?x": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/fr/": ("example.net", "/fr/", "net/", "block"),
        "http://example.net?q": ("example.net", "", None, None),
        "http://my.example.com/de/#a": ("my.example.com", "/de/", "example.com/de/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, None),
        "ftp://x.org/fr/a://b": ("x.org", "/fr/a://b", "org/fr/", "allow"),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
        "http://" + "x" * 5000 + ".org/\n": ("x" * 5000 + ".org", "/\n", None, None),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id bigint, url string, host string")
    for r, want in zip(sorted(urls.judge(pages).collect()), cases.values()):
        assert (r["host"], r["path"], r["rule"]) == want[:3] and r["verdict"] in ([want[3]] if want[3] else ["allow", "block"])
    assert urls.judge(pages.limit(0)).count() == 0


CLASHING = "pattern whole steps filler sources h size cover edges pieces a.b __sha __id __th __packed __lang __found __maybe __word0 __keep __row kept doc".split()


def test_pipeline(spark, docs, empty):
    """Stage by stage against plain versions, with columns named like those that the operators add."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "source_mix", "piece_encoding"]
    # copies that differ little: hundreds of words with one changed
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(600)]
    near = [(300 + i, " ".join(base[: 100 * i] + ["changed"] + base[100 * i :])) for i in range(5)]
    near = spark.createDataFrame([(d, t, "en", "b", 0, "x", 1, "y") for d, t in near], SCHEMA)
    table = docs.unionByName(near).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    columns = table.columns

    net = langid.fit(table)
    found = langid.identify(table.select("doc_id", "text"), net).collect()
    identified = stages["language_id"](spark, table, "").persist()
    good = [r for r in found if r["lang_pred"] != "und" and r["score"] >= langid.LEAST_SCORE]
    assert identified.columns == columns
    assert count(identified.select("doc_id", "text").collect()) == count((r["doc_id"], r["text"]) for r in good)

    distinct = stages["exact_dedup"](spark, table, "").persist()
    last = {}
    for d, t in table.select("doc_id", "text").collect():
        last[lower(t)] = max(last.get(lower(t), -1), -1 if d is None else d)
    assert distinct.columns == columns
    assert count(distinct.select("doc_id").collect()) == count((None if d == -1 else d,) for d in last.values())

    single = stages["near_dedup"](spark, distinct, "").persist()
    texts = [(r["doc_id"], _print(r["text"])) for r in distinct.select("doc_id", "text").collect()]
    firsts = {(c, f if c is None else 0) for _, f, c in _components(texts)}
    assert single.columns == columns and len(firsts) < len(texts)
    assert count(single.select("doc_id").collect()) == count((c,) for c, _ in firsts)

    mixed = stages["source_mix"](spark, single, "").persist()
    taken = mixing.mix(single).where("size > 0").select("doc_id", (F.col("taken") / F.col("size")).cast("int")).collect()
    assert mixed.columns == columns
    assert count(mixed.select("doc_id").where(F.length("text") > 0).collect()) >= count((d,) for d, n in taken for _ in range(n))
    assert all(r["a.b"] == f"a.b{r['doc_id']}" for r in mixed.where("doc_id is not null").collect())

    encoded = stages["piece_encoding"](spark, mixed, "").collect()
    codec = pieces.codec(tokenizer_path("piece_bpe_32k.model"))
    assert len(encoded) == mixed.count()
    assert all(codec.decode(r["pieces"]) == (r["text"] or "") for r in encoded if "\u2581" not in (r["text"] or ""))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_filter(spark):
    F = bloom.F
    df = spark.range(30_000).select((F.col("id") % 20_000).alias("chunk"), F.lit(1).alias("words"), F.col("id").alias("H"))
    once = bloom.build(F.col("chunk"), df.where("chunk < 5000"), 1 << 18)
    found = bloom.probe(df, F.col("chunk"), once, "maybe")
    assert found.columns == ["chunk", "words", "H", "maybe"]
    assert found.where("chunk < 5000 and not maybe").count() == 0
    assert found.where("chunk >= 5000 and maybe").select("chunk").distinct().count() < 300  # 15,000 others
    twice = bloom.probe(df, F.col("chunk"), bloom.build(F.col("chunk"), df, 1 << 19, times=2), "maybe")
    assert twice.where("chunk < 10000 and not maybe").count() == 0  # those that occur again
    assert twice.where("chunk >= 10000 and maybe").count() < 1000
    nothing = bloom.probe(df, F.col("chunk"), bloom.build(F.col("chunk"), df.where("false"), bloom.bits_for(0)), "maybe")
    assert nothing.where("maybe").count() == 0


def test_pieces_beside_other_columns(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a b", 7, 8), (2, None, 7, 8), (3, "", 7, 8)], "doc_id long, text string, `a.b` int, pieces int")
    found = pieces.with_pieces(docs, path)
    assert found.columns == ["doc_id", "text", "a.b", "pieces"]
    got = {r["doc_id"]: (r["text"], r["a.b"], r["pieces"]) for r in found.collect()}
    assert got == {1: ("a b", 7, pieces.codec(path).encode("a b").tolist()), 2: (None, 7, []), 3: ("", 7, [])}
    assert pieces.with_pieces(docs.where("false"), path).count() == 0
