import hashlib
import math
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame, functions as F

from conftest import LETTERS_THESAURUS, PETS_THESAURUS, SCHEMA, lines, matrix, sentence
from wordfold.functions import draws, grammar as g, text as tx
from wordfold.operators import (
    blocks, classify as cl, features as ft, metrics as mt, neighbours as nb, ranking, reduce as rd, search, select as sel, splits, stats, tokens as tk, vectorize as vz,
)
from wordfold.sources import vectors as ve

UNI = ft.FeatureOptions(unigram_pos="J,N,V", phrase_types=())


def counts(sentences, options=UNI, tokens=tk.TokenOptions()):
    return vz.doc_term_counts(ft.extract_features(tk.clean_tokens(sentences, tokens), options).select("doc_id", "label", "feature"))


def column(df, name):
    return [r[name] for r in df.collect()]


# ------------------------------------------------------------------ tokens


@pytest.mark.parametrize(
    ("text", "number"),
    [("12/23", True), ("1,000.12", True), (",", True), ("1e5", True), ("nan", True), ("-Infinity", True), ("cat", False), ("4x4", False), ("e5", False)],
)
def test_is_number(spark, text, number):
    assert spark.range(1).select(tx.is_number(F.lit(text))).first()[0] is number


def test_invalid_tokens_and_entities(spark):
    df = spark.createDataFrame(
        [sentence("d", "x", [("big_Cats", "big_cat", "NNP", "O"), ("like", "like", "VB", "O"), ("dogs", "dog", "NNP", "ORG"), ("dogs/b", "dog", "NN", "O"), (".", ".", ".", "O")])],
        SCHEMA,
    )
    plain = tk.TokenOptions(lemmatize=False, lowercase=False, use_pos=False, coarse_pos=False)
    got = tk.clean_tokens(df, plain).first()["tokens"]
    assert [(t["text"], t["pos"], t["idx"], t["ner"]) for t in got] == [("like", "", 2, "O"), ("dogs", "", 3, "ORG")]
    got = tk.clean_tokens(df, tk.TokenOptions(False, False, False, False, normalise_entities=True)).first()["tokens"]
    assert [t["text"] for t in got] == ["like", "__NER-ORG__"]
    rows = tk.clean_token_rows(df, plain).orderBy("idx").collect()
    assert [(r["text"], r["idx"]) for r in rows] == [("like", 2), ("dogs", 3)]


def test_edges_need_both_tokens_and_last_one_wins(spark):
    words = [("the", "the", "NNP", "O"), ("like", "like", "VB", "O"), ("dogs", "dog", "NNP", None)]
    df = spark.createDataFrame(
        [sentence("d", "x", words, [("root", 0, 2), ("nsubj", 2, 1), ("dep", 2, 3), ("dobj", 2, 3)])], SCHEMA
    )
    edges = tk.surviving_edges(tk.clean_tokens(df)).collect()
    assert sorted((e["type"], e["head_idx"], e["dep_idx"]) for e in edges) == [("dobj", 2, 3), ("nsubj", 2, 1)]
    fewer = tk.surviving_edges(tk.clean_tokens(df, tk.TokenOptions(remove_stopwords=True, stopwords=("the",)))).collect()
    assert [(e["type"], e["head_idx"], e["dep_idx"]) for e in fewer] == [("dobj", 2, 3)]


def test_gaps_in_token_numbers(spark):
    row = ("d", "x", 1, [(2, "big", "big", "JJ", "O"), (5, "cat", "cat", "NN", "O")], [(5, 2, "amod")])
    df = spark.createDataFrame([row], SCHEMA)
    assert column(ft.adj_noun(tk.clean_tokens(df)), "feature") == ["big/J_cat/N"]


# ------------------------------------------------------------------ features

BLACK_CAT = [
    ("The", "the", "DT"), ("big", "big", "JJ"), ("black", "black", "JJ"), ("cat", "cat", "NN"), ("ate", "eat", "VBD"), ("the", "the", "DT"), ("small", "small", "JJ"),
    ("red", "red", "JJ"), ("bird", "bird", "NN"), ("and", "and", "CC"), ("survived", "survive", "VBD"), ("the", "the", "DT"), ("heart", "heart", "NN"), ("surgery", "surgery", "NN"), (".", ".", "."),
]
BLACK_CAT_EDGES = [
    ("amod", 4, 2), ("amod", 4, 3), ("nsubj", 5, 4), ("nsubj", 11, 4), ("amod", 9, 7), ("amod", 9, 8), ("dobj", 5, 9), ("nn", 14, 13), ("dobj", 11, 14), ("conj_and", 5, 11),
    ("det", 4, 1), ("det", 9, 6), ("det", 14, 12),
]


def black_cat(spark, ner="O", edges=BLACK_CAT_EDGES):
    words = [(w, lem, p, ner if w == "cat" else "O") for w, lem, p in BLACK_CAT]
    return tk.clean_tokens(spark.createDataFrame([sentence("d", "x", words, edges)], SCHEMA))


PHRASES = ft.FeatureOptions(unigram_pos="", phrase_types=("AN", "NN", "VO", "SVO"))


def test_black_cat_phrases(spark):
    cleaned = black_cat(spark)
    assert len(cleaned.first()["tokens"]) == 14
    got = {(r["ftype"], r["feature"]) for r in ft.extract_features(cleaned, PHRASES).collect()}
    want = {
        ("AN", "big/J_cat/N"), ("AN", "black/J_cat/N"), ("AN", "small/J_bird/N"), ("AN", "red/J_bird/N"), ("VO", "eat/V_bird/N"), ("VO", "survive/V_surgery/N"),
        ("SVO", "cat/N_eat/V_bird/N"), ("SVO", "cat/N_survive/V_surgery/N"), ("NN", "heart/N_surgery/N"),
    }
    assert got == want
    person = ft.extract_features(black_cat(spark, "PERSON"), ft.FeatureOptions(unigram_pos="", phrase_types=("AN", "NN", "VO", "SVO"), drop_ner=True))
    assert person.count() == len(want) - 4


@pytest.mark.parametrize(("relation", "expected"), [("amod", 4), ("nsubj", 0), ("dobj", 4)])
def test_wrong_relations(spark, relation, expected):
    edges = [(relation, h, d) for _, h, d in BLACK_CAT_EDGES]
    found = ft.extract_features(black_cat(spark, edges=edges), PHRASES)
    # with every relation a dobj: eat-bird and survive-surgery, and the two verbs with their subject
    assert found.count() == expected


def test_grammar(spark):
    cases = {
        "cat/N": "1-GRAM", "big/J_cat/N": "AN", "a/N_b/N": "NN", "a/V_b/N": "VO", "a/N_b/V_c/N": "SVO", "cat/N_like/V": "2-GRAM", "messed_up": "EMPTY", "123/V_$$$/N": "EMPTY", "": "EMPTY",
    }
    df = spark.createDataFrame(list(cases.items()), "feature string, want string")
    got = ft.with_type(df)
    assert {r["feature"]: r["ftype"] for r in got.collect()} == cases
    assert spark.range(1).select(g.remove_pos(F.lit("cat/N_food/N"))).first()[0] == "cat_food"
    spaced = spark.range(1).select(g.feature_type(F.lit("big/J cat/N"), " ")).first()[0]
    assert spaced == "AN"


def test_filter_preextracted(spark):
    df = spark.createDataFrame([("d", "x", f) for f in ["cat/N", "run/V", "big/J_cat/N", "a/N_b/N", "messed_up"]], "doc_id string, label string, feature string")
    got = ft.filter_features(df, ft.FeatureOptions(unigram_pos="N", phrase_types="AN"))
    assert sorted(column(got, "feature")) == ["big/J_cat/N", "cat/N"]
    with pytest.raises(ValueError):
        ft.filter_features(df, ft.FeatureOptions(drop_ner=True))


def test_unigram_paths_agree(spark, pets):
    a = ft.extract_features(tk.clean_tokens(pets[0]), UNI).select("doc_id", "feature")
    b = ft.extract_unigrams(tk.clean_token_rows(pets[0]), UNI).select("doc_id", "feature")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_bigram_vocabulary_order(pets):
    rows = counts(pets[0], ft.FeatureOptions(unigram_pos="J,N,V", phrase_types=(), ngram_max=2))
    vocab = {r["feature"]: r["idx"] for r in vz.index_vocab(vz.build_vocab(rows)).collect()}
    names = ["cat/N", "dog/N", "game/N", "kid/N", "like/V", "play/V", "cat/N_like/V", "kid/N_play/V", "like/V_dog/N", "play/V_game/N"]
    assert vocab == {f: i for i, f in enumerate(names)}
    assert matrix(rows, ["t1", "t2", "t3"], names) == [[1, 1, 0, 0, 1, 0, 1, 0, 1, 0]] * 2 + [[0, 0, 1, 1, 0, 1, 0, 1, 0, 1]]


# ------------------------------------------------------------------ vectorization

ABC = ["a/N", "b/N", "c/N", "d/N", "e/N", "f/N"]


@pytest.fixture(scope="module")
def letters_thesaurus(spark):
    return ve.parse_thesaurus(lines(spark, LETTERS_THESAURUS))


@pytest.mark.parametrize(
    ("handler", "in_model", "expected"),
    [
        ("base", False, [4, 1, 2, 0, 0, 0]),
        ("signifier_signified", False, [4, 1, 2, 2.1, 0, 0]),
        ("signifier_signified", True, [4, 1, 2.1]),
        ("signified_only", False, [0, 0, 0, 4.4, 0, 0]),
        ("signified_only", True, [0, 0, 4.4]),
    ],
)
def test_handlers_on_letters(letters, letters_thesaurus, handler, in_model, expected):
    vocab = vz.build_vocab(counts(letters[0]))
    names = ABC
    if in_model:
        vocab, names = sel.keep_in_model(vocab, letters_thesaurus), ["a/N", "b/N", "d/N"]
    # x/X is not in the vocabulary and must not use up the single place
    got = vz.transform_test(counts(letters[1]), vocab, handler, letters_thesaurus, k=1)
    assert matrix(got, ["e1"], names) == [expected]


def test_constant_neighbour(spark, letters):
    test = counts(letters[1])
    every = test.select("feature", F.lit("b/N").alias("neighbour"), F.lit(1.0).alias("sim")).distinct()
    got = vz.transform_test(test, vz.build_vocab(counts(letters[0])), "signified_only", every, k=1)
    assert matrix(got, ["e1"], ABC) == [[0, 11, 0, 0, 0, 0]]


def test_bigram_expansion(spark, pets):
    o = ft.FeatureOptions(unigram_pos="J,N,V", phrase_types=(), ngram_max=2)
    near = ve.parse_thesaurus(lines(spark, PETS_THESAURUS + "\nlike/V_fruit/N\tlike/V\t0.8"))
    got = vz.transform_test(counts(pets[1], o), vz.build_vocab(counts(pets[0], o)), "signifier_signified", near, k=1)
    rows = matrix(got, ["e1", "e2", "e3"], ["cat/N", "dog/N", "like/V"])
    assert rows == [[0.06, 0, 1.8], [0.06, 0, 1.8], [0, 1, 0]]


def test_empty_vocabulary(spark, letters):
    rows = counts(letters[1])
    with pytest.raises(ValueError):
        vz.transform_test(rows, vz.build_vocab(rows).where("false"))


def test_random_handler_draws_per_occurrence(letters):
    vocab = vz.build_vocab(counts(letters[0]))
    test = counts(letters[1])
    got = vz.handle_random(test, vocab, 2, seed=3).collect()
    assert sum(r["weight"] for r in got) == 11 * 2 and {r["feature"] for r in got} <= set(ABC)
    assert sorted(map(tuple, got)) == sorted(map(tuple, vz.handle_random(test, vocab, 2, seed=3).collect()))


def test_limit_df(spark):
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 5), ("d", 10)], "feature string, df long")
    docs = spark.range(10).select(F.col("id").alias("doc_id"))
    assert column(vz.limit_df(vocab, 2, 5), "feature") == ["b", "c"]
    assert column(vz.limit_df(vocab, 2, 0.5, docs), "feature") == ["b", "c"]
    with pytest.raises(ValueError):
        vz.limit_df(vocab, 5, 2)
    with pytest.raises(Exception, match="max_df"):
        vz.limit_df(vocab, 6, 0.5, docs).collect()


def test_cluster_vectorizer(spark):
    pairs = [("ae", 0), ("ae", 0), ("ae", 0), ("ae", 0), ("bf", 1), ("bf", 1), ("bf", 1), ("bf", 1)]
    rows = [(i, str(lab), f"{x}/N") for i, (p, lab) in enumerate(pairs) for x in p] + [(0, "0", "unseen/N")]
    feats = spark.createDataFrame(rows, "doc_id long, label string, feature string")
    clusters = spark.createDataFrame([("a/N", 0), ("e/N", 0), ("b/N", 1), ("f/N", 1), ("q/N", 2)], "feature string, cluster int")
    got = matrix(vz.cluster_vectorize(feats, clusters), range(8), ["cluster0", "cluster1"])
    assert got == [[2, 0]] * 4 + [[0, 2]] * 4


# ------------------------------------------------------------------ neighbours

EVENTS = "\n".join(
    ["cat/N\ta\t4\tb\t2\tc\t1\td\t1", "dog/N\ta\t3\tb\t3\tc\t1", "game/N\td\t3\te\t1\tf\t2", "kid/N\tg\t2\th\t5\ti\t3", "fruit/N\ta\t1", "like/V\tj\t3\tk\t3", "play/V\tk\t3"]
)


def test_cosine_values(spark):
    vectors = ve.parse_vectors(lines(spark, EVENTS))
    got = {(r["feature"], r["neighbour"]): r["sim"] for r in nb.knn_cosine(vectors, 10).collect()}
    want = {("cat/N", "dog/N"): 0.92932, ("cat/N", "game/N"): 0.170941, ("cat/N", "fruit/N"): 0.852803, ("dog/N", "fruit/N"): 0.688247, ("like/V", "play/V"): 0.707107}
    assert len(got) == 2 * len(want)
    for (a, b), sim in want.items():
        assert got[a, b] == pytest.approx(sim, abs=1e-5) and got[b, a] == pytest.approx(sim, abs=1e-5)


def brute(q, v, k, metric):
    out = {}
    for a, x in q.items():
        scored = []
        for b, y in v.items():
            dot = sum(w * y.get(c, 0.0) for c, w in x.items())
            xs, ys = sum(w * w for w in x.values()), sum(w * w for w in y.values())
            if metric == "cosine" and a != b and dot:
                scored.append((-round(dot / math.sqrt(xs * ys), 9), b))
            if metric == "euclidean":
                scored.append((round(math.sqrt(max(xs + ys - 2 * dot, 0)), 9), b))
        out[a] = [b for _, b in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_search_equals_brute_force(spark, metric):
    rng = np.random.default_rng(5)
    # one context is in every vector: the hot one
    data = {f"v{i:02d}": {"hot": 1.0, **{f"c{rng.integers(40)}": float(rng.integers(1, 6)) for _ in range(6)}} for i in range(60)}
    df = spark.createDataFrame([(n, c, w) for n, x in data.items() for c, w in x.items()], "name string, ctx string, weight double")
    got = search.nearest(df, df, 5, metric, exclude_self=metric == "cosine", rows_per_block=13).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query"], -r["score"], r["item"])):
        found.setdefault(r["query"], []).append(r["item"])
    assert found == brute(data, data, 5, metric)


@pytest.mark.parametrize(("worth", "chunk", "step"), [(1e12, 7, 4), (20, 50, 3), (0, 50, 5)])
def test_sparse_product(monkeypatch, worth, chunk, step):
    monkeypatch.setattr(blocks, "PAIRS_WORTH_A_STEP", worth)
    monkeypatch.setattr(blocks, "PAIRS_PER_CHUNK", chunk)
    monkeypatch.setattr(blocks, "CONTEXTS_PER_STEP", step)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (9, 30)).astype(float), rng.integers(0, 2, (11, 30)).astype(float)
    entries = lambda m: (*np.nonzero(m), m[np.nonzero(m)])
    assert np.array_equal(blocks.sparse_product(entries(a), entries(b), (9, 11), 30), a @ b.T)


def test_combined_neighbours(spark):
    one = nb.knn_cosine(ve.parse_vectors(lines(spark, "a/N\tx\t1\ty\t1\nb/V\tx\t1\ty\t2\nc/J\tx\t1\ty\t3\nd/N\tx\t1\ty\t4")), 10)
    sets = one.withColumn("source_id", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    for entry in ("a/N", "b/V", "c/J", "d/N"):
        got = nb.combine_neighbours(sets).where(F.col("feature") == entry).orderBy("rank").collect()
        assert [r["sim"] for r in got] == pytest.approx([1, 1 / 2, 1 / 3])
        want = one.where(F.col("feature") == entry).orderBy(F.desc("sim")).collect()
        assert [r["neighbour"] for r in got] == [r["neighbour"] for r in want]
    assert nb.combine_neighbours(sets.where("source_id = 0")).count() == 0


def test_lexical_overlap(spark):
    text = "daily/J_pais/N\tp\t1\tq\t2\ndaily/J\tp\t1.1\tq\t21\npais/N\tp\t1.2\tq\t2.2"
    near = nb.drop_lexical_overlap(nb.knn_cosine(ve.parse_vectors(lines(spark, text)), 3))
    assert {r["feature"] for r in near.collect()} == {"daily/J", "pais/N"}


def test_skipping_strategy(spark):
    near = spark.createDataFrame(
        [("a", "b", 0.9), ("a", "c", 0.8), ("b", "a", 0.9), ("b", "d", 0.5), ("d", "e", 0.4), ("c", "a", 0.8)], "feature string, neighbour string, sim double"
    )
    got = nb.neighbour_strategy(near, 3, "skipping").where("feature = 'a'").orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == ["b", "d", "e"]
    got = nb.neighbour_strategy(near, 3).where("feature = 'a'").orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == ["b", "c"]


def test_get_vector_and_noise(spark):
    vectors = ve.parse_vectors(lines(spark, "a/N\tt:t1\t1\tt:t2\t2\tamod:c\t2\tt:t3\t3\nb/V\tt:t4\t1"))
    asked = spark.createDataFrame([("a/N",), ("zzz/N",)], "feature string")
    got = sorted(map(tuple, nb.get_vector(vectors, asked).collect()))
    assert got == [("a/N", 0, "amod:c", 2.0), ("a/N", 1, "t:t1", 1.0), ("a/N", 2, "t:t2", 2.0), ("a/N", 3, "t:t3", 3.0)]
    noisy = {r["ctx"]: r["weight"] for r in nb.add_noise(vectors, 0.5, 1).collect()}
    plain = {r["ctx"]: r["weight"] for r in vectors.collect()}
    assert all(0 <= noisy[c] - plain[c] < 0.5 * 2 for c in plain) and noisy != plain
    dense = spark.createDataFrame([("zero", [0.0, 0.0]), ("x", [2.0, 0.0]), ("none", [])], "feature string, embedding array<double>")
    out = {r["feature"]: r["embedding"] for r in nb.add_noise(dense, 0.5, 1).collect()}
    assert out["zero"] == [0.0, 0.0] and out["none"] == [] and out["x"][1] == 0.0 and 2.0 <= out["x"][0] <= 3.0


def test_draws_are_the_beginning_of_a_digest(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None), (None, 3)], "k string, n int")
    got = rows.select(draws.draw(7, "k", "n"), draws.share(7, "k", "n")).collect()
    want = [int(hashlib.md5(f"7:{k}".encode()).hexdigest()[:15], 16) for k in ("a:1", "b:", ":3")]
    assert [tuple(r) for r in got] == [(w, float(w) / 16.0**15) for w in want]


# ------------------------------------------------------------------ selection


def test_chi2_and_selection(spark, pets):
    rows, docs = counts(pets[0]), pets[0].select("doc_id", "label")
    scores = {r["feature"]: r["score"] for r in sel.chi2_scores(rows, docs).collect()}
    assert scores == pytest.approx({"cat/N": 1, "dog/N": 1, "game/N": 2, "kid/N": 2, "like/V": 1, "play/V": 2})
    vocab = vz.index_vocab(vz.build_vocab(rows))
    kept = {r["feature"]: r["idx"] for r in sel.select_features(vocab, rows, docs, 3).collect()}
    assert kept == {"game/N": 0, "kid/N": 1, "play/V": 2}
    model = ve.parse_thesaurus(lines(spark, PETS_THESAURUS)).where("feature <> 'kid/N'")
    kept = {r["feature"]: r["idx"] for r in sel.select_features(vocab, rows, docs, 3, model, True).collect()}
    assert kept == {"game/N": 0, "play/V": 1}
    with pytest.raises(ValueError):
        sel.select_features(vocab, rows, docs, 3, None, True)


def test_log_odds(spark):
    data = [[1, 1, 0, 0], [1, 1, 1, 0], [0, 1, 1, 1], [0, 0, 1, 1]]
    rows = spark.createDataFrame([(i, f"f{j}", float(x)) for i, r in enumerate(data) for j, x in enumerate(r) if x], "doc_id long, feature string, weight double")
    docs = spark.createDataFrame([(0, "0"), (1, "0"), (2, "1"), (3, "1")], "doc_id long, label string")
    got = column(sel.log_odds(rows, docs).orderBy("feature"), "score")
    assert got == sorted(got, reverse=True) and len(set(got)) == 4
    with pytest.raises(Exception, match="binary"):
        sel.log_odds(rows, docs.withColumn("label", F.col("doc_id").cast("string"))).collect()


def test_empty_documents_weigh_nothing(spark, pets):
    docs = pets[0].select("doc_id", "label").union(spark.createDataFrame([("t9", "earn")], "doc_id string, label string"))
    kept = sel.keep_docs_min_weight(docs, counts(pets[0]), 3)
    assert sorted(column(kept, "doc_id")) == ["t1", "t2", "t3"]
    assert sel.keep_docs_min_weight(docs, counts(pets[0]), 0).count() == 4


# ------------------------------------------------------------------ splits and ranks


@pytest.mark.parametrize(("n", "k"), [(7, 3), (2, 2), (1000, 7), (3, 5)])
def test_kfold_sizes(spark, n, k):
    docs = spark.range(n).select((F.col("id") * 7).alias("doc_id"), F.lit("x").alias("label"))
    got = splits.kfold(docs, k).where("role = 'test'").orderBy("doc_id").collect()
    want = [f for f, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
    assert [r["cv_no"] for r in got] == want


def test_global_rank_with_hot_group(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("g"))
    got = ranking.global_rank(df, F.col("id"), ["g"]).collect()
    for group in ("hot", "cold"):
        rows = sorted((r["id"], r["rank"], r["total"]) for r in got if r["g"] == group)
        assert [r[1] for r in rows] == list(range(len(rows))) and rows[0][2] == len(rows)


def test_split_rules(spark):
    docs = spark.createDataFrame([(i, str(i % 2)) for i in range(200)], "doc_id long, label string")
    train, test = docs.where("doc_id < 100"), docs.where("doc_id >= 100")
    with pytest.raises(ValueError):
        splits.split("kfold", train, test)
    with pytest.raises(ValueError):
        splits.split("test_set", train)
    assert splits.kfold(docs, 101).select("cv_no").distinct().count() == 101
    rows = splits.split("subsampled_test_set", train, test, 2, 10, 1)
    sizes = {(r["cv_no"], r["role"], r["label"]): r["count"] for r in rows.groupBy("cv_no", "role", "label").count().collect()}
    assert sizes == {(c, role, lab): n for c in (0, 1) for lab in "01" for role, n in (("train", 5), ("test", 50))}
    other = splits.split("subsampled_test_set", train, test, 2, 10, 2)
    pick = lambda d: sorted((r["cv_no"], r["doc_id"]) for r in d.where("role = 'train'").collect())
    assert pick(rows) == pick(splits.split("subsampled_test_set", train, test, 2, 10, 1)) != pick(other)
    with pytest.raises(Exception, match="fewer training documents"):
        splits.split("subsampled_test_set", train, test, 1, 1000).collect()
    mixed = splits.shuffle_labels(docs, 4)
    assert {r["label"]: r["count"] for r in mixed.groupBy("label").count().collect()} == {"0": 100, "1": 100}
    assert sorted(map(tuple, mixed.collect())) != sorted(map(tuple, docs.collect()))


# ------------------------------------------------------------------ classifiers and scores


def toy(spark):
    rng = np.random.default_rng(2)
    rows, docs = [], []
    for i in range(30):
        lab = "p" if i % 3 else "n"
        docs.append((i, lab))
        for w in rng.choice(["x", "y", "z"] if lab == "p" else ["y", "u", "v"], 4):
            rows.append((i, lab, str(w), 1.0))
    df = spark.createDataFrame(rows, "doc_id long, label string, feature string, weight double")
    return vz.merge_duplicates(df), spark.createDataFrame(docs, "doc_id long, label string")


def dense(rows, docs, names):
    m = {(r["doc_id"], r["feature"]): r["weight"] for r in rows.collect()}
    d = sorted(map(tuple, docs.collect()))
    return np.array([[m.get((i, f), 0.0) for f in names] for i, _ in d]), np.array([lab for _, lab in d])


@pytest.mark.parametrize("kind", ["multinomial", "bernoulli"])
def test_naive_bayes_by_formula(spark, kind):
    rows, docs = toy(spark)
    names = ["u", "v", "x", "y", "z"]
    x, y = dense(rows, docs, names)
    a, scores = 0.1, []
    for lab in ("n", "p"):
        part = x[y == lab]
        prior = math.log(len(part) / len(x))
        if kind == "multinomial":
            w = part.sum(0) + a
            scores.append(prior + x @ np.log(w / w.sum()))
        else:
            p = ((part > 0).sum(0) + a) / (len(part) + 2 * a)
            scores.append(prior + (x > 0) @ np.log(p) + (x == 0) @ np.log(1 - p))
    want = np.array(["n", "p"])[np.argmax(scores, axis=0)]
    fit = cl.multinomial_nb if kind == "multinomial" else cl.bernoulli_nb
    extra = docs.union(spark.createDataFrame([(99, "n")], "doc_id long, label string"))
    got = {r["doc_id"]: r["prediction"] for r in fit(rows, docs, rows, extra, a).collect()}
    assert [got[i] for i in range(30)] == list(want)
    assert got[99] == "p"  # no features: the larger class, or absence of everything


def test_other_classifiers(spark):
    rows, docs = toy(spark)
    vocab = vz.build_vocab(rows)
    assert set(column(cl.most_common_label(docs, docs), "prediction")) == {"p"}
    for fit in (cl.logistic_regression, cl.linear_svc):
        got = {r["doc_id"]: r["prediction"] for r in fit(rows, docs, rows, docs, vocab, max_iter=10).collect()}
        assert np.mean([got[i] == lab for i, lab in map(tuple, docs.collect())]) > 0.9
    one = cl.knn_classify(rows, docs, rows, docs, 1)
    x, y = dense(rows, docs, ["u", "v", "x", "y", "z"])
    near = [y[np.argmin(((x - v) ** 2).sum(1))] for v in x]
    assert [r["prediction"] for r in one.orderBy("doc_id").collect()] == near
    empty = docs.where("doc_id < 3")
    # documents without features are zero vectors, not lost
    assert cl.knn_classify(rows, docs, rows.where("false"), empty, 1).count() == 3


def test_vectors_of_all_folds(spark):
    """Made together without Python rows; features a fold does not know are left out, documents without features stay."""
    rows = spark.createDataFrame([(0, 1, "a", 2.0), (0, 1, "c", 1.0), (1, 1, "a", 5.0), (1, 2, "b", 3.0), (0, 3, "b", 9.0)], "cv_no int, doc_id long, feature string, weight double")
    docs = spark.createDataFrame([(0, 1, "x"), (0, 3, "y"), (1, 1, "x"), (1, 2, "y"), (1, 4, "y")], "cv_no int, doc_id long, label string")
    indexed = spark.createDataFrame([(0, "a", 0), (0, "c", 2), (1, "a", 0), (1, "b", 1)], "cv_no int, feature string, idx long")
    made = cl.to_vectors(rows, docs, indexed, 3, ["cv_no"])
    got = {(r["cv_no"], r["doc_id"]): (r["label"], r["features"].size, dict(zip(r["features"].indices.tolist(), r["features"].values))) for r in made.collect()}
    assert got == {
        (0, 1): ("x", 3, {0: 2.0, 2: 1.0}), (0, 3): ("y", 3, {}), (1, 1): ("x", 3, {0: 5.0}), (1, 2): ("y", 3, {1: 3.0}), (1, 4): ("y", 3, {}),
    }


def test_folds_fitted_side_by_side(spark):
    """Folds with other vocabularies and labels get the predictions that each gets on its own."""
    rows, docs = toy(spark)
    in_fold = lambda df, n, keep: df.where(keep).withColumn("cv_no", F.lit(n))
    keeps = [F.col("doc_id") % 3 != n for n in range(3)]
    train, train_docs = (reduce(DataFrame.unionByName, [in_fold(t, n, keep) for n, keep in enumerate(keeps)]) for t in (rows, docs))
    test, test_docs = (reduce(DataFrame.unionByName, [in_fold(t, n, ~keep) for n, keep in enumerate(keeps)]) for t in (rows, docs))
    vocab = vz.build_vocab(train, ["cv_no"]).where("cv_no <> 1 or feature <> 'v'")
    found = cl.linear_svc(train, train_docs, test, test_docs, vocab, by=["cv_no"], max_iter=10)
    assert found.columns == ["cv_no", "doc_id", "prediction"]
    for n in range(3):
        pick = lambda df: df.where(F.col("cv_no") == n).drop("cv_no")
        alone = cl.linear_svc(*map(pick, (train, train_docs, test, test_docs, vocab)), max_iter=10)
        assert sorted(map(tuple, pick(found).collect())) == sorted(map(tuple, alone.collect()))


def test_scores(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    got = {r["metric"]: r["score"] for r in mt.multiple_scores(df).collect()}
    assert got["accuracy_score"] == got["microavg_f1"] == pytest.approx(5 / 7)
    assert got["macroavg_prec"] == pytest.approx((3 / 4 + 2 / 3 + 0) / 3)
    assert got["macroavg_rec"] == pytest.approx((3 / 4 + 1 + 0) / 3)
    assert got["macroavg_f1"] == pytest.approx((3 / 4 + 4 / 5 + 0) / 3)


# ------------------------------------------------------------------ statistics and reduction


def test_coverage_and_replacements(spark, pets):
    near = ve.parse_thesaurus(lines(spark, PETS_THESAURUS))
    train, test = counts(pets[0]), counts(pets[1])
    vocab = vz.build_vocab(train)
    marked = vz.mark_iv_it(test, vocab, near)
    rows = stats.coverage_counts(marked, "ev").collect()
    kinds = lambda iv, it: [r["count"] for r in rows if (r["IV"], r["IT"]) == (iv, it)]
    assert (len(rows), sum(r["count"] for r in rows)) == (5, 9)
    assert (len(kinds(0, 0)), sum(kinds(0, 0))) == (2, 4)
    assert kinds(0, 1) == [2] and (len(kinds(1, 1)), sum(kinds(1, 1))) == (2, 3) and kinds(1, 0) == []
    assert all((r["IV"], r["IT"]) == (1, 1) for r in stats.coverage_counts(vz.mark_iv_it(train, vocab, near), "tr").collect())
    # every looked-up feature, as with extreme expansion
    got = {r["feature"]: r for r in stats.replacement_counts(marked.where("it"), near, vocab, 3, "ev").collect()}
    assert {f: r["available_replacements"] for f, r in got.items()} == {"like/V": 1, "fruit/N": 2, "dog/N": 2}
    assert (got["dog/N"]["neigh1"], got["dog/N"]["neigh1_sim"], got["dog/N"]["neigh3"]) == ("cat/N", 0.7, "")
    assert got["like/V"]["count"] == 2


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 4, (40, 12)).astype(float)
    cells = [(f"w{i:02d}/N", f"c{j:02d}", float(x)) for i, r in enumerate(a) for j, x in enumerate(r) if x]
    vectors = spark.createDataFrame(cells, "feature string, ctx string, weight double")
    fit = rd.svd_fit(vectors, 3, oversample=9, iterations=2)
    rows = fit.orderBy("ctx").collect()
    v = np.array([r["v"] for r in rows])
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(rows[0]["sigma"], s[:3], rtol=1e-6)
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-8)
    assert np.allclose(np.abs(v.T @ vt[:3].T), np.eye(3), atol=1e-4)
    projected = rd.pack_reduced(rd.svd_project(vectors, rd.long_loadings(fit))).orderBy("feature").collect()
    assert np.allclose([r["embedding"] for r in projected], a @ v)


def test_clusters(spark):
    rows = [(f"{x}/N", [float(i), 0.0]) for i, x in enumerate("abcd")] + [(f"{x}/N", [100.0 + i, 0.0]) for i, x in enumerate("efgh")]
    got = {r["feature"][0]: r["cluster"] for r in rd.cluster_vectors(spark.createDataFrame(rows, "feature string, embedding array<double>"), 2).collect()}
    assert len({got[x] for x in "abcd"}) == len({got[x] for x in "efgh"}) == 1 and got["a"] != got["e"]


def test_more_than_a_hundred_folds(spark):
    docs = spark.range(300).selectExpr("cast(id as string) doc_id", "'x' label")
    rows = splits.kfold(docs, 101).where("role = 'test'").groupBy("cv_no").count().collect()
    assert len(rows) == 101 and {r["count"] for r in rows} == {2, 3}


def test_chi2_at_large_weights(spark):
    docs = spark.createDataFrame([(str(i), "ab"[i % 2]) for i in range(4)], "doc_id string, label string")
    dtm = spark.createDataFrame([("0", "f", 1e12 + 1000.0), ("1", "f", 1e12), ("0", "g", 4.0)], "doc_id string, feature string, weight double")
    scores = dict(sel.chi2_scores(dtm, docs).select("feature", "score").collect())
    assert abs(scores["f"] / (2 * 500.0**2 / (1e12 + 500)) - 1) < 1e-9 and scores["g"] == 4.0


@pytest.mark.parametrize("rows_per_range", [1_000_000, 2])
def test_ranks_with_few_and_many_ranges(spark, monkeypatch, rows_per_range):
    from wordfold.operators import ranking

    monkeypatch.setattr(ranking, "ROWS_PER_RANGE", rows_per_range)
    keys = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("k"), (F.col("id") % 3).alias("g"))
    want = {k: n for n, k in enumerate(sorted(r["k"] for r in keys.collect()))}
    assert {r["k"]: r["rank"] for r in ranking.global_rank(keys, F.col("k")).collect()} == want
    per_group = ranking.global_rank(keys, F.col("k"), ["g"]).groupBy("g").agg(F.sort_array(F.collect_list("rank")).alias("r"), F.max("total").alias("t"))
    assert all(r["r"] == list(range(r["t"])) for r in per_group.collect())
