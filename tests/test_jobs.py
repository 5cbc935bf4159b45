import gzip
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import LETTERS_THESAURUS, PETS_THESAURUS, SCHEMA, lines, nouns
from wordfold.operators import features as ft, neighbours as nb, tokens as tk, vectorize as vz
from wordfold.plans import corpus as pc, experiment as ex, models as pm
from wordfold.sources import corpora as co, sinks, vectors as ve

UNI = ft.FeatureOptions(unigram_pos="J,N,V", phrase_types=())
WORDS = [("Cats", "Cat", "NNP", "O"), ("like", "like", "VB", "O"), ("dogs", "dog", "NNP", "ORG")]


def xml(dep_open, dep_close, ner=True):
    tokens = "".join(
        f'<token id="{i + 1}"><word>{w}</word><lemma>{lem}</lemma><POS>{p}</POS>{f"<NER>{n}</NER>" if ner else ""}</token>' for i, (w, lem, p, n) in enumerate(WORDS)
    )
    deps = "".join(
        f'<dep type="{t}"><governor idx="{h}">x</governor><dependent idx="{d}">y</dependent></dep>' for t, h, d in [("root", 0, 2), ("nsubj", 2, 1), ("dobj", 2, 3)]
    )
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<root><document><sentences>\n<sentence id="1">\n<tokens>{tokens}</tokens>\n{dep_open}{deps}{dep_close}\n</sentence>\n</sentences></document></root>\n'


def put(root, label, name, text):
    folder = root / label
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_raw_directory(spark, tmp_path):
    put(tmp_path, "de", "a.txt", "eins\nzwei")
    put(tmp_path, "en", "b.txt", "one")
    got = {(r["label"], r["text"]) for r in co.read_labelled_dir(spark, str(tmp_path)).collect()}
    assert got == {("de", "eins\nzwei"), ("en", "one")}
    with pytest.raises(ValueError):
        co.read_labelled_dir(spark, str(tmp_path / "de" / "a.txt"))


@pytest.mark.parametrize("layout", [("<collapsed-ccprocessed-dependencies>", "</collapsed-ccprocessed-dependencies>"), ('<dependencies type="collapsed-ccprocessed-dependencies">', "</dependencies>")])
def test_xml_layouts(spark, tmp_path, layout):
    put(tmp_path, "earn", "1.tagged", xml(*layout))
    df = co.read_parsed_xml(spark, str(tmp_path))
    edges = tk.surviving_edges(tk.clean_tokens(df)).collect()
    assert sorted((e["type"], e["head_idx"], e["dep_idx"]) for e in edges) == [("dobj", 2, 3), ("nsubj", 2, 1)]
    row = tk.clean_tokens(df).first()
    assert row["label"] == "earn" and [(t["text"], t["pos"], t["ner"]) for t in row["tokens"]] == [("cat", "N", "O"), ("like", "V", "O"), ("dog", "N", "ORG")]


def test_malformed_xml_is_set_aside(spark, tmp_path):
    put(tmp_path, "earn", "1.tagged", xml("<dependencies>", "</dependencies>", ner=False))
    put(tmp_path, "earn", "2.tagged", "<root><sentence id='1'><tokens><token id='x'></tokens></sentence></root>")
    read = co.read_parsed_xml(spark, str(tmp_path))
    assert sorted((r["label"], len(r["tokens"])) for r in read.collect()) == [("earn", 0), ("earn", 3)]
    assert co.malformed_xml(spark, str(tmp_path)).count() == 1
    tokens = tk.clean_tokens(read.where(F.size("tokens") > 0)).first()["tokens"]
    assert {t["ner"] for t in tokens} == {"MISSING"}


def test_a_malformed_sentence_costs_no_other(spark, tmp_path):
    good = "<sentence id='{0}'><tokens><token id='1'><word>w{0}</word><lemma>w{0}</lemma><POS>NN</POS></token></tokens></sentence>"
    wrap = "<?xml version='1.0'?>\n<root><document><sentences>\n{0}\n</sentences></document></root>".format
    bad = "<sentence id='2'><tokens><token id='1'><word>b</word></token></sentence>"
    put(tmp_path, "x", "1.tagged", wrap(good.format(1) + bad + good.format(3) + "<sentence id='4'/>"))
    put(tmp_path, "x", "2.tagged", wrap(""))
    put(tmp_path, "y", "3.tagged", wrap(bad + bad))
    put(tmp_path, "y", "4.tagged", wrap(good.format(1)) + "<sentence id='2'><tok")
    rows = lambda df: sorted((r["doc_id"][-8], r["sent_id"], len(r["tokens"])) for r in df.collect())
    assert rows(co.read_parsed_xml(spark, str(tmp_path))) == [("1", 1, 1), ("1", 3, 1), ("1", 4, 0), ("2", 1, 0), ("3", 1, 0), ("4", 1, 1)]
    marked = co.load_corpus(spark, str(tmp_path), fmt="xml", keep_malformed=True)
    assert sorted(r["doc_id"][-8] for r in marked.where("malformed").collect()) == ["1", "3", "3", "4"]
    e = ex.Experiment(split="oracle", train_features=UNI, test_features=UNI, classifiers={"most_common_label": {}})
    survival = ex.run_experiment(marked.drop("split"), e).survival.first()
    assert (survival["docs"], survival["malformed"]) == (4, 4)


def test_conll(spark, tmp_path):
    text = "1\tHe\the\tPRP\tO\t2\tnsubj\n2\tleads\tlead\tVBZ\tO\t0\tROOT\n3\t,\t,\t,\tO\t_\t_\n\n1\tTeams\tteam\tNNS\tO\t2\tnsubj\n2\twin\twin\tVBP\tO\t0\tROOT\n3\tgames\tgame\tNNS\tO\t2\tdobj"
    put(tmp_path, "x", "1.conll", text)
    df = co.load_corpus(spark, str(tmp_path), fmt="conll")
    assert df.count() == 2 and {r["split"] for r in df.collect()} == {"train"}
    got = ft.extract_features(tk.clean_tokens(df), ft.FeatureOptions(unigram_pos="V", phrase_types="SVO,VO")).collect()
    # the last sentence counts although no blank line follows
    assert sorted(r["feature"] for r in got) == ["lead/V", "team/N_win/V_game/N", "win/V", "win/V_game/N"]


def test_feature_corpus_round_trip(spark, tmp_path, pets):
    distinct = pc.corpus_to_features(pets[0], str(tmp_path / "json"), features=UNI, inventory=str(tmp_path / "lists"))
    assert distinct.count() == 6
    back = co.read_feature_json(spark, str(tmp_path / "json"))
    assert sorted((r["label"], sorted(r["features"])) for r in back.collect()) == [
        ("earn", ["cat/N", "dog/N", "like/V"]), ("earn", ["cat/N", "dog/N", "like/V"]), ("not-earn", ["game/N", "kid/N", "play/V"]),
    ]
    part = next((tmp_path / "json").glob("part-*.gz"))
    assert all(len(json.loads(x)) == 2 for x in gzip.open(part, "rt"))
    assert spark.read.text(str(tmp_path / "lists")).where("list = 'all_features'").count() == 6


def test_json_labels_with_quotes(spark):
    line = json.dumps(['a "quoted", label', ["x/N", 'y"z/N']])
    row = co.parse_feature_json(lines(spark, line)).first()
    assert (row["label"], row["features"]) == ('a "quoted", label', ["x/N", 'y"z/N'])
    back = spark.createDataFrame([('a "q', ["x/N"])], "label string, features array<string>")
    assert json.loads(sinks.feature_json(back).first()[0]) == ['a "q', ["x/N"]]


def test_inventory_lists(spark):
    df = spark.createDataFrame([(f,) for f in ["big/J_cat/N", "eat/V_bird/N", "cat/N_eat/V_bird/N", "cat/N"]], "feature string")
    rows = sinks.feature_inventory_lists(df).collect()
    by = lambda n: sorted(r["value"] for r in rows if r["list"] == n)
    assert by("np_modifiers") == ["big/J"] and by("verbs") == ["eat/V"] and len(by("brackets")) == 4
    assert "(ROOT\n (NP (JJ big) (NN cat)))\n\n" in by("brackets")
    with pytest.raises(Exception, match="wrong feature type"):
        sinks.feature_inventory_lists(spark.createDataFrame([("a/N_b/V",)], "feature string")).collect()
    snippet = sinks.np_conll(df).collect()
    assert [r["value"] for r in snippet] == ["1\tbig\t2\tamod\n2\tcat\t0\troot\n\n"]


def test_composed_vectors(spark, tmp_path):
    (tmp_path / "1.sent").write_text("1\tbig\t2\tamod\n2\tcat\t0\troot\n")
    for name, text in (("1.apt.vec.gz", "Amod:X\t2\tdobj:y\t3\nignored\t1\n"), ("2.apt.vec.gz", "a\t1\n")):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)
    got = ve.read_composed_vectors(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("big cat", "amod:x", 2.0), ("big cat", "dobj:y", 3.0)]


def test_composed_vectors_in_folders(spark, tmp_path):
    for name, text in (("name=7.sent/part-0.txt", "1\tred\n2\tcar\n"), ("name=7.apt.vec.gz/part-0.txt", "A\t1\n"), ("8.sent", "1\tx\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in ve.read_composed_vectors(spark, str(tmp_path)).collect()] == [("red car", "a", 1.0)]


def test_merge_vectors(spark):
    uni = ve.parse_vectors(lines(spark, "a/N\tx\t1\ty\t2\nb/N\ty\t3\tz\t1\nc/V\tx\t2\tz\t2\na/N_b/N\tx\t9"))
    phrases = ve.parse_vectors(lines(spark, "big cat\tx\t1\tunknown\t5"))
    words, composed = pm.merge_vectors(uni, phrases, d=2)
    assert {r["feature"] for r in words.collect()} == {"a/N", "b/N", "c/V"}
    assert [len(r["embedding"]) for r in composed.collect()] == [2]


def test_dump(spark, pets):
    rows = vz.doc_term_counts(ft.extract_features(tk.clean_tokens(pets[0]), UNI).select("doc_id", "label", "feature"))
    docs = pets[0].select("doc_id", "label")
    wide = sinks.dump_dtm(rows, docs, ["cat/N", "game/N"]).orderBy("id")
    assert wide.columns == ["id", "target", "total_feat_weight", "nonzero_feats", "cat/N", "game/N"]
    assert [tuple(r) for r in wide.collect()] == [("t1", "earn", 1.0, 1, 1.0, 0.0), ("t2", "earn", 1.0, 1, 1.0, 0.0), ("t3", "not-earn", 1.0, 1, 0.0, 1.0)]
    assert {r["target"] for r in sinks.dump_dtm(rows, docs, test=True).collect()} == {""}


def test_scores_file(spark, tmp_path):
    df = spark.createDataFrame([("nb", 0, "f1", float("nan")), ("nb", 0, "acc", None)], "classifier string, cv_no int, metric string, score double")
    sinks.write_scores(df, str(tmp_path / "s"))
    assert {r["score"] for r in spark.read.csv(str(tmp_path / "s"), header=True, inferSchema=True).collect()} == {-1.0}
    with pytest.raises(ValueError):
        sinks.write_scores(df.where("false"), str(tmp_path / "t"))


# ------------------------------------------------------------------ experiments

BASE = dict(train_features=UNI, test_features=UNI)


def accuracy(result):
    return {r["score"] for r in result.scores.where("metric = 'accuracy_score'").collect()}


def test_testing_on_training_data_is_perfect(pets):
    e = ex.Experiment(split="oracle", classifiers={"multinomial_nb": {"alpha": 0.1}, "bernoulli_nb": {"alpha": 0.1}, "knn_classify": {"k": 1}}, **BASE)
    assert {r["score"] for r in ex.run_experiment(pets[0], e).scores.collect()} == {1.0}


@pytest.mark.parametrize("handler", ["signifier_signified", "signified_only"])
def test_expansion_with_thesaurus(spark, pets, tmp_path, handler):
    model = ex.Model(neighbours=ve.parse_thesaurus(lines(spark, PETS_THESAURUS)))
    e = ex.Experiment(split="subsampled_test_set", folds=2, sample_size=3, handler=handler, k=3, is_thesaurus=True, **BASE)
    result = ex.run_experiment(pets[0], e, model, pets[1], str(tmp_path / "out"))
    assert result.scores.count() == 2 * 7
    assert spark.read.csv(str(tmp_path / "out" / "scores"), header=True).count() == 14
    ev = result.coverage.where("stage = 'ev' and cv_fold = 0").collect()
    assert (len(ev), sum(r["count"] for r in ev)) == (5, 9)
    tr = result.coverage.where("stage = 'tr' and cv_fold = 0").collect()
    assert all((r["IV"], r["IT"]) == (1, 1) for r in tr) and sum(r["count"] for r in tr) == 9
    both = ex.run_experiment(pets[0], replace(e, train_handler="signified_only", dump=True), model, pets[1], str(tmp_path / "both"))
    assert {r["stage"] for r in both.replacements.collect()} == {"tr", "ev"}
    assert both.replacements.where("stage = 'ev'").exceptAll(result.replacements).count() == 0
    dumped = spark.read.parquet(str(tmp_path / "both" / "dump"))
    assert dumped.count() == both.dump.count() and {r["stage"] for r in dumped.collect()} == {"tr", "ev"}
    assert {r["target"] for r in dumped.where("stage = 'ev'").collect()} == {""}


@pytest.mark.parametrize("strategy", ["linear", "skipping"])
def test_expansion_with_vectors(spark, letters, strategy):
    text = "\n".join(f"{w}/N\tx\t{i + 1}\ty\t{7 - i}" for i, w in enumerate("abcdefg"))
    model = ex.Model(vectors=[ve.parse_vectors(lines(spark, text))])
    e = ex.Experiment(split="test_set", handler="signifier_signified", k=1, neighbour_strategy=strategy, **BASE)
    got = {r["feature"]: r["weight"] for r in ex.run_experiment(letters[0], e, model, letters[1]).test.collect()}
    # g is unknown; its nearest vocabulary entry is f, at a similarity just under 1
    assert got["a/N"] == 4 and got["c/N"] == 2 and 2.5 < got["f/N"] < 3 and "g/N" not in got


def test_several_vector_sets(spark, letters):
    text = "\n".join(f"{w}/N\tx\t{i + 1}\ty\t{7 - i}" for i, w in enumerate("abcdefg"))
    vectors = ve.parse_vectors(lines(spark, text))
    e = ex.Experiment(split="test_set", handler="signifier_signified", k=1, **BASE)
    got = {r["feature"]: r["weight"] for r in ex.run_experiment(letters[0], e, ex.Model(vectors=[vectors, vectors]), letters[1]).test.collect()}
    assert got["f/N"] == 3  # best rank in both sets


def test_clusters_and_random(spark, pets):
    names = ["cat/N", "dog/N", "like/V", "kid/N", "play/V", "game/N", "bird/N"]
    clusters = spark.createDataFrame([(f, i // 3) for i, f in enumerate(names)], "feature string, cluster int")
    result = ex.run_experiment(pets[0], ex.Experiment(split="test_set", **BASE), ex.Model(clusters=clusters), pets[1])
    assert {r["feature"] for r in result.vocab.collect()} == {"cluster0", "cluster1"}
    e = ex.Experiment(split="test_set", handler="signified_random", random_neighbours=True, k=2, **BASE)
    assert ex.run_experiment(pets[0], e, ex.Model(), pets[1]).test.agg(F.sum("weight")).first()[0] == 9 * 2


def test_random_neighbours_follow_the_handler(pets):
    e = ex.Experiment(split="test_set", random_neighbours=True, k=2, **BASE)
    base = ex.run_experiment(pets[0], e, ex.Model(), pets[1])
    known = {(r["doc_id"], r["feature"]): r["weight"] for r in base.test.collect()}
    marked = base.coverage.where("stage = 'ev'")
    assert {r["IT"] for r in marked.collect()} == {1}
    unknown = marked.where("IV = 0").agg(F.sum("count")).first()[0]
    assert unknown > 0
    e = ex.Experiment(split="test_set", handler="signifier_signified", random_neighbours=True, k=2, **BASE)
    mixed = {(r["doc_id"], r["feature"]): r["weight"] for r in ex.run_experiment(pets[0], e, ex.Model(), pets[1]).test.collect()}
    # features of the vocabulary stay, every occurrence of another draws two entries
    assert all(mixed[key] >= weight for key, weight in known.items())
    assert sum(mixed.values()) == sum(known.values()) + 2 * unknown


def test_entries_of_restricts_membership(spark, pets):
    near = ve.parse_thesaurus(lines(spark, PETS_THESAURUS))
    only = spark.createDataFrame([("cat/N",)], "feature string")
    e = ex.Experiment(split="test_set", handler="signified_only", is_thesaurus=True, min_df=2, **BASE)
    result = ex.run_experiment(pets[0], e, ex.Model(neighbours=near, entries_of=only), pets[1])
    assert {r["feature"] for r in result.coverage.where("IT = 1").collect()} == {"cat/N"}
    assert {r["feature"] for r in result.replacements.collect()} <= {"cat/N"}
    # rare training words are counted before the limit on document frequency
    assert {r["IV"] for r in result.coverage.where("stage = 'tr'").collect()} == {1}


def test_empty_conll_documents_stay(spark):
    docs = spark.createDataFrame([("a", "x", "1\tHe\the\tPRP\tO\t2\tnsubj"), ("b", "x", ""), ("c", "y", None)], "doc_id string, label string, text string")
    got = {r["doc_id"]: (len(r["tokens"]), len(r["edges"])) for r in co.parse_conll(docs).collect()}
    assert got == {"a": (1, 1), "b": (0, 0), "c": (0, 0)}


def test_json_ids_do_not_depend_on_the_scan(spark, tmp_path):
    (tmp_path / "c.json").write_text('["x", ["a/N"]]\n["x", ["a/N"]]\n["y", ["b/N"]]\n')
    first, second = ({r["doc_id"] for r in co.read_feature_json(spark, str(tmp_path)).repartition(n).collect()} for n in (1, 3))
    assert first == second and len(first) == 3


def test_wide_dumps_have_every_column(spark, pets):
    rows = vz.doc_term_counts(ft.extract_features(tk.clean_tokens(pets[0]), UNI).select("doc_id", "label", "feature"))
    names = ["cat/N", *[f"w{n}/N" for n in range(2001)]]
    assert sinks.dump_dtm(rows, pets[0].select("doc_id", "label"), names).columns[4:] == names


@pytest.mark.parametrize("n", [3, 2000])
def test_a_hot_feature_is_ranked_in_parts(spark, n):
    rows = [(s, "hot", f"n{i:05d}", 1 / (1 + i * 7919 % 3001)) for s in (0, 1) for i in range(3000)] + [(0, "cold", "x", 0.5), (1, "cold", "x", 0.4)]
    near = spark.createDataFrame(rows, "source_id int, feature string, neighbour string, sim double")
    linear = nb.neighbour_strategy(near.where("source_id = 0").drop("source_id"), n)
    combined = nb.combine_neighbours(near, per_source=n, k=n)
    for df in (linear, combined):
        assert "__part" in df._jdf.queryExecution().executedPlan().toString()
    best = sorted((r[1:] for r in rows if r[0] == 0), key=lambda r: (-r[2], r[1]))
    want = [x[1] for x in best if x[0] == "hot"][:n]
    for df in (linear, combined):
        got = {r["rank"]: r["neighbour"] for r in df.where("feature = 'hot'").select("rank", "neighbour").collect()}
        assert [got[i] for i in range(len(got))] == want
    everything = nb.combine_neighbours(near).where("feature = 'hot'").select("rank", "neighbour").collect()
    assert [r["neighbour"] for r in sorted(everything)] == [x[1] for x in best if x[0] == "hot"]


def test_selection_and_pruning(spark, pets):
    model = ex.Model(neighbours=ve.parse_thesaurus(lines(spark, PETS_THESAURUS)).where("feature <> 'kid/N'"))
    e = ex.Experiment(split="test_set", handler="signifier_signified", must_be_in_model=True, select_k=3, min_train_features=1, **BASE)
    result = ex.run_experiment(pets[0], e, model, pets[1])
    assert sorted(r["feature"] for r in result.vocab.collect()) == ["game/N", "play/V"]
    assert tuple(result.survival.first())[1:5] == (3, 1, 6, 2)


def test_misconfiguration(spark, pets):
    near = ve.parse_thesaurus(lines(spark, LETTERS_THESAURUS))
    clusters = spark.createDataFrame([("a/N", 0)], "feature string, cluster int")
    for e, model in [
        (ex.Experiment(must_be_in_model=True), ex.Model()),
        (ex.Experiment(must_be_in_model=True), ex.Model(neighbours=near)),
        (ex.Experiment(handler="signified_only"), ex.Model()),
        (ex.Experiment(), ex.Model(neighbours=near, clusters=clusters)),
        (ex.Experiment(handler="signified_random", random_neighbours=True, is_thesaurus=True), ex.Model(neighbours=near)),
    ]:
        with pytest.raises(ValueError):
            ex.run_experiment(pets[0], e, model)
    with pytest.raises(ValueError):
        ex.run_experiment(pets[0], ex.Experiment(split="skfold"), test_corpus=pets[1])


def test_preextracted_corpus(spark, tmp_path):
    train = spark.createDataFrame([nouns("t1", "earn", "a b c"), nouns("t2", "not-earn", "d e f")], SCHEMA)
    pc.corpus_to_features(train, str(tmp_path / "json"), features=UNI)
    corpus = co.load_corpus(spark, str(tmp_path / "json"), fmt="json")
    assert accuracy(ex.run_experiment(corpus, ex.Experiment(split="oracle", **BASE))) == {1.0}
