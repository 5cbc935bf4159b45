"""Jobs that moved, wrote or left out more than they had to."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordfold.catalog import QUERIES, corpora as cat, evaluation as ev, inputs as i, matrices as mx, small_files
from wordfold.operators import classify as cl, vectorize as vz
from wordfold.plans import experiment as ex
from wordfold.sources import corpora as co, vectors as ve

TEXTS = ["The big cat likes red fruit", "A cat eats fruit\nthe dog runs", "dogs like cats", "le chat mange", "le chien court vite le soir", "cat dog cat"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """20 documents of two languages in 8 files, so that there are at least as many splits as cores; 12 have a quality label."""
    root = tmp_path_factory.mktemp("tables")
    rows = [(n, TEXTS[n % 6], "en" if n % 2 else "fr") for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8, "doc_id")
    for n in range(8):
        docs.where(f"pmod(doc_id, 8) = {n}").coalesce(1).write.mode("append").parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(n, n % 2) for n in range(12)], "doc_id long, quality int").write.parquet(str(root / "labels.parquet"))
    return str(root), rows


def recorded(monkeypatch, module):
    names, keep = [], module.materialize

    def materialize(df, name, *schema):
        names.append(name)
        return keep(df, name, *schema)

    monkeypatch.setattr(module, "materialize", materialize)
    return names


@pytest.mark.parametrize("name", ["ngrams", "extract_features", "doc_term_counts"])
def test_texts_are_moved_and_not_what_is_taken_from_them(spark, tables, name):
    path, rows = tables
    assert i.documents(spark, path).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = QUERIES[name](spark, path)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    moved = [x for x in plan.split("\n") if "Exchange" in x]
    assert len(moved) == 1 and "hashpartitioning(doc_id" in moved[0], plan
    if name == "doc_term_counts":
        want = Counter((n, w) for n, text, _ in rows for w in text.lower().split())
        assert {(r["doc_id"], r["feature"]): r["weight"] for r in got.collect()} == want


def test_rows_with_the_folds_of_their_document(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 1.0), (3, "c", 1.0), (None, "a", 1.0)], "doc_id long, feature string, weight double")
    # document 1 is listed twice, 3 not at all
    train = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (0, None)], "cv_no int, doc_id long")
    test = spark.createDataFrame([(1, 1)], "cv_no int, doc_id long")
    both = vz.with_folds(rows, ["cv_no"], train=train, test=test)
    for count in (vz.build_vocab, vz.feature_totals):
        want = rows.join(train, "doc_id")
        assert sorted(map(tuple, count(both, ["cv_no"], "train").collect())) == sorted(map(tuple, count(want, ["cv_no"]).collect()))
        assert sorted(map(tuple, count(rows, ["cv_no"], train).collect())) == sorted(map(tuple, count(want, ["cv_no"]).collect()))
    assert [tuple(r) for r in both.selectExpr("feature", "inline(test)").orderBy("feature").collect()] == [("a", 1), ("b", 1)]


def test_a_thesaurus_is_written_once(spark, tables, monkeypatch):
    names = recorded(monkeypatch, mx)
    mx.stored_thesaurus(spark, tables[0])
    assert names == ["thesaurus"]


def test_coverage_of_both_stages(spark, tables):
    path, rows = tables
    total = Counter(w for _, text, _ in rows for w in text.lower().split())
    got = QUERIES["coverage_counts"](spark, path).collect()
    for stage, times in (("ev", 1), ("tr", 4)):
        seen = Counter()
        for r in got:
            if r["stage"] == stage:
                seen[r["feature"]] += r["count"]
        assert seen == {w: n * times for w, n in total.items()}
    assert {r["IV"] for r in got if r["stage"] == "tr"} == {1}


def test_an_experiment_writes_its_training_matrix_once(spark, monkeypatch):
    rows = [(n, "xy"[n % 2], ["a/N", "b/N", f"c{n}/N"]) for n in range(10)]
    corpus = spark.createDataFrame(rows, "doc_id long, label string, features array<string>")
    names = recorded(monkeypatch, ex)
    whole = ex.run_experiment(corpus, ex.Experiment(min_df=2, classifiers={"most_common_label": {}}))
    assert names.count("train") == 1 and "train-kept" not in names
    assert {r["feature"] for r in whole.train.select("feature").collect()} == {"a/N", "b/N"}
    assert whole.train.count() == 5 * 8 * 2 and whole.test.count() == 5 * 2 * 2
    cut = ex.run_experiment(corpus, ex.Experiment(min_df=2, select_k=1, classifiers={"most_common_label": {}}))
    assert "train-kept" in names and cut.train.select("feature").distinct().count() == 1
    keeps = {(a, b): vz.KEEP for a in (True, False) for b in (True, False)}
    assert ex._in_vocabulary("signified_only") and not ex._in_vocabulary(keeps)


def test_svc_trains_all_folds_to_the_end(spark, tables, monkeypatch):
    seen = {}

    def taken(train, train_docs, test, test_docs, vocab, C, by, **options):
        seen.update(folds=train_docs.select(*by).distinct().count(), docs=test_docs.count(), options=options)
        return test_docs

    monkeypatch.setattr(ev.cl, "linear_svc", taken)
    QUERIES["linear_svc"](spark, tables[0])
    assert seen == {"folds": 5, "docs": 12, "options": {}}


def test_fits_side_by_side_stay_within_memory():
    assert [cl.fits_at_once(n) for n in (0, 10, 400_000, 5_000_000)] == [4, 4, 2, 1]


def test_a_composed_vector_is_cut_up_once(spark, tmp_path):
    n = 30
    for name, text in (("1.sent", "1\tbig\n2\tcat\n"), ("1.apt.vec.gz", "\t".join(f"C{k}\t{k}" for k in range(n)) + "\t\n"), ("2.sent", "1\tx\n"), ("2.apt.vec.gz", "\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0.txt").write_text(text)
    got = ve.read_composed_vectors(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(("big cat", f"c{k}", float(k)) for k in range(n))
    generate = next(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in x)
    assert generate.count("regexp_replace") == 1, generate


def test_files_of_documents_are_written_by_tasks(spark, tmp_path, monkeypatch):
    labels = ["en", "a b", "a/b", "50%", "x:y=z", "q\"'*?\\{[]}^#", "\u00fc", "", None, "en", "en"]
    rows = [(n, lab, f"text {n}" if n < 10 else None) for n, lab in enumerate(labels)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, label string, text string")
    listed = lambda p: sorted(x for x in os.listdir(p) if x[0] not in "._")
    cat.write_one_file_per_document(docs, F.col("text"), f"file:{tmp_path}/tasks")
    assert not [f for _, _, names in os.walk(tmp_path / "tasks") for f in names if not f.startswith("part-")]  # no checksums, nothing unfinished
    monkeypatch.setattr(small_files, "is_plain", lambda path: False)
    cat.write_one_file_per_document(docs, F.col("text"), f"{tmp_path}/spark")
    assert listed(tmp_path / "tasks") == listed(tmp_path / "spark")
    read = lambda p: sorted((r["label"], r["text"]) for r in co.read_labelled_dir(spark, f"{tmp_path}/{p}").collect())
    assert read("tasks") == read("spark") and len(read("tasks")) == 12


def test_composed_vectors_of_repeated_documents(spark, tmp_path, monkeypatch):
    rows = [(1, "a b a", "en"), (1, "c", "en"), (2, "a", "en"), (3, "...", "en"), (None, "z", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = lambda: sorted(map(tuple, QUERIES["read_composed_vectors"](spark, str(tmp_path)).collect()))
    by_tasks = found()
    monkeypatch.setattr(small_files, "is_plain", lambda path: False)
    assert by_tasks == found() and len(by_tasks) == 4
