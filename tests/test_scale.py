"""Forms of the same rows that keep work in place: cheap tests before regular expressions, files listed by label, one pass over XML."""

import math
import os
import re

from pyspark.sql import functions as F

from wordfold.catalog import corpora as cat, inputs as i
from wordfold.functions import grammar as g, text as tx
from wordfold.functions.text import let
from wordfold.operators import crossval, neighbours as nb, search, vectorize as vz
from wordfold.sources import corpora as co, vectors as ve

WORDS = ["dogs", "dogs\r", "dogs ", "gas", "glass", "Ärgers", "ÉTÉ", "zebra", "Zebras", "[x]", "{x}", "", "12/23", "1e5", "+1e5", "nan", "NaN",
         "INF", "-inf", "infs", ".5e3", "n", "i", "1_0e2", "übers", "@a", "`a", "٣e٥", "ins"]


def test_cheap_tests_change_nothing(spark):
    rows = spark.createDataFrame([(w,) for w in [*WORDS, None]], "w string")
    got = rows.select(
        "w",
        tx.is_number(F.col("w")).alias("plain"),
        let(F.col("w"), tx.is_number_in_lambda).alias("cheap"),
        i._annotated(F.col("w"), F.lit(0)).alias("a"),
        F.when(F.char_length("w") > 4, F.regexp_replace("w", "s$", "")).otherwise(F.col("w")).alias("lemma"),
        (F.col("w").rlike("^[A-Z]")).alias("capital"),
        F.col("w").rlike(r"\p{L}").alias("lettered"),
        F.char_length("w").alias("n"),
    ).collect()
    for r in got:
        assert r.plain == r.cheap, r
        if r.w is None:
            continue
        assert r.a.lemma == r.lemma, r
        assert r.a.pos == (i.TAGS[r.n % 10] if r.lettered else "."), r
        wanted = None if r.n == 2 else "Person" if r.capital and r.n % 6 == 0 else "misc" if r.capital and r.n % 6 == 3 else "O"
        assert r.a.ner == wanted, r


def test_relations_of_neighbours(spark):
    # lengths 4, 3, 10, 5, 2: J N VBZ NNS IN
    line = spark.createDataFrame([("able dog abcdefghij birds of",)], "line string")
    s = line.select(i.annotated_line(F.col("line")).alias("s")).first().s
    tags = [t.pos for t in s.tokens]
    assert tags == ["JJ", "NN", "VBZ", "NNS", "IN"]
    assert [(e.head, e.dep, e.type) for e in s.edges] == [(2, 1, "amod"), (3, 2, "nsubj"), (3, 4, "dobj"), (4, 5, "dep")]


def test_feature_type_and_validity_agree(spark):
    kinds = {"cat/N": "1-GRAM", "big/J_cat/N": "AN", "a/N_b/V_c/N": "SVO", "a/N_b/V_c/N_d/N": "4-GRAM", "a/N_": "EMPTY", "1/N": "EMPTY", "a": "EMPTY",
             "a/N\n": "1-GRAM", "a/N_b/X": "2-GRAM", "_": "EMPTY"}
    rows = spark.createDataFrame([(f, k) for f, k in kinds.items()] + [(None, "EMPTY")], "feature string, kind string")
    for r in rows.select("*", g.feature_type(F.col("feature")).alias("got"), g.is_valid(F.col("feature")).alias("ok")).collect():
        assert r.got == r.kind and r.ok == (r.kind != "EMPTY"), r


def _documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_xml_is_written_compressed_and_listed_by_label(spark, tmp_path):
    d = _documents(spark, tmp_path, [(k, "a b c\n\nBirds fly, 1 < 2", lang, "s", 1) for k, lang in enumerate(["en", "de", "", None, "en"])])
    path = str(tmp_path / "out")
    docs = cat.parsed_documents(spark, d)
    cat.write_one_file_per_document(docs, cat._wrapped(cat.parsed_text(cat._sentence_xml, "\n")), path)
    files = [os.path.join(a, f) for a, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert len(files) == 5 and all(f.endswith(".gz") for f in files)
    read = co.read_parsed_xml(spark, path)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # one pass
    got = sorted((r.label, r.sent_id, [t.word for t in r.tokens]) for r in read.collect())
    none = "__HIVE_DEFAULT_PARTITION__"
    assert got == sorted((lab, n, w) for lab in ["en", "de", none, none, "en"] for n, w in [(1, ["a", "b", "c"]), (3, ["Birds", "fly,", "1", "<", "2"])])


def test_repeated_documents_are_one_with_all_their_sentences(spark, tmp_path):
    d = _documents(spark, tmp_path, [(1, "a b\nc", "en", "s", 1), (1, "d\n\ne f", "en", "s", 1), (2, None, "en", "s", 0), (3, " \t\n ", "en", "s", 0)])
    text = cat.parsed_documents(spark, d).select("doc_id", cat.parsed_text(lambda n, t, e: F.concat_ws(" ", n.cast("string"), t["word"]), "|").alias("t"))
    assert [tuple(r) for r in text.collect()] == [(1, "1 a b|1 d|2 c|3 e f")]


def test_a_document_of_malformed_sentences_stays(spark, tmp_path):
    (tmp_path / "en").mkdir()
    good = '<sentence id="7"><tokens><token id="1"><word>a</word></token></tokens></sentence>'
    for name, body in {"x": good + "<sentence><tokens>", "y": "<sentence><tokens>", "z": ""}.items():
        (tmp_path / "en" / f"{name}.tagged").write_text(f"<root><document><sentences>{body}</sentences></document></root>")
    got = sorted((os.path.basename(r.doc_id), r.sent_id, len(r.tokens)) for r in co.read_parsed_xml(spark, str(tmp_path)).collect())
    assert got == [("x.tagged", 7, 1), ("y.tagged", 1, 0), ("z.tagged", 1, 0)]
    assert co.read_parsed_xml(spark, str(tmp_path), keep_malformed=True).where("malformed").count() == 2
    assert co.malformed_xml(spark, str(tmp_path)).count() == 2


def test_draws_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(nb, "NAME_PARTS", 3)
    names = ["a", "b", "c", "d", "e", "f", "g", "g"]  # one name twice: two entries
    vocab = spark.createDataFrame([(v, n) for v in (0, 1) for n in names[: 8 - v]], "cv_no int, feature string")
    seen = spark.createDataFrame([(v, d, f, float(1 + d % 3)) for v in (0, 1) for d in range(20) for f in "abx"], "cv_no int, doc_id long, feature string, weight double")
    each = seen.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    drawn = nb.random_neighbours(each, vz.index_vocab(vocab, ["cv_no"]), 3, 5, ["doc_id", "feature", "__nth"], ["cv_no"])
    want = drawn.groupBy("cv_no", "doc_id", "neighbour").agg(F.count(F.lit(1)).cast("double"))
    got = vz.handle_random(seen, vocab, 3, 5, None, ["cv_no"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_combined_sets_move_once(spark):
    rows = [(s, f, n, round(1 / (1 + i + s), 3)) for s in (0, 1) for f in ("a", "b", "hot") for i, n in enumerate("cdefghij" if f == "hot" else "cd")]
    sets = spark.createDataFrame([*rows, (0, "alone", "c", 0.5)], "source_id int, feature string, neighbour string, sim double")
    together = nb.combine_neighbours(sets)
    apart = nb.combine_neighbours(sets, rows_together=5)
    assert together.columns == apart.columns and together.dtypes == apart.dtypes
    assert sorted(map(tuple, together.collect())) == sorted(map(tuple, apart.collect()))
    assert sorted(map(tuple, nb.combine_neighbours(sets, k=2).collect())) == sorted(map(tuple, nb.combine_neighbours(sets, k=2, rows_together=5).collect()))
    assert {r["feature"] for r in together.collect()} == {"a", "b", "hot"}
    plan = together._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") <= 1


def test_a_long_line_is_not_copied_for_each_pair(spark):
    line = "w\t" + "\t".join(f"n{i}\t{i}.5" for i in range(50)) + "\t"
    got = ve.parse_thesaurus(spark.createDataFrame([(line,), ("x\ty",), ("only",), ("z\ta\t1\tb",)], "value string"))
    assert {(r["feature"], r["neighbour"], r["sim"]) for r in got.collect()} == {("w", f"n{i}", i + 0.5) for i in range(50)} | {("z", "a", 1.0)}
    generate = next(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in x)
    assert re.search(r"\), \[\d+\], false", generate), generate  # what is exploded is not kept beside its rows


def test_models_that_are_not_broadcast_whole(spark, monkeypatch):
    docs = spark.createDataFrame([(d, "xyz"[d % 3]) for d in range(30)], "doc_id long, label string")
    rows = [(d, f, float(1 + (d * n) % 3)) for d in range(30) for n, f in enumerate(["the", "of", f"w{d % 7}", f"r{d}", "xyz"[d % 3] + "q"])]
    folded = crossval.Folded.of(spark.createDataFrame(rows, "doc_id long, feature string, weight double"), docs, 5)
    for judge in (crossval.multinomial_nb, crossval.bernoulli_nb):
        for training in (False, True):
            found = []
            for values in (1_000_000, 15 * 8, 1):  # all, some and no features
                monkeypatch.setattr(crossval, "BROADCAST_VALUES", values)
                found.append(sorted(map(tuple, judge(folded, training=training).collect())))
            assert found[0] == found[1] == found[2] and len(found[0]) == (120 if training else 30)


def test_dense_blocks_stay_few(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS_PER_BLOCK", 4)
    monkeypatch.setattr(search, "MOST_DENSE_BLOCKS", 3)
    monkeypatch.setattr(search, "DENSE_ROWS_PER_PART", 7)
    monkeypatch.setattr(search, "SCORES_AT_ONCE", 20)
    points = {f"p{i}": [float((i * 37) % 11 - 5), float((i * 53) % 17 - 8), 1.0] for i in range(60)}
    trace = []
    vectors = spark.createDataFrame(list(points.items()), "feature string, embedding array<float>")
    found = nb.knn_cosine(vectors, 2, candidates=1, trace=trace).collect()
    assert {r["block"] for t in trace for r in t.select("block").distinct().collect()} <= {0, 1, 2}
    for name, x in points.items():
        score = {o: round(sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y)), 9) for o, y in points.items() if o != name}
        want = sorted(score, key=lambda o: (-score[o], o))[:2]
        assert sorted(r["neighbour"] for r in found if r["feature"] == name) == sorted(want)
