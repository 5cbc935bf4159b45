"""Readers and writers, exercised by writing the given tables and reading them back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordfold.catalog import inputs as i, small_files
from wordfold.catalog.evaluation import _FOLDED, _FOLD_ROWS, _TWO_SQL, _scores_sql, two_classifiers
from wordfold.catalog.matrices import BY, REPLACE, SPLIT, THESAURUS, stored_thesaurus, test_parts, thesaurus
from wordfold.catalog.registry import query, with_ctes
from wordfold.catalog.vectors import dense_as_sparse
from wordfold.functions.text import let
from wordfold.operators import features as ft, metrics as mt, reduce as rd, stats, tokens as tk, vectorize as vz
from wordfold.plans import experiment as ex
from wordfold.sources import corpora as co, sinks, vectors as ve
from wordfold.storage import materialize, scratch_path


_NO_LABEL = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder for rows without a value


def write_one_file_per_document(docs, value: Column, path: str) -> None:
    """``value`` of every row as a directory corpus: a directory per label, a file per document.

    Rows are put in order of their label before ``value`` makes them large, so that Spark need not sort (and spill) them after;
    files are compressed, and moved to their place by the tasks, not one by one by the driver.
    """
    label = F.coalesce(F.when(F.col("label").cast("string") != "", F.col("label").cast("string")), F.lit(_NO_LABEL))
    rows = docs.withColumn("label", label)
    if small_files.is_plain(path):
        # in an order that another attempt of a task repeats; rows that agree in it are equal
        named = F.concat(F.lit("label="), small_files.escaped(F.col("label")), F.lit("/part-"), F.lpad(F.spark_partition_id().cast("string"), 5, "0"))
        rows = rows.sortWithinPartitions("label", *docs.columns).select(F.concat(named, F.lit("-")).alias("name"), value.alias("value"))
        small_files.write(rows, path, numbered=".txt.gz")
        return
    rows = rows.sortWithinPartitions("label").select("label", value.alias("value"))
    writer = rows.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    writer.option("compression", "gzip").partitionBy("label").text(path)


@query("read_labelled_dir", "SELECT lang AS label, md5(text || chr(10)) AS digest, count(*) AS n FROM documents GROUP BY ALL")
def read_labelled_dir(spark, d):
    path = scratch_path(spark, "raw")
    write_one_file_per_document(i.documents(spark, d), F.col("text"), path)
    return co.read_labelled_dir(spark, path).groupBy("label", F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


def _escaped(text: Column) -> Column:
    out = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    # characters XML cannot hold
    return F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def _sentence_xml(sent_id: Column, tokens: Column, edges: Column) -> Column:
    token = lambda t: F.concat(
        F.lit('<token id="'), t["idx"].cast("string"), F.lit('"><word>'), _escaped(t["word"]), F.lit("</word><lemma>"),
        _escaped(t["lemma"]), F.lit("</lemma><POS>"), t["pos"], F.lit("</POS>"),
        F.coalesce(F.concat(F.lit("<NER>"), t["ner"], F.lit("</NER>")), F.lit("")), F.lit("</token>"),
    )
    edge = lambda e: F.concat(
        F.lit('<dep type="'), e["type"], F.lit('"><governor idx="'), e["head"].cast("string"), F.lit('">-</governor><dependent idx="'),
        e["dep"].cast("string"), F.lit('">-</dependent></dep>'),
    )
    return F.concat(
        F.lit('<sentence id="'), sent_id.cast("string"), F.lit('"><tokens>'), F.array_join(F.transform(tokens, token), ""),
        F.lit("</tokens><collapsed-ccprocessed-dependencies>"), F.array_join(F.transform(edges, edge), ""),
        F.lit("</collapsed-ccprocessed-dependencies></sentence>"),
    )


def parsed_documents(spark, d):
    """One row per document with sentences, ``(doc_id, label, texts)``; ``parsed_text`` writes them as text.

    Only texts are moved, as they were read; sentences are made in place.
    """
    docs = i.documents(spark, d).groupBy("doc_id", "label").agg(F.collect_list("text").alias("texts"))
    return docs.where(F.exists("texts", lambda t: t.rlike(r"[^ \t\n]")))


def parsed_text(sentence, joiner: str) -> Column:
    """The sentences of a document of ``parsed_documents``; those of repeated rows follow each other by number."""

    def written(line: Column, at: Column) -> Column:
        s = i.annotated_line(line)
        return let(s, lambda x: F.when(F.size(x["tokens"]) > 0, F.struct(at.alias("sent_id"), sentence(at + 1, x["tokens"], x["edges"]).alias("s"))))

    lines = F.flatten(F.transform("texts", lambda t: F.filter(F.transform(F.split(t, "\n"), written), lambda x: x.isNotNull())))
    ordered = F.when(F.size("texts") > 1, F.sort_array(lines)).otherwise(lines)
    return F.array_join(F.transform(ordered, lambda x: x["s"]), joiner)


def _wrapped(text: Column) -> Column:
    return F.concat(F.lit("<root><document><sentences>\n"), text, F.lit("\n</sentences></document></root>"))


_COUNTS = """SELECT label, text, pos, ner, count(*) AS n FROM kept GROUP BY ALL"""


def _token_counts(sentences):
    kept = tk.clean_token_rows(sentences)
    return kept.groupBy("label", "text", "pos", "ner").agg(F.count(F.lit(1)).alias("n"))


@query("read_parsed_xml", with_ctes(i.KEPT, select=_COUNTS))
def read_parsed_xml(spark, d):
    path = scratch_path(spark, "xml")
    write_one_file_per_document(parsed_documents(spark, d), _wrapped(parsed_text(_sentence_xml, "\n")), path)
    return _token_counts(co.read_parsed_xml(spark, path))


# sentences of 3, 10, 17, ... tokens lose a closing tag; documents whose sentences all did so stay
_BROKEN_SQL = f"""{i.TOKENS},
per_sentence AS (SELECT doc_id, label, len(ws) AS n FROM sent_words WHERE len(ws) > 0),
per_doc AS (SELECT doc_id, label, count(*) FILTER (n % 7 <> 3) AS good, count(*) FILTER (n % 7 = 3) AS bad,
  coalesce(sum(n) FILTER (n % 7 <> 3), 0)::BIGINT AS tokens FROM per_sentence GROUP BY ALL)"""


def broken_xml(spark, d) -> str:
    def broken(sent_id: Column, tokens: Column, edges: Column) -> Column:
        whole = _sentence_xml(sent_id, tokens, edges)
        return F.when(F.size(tokens) % 7 == 3, F.replace(whole, F.lit("</tokens>"), F.lit(""))).otherwise(whole)

    path = scratch_path(spark, "xml")
    write_one_file_per_document(parsed_documents(spark, d), _wrapped(parsed_text(broken, "\n")), path)
    return path


@query(
    "read_parsed_xml_malformed",
    with_ctes(
        _BROKEN_SQL,
        select="""SELECT label, good + bad AS sentences, bad AS malformed, tokens, count(*) AS docs FROM per_doc GROUP BY ALL""",
    ),
)
def read_parsed_xml_malformed(spark, d):
    read = co.read_parsed_xml(spark, broken_xml(spark, d), keep_malformed=True)
    per_doc = read.groupBy("doc_id", "label").agg(
        F.count(F.lit(1)).alias("sentences"), F.count_if("malformed").alias("malformed"), F.sum(F.size("tokens")).alias("tokens")
    )
    return per_doc.groupBy("label", "sentences", "malformed", "tokens").agg(F.count(F.lit(1)).alias("docs"))


@query(
    "read_parsed_xml_dropped",
    with_ctes(
        _BROKEN_SQL,
        select="SELECT label, greatest(good, 1) AS sentences, tokens, count(*) AS docs FROM per_doc GROUP BY ALL",
    ),
)
def read_parsed_xml_dropped(spark, d):
    read = co.read_parsed_xml(spark, broken_xml(spark, d))
    per_doc = read.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.size("tokens")).alias("tokens"))
    return per_doc.groupBy("label", "sentences", "tokens").agg(F.count(F.lit(1)).alias("docs"))


def _conll_block(sent_id: Column, tokens: Column, edges: Column) -> Column:
    size = F.size(tokens)
    rel = lambda t: F.when(t["idx"] < size, F.lit("dep")).otherwise(F.lit("_"))
    head = lambda t: F.when(t["idx"] < size, (t["idx"] + 1).cast("string")).otherwise(F.lit("_"))
    row = lambda t: F.concat_ws(
        "\t", t["idx"].cast("string"), t["word"], t["lemma"], t["pos"], F.coalesce(t["ner"], F.lit("MISSING")), head(t), rel(t)
    )
    return F.array_join(F.transform(tokens, row), "\n")


# every token hangs on the next one
_CHAIN = f"""{i.KEPT},
next AS (SELECT *, lead(keep) OVER w AS keep2, lead(idx) OVER w AS idx2 FROM marked WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY idx)),
per_doc AS (SELECT doc_id, count(*) FILTER (keep) AS tokens, count(*) FILTER (keep AND keep2) AS edges,
  sum(CASE WHEN keep AND keep2 THEN idx2 ELSE 0 END)::BIGINT AS heads,
  sum(CASE WHEN keep THEN length(text) ELSE 0 END)::BIGINT AS chars FROM next GROUP BY doc_id)"""


@query("parse_conll", with_ctes(_CHAIN, select="SELECT * FROM per_doc"))
def parse_conll(spark, d):
    cleaned = tk.clean_tokens(co.parse_conll(parsed_documents(spark, d).select("doc_id", "label", parsed_text(_conll_block, "\n\n").alias("text"))))
    total = lambda arr, f: F.sum(F.aggregate(arr, F.lit(0).cast("long"), lambda a, x: a + f(x)))
    return cleaned.groupBy("doc_id").agg(
        F.sum(F.size("tokens")).alias("tokens"),
        F.sum(F.size("arcs")).alias("edges"),
        total("arcs", lambda a: a["head"]["idx"]).alias("heads"),
        total("tokens", lambda t: F.char_length(t["text"])).alias("chars"),
    )


@query("read_conll", with_ctes(i.KEPT, select=_COUNTS))
def read_conll(spark, d):
    path = scratch_path(spark, "conll")
    write_one_file_per_document(parsed_documents(spark, d), F.concat(parsed_text(_conll_block, "\n\n"), F.lit("\n")), path)
    return _token_counts(co.load_corpus(spark, path, fmt="conll").drop("split"))


_PER_DOC = with_ctes(i.PHRASES, select="SELECT label, feature, count(*) AS n FROM feats GROUP BY ALL")


def written_corpus(spark, d) -> str:
    path = scratch_path(spark, "features")
    sinks.write_feature_corpus(ft.extract_features(i.cleaned(spark, d)).select("doc_id", "label", "feature"), path)
    return path


def _label_counts(docs):
    return co.explode_features(docs).groupBy("label", "feature").agg(F.count(F.lit(1)).alias("n"))


@query("write_feature_corpus", _PER_DOC)
def write_feature_corpus(spark, d):
    return _label_counts(co.read_feature_json(spark, written_corpus(spark, d)))


@query(
    "parse_feature_json",
    with_ctes(
        i.PHRASES,
        select="SELECT doc_id, label, count(*) AS n, min(feature) AS first_feature, max(feature) AS last_feature FROM feats GROUP BY ALL",
    ),
)
def parse_feature_json(spark, d):
    rows = ft.extract_features(i.cleaned(spark, d)).select("doc_id", "label", "feature")
    text = sinks.feature_corpus(rows).select("doc_id", sinks.json_line(F.col("label"), F.col("features")).alias("value"))
    docs = co.parse_feature_json(text)
    return docs.select(
        "doc_id",
        "label",
        F.size("features").alias("n"),
        F.array_min("features").alias("first_feature"),
        F.array_max("features").alias("last_feature"),
    )


@query(
    "load_corpus",
    with_ctes(
        i.PHRASES,
        select="""SELECT split, label, feature, count(*) AS n FROM feats, (SELECT unnest(['train', 'test']) AS split) GROUP BY ALL""",
    ),
)
def load_corpus(spark, d):
    path = written_corpus(spark, d)
    docs = co.load_corpus(spark, path, path, "json")
    return (
        docs.select("split", "label", F.explode("features").alias("feature")).groupBy("split", "label", "feature").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "write_feature_inventory",
    with_ctes(
        i.PHRASES,
        "inv AS (SELECT DISTINCT ftype, feature, string_split(feature, '_') AS t FROM feats)",
        "lists AS (SELECT 'all_features' AS list, feature AS value FROM inv"
        " UNION ALL SELECT DISTINCT 'np_modifiers', t[1] FROM inv WHERE ftype IN ('AN', 'NN')"
        " UNION ALL SELECT DISTINCT 'verbs', t[len(t) - 1] FROM inv WHERE ftype IN ('VO', 'SVO')"
        " UNION ALL SELECT 'brackets', CASE ftype"
        " WHEN 'VO' THEN '(ROOT\n  (S\n    (VP (VB ' || string_split(t[1], '/')[1] || ')\n      (NP (NN ' || string_split(t[2], '/')[1] || ')))))\n\n'"
        " WHEN 'SVO' THEN '(ROOT\n  (S\n    (NP (NN ' || string_split(t[1], '/')[1] || '))\n    (VP (VB ' || string_split(t[2], '/')[1] || ')\n      (NP (NN '"
        " || string_split(t[3], '/')[1] || ')))))\n\n'"
        " WHEN '1-GRAM' THEN '(ROOT\n (NP (' || repeat(string_split(t[1], '/')[2], 2) || ' ' || string_split(t[1], '/')[1] || ')))\n\n'"
        " ELSE '(ROOT\n (NP (' || repeat(string_split(t[1], '/')[2], 2) || ' ' || string_split(t[1], '/')[1] || ') ('"
        " || repeat(string_split(t[2], '/')[2], 2) || ' ' || string_split(t[2], '/')[1] || ')))\n\n' END FROM inv)",
        select="SELECT list, md5(value) AS digest, count(*) AS n FROM lists GROUP BY ALL",
    ),
)
def write_feature_inventory(spark, d):
    features = ft.extract_features(i.cleaned(spark, d)).select("feature")
    return sinks.feature_inventory_lists(features).groupBy("list", F.md5("value").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "export_np_conll",
    with_ctes(
        i.PHRASES,
        "np AS (SELECT DISTINCT ftype, feature, string_split(feature, '_') AS t FROM feats WHERE ftype IN ('AN', 'NN'))",
        "snippets AS (SELECT '1' || chr(9) || string_split(t[1], '/')[1] || chr(9) || '2' || chr(9) || CASE ftype WHEN 'AN' THEN 'amod' ELSE 'compound' END"
        " || chr(10) || '2' || chr(9) || string_split(t[2], '/')[1] || chr(9) || '0' || chr(9) || 'root' || chr(10) || chr(10) AS value FROM np)",
        select="SELECT value, count(*) AS n FROM snippets GROUP BY value",
    ),
)
def export_np_conll(spark, d):
    phrases = ft.extract_features(i.cleaned(spark, d), ft.FeatureOptions(unigram_pos="", phrase_types=("AN", "NN")))
    return sinks.np_conll(phrases).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- vector files


def _as_lines(rows, key: str, value: str):
    """Ragged lines of an entry with its pairs; entries are as wide as their vector."""
    cells = F.sort_array(F.collect_list(F.concat_ws("\t", key, F.col(value).cast("string"))))
    return rows.groupBy("feature").agg(cells.alias("c")).select(F.concat_ws("\t", "feature", F.array_join("c", "\t")).alias("value"))


_VECTOR_SUMS = "SELECT feature, count(*) AS contexts, sum(weight) AS weight, min(ctx) AS first_ctx, max(ctx) AS last_ctx FROM {0} GROUP BY {1}"


def _sums(df, *by):
    return df.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("contexts"), F.sum("weight").alias("weight"), F.min("ctx").alias("first_ctx"), F.max("ctx").alias("last_ctx")
    )


@query("read_vectors_tsv", with_ctes(i.VECTORS, select=_VECTOR_SUMS.format("vectors", "feature")))
def read_vectors_tsv(spark, d):
    path = scratch_path(spark, "vectors")
    _as_lines(i.context_vectors(spark, d), "ctx", "weight").write.text(path)
    return _sums(ve.read_vectors_tsv(spark, path))


@query(
    "read_thesaurus_tsv",
    with_ctes(THESAURUS, select="SELECT feature, count(*) AS n, round(sum(sim), 6) AS sim, min(neighbour) AS first_neighbour FROM thesaurus GROUP BY feature"),
)
def read_thesaurus_tsv(spark, d):
    path = scratch_path(spark, "thesaurus")
    # a trailing tab, as such files have it
    _as_lines(thesaurus(spark, d), "neighbour", "sim").select(F.concat("value", F.lit("\t"))).write.text(path)
    return ve.read_thesaurus_tsv(spark, path).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("sim"), 6).alias("sim"), F.min("neighbour").alias("first_neighbour")
    )


@query(
    "read_vector_sets",
    with_ctes(
        i.VECTORS,
        "sets AS (SELECT substr(ctx, 1, 2) AS side, * FROM vectors)",
        select="""SELECT CASE side WHEN 'l:' THEN 0 ELSE 1 END AS source_id, feature, count(*) AS contexts, sum(weight) AS weight,
  min(ctx) AS first_ctx, max(ctx) AS last_ctx FROM sets GROUP BY side, feature""",
    ),
)
def read_vector_sets(spark, d):
    vectors, paths = i.context_vectors(spark, d), []
    for side in ("l:", "r:"):
        paths.append(scratch_path(spark, "vectors"))
        _as_lines(vectors.where(F.col("ctx").startswith(side)), "ctx", "weight").write.text(paths[-1])
    return _sums(ve.read_vector_sets(spark, paths), "source_id")


@query(
    "read_composed_vectors",
    with_ctes(
        i.WORD_LISTS,
        "phrases AS (SELECT doc_id, md5(array_to_string(ws, ' ')) AS phrase, unnest(ws) AS w FROM word_lists)",
        "counted AS (SELECT doc_id, phrase, 't:' || w AS ctx, count(*)::DOUBLE AS weight FROM phrases GROUP BY ALL)",
        select="SELECT phrase, ctx, weight FROM counted",
    ),
)
def read_composed_vectors(spark, d):
    """Every document as a phrase with the counts of its words as its vector, a file of each kind."""
    path = scratch_path(spark, "composed")
    docs = i.documents(spark, d, together=True).select("doc_id", i.word_array().alias("ws")).where(F.size("ws") > 0)
    line = F.array_join(F.transform("ws", lambda w, at: F.concat_ws("\t", (at + 1).cast("string"), w)), "\n")
    name = lambda kind: F.concat(F.col("doc_id").cast("string"), F.lit(kind)).alias("name")
    lines = docs.select("doc_id", line.alias("value"))
    rows = docs.select("doc_id", F.explode("ws").alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.collect_list(F.concat_ws("\t", F.concat(F.lit("T:"), "w"), F.col("n").cast("string")))
    vectors = rows.groupBy("doc_id").agg(F.array_join(pairs, "\t").alias("value")).select(name(".apt.vec.gz"), "value")
    if small_files.is_plain(path):
        # the lines of repeated rows follow each other in the file of their document
        whole = lines.groupBy("doc_id").agg(F.array_join(F.collect_list("value"), "\n").alias("value")).select(name(".sent"), "value")
        for files in (whole, vectors):
            small_files.write(files.where("name is not null"), path)
    else:
        # a folder for each document: tasks move their own, the driver would do it one by one
        by_tasks = ("mapreduce.fileoutputcommitter.algorithm.version", 2)
        lines.select(name(".sent"), "value").write.option(*by_tasks).partitionBy("name").text(path)
        vectors.write.mode("append").option(*by_tasks).partitionBy("name").option("compression", "gzip").text(path)
    return ve.read_composed_vectors(spark, path).select(F.md5("feature").alias("phrase"), "ctx", "weight")


@query("vector_entries", with_ctes(i.VECTORS, select="SELECT DISTINCT feature FROM vectors"))
def vector_entries(spark, d):
    path = scratch_path(spark, "vectors")
    _as_lines(i.context_vectors(spark, d), "ctx", "weight").write.text(path)
    return ve.vector_entries(spark, path)


@query("read_clusters", with_ctes(i.DENSE, select="SELECT feature, cluster FROM dense"))
def read_clusters(spark, d):
    path = scratch_path(spark, "clusters")
    i.dense_vectors(spark, d).select("feature", F.col("cluster").cast("int").alias("cluster")).write.parquet(path)
    return ve.read_clusters(spark, path)


@query("write_reduced_vectors")
def write_reduced_vectors(spark, d):
    vectors = dense_as_sparse(spark, d)
    loadings = rd.long_loadings(rd.svd_fit(vectors, 4, iterations=2))
    path = scratch_path(spark, "reduced")
    sinks.write_reduced_vectors(rd.pack_reduced(rd.svd_project(vectors, loadings)), path)
    return spark.read.schema("feature string, embedding array<double>").parquet(path)


# ---------------------------------------------------------------- results


@query("write_scores", with_ctes(_FOLDED, *_TWO_SQL, *_scores_sql("classifier, cv_no"), select=_FOLD_ROWS))
def write_scores(spark, d):
    path = scratch_path(spark, "scores")
    sinks.write_scores(mt.scores_per_fold(two_classifiers(spark, d)), path)
    rows = spark.read.csv(path, header=True, schema="classifier string, cv_no int, metric string, score double")
    return rows.withColumn("score", F.round("score", 6))


@query("write_predictions", with_ctes(_FOLDED, *_TWO_SQL, select="SELECT cv_no, classifier, doc_id, prediction FROM judged"))
def write_predictions(spark, d):
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(two_classifiers(spark, d), path)
    schema = "doc_id long, prediction string, cv_no int, classifier string"
    return spark.read.csv(path, header=True, schema=schema).select("cv_no", "classifier", "doc_id", "prediction")


@query("write_gold", with_ctes(_FOLDED, select="SELECT cv_no, doc_id, label FROM test_docs"))
def write_gold(spark, d):
    from wordfold.operators import splits

    folds = splits.stratified_kfold(i.doc_labels(spark, d), 5)
    path = scratch_path(spark, "gold")
    sinks.write_gold(folds.where("role = 'test'"), path)
    return spark.read.csv(path, header=True, schema="doc_id long, label string, cv_no int").select("cv_no", "doc_id", "label")


@query(
    "write_stats",
    with_ctes(
        REPLACE,
        select="""SELECT cv_no AS cv_fold, 'ev' AS stage, iv::INT AS "IV", it::INT AS "IT", count(DISTINCT feature) AS types, sum(weight)::BIGINT AS tokens,
  CASE WHEN NOT iv AND it THEN count(DISTINCT feature) END AS replaced_types, CASE WHEN NOT iv AND it THEN sum(weight)::BIGINT END AS replaced_tokens
FROM flags GROUP BY cv_no, iv, it""",
    ),
)
def write_stats(spark, d):
    vocab, test, _ = test_parts(spark, d)
    near = stored_thesaurus(spark, d)
    # occurrences of a feature are added up before they are marked
    marked = materialize(vz.mark_iv_it(vz.feature_totals(test, BY), vocab, near, BY), "marked")
    path = scratch_path(spark, "stats")
    looked_up = marked.where("not iv and it")
    sinks.write_stats(stats.coverage_counts(marked, "ev"), stats.replacement_counts(looked_up, near, vocab, 3, "ev", BY), path)
    rows = spark.read.parquet(f"{path}/coverage")
    covered = rows.groupBy("cv_fold", "stage", "IV", "IT").agg(F.count_distinct("feature").alias("types"), F.sum("count").alias("tokens"))
    given = spark.read.parquet(f"{path}/replacements").groupBy("cv_fold", "stage", F.lit(0).alias("IV"), F.lit(1).alias("IT"))
    replaced = given.agg(F.count_distinct("feature").alias("replaced_types"), F.sum("count").alias("replaced_tokens"))
    return covered.join(replaced, ["cv_fold", "stage", "IV", "IT"], "left")


@query(
    "all_corpora",
    "WITH ws AS (SELECT 'documents' AS corpus, unnest(regexp_split_to_array(lower(text), '[^\\pL]+')) AS feature FROM documents "
    "UNION ALL SELECT 'conversations', unnest(regexp_split_to_array(lower(text), '[^\\pL]+')) FROM conversations) "
    "SELECT corpus, feature, count(*) AS n FROM ws WHERE feature <> '' GROUP BY ALL",
)
def all_corpora(spark, d):
    talks = i.table(spark, d, "conversations").select("text")
    both = co.all_corpora({"documents": i.documents(spark, d).select("text"), "conversations": talks})
    words = both.select("corpus", F.explode_outer(i.word_array()).alias("feature")).where("feature is not null")
    return words.groupBy("corpus", "feature").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- whole experiment

_LANG_NB = [s for s in _TWO_SQL[:-2]]


@query(
    "run_experiment",
    with_ctes(
        SPLIT.split(",\nfolds AS")[0],
        "assigned AS (SELECT doc_id, label, ntile(5) OVER (PARTITION BY label ORDER BY doc_id) - 1 AS fold FROM docs)",
        "folds AS (SELECT doc_id, label, cv_no, CASE WHEN fold = cv_no THEN 'test' ELSE 'train' END AS role FROM assigned, range(5) r(cv_no))",
        "feats0 AS (SELECT doc_id, feature || '/N' AS feature, weight FROM dtm)",
        "train_docs AS (SELECT cv_no, doc_id, label FROM folds WHERE role = 'train')",
        "test_docs AS (SELECT cv_no, doc_id, label FROM folds WHERE role = 'test')",
        "train0 AS (SELECT f.cv_no, f.doc_id, f.label, d.feature, d.weight FROM train_docs f JOIN feats0 d ON f.doc_id = d.doc_id)",
        "vocab AS (SELECT cv_no, feature FROM train0 GROUP BY ALL HAVING count(*) >= 2)",
        "train AS (SELECT t.* FROM train0 t JOIN vocab v ON v.cv_no = t.cv_no AND v.feature = t.feature)",
        "test AS (SELECT f.cv_no, f.doc_id, d.feature, d.weight FROM test_docs f JOIN feats0 d ON f.doc_id = d.doc_id "
        "JOIN vocab v ON v.cv_no = f.cv_no AND v.feature = d.feature)",
        "class_sizes AS (SELECT cv_no, label, count(*) AS docs FROM train_docs GROUP BY ALL)",
        "priors AS (SELECT cv_no, label, docs, ln(docs / sum(docs) OVER (PARTITION BY cv_no)) AS prior FROM class_sizes)",
        "sizes AS (SELECT cv_no, count(*) AS v FROM vocab GROUP BY cv_no)",
        *_LANG_NB,
        "judged AS (SELECT 'multinomial_nb' AS classifier, p.cv_no, p.doc_id, t.label, p.prediction FROM predicted p "
        "JOIN test_docs t ON t.cv_no = p.cv_no AND t.doc_id = p.doc_id)",
        *_scores_sql("classifier, cv_no"),
        select=_FOLD_ROWS,
    ),
)
def run_experiment(spark, d):
    features = F.transform(i.word_array(), lambda w: F.concat(w, F.lit("/N")))
    corpus = i.documents(spark, d, together=True).select("doc_id", "label", features.alias("features"))
    result = ex.run_experiment(corpus, ex.Experiment(min_df=2, classifiers={"multinomial_nb": {"alpha": 0.1}}))
    return result.scores.withColumn("score", F.round("score", 6))

