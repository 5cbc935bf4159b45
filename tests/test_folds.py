"""Steps that all folds share: the same results as with a copy of each row for each fold, without the copies."""

from pyspark.sql import functions as F

from wordfold.operators import stats, vectorize as vz

BY = ["cv_no"]


def corpus(spark):
    """Documents in three folds, one of them listed twice in a fold, one in none."""
    counts = [(d, f"w{(d * d + 3 * n) % 11}", float(1 + (d + n) % 3)) for d in range(9) for n in range(4)]
    rows = spark.createDataFrame(sorted({(d, f): (d, f, w) for d, f, w in counts}.values()), "doc_id long, feature string, weight double")
    train = [(c, d) for d in range(8) for c in range(3) if d % 3 != c] + [(1, 0)]
    test = [(d % 3, d) for d in range(8)]
    return rows, spark.createDataFrame(train, "cv_no int, doc_id long"), spark.createDataFrame(test, "cv_no int, doc_id long")


def thesaurus(spark):
    """Neighbours of every word, among them words that no fold or only some folds know, with ties."""
    near = [(f"w{a}", f"w{b}", round(1 / (1 + (a * b) % 4), 3)) for a in range(12) for b in range(14) if a != b]
    return spark.createDataFrame(near, "feature string, neighbour string, sim double")


def listed(df):
    return sorted(map(tuple, df.collect()))


def test_sums_over_folds_equal_copies(spark):
    rows, train, _ = corpus(spark)
    copies = rows.join(train, "doc_id")
    for of in (vz.build_vocab, vz.feature_totals):
        assert listed(of(rows, BY, train)) == listed(of(copies, BY).select(*of(rows, BY, train).columns))


def test_replacements_of_what_is_looked_up(spark):
    rows, train, test = corpus(spark)
    vocab, near = vz.limit_df(vz.build_vocab(rows, BY, train), min_df=2, by=BY), thesaurus(spark)
    wanted = rows.join(test, "doc_id").where("weight > 1")
    asked = wanted.select(*BY, "feature").distinct()
    columns = [*BY, "feature", "neighbour", "sim"]
    every = vz.replacements(near, vocab, 2, BY).join(asked, [*BY, "feature"], "left_semi").select(*columns)
    found = vz.replacements(near, vocab, 2, BY, wanted).select(*columns)
    assert listed(found) == listed(every) and found.count() > 0
    usable = vz.usable_neighbours(near, vocab, BY).join(asked, [*BY, "feature"], "left_semi").groupBy(*BY, "feature").agg(F.count(F.lit(1)).alias("n"))
    assert listed(vz.available(near, vocab, wanted, BY)) == listed(usable.select(*BY, "feature", "n"))
    rows = stats.replacement_counts(wanted, near, vocab, 2, "ev", BY).collect()
    assert {(r["cv_fold"], r["feature"]) for r in rows} == {tuple(r) for r in asked.collect()}


def test_handler_in_folds(spark):
    rows, train, test = corpus(spark)
    vocab, near = vz.limit_df(vz.build_vocab(rows, BY, train), min_df=3, by=BY), thesaurus(spark)
    judged = rows.join(test, "doc_id")
    got = vz.apply_handler(judged, vocab, "signifier_signified", near, k=2, by=BY)
    known = {tuple(r) for r in vocab.select(*BY, "feature").collect()}
    entries, best = {r["feature"] for r in near.collect()}, {}
    for f, n, s in sorted(map(tuple, near.collect()), key=lambda r: (r[0], -r[2], r[1])):
        for c in range(3):
            if (c, n) in known and len(best.setdefault((c, f), [])) < 2:
                best[c, f].append((n, s))
    want: dict = {}
    for c, d, f, w in judged.select(*BY, "doc_id", "feature", "weight").collect():
        for n, s in [(f, 1.0)] if (c, f) in known else best.get((c, f), []) if f in entries else []:
            want[c, d, n] = want.get((c, d, n), 0) + w * s
    assert {(r["cv_no"], r["doc_id"], r["feature"]): round(r["weight"], 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_unnamed_features_that_a_rule_keeps(spark):
    rows = spark.createDataFrame([(1, None, 2.0), (1, "a", 1.0), (2, "b", 3.0)], "doc_id long, feature string, weight double")
    vocab, near = spark.createDataFrame([("a", 1)], "feature string, df long"), spark.createDataFrame([("b", "a", 0.5)], "feature string, neighbour string, sim double")
    rules = {(True, True): vz.KEEP, (True, False): vz.KEEP, (False, True): vz.EXPAND, (False, False): vz.KEEP}
    got = vz.apply_handler(rows, vocab, rules, near, k=1)
    assert {tuple(r) for r in got.select("doc_id", "feature", "weight").collect()} == {(1, None, 2.0), (1, "a", 1.0), (2, "a", 1.5)}
