"""A whole experiment: corpus -> splits -> features -> matrices -> predictions -> scores.

All folds go through the same plan with ``cv_no`` as a key.  Tables that several stages
read (counts, splits, vocabulary, matrices) are written once to the shared folder, so no
stage recomputes the corpus and a lost executor costs only its own tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordfold.operators import classify, metrics, neighbours as nb, select, splits, stats, vectorize as vz
from wordfold.operators.features import FeatureOptions, as_set, extract_features, extract_unigrams, filter_features
from wordfold.operators.tokens import TokenOptions, clean_token_rows, clean_tokens
from wordfold.sources import sinks
from wordfold.storage import materialize

BY = ["cv_no"]


@dataclass(frozen=True)
class Experiment:
    tokens: TokenOptions = TokenOptions()
    train_features: FeatureOptions = FeatureOptions()
    test_features: FeatureOptions = FeatureOptions()
    # vectorization
    handler: str | dict = "base"
    train_handler: str | dict = "base"
    k: int = 3
    sim_fn: Callable[[Column], Column] = vz.unit
    min_df: int | float = 0
    max_df: int | float = 1.0
    random_neighbours: bool = False
    vectorizer: Callable | None = None
    # neighbours
    is_thesaurus: bool = False
    include_self: bool = False
    sim_threshold: float = 0.0
    allow_lexical_overlap: bool = True
    max_neighbours: int | None = None
    neighbour_strategy: str = "linear"
    noise: float = 0.0
    # selection
    must_be_in_model: bool = False
    select_k: int | str = "all"
    min_log_odds: float = 0.0
    scoring: Callable = select.chi2_scores
    min_train_features: float = 0.0
    min_test_features: float = 0.0
    # evaluation
    split: str = "skfold"
    folds: int = 5
    sample_size: int | None = None
    first_fold_only: bool = False
    shuffle_labels: bool = False
    seed: int = 0
    classifiers: dict = field(default_factory=lambda: {"multinomial_nb": {"alpha": 0.1}})
    # output
    dump: bool = False


@dataclass(frozen=True)
class Model:
    """Distributional information: vector tables, a table of neighbours, or clusters."""

    vectors: Sequence[DataFrame] = ()
    neighbours: DataFrame | None = None
    clusters: DataFrame | None = None
    entries_of: DataFrame | None = None

    @property
    def given(self) -> bool:
        return bool(self.vectors) or self.neighbours is not None or self.clusters is not None

    def restricted(self) -> Model:
        """The model without the entries that ``entries_of`` lacks: they count as unknown everywhere."""
        if self.entries_of is None:
            return self
        near = None if self.neighbours is None else nb.restrict_entries(self.neighbours, self.entries_of)
        return replace(self, vectors=[nb.restrict_entries(v, self.entries_of) for v in self.vectors], neighbours=near, entries_of=None)


@dataclass(frozen=True)
class Result:
    scores: DataFrame
    training_scores: DataFrame
    predictions: DataFrame
    gold: DataFrame
    vocab: DataFrame
    train: DataFrame
    test: DataFrame
    coverage: DataFrame
    replacements: DataFrame | None
    survival: DataFrame
    dump: DataFrame


def check(e: Experiment, m: Model) -> None:
    """Reject contradictory settings before any job starts."""
    expands = e.handler != "base" or e.train_handler != "base"
    if (m.vectors or m.neighbours is not None) and m.clusters is not None:
        raise ValueError("word vectors and word clusters cannot be used together")
    if e.random_neighbours and m.given and e.is_thesaurus:
        raise ValueError("random neighbours and a given thesaurus cannot be used together")
    if expands and not e.random_neighbours and not m.given:
        raise ValueError("this handler needs a source of distributional information")
    if e.must_be_in_model and (not m.given or (not expands and m.clusters is None)):
        raise ValueError("keeping only features in the model needs vectors or clusters and a handler that uses them")


def corpus_counts(corpus: DataFrame, tokens: TokenOptions, features: FeatureOptions) -> DataFrame:
    """(doc_id, label, feature, weight) from parsed sentences or from extracted features."""
    if "edges" in corpus.columns:
        sentences = corpus.drop("split", "malformed")
        if as_set(features.phrase_types) or features.ngram_max > 1:
            rows = extract_features(clean_tokens(sentences, tokens), features)
        else:
            rows = extract_unigrams(clean_token_rows(sentences, tokens), features)
    else:
        rows = filter_features(corpus.select("doc_id", "label", F.explode("features").alias("feature")), features)
    return vz.doc_term_counts(rows.select("doc_id", "label", "feature"))


def in_fold(counts: DataFrame, role: str) -> DataFrame:
    """Rows of the documents that play ``role``, with the labels of the split; ``counts`` have the columns of ``with_folds``."""
    return counts.select("doc_id", "feature", "weight", F.inline(role))


def _in_vocabulary(handler: str | dict) -> bool:
    """Whether a handler's matrix has features of the vocabulary only, as replacements are part of it."""
    rules = vz.HANDLERS[handler] if isinstance(handler, str) else handler
    return all(action != vz.KEEP for (iv, _), action in rules.items() if not iv)


def neighbour_table(e: Experiment, m: Model, vocab: DataFrame, lookups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(neighbours per fold, model entries) for the features that will be looked up."""
    if m.neighbours is not None:
        entries = m.neighbours.select("feature").distinct()
        near = nb.include_self(nb.sim_threshold(m.neighbours, e.sim_threshold), e.include_self)
        if not e.allow_lexical_overlap:
            near = nb.drop_lexical_overlap(near)
        if e.max_neighbours is not None:
            near = nb.max_neighbours(near, e.max_neighbours)
        return near, entries
    sets, keys = None, BY
    for i, vectors in enumerate(m.vectors):
        vectors = nb.add_noise(vectors, e.noise, e.seed + i)
        # following a chain of neighbours needs the neighbours of every vocabulary entry too
        queries = lookups if e.neighbour_strategy == "linear" else lookups.unionByName(vocab.select(*lookups.columns)).distinct()
        near = nb.knn_cosine(vectors, e.k, vocab, queries, e.include_self, by=keys)
        near = nb.sim_threshold(near, e.sim_threshold)
        if not e.allow_lexical_overlap:
            near = nb.drop_lexical_overlap(near)
        if e.max_neighbours is not None:
            near = nb.max_neighbours(near, e.max_neighbours, keys)
        near = near.withColumn("source_id", F.lit(i))
        sets = near if sets is None else sets.unionByName(near)
    entries = None
    for i, vectors in enumerate(m.vectors):
        one = vectors.select("feature").distinct().withColumn("source_id", F.lit(i))
        entries = one if entries is None else entries.unionByName(one)
    spare = e.k * nb.CANDIDATES_PER_NEIGHBOUR
    if len(m.vectors) == 1:
        near = nb.neighbour_strategy(sets.drop("source_id"), spare if e.neighbour_strategy == "linear" else e.k, e.neighbour_strategy, keys)
        return near, entries.select("feature")
    # with their own copy of an entry, sets hold up to one neighbour more than they were asked for
    return nb.combine_neighbours(sets, entries, keys, spare + 1), entries.select("feature").distinct()


def looked_up(marked: DataFrame, handler: str | dict) -> DataFrame:
    """The rows whose feature the handler replaces."""
    rules = vz.HANDLERS[handler] if isinstance(handler, str) else handler
    wanted = F.lit(False)
    for (iv, it), action in rules.items():
        if action == vz.EXPAND:
            wanted = wanted | ((F.col("iv") == iv) & (F.col("it") == it))
    return marked.where(wanted)


def run_experiment(
    corpus: DataFrame, e: Experiment = Experiment(), model: Model = Model(), test_corpus: DataFrame | None = None, output: str | None = None
) -> Result:
    check(e, model)
    model = model.restricted()
    if test_corpus is None and "split" in corpus.columns:
        test_corpus = corpus.where("split = 'test'")
        corpus = corpus.where("split = 'train'")
        if e.split not in splits.SPLITS_WITH_TEST_SET:
            if not test_corpus.isEmpty():
                raise ValueError(f"the corpus has test documents, which a split of kind {e.split} does not use")
            test_corpus = None
    same = e.train_features == e.test_features
    docs = corpus.select("doc_id", "label").distinct()
    test_docs = None if test_corpus is None else test_corpus.select("doc_id", "label").distinct()
    if e.shuffle_labels:
        docs = splits.shuffle_labels(docs, e.seed)
        test_docs = None if test_docs is None else splits.shuffle_labels(test_docs, e.seed)
    folds = splits.split(e.split, docs, test_docs, e.folds, e.sample_size, e.seed)
    folds = materialize(splits.first_fold_only(folds) if e.first_fold_only else folds, "folds")
    roles = {r: folds.where(F.col("role") == r).drop("role") for r in ("train", "test")}

    everything = corpus if test_corpus is None else corpus.unionByName(test_corpus)
    # stored with the folds of their document, so that they are not moved by document for each role
    counted = lambda f: materialize(vz.with_folds(corpus_counts(everything, e.tokens, f), ["label", *BY], **roles), "counts")
    train_counts = counted(e.train_features)
    test_counts = train_counts if same else counted(e.test_features)
    train_rows, test_rows = in_fold(train_counts, "train"), in_fold(test_counts, "test")

    # training matrix and its vocabulary
    if model.clusters is not None:
        train_rows = vz.cluster_vectorize(train_rows, model.clusters, by=BY)
    terms = vz.build_vocab(train_rows, BY) if model.clusters is not None else vz.build_vocab(train_counts, BY, "train")
    full_vocab = vz.limit_df(terms, e.min_df, e.max_df, roles["train"], BY)
    full_vocab = materialize(full_vocab, "vocab")
    entries = None
    if model.clusters is not None:
        entries = full_vocab.select("feature").distinct()
    elif model.neighbours is not None:
        entries = model.neighbours.select("feature").distinct()
    elif model.vectors:
        entries = model.vectors[0].select("feature").distinct()
        for v in model.vectors[1:]:
            entries = entries.unionByName(v.select("feature")).distinct()
    recorded = []  # replacements of both stages
    if e.train_handler == "base" or model.clusters is not None:
        train = vz.apply_handler(train_rows, full_vocab, "base", by=BY)
    else:
        totals = vz.feature_totals(train_counts, BY, "train")
        wanted = materialize(looked_up(vz.mark_iv_it(totals, full_vocab, entries, BY), e.train_handler), "wanted-train")
        near, known = neighbour_table(e, model, full_vocab, wanted.select(*BY, "feature").distinct())
        near = materialize(near, "neighbours-train")
        train = vz.apply_handler(train_rows, full_vocab, e.train_handler, near, known, e.k, e.sim_fn, BY)
        recorded.append(stats.replacement_counts(wanted, near, full_vocab, e.k, "tr", BY))
    train = materialize(train, "train")
    vocab = select.select_features(
        full_vocab, train, roles["train"], e.select_k, entries, e.must_be_in_model, e.min_log_odds, e.scoring, BY
    )
    vocab = materialize(vocab, "vocab-selected")
    if e.must_be_in_model and vocab.isEmpty():
        raise ValueError("selection removed all features")
    whole = model.clusters is None and _in_vocabulary(e.train_handler) and e.select_k == "all" and not e.must_be_in_model and e.min_log_odds <= 0
    if not whole:  # else there is nothing to drop
        train = train.join(vocab.select(*BY, "feature"), [*BY, "feature"], "left_semi")

    # test matrix against the selected vocabulary; a feature is marked once for all documents of a fold
    marked = vz.feature_totals(test_rows, BY)
    if model.clusters is not None:
        test = vz.cluster_vectorize(test_rows, model.clusters, vocab, BY)
        marked = vz.mark_iv_it(vz.feature_totals(test, BY), vocab, entries, BY)
    elif e.vectorizer is not None:
        test, marked = e.vectorizer(test_rows, vocab, model, BY), vz.mark_iv_it(marked, vocab, entries, BY)
    elif e.random_neighbours:
        marked = vz.mark_iv_it(marked, vocab, None, BY).withColumn("it", F.lit(True))
        test = vz.handle_marked_random(vz.mark_iv_it(test_rows, vocab, None, BY).withColumn("it", F.lit(True)), vocab, e.handler, e.k, e.seed, BY)
    else:
        marked = materialize(vz.mark_iv_it(marked, vocab, entries, BY), "marked")
        if e.handler == "base":
            test = vz.apply_handler(test_rows, vocab, "base", by=BY)
        else:
            wanted = looked_up(marked, e.handler)
            near, known = neighbour_table(e, model, vocab, wanted.select(*BY, "feature").distinct())
            near = materialize(near, "neighbours")
            test = vz.transform_test(test_rows, vocab, e.handler, near, known, e.k, e.sim_fn, BY, e.seed, check=False)
            recorded.append(stats.replacement_counts(wanted, near, vocab, e.k, "ev", BY))

    # pruning: the test matrix follows the surviving training features
    train_docs = select.keep_docs_min_weight(roles["train"], train, e.min_train_features, BY)
    train = train.join(train_docs.select(*BY, "doc_id"), [*BY, "doc_id"], "left_semi") if e.min_train_features > 0 else train
    kept_vocab = materialize(select.drop_empty_features(vocab, train, BY), "vocab-kept")
    if not whole or e.min_train_features > 0:
        train = materialize(train, "train-kept")
    test = materialize(test, "test")
    test_docs = select.keep_docs_min_weight(roles["test"], test, e.min_test_features, BY)
    test = test.join(kept_vocab.select(*BY, "feature"), [*BY, "feature"], "left_semi")
    if e.min_test_features > 0:
        test = test.join(test_docs.select(*BY, "doc_id"), [*BY, "doc_id"], "left_semi")

    predicted = materialize(
        classify.run_classifiers(e.classifiers, train, train_docs, test, test_docs, kept_vocab, BY), "predictions"
    )
    judged = predicted.join(test_docs.select(*BY, "doc_id", "label"), [*BY, "doc_id"])
    on_training = classify.run_classifiers(e.classifiers, train, train_docs, train, train_docs, kept_vocab, BY).join(
        train_docs.select(*BY, "doc_id", "label"), [*BY, "doc_id"]
    )
    # training features count as known before any limit on their frequency
    in_training = vz.mark_iv_it(vz.feature_totals(train_counts, BY, "train"), None, entries, BY)
    coverage = stats.coverage_counts(in_training, "tr").unionByName(stats.coverage_counts(marked, "ev"))
    replaced = None
    for stage in recorded:
        replaced = stage if replaced is None else replaced.unionByName(stage)
    dump = sinks.dump_entries(train, train_docs, "tr", BY).unionByName(sinks.dump_entries(test, test_docs, "ev", BY))
    survival = stats.survival_counts(roles["train"], train_docs, full_vocab, kept_vocab, train, BY)
    if "malformed" in corpus.columns:
        survival = survival.join(stats.malformed_counts(corpus, roles["train"], BY), BY, "left").fillna(0, ["malformed"])
    result = Result(
        scores=metrics.scores_per_fold(judged),
        training_scores=metrics.scores_per_fold(on_training),
        predictions=judged,
        gold=test_docs.select(*BY, "doc_id", "label"),
        vocab=kept_vocab,
        train=train,
        test=test,
        coverage=coverage,
        replacements=replaced,
        survival=survival,
        dump=dump,
    )
    if output:
        root = output.rstrip("/")
        sinks.write_scores(result.scores, f"{root}/scores")
        sinks.write_gold(result.gold, f"{root}/gold")
        sinks.write_predictions(result.predictions, f"{root}/predictions")
        sinks.write_stats(result.coverage, result.replacements, f"{root}/statistics")
        if e.dump:
            sinks.write_dump(result.dump, f"{root}/dump")
    return result
