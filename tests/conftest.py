import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def sentence(doc_id, label, words, edges=(), sent_id=1):
    """words: (word, lemma, pos, ner) in order; edges: (type, head, dep)."""
    tokens = [(i + 1, *w) for i, w in enumerate(words)]
    return (doc_id, label, sent_id, tokens, [(h, d, t) for t, h, d in edges])


SCHEMA = (
    "doc_id string, label string, sent_id int, tokens array<struct<idx:int,word:string,lemma:string,pos:string,ner:string>>,"
    " edges array<struct<head:int,dep:int,type:string>>"
)


def nouns(doc_id, label, text):
    return sentence(doc_id, label, [(w, w, "NN", "O") for w in text.split()])


@pytest.fixture(scope="session")
def pets(spark):
    """Training: cats like dogs (twice), kids play games.  Test: birds like fruit (twice), dogs eat birds."""
    make = lambda d, lab, s, v, o: sentence(d, lab, [(s + "s", s, "NNP", "O"), (v, v, "VB", "O"), (o + "s", o, "NNP", "O")])
    train = [make("t1", "earn", "cat", "like", "dog"), make("t2", "earn", "cat", "like", "dog"), make("t3", "not-earn", "kid", "play", "game")]
    test = [make("e1", "earn", "bird", "like", "fruit"), make("e2", "earn", "bird", "like", "fruit"), make("e3", "not-earn", "dog", "eat", "bird")]
    return spark.createDataFrame(train, SCHEMA), spark.createDataFrame(test, SCHEMA)


@pytest.fixture(scope="session")
def letters(spark):
    train = [nouns("t1", "earn", "a b c"), nouns("t2", "not-earn", "d e f")]
    test = [nouns("e1", "earn", "a a a a b c c g g g x")]
    return spark.createDataFrame(train, SCHEMA), spark.createDataFrame(test, SCHEMA)


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.strip("\n").split("\n")], "value string")


PETS_THESAURUS = "\n".join(
    [
        "cat/N\tdog/N\t0.8\tgame/N\t0.4",
        "dog/N\tcat/N\t0.7\tkid/N\t0.3",
        "game/N\tplay/V\t0.6\tcat/N\t0.04\tdog/N\t0.03",
        "kid/N\tfruit/N\t0.1\tcat/N\t0.02\tdog/N\t0.01",
        "fruit/N\tcat/N\t0.06\tdog/N\t0.05",
        "like/V\tplay/V\t0.11\t",
        "play/V\tlike/V\t0.09",
    ]
)
LETTERS_THESAURUS = "\n".join(
    [
        "g/N\tx/X\t0.9\td/N\t0.7\tb/N\t0.6\ta/N\t0.3",
        "a/N\td/N\t0.5\tg/N\t0.3\tb/N\t0.1",
        "d/N\tg/V\t0.7\ta/N\t0.5\tb/N\t0.3",
        "b/N\tg/N\t0.6\td/N\t0.3\ta/N\t0.1",
    ]
)


def matrix(dtm, docs, vocab):
    """Rows of weights in the given orders."""
    cells = {(r["doc_id"], r["feature"]): r["weight"] for r in dtm.collect()}
    assert {f for _, f in cells} <= set(vocab)
    return [[round(cells.get((d, f), 0.0), 9) for f in vocab] for d in docs]
