"""Cleaning of parsed sentences.

A sentence is one row, ``(doc_id, label, sent_id, tokens, edges)``.  Tokens and edges
stay in arrays, so cleaning and phrase extraction run where the sentence was read:
no shuffle of the token table, and no join between tokens and edges.

tokens  ARRAY<STRUCT<idx INT, word, lemma, pos, ner STRING>>
edges   ARRAY<STRUCT<head INT, dep INT, type STRING>>
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordfold.functions import text as tx
from wordfold.functions.text import let

SENTENCE_TOKENS = "array<struct<idx:int,word:string,lemma:string,pos:string,ner:string>>"
SENTENCE_EDGES = "array<struct<head:int,dep:int,type:string>>"


@dataclass(frozen=True)
class TokenOptions:
    lemmatize: bool = True
    lowercase: bool = True
    use_pos: bool = True
    coarse_pos: bool = True
    normalise_entities: bool = False
    remove_stopwords: bool = False
    remove_short_words: bool = False
    remove_long_words: bool = False
    stopwords: tuple[str, ...] = field(default=())

    def stopword_list(self) -> list[str]:
        if not self.remove_stopwords:
            return []
        return list(self.stopwords) or StopWordsRemover.loadDefaultStopWords("english")


def _prepared(t: Column, o: TokenOptions, bound: bool = False) -> Column:
    """One token with its final text, tag and whether it survives every filter; ``bound`` inside lambdas, where nothing else shares the tag."""
    raw = tx.choose_text(t["word"], t["lemma"], o.lemmatize)

    def finish(pos: Column) -> Column:
        ner = tx.ner_tag(t["ner"])
        # cheap tests first: regular expressions are slow where they are interpreted
        keep = (pos != "PUNCT") & ~tx.has_separator(raw)
        if o.remove_short_words:
            keep = keep & ~tx.is_short(raw)
        if o.remove_long_words:
            keep = keep & ~tx.is_long(raw)
        if o.remove_stopwords:
            keep = keep & ~tx.is_stopword(raw, o.stopword_list())
        keep = keep & ~(tx.is_number_in_lambda(raw) if bound else tx.is_number(raw))
        out = F.lower(raw) if o.lowercase else raw
        if o.normalise_entities:
            pos = F.when(tx.is_entity(ner), F.lit("")).otherwise(pos)
            out = F.when(tx.is_entity(ner), tx.entity_text(ner)).otherwise(out)
        return F.struct(
            t["idx"].alias("idx"),
            out.alias("text"),
            pos.alias("pos"),
            ner.alias("ner"),
            F.coalesce(keep, F.lit(False)).alias("keep"),
        )

    pos = tx.coarse_pos(t["pos"]) if o.coarse_pos and o.use_pos else tx.use_pos(t["pos"], o.use_pos)
    return let(pos, finish) if bound else finish(pos)


def token_at(tokens: Column, idx: Column) -> Column:
    """Token number ``idx``: by position when numbering has no gaps, else by search."""
    direct = F.get(tokens, idx - 1)
    return F.when(direct["idx"] == idx, direct).otherwise(
        F.get(F.filter(tokens, lambda t: t["idx"] == idx), F.lit(0))
    )


def last_edge_per_pair(edges: Column) -> Column:
    """One edge per (head, dependent): the last one in the document wins.

    Sentences without a repeated pair, nearly all of them, are passed through unsorted.
    """
    pairs = F.transform(edges, lambda e: e["head"].cast("long") * (1 << 32) + e["dep"])
    ordered = F.array_sort(
        F.transform(
            edges,
            lambda e, i: F.struct(
                e["head"].alias("head"), e["dep"].alias("dep"), i.alias("at"), e["type"].alias("type")
            ),
        )
    )

    def keep_last(arr: Column) -> Column:
        return F.filter(
            arr,
            lambda e, i: ~F.coalesce(
                (F.get(arr, i + 1)["head"] == e["head"]) & (F.get(arr, i + 1)["dep"] == e["dep"]), F.lit(False)
            ),
        )

    plain = F.transform(edges, lambda e: F.struct(e["head"].alias("head"), e["dep"].alias("dep"), F.lit(0).alias("at"), e["type"].alias("type")))
    return F.when(let(pairs, lambda p: F.size(F.array_distinct(p)) == F.size(p)), plain).otherwise(let(ordered, keep_last))


def clean_tokens(sentences: DataFrame, options: TokenOptions = TokenOptions()) -> DataFrame:
    """Apply every token rule; edges survive only with both of their tokens.

    Adds ``tokens ARRAY<STRUCT<idx, text, pos, ner>>`` and
    ``arcs ARRAY<STRUCT<type, head STRUCT, dep STRUCT>>``.
    """

    def both(slots: Column) -> Column:
        kept = F.transform(
            F.filter(slots, lambda t: t["keep"]),
            lambda t: F.struct(
                t["idx"].alias("idx"), t["text"].alias("text"), t["pos"].alias("pos"), t["ner"].alias("ner")
            ),
        )
        arcs = F.transform(
            last_edge_per_pair(F.col("edges")),
            lambda e: F.struct(
                e["type"].alias("type"), token_at(slots, e["head"]).alias("head"), token_at(slots, e["dep"]).alias("dep")
            ),
        )
        alive = F.filter(arcs, lambda a: F.coalesce(a["head"]["keep"] & a["dep"]["keep"], F.lit(False)))
        return F.struct(kept.alias("tokens"), alive.alias("arcs"))

    # one expression bound to the prepared tokens: however the optimiser moves it, a token
    # is prepared once per sentence and not once per edge
    keep = [c for c in sentences.columns if c not in ("tokens", "edges")]
    prepared = F.transform("tokens", lambda t: _prepared(t, options, bound=True))
    return sentences.select(*keep, let(prepared, both).alias("__c")).select(*keep, "__c.tokens", "__c.arcs")


def clean_token_rows(sentences: DataFrame, options: TokenOptions = TokenOptions()) -> DataFrame:
    """The surviving tokens alone, one row each.

    Without relations to follow, tokens are taken apart first, so every rule runs inside
    whole-stage code generation.
    """
    keep = [c for c in sentences.columns if c not in ("tokens", "edges")]
    rows = sentences.select(*keep, F.explode_outer("tokens").alias("t")).where("t is not null")
    prepared = rows.select(*keep, _prepared(F.col("t"), options).alias("p"))
    return prepared.where("p.keep").select(*keep, "p.idx", "p.text", "p.pos", "p.ner")


def explode_tokens(sentences: DataFrame) -> DataFrame:
    """One row per token, for work that needs no neighbours."""
    keep = [c for c in sentences.columns if c not in ("tokens", "edges", "arcs")]
    return sentences.select(*keep, F.explode_outer("tokens").alias("t")).where("t is not null").select(*keep, "t.*")


def surviving_edges(cleaned: DataFrame) -> DataFrame:
    """One row per edge whose two tokens survived."""
    keep = [c for c in cleaned.columns if c not in ("tokens", "arcs")]
    # the outer form keeps the optimiser from testing the array, i.e. building it twice
    return cleaned.select(*keep, F.explode_outer("arcs").alias("a")).where("a is not null").select(
        *keep, F.col("a.head.idx").alias("head_idx"), F.col("a.dep.idx").alias("dep_idx"), F.col("a.type").alias("type")
    )
