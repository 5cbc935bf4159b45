"""From parsed corpora to files of extracted features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wordfold.operators.features import FeatureOptions, extract_features
from wordfold.operators.tokens import TokenOptions, clean_tokens
from wordfold.sources import sinks
from wordfold.storage import materialize


def corpus_to_features(
    sentences: DataFrame,
    output: str,
    tokens: TokenOptions = TokenOptions(),
    features: FeatureOptions = FeatureOptions(),
    inventory: str | None = None,
) -> DataFrame:
    """Extract once and write one JSON line per document; training and test parts go together.

    Returns the distinct features and, on request, writes the inventory lists.
    """
    rows = materialize(extract_features(clean_tokens(sentences, tokens), features).select("doc_id", "label", "feature"), "features")
    docs = sentences.select("doc_id", "label").distinct()
    distinct = sinks.write_feature_corpus(rows, output, docs)
    if inventory:
        sinks.write_feature_inventory(distinct, inventory)
    return distinct
