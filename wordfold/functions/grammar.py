"""The string form of features: ``text/POS`` tokens joined by a separator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordfold.functions.text import let

SEPARATOR = "_"
EMPTY = "EMPTY"
UNIGRAM = "1-GRAM"

# Part-of-speech sequence -> phrase type.
PHRASE_TYPES = {("J", "N"): "AN", ("N", "N"): "NN", ("V", "N"): "VO", ("N", "V", "N"): "SVO"}


def format_token(text: Column, pos: Column) -> Column:
    return F.when(pos == "", text).otherwise(F.concat_ws("/", text, pos))


def format_feature(tokens: Column, separator: str = SEPARATOR) -> Column:
    return F.array_join(F.transform(tokens, lambda t: format_token(t["text"], t["pos"])), separator)


def split_feature(feature: Column, separator: str = SEPARATOR) -> Column:
    return F.split(feature, F.lit("\\Q" + separator + "\\E"))


def feature_tokens(feature: Column, separator: str = SEPARATOR) -> Column:
    """``cat/N_food/N`` -> array of (text, pos)."""
    return F.transform(
        split_feature(feature, separator),
        lambda t: F.struct(
            F.regexp_extract(t, "^([^/]*)", 1).alias("text"),
            F.regexp_extract(t, "/(.*)$", 1).alias("pos"),
        ),
    )


def _token_pattern(require_pos: bool) -> str:
    # one letter somewhere in the text, one slash, an upper-case tag
    tag = r"/[A-Z]+\$?"
    return r"[^/]*\p{L}[^/]*" + (tag if require_pos else f"({tag})?")


def is_valid(feature: Column, separator: str = SEPARATOR, require_pos: bool = True) -> Column:
    """Whether every token parses; false for NULL."""
    pattern = "^" + _token_pattern(require_pos) + "$"
    one = ~feature.contains(separator) & feature.rlike(pattern)
    return F.coalesce(one | F.forall(split_feature(feature, separator), lambda t: t.rlike(pattern)), F.lit(False))


def feature_type(feature: Column, separator: str = SEPARATOR, require_pos: bool = True) -> Column:
    """Type from the sequence of tags; EMPTY when some token does not parse."""

    def named(tokens: Column) -> Column:
        tags = F.array_join(F.transform(tokens, lambda t: F.regexp_extract(t, "/(.*)$", 1)), " ")
        types = F.create_map(*[F.lit(x) for sequence, name in PHRASE_TYPES.items() for x in (" ".join(sequence), name)])
        plain = F.concat(F.size(tokens).cast("string"), F.lit("-GRAM"))
        # only sequences of two and three tags have a name
        return F.when(F.size(tokens).between(2, 3), F.coalesce(F.try_element_at(types, tags), plain)).otherwise(plain)

    valid = is_valid(feature, separator, require_pos)
    return F.when(valid, let(split_feature(feature, separator), named)).otherwise(F.lit(EMPTY))


def parse_feature(feature: Column, separator: str = SEPARATOR, require_pos: bool = True) -> Column:
    return F.struct(
        feature_type(feature, separator, require_pos).alias("ftype"),
        feature_tokens(feature, separator).alias("tokens"),
    )


def n_tokens(feature: Column, separator: str = SEPARATOR) -> Column:
    return F.size(split_feature(feature, separator))


def remove_pos(feature: Column, separator: str = SEPARATOR) -> Column:
    """``cat/N_food/N`` -> ``cat_food``."""
    return F.array_join(
        F.transform(split_feature(feature, separator), lambda t: F.regexp_replace(t, "/.*$", "")), separator
    )


def shares_token(left: Column, right: Column, separator: str = SEPARATOR) -> Column:
    return F.arrays_overlap(split_feature(left, separator), split_feature(right, separator))
