"""Column expressions on single tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fine part-of-speech tag -> coarse tag; any other tag is UNK.
COARSE_POS = {
    "J": ["JJ", "JJN", "JJS", "JJR"],
    "V": ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ"],
    "N": ["NN", "NNS", "NNP", "NPS", "NP"],
    "RB": ["RB", "RBR", "RBS"],
    "DET": ["DT", "WDT"],
    "CONJ": ["IN", "CC"],
    "PRON": ["PRP", "PRP$", "WP", "WP$"],
    "PUNCT": [".", ":", "", "'", '"', "-LRB-", "-RRB-"],
    "PERSON": ["PERSON"],
    "LOC": ["LOC"],
    "ORG": ["ORG"],
    "NUMBER": ["NUMBER"],
}
UNKNOWN_POS = "UNK"

# Entity tags whose phrases cannot be composed.
ENTITY_TAGS = ("ORGANIZATION", "PERSON", "LOCATION")
# Tags that mean "no entity here".
NOT_AN_ENTITY = ("O", "MISSING", "_")

# A word with letters still counts as a number when it reads as a float.
_FLOAT_WITH_LETTERS = (
    r"(?i)^[+-]?([0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)e[+-]?[0-9][0-9_]*$|^[+-]?(nan|inf|infinity)$"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def choose_text(word: Column, lemma: Column, lemmatize: bool = True) -> Column:
    return lemma if lemmatize else word


def begins_with_letter(text: Column) -> Column:
    """Whether the first byte is a letter: a cheap test before a regular expression that looks for any letter."""
    return ((text >= "a") & (text < "{")) | ((text >= "A") & (text < "["))


def is_number(text: Column) -> Column:
    """No letter at all, or readable as a float (so ``12/23``, ``1,000``, ``,``, ``1e5`` and ``nan``)."""
    return ~text.rlike(r"\p{L}") | text.rlike(_FLOAT_WITH_LETTERS)


def is_number_in_lambda(text: Column) -> Column:
    """``is_number`` with cheap tests first, for lambdas, which are interpreted; compiled code would grow too large by them."""
    lettered = begins_with_letter(text) | text.rlike(r"\p{L}")
    # what reads as a float begins with one of these
    return ~lettered | (F.left(text, F.lit(1)).isin(*"+-.0123456789nNiI") & text.rlike(_FLOAT_WITH_LETTERS))


def is_stopword(text: Column, stopwords: list[str]) -> Column:
    return F.lower(text).isin(*stopwords) if stopwords else F.lit(False)


def is_short(text: Column, longest: int = 3) -> Column:
    return F.char_length(text) <= longest


def is_long(text: Column, shortest: int = 25) -> Column:
    return F.char_length(text) >= shortest


def has_separator(text: Column) -> Column:
    return text.contains("/") | text.contains("_")


def use_pos(pos: Column, enabled: bool = True) -> Column:
    return F.upper(pos) if enabled else F.lit("")


def coarse_pos(pos: Column) -> Column:
    cells = [F.lit(x) for coarse, fine in COARSE_POS.items() for tag in fine for x in (tag, coarse)]
    return F.coalesce(F.try_element_at(F.create_map(*cells), F.upper(pos)), F.lit(UNKNOWN_POS))


def ner_tag(ner: Column) -> Column:
    return F.coalesce(F.upper(ner), F.lit("MISSING"))


def is_entity(tag: Column) -> Column:
    return ~tag.isin(*NOT_AN_ENTITY)


def entity_text(tag: Column) -> Column:
    return F.concat(F.lit("__NER-"), tag, F.lit("__"))
