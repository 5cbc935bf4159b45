"""Every operator as a query over the given tables, with the same result written in SQL."""

from wordfold.catalog import corpora, evaluation, jobs, matrices, tokens, vectors  # noqa: F401
from wordfold.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
