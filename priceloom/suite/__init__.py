"""Named queries over the sample tables."""


def all_queries():
    """(queries, oracle SQL); importing the modules fills the registry."""
    from . import book_queries, match_queries, review_queries, row_queries  # noqa: F401
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
