"""Credit-risk and loan-portfolio analysis as Spark DataFrame operators.

    from riskbook import Book, report
    book = Book.from_paths(spark, {"loans": ".../loans.csv", ...}).prepared()
    report(book, "red_flag_list").show()
"""

from __future__ import annotations

from .sources.book import Book


def report_names() -> list[str]:
    from .registry import BOOK_QUERIES

    return sorted(BOOK_QUERIES)


def report(book: Book, name: str):
    """The named report over ``book`` (names as in ``report_names()``)."""
    from .registry import BOOK_QUERIES

    return BOOK_QUERIES[name](book)


__all__ = ["Book", "report", "report_names"]
