"""Table functions: what is in a document as rows, for SQL with LATERAL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioforge.operators import documents as D

#: Name -> the result's columns, and the rows of one document.
FUNCTIONS: dict[str, tuple[str, Callable[[str | None], Iterator[tuple]]]] = {
    "html_pages": ("page_order int, content string", lambda x: enumerate(D.html_pages(x))),
    "sections": ("article_title string, article_order int, section_title string, section_order int, content string", lambda x: (tuple(r.values()) for r in D.sections_of(x))),
    "clauses": ("clause_order int, anchor string, text string, method string, start int, stop int", lambda x: ((k, *r.values()) for k, r in enumerate(D.clauses_of((x or "").split("\n"))))),
    "violations": ("code string, detail string, pages array<string>", lambda x: (tuple(r.values()) for r in D.violations_of(x))),
}


def register(spark: SparkSession) -> None:
    """The functions under their names; each takes a document's text, HTML or XML and gives its rows."""

    def made(rows: Callable[[str | None], Iterator[tuple]]):
        class Rows:
            def eval(self, text: str) -> Iterator[tuple]:
                yield from rows(text)

        return Rows

    for name, (columns, rows) in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(made(rows), returnType=columns))
