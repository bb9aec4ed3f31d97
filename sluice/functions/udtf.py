"""Table functions for SQL texts: what pages give, by selectors in the query itself.

    SELECT * FROM extract_links(TABLE(pages), 'a.product')
    SELECT * FROM page_fields(TABLE(pages), map('title', 'h1', 'price', '.price'))
    SELECT * FROM find_elements(TABLE(pages), 'table tr', 'total')

The table has a column html, and url if links are to be absolute. Rows keep its other columns. What comes back
is told by analyze() from the table's columns and the constants of the call, so a query knows its types, and a
wrong selector or a missing column is refused before it runs.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.types import DoubleType, IntegerType, Row, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from sluice.operators import dom, extract


def _kept(table: AnalyzeArgument, more: list[StructField]) -> StructType:
    """The table's columns but html, and what the function adds; a name that the table has too gets underscores."""
    if not table.isTable or "html" not in table.dataType.names:
        raise ValueError("the first argument must be a table with a column html")
    kept = [f for f in table.dataType.fields if f.name != "html"]
    taken = {f.name.lower() for f in kept}
    out = []
    for f in more:
        name = f.name
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(StructField(name, f.dataType))
    return StructType([*kept, *out])


def _constant(arg: AnalyzeArgument, what: str):
    if not arg.isConstantExpression or arg.value is None:
        raise ValueError(f"{what} must be a constant")
    return arg.value


def _others(row: Row) -> tuple:
    return tuple(v for k, v in row.asDict().items() if k != "html")


def _base(row: Row) -> str | None:
    return row.asDict().get("url")


class ExtractLinks:
    """Rows (pos, link, text) of the links that a selector finds."""

    @staticmethod
    def analyze(pages: AnalyzeArgument, selector: AnalyzeArgument) -> AnalyzeResult:
        dom.compile_selector(_constant(selector, "the selector"))
        return AnalyzeResult(_kept(pages, [StructField("pos", IntegerType()), StructField("link", StringType()), StructField("text", StringType())]))

    def eval(self, row: Row, selector: str):
        for pos, found in enumerate(extract.links_in(dom.parse(row["html"]), selector, _base(row))):
            yield (*_others(row), pos, found["link"], found["text"])


class PageFields:
    """A row a page with a column for each named selector: the first value that it finds, or null."""

    @staticmethod
    def analyze(pages: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        wanted = _constant(fields, "the map of fields")
        for s in wanted.values():
            dom.compile_selector(s)
        return AnalyzeResult(_kept(pages, [StructField(name, StringType()) for name in wanted]))

    def eval(self, row: Row, fields: dict[str, str]):
        root = dom.parse(row["html"])
        yield (*_others(row), *(next((v for v in dom.values(root, s, " ") if v), None) for s in fields.values()))


class FindElements:
    """Rows (path, text) of the elements that a selector finds and whose text a pattern matches."""

    @staticmethod
    def analyze(pages: AnalyzeArgument, selector: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        dom.compile_selector(_constant(selector, "the selector"))
        re.compile(_constant(pattern, "the pattern"))
        return AnalyzeResult(_kept(pages, [StructField("path", StringType()), StructField("text", StringType())]))

    def eval(self, row: Row, selector: str, pattern: str):
        wanted = re.compile(pattern)
        for n in dom.select(dom.parse(row["html"]), selector):
            text = " ".join(n.text(" ", True).split())
            if wanted.search(text):
                yield (*_others(row), dom.path(n), text)


class FieldScores:
    """A row a page with (field, selector, score): the selector that may best find each field of a comma-separated list."""

    @staticmethod
    def analyze(pages: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        _constant(fields, "the fields")
        return AnalyzeResult(_kept(pages, [StructField("field", StringType()), StructField("selector", StringType()), StructField("score", DoubleType())]))

    def eval(self, row: Row, fields: str):
        root = dom.parse(row["html"])
        for field in (f.strip() for f in fields.split(",") if f.strip()):
            for selector, score, _, _ in extract.candidates_in(root, _base(row) or "", field)[:1]:
                yield (*_others(row), field, selector, float(score))


FUNCTIONS = {"extract_links": ExtractLinks, "page_fields": PageFields, "find_elements": FindElements, "field_scores": FieldScores}


def register(spark: SparkSession) -> None:
    """Make the functions callable in SQL texts of the session."""
    from pyspark.sql.functions import udtf

    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
