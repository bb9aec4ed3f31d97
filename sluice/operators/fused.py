"""Several extractions from one reading of a page.

An extractor is a type and a function of a Page, which parses its source when it is first asked to, and once.
read() runs any number of them in one Arrow pass and gives a column each, so a plan has one Python node however
much it takes from its pages, and no joins to bring results of several passes together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.pieces import in_pieces
from sluice.operators import dom, extract
from sluice.session import fresh


class Page:
    """A page's source and URL, and its tree."""

    def __init__(self, source: str | None, base: str | None):
        self.source, self.base = source, base

    @cached_property
    def root(self) -> dom.Node:
        return dom.parse(self.source)


@dataclass(frozen=True)
class Extractor:
    """kind: the Spark type; arrow: the same as Arrow has it; of: what a page gives."""

    kind: str
    arrow: pa.DataType
    of: Callable[[Page], Any]


def _rows(ddl: str, /, **fields: pa.DataType) -> tuple[str, pa.DataType]:
    return f"array<struct<{ddl}>>", pa.list_(pa.struct(list(fields.items())))


def links(selector: str = "a[href]") -> Extractor:
    dom.compile_selector(selector)
    return Extractor(*_rows("link:string,text:string", link=pa.string(), text=pa.string()), lambda p: extract.links_in(p.root, selector, p.base))


def n_links(selector: str = "a[href]") -> Extractor:
    dom.compile_selector(selector)
    return Extractor("long", pa.int64(), lambda p: len(extract.links_in(p.root, selector, p.base)))


def values(selector: str) -> Extractor:
    dom.compile_selector(selector)
    return Extractor("array<string>", pa.list_(pa.string()), lambda p: dom.values(p.root, selector, " "))


def candidates(fields: list[str], most: int = 8) -> Extractor:
    """Of each field the selectors that may find it, best first."""

    def of(p: Page) -> list[dict]:
        return [{"field": f, "rank": i, "selector": s, "score": round(x, 3), "hits": h, "sample": t} for f in fields for i, (s, x, h, t) in enumerate(extract.candidates_in(p.root, p.base or "", f)[:most])]

    return Extractor(*_rows("field:string,rank:int,selector:string,score:double,hits:int,sample:string", field=pa.string(), rank=pa.int32(), selector=pa.string(), score=pa.float64(), hits=pa.int32(), sample=pa.string()), of)


TEXT = Extractor("string", pa.string(), lambda p: p.root.text("\n", True, dom.HIDDEN))
SIGNALS = Extractor(extract.SIGNALS_KIND, extract.SIGNALS_ARROW, lambda p: extract.signals_in(p.source, p.root))
HINTS = Extractor(*_rows("hint:string,source:string,json_like:boolean,paged:boolean", hint=pa.string(), source=pa.string(), json_like=pa.bool_(), paged=pa.bool_()), lambda p: extract.hints_in(p.root, p.base))
N_HINTS = Extractor("long", pa.int64(), lambda p: len(extract.hints_in(p.root, p.base)))
PAGINATION = Extractor(
    *_rows("kind:string,next:string,text:string,confidence:double,params:map<string,string>", kind=pa.string(), next=pa.string(), text=pa.string(), confidence=pa.float64(), params=pa.map_(pa.string(), pa.string())),
    lambda p: extract.pagination_in(p.root, p.base or ""),
)


def read(pages: DataFrame, wanted: dict[str, Extractor], *, html: str = "html", url: str | None = "url") -> DataFrame:
    """pages with a column for each extractor; a null source is an empty page. url=None: links stay as they are."""

    def run(sources: pa.Array, bases: pa.Array) -> pa.Array:
        each = [Page(s, b) for s, b in zip(sources.to_pylist(), bases.to_pylist(), strict=True)]
        columns: list[list] = [[] for _ in wanted]
        while each:
            page = each.pop()
            for out, x in zip(columns, wanted.values(), strict=True):
                out.append(x.of(page))
        return pa.StructArray.from_arrays([pa.array(c[::-1], type=x.arrow) for c, x in zip(columns, wanted.values(), strict=True)], names=list(wanted))

    both = fresh("x_read", pages)
    kind = ",".join(f"`{k}`:{x.kind}" for k, x in wanted.items())
    base = F.col(url).cast("string") if url else F.lit(None).cast("string")
    # Told as nondeterministic, so that a filter on one of the columns isn't pushed below with a reading of its own.
    once = in_pieces(run, f"struct<{kind}>", 2).asNondeterministic()
    done = pages.withColumn(both, once(F.col(html).cast("string"), base))
    return done.withColumns({k: F.col(both)[k] for k in wanted}).drop(both)
