"""Finding stored elements again on pages that have changed.

An element is stored as its fingerprint: tag, text, attributes, path, parent and siblings. How like it an
element of a page is, is the mean over PARTS, of which each tells when it counts and which pairs of
sequences it compares. The best of a page's elements are found without comparing all: lengths, then
counts of characters, bound every ratio from above, so elements are tried from the highest bound down until
none can reach the best any more. What is found is what comparing all would find.

Pages meet the stored elements of their site, in groups of GROUP, so a page is parsed once for each group
and a site with very many stored elements is many rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Sequence
from difflib import SequenceMatcher
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import dom
from sluice.session import fresh, write_out

Pairs = list[tuple[float, Sequence, Sequence]]
GROUP = 64
BROADCAST_BYTES = 8 << 20
#: A score is rounded to two digits, so what is this near may be equal.
MARGIN = 0.02


class Part(NamedTuple):
    """One part of the likeness: when it counts, of the stored element and the other, and weighted pairs of sequences."""

    counts: Callable[[dict, dict], bool]
    pairs: Callable[[dict, dict], Pairs]


def _maps(a: dict, b: dict) -> Pairs:
    return [(0.5, tuple(a), tuple(b)), (0.5, tuple(a.values()), tuple(b.values()))]


def _own(name: str) -> Callable[[dict, dict], Pairs]:
    return lambda a, b: [(1.0, a[name], b[name])]


def _attribute(name: str) -> Part:
    return Part(lambda a, b: bool(a["attributes"].get(name)), lambda a, b: [(1.0, a["attributes"][name], b["attributes"].get(name, ""))])


_parents = lambda a, b: bool(a["parent_name"] and b["parent_name"])
# The parts of the likeness, all of one weight.
PARTS = (
    Part(lambda a, b: True, lambda a, b: [(1.0, (a["tag"],), (b["tag"],))]),
    Part(lambda a, b: True, _own("path")),
    Part(lambda a, b: True, lambda a, b: _maps(a["attributes"], b["attributes"])),
    *map(_attribute, ("class", "id", "href", "src")),
    Part(lambda a, b: bool(a["text"]), _own("text")),
    Part(lambda a, b: bool(a["siblings"]), _own("siblings")),
    Part(_parents, _own("parent_name")),
    Part(_parents, lambda a, b: _maps(a["parent_attribs"], b["parent_attribs"])),
    Part(lambda a, b: _parents(a, b) and bool(a["parent_text"]), _own("parent_text")),
)


def _exact(x: Sequence, y: Sequence) -> float:
    return SequenceMatcher(None, x, y).ratio()


def _by_length(x: Sequence, y: Sequence) -> float:
    return 2.0 * min(len(x), len(y)) / (len(x) + len(y)) if x or y else 1.0


def _by_counts(x: Sequence, y: Sequence) -> float:
    return 2.0 * (Counter(x) & Counter(y)).total() / (len(x) + len(y)) if x or y else 1.0


def likeness(a: dict, b: dict, ratio: Callable[[Sequence, Sequence], float] = _exact) -> float:
    """0 to 100; with a bound in place of the exact ratio, a bound."""
    held = [p.pairs(a, b) for p in PARTS if p.counts(a, b)]
    return round(100 * sum(w * ratio(x, y) for pairs in held for w, x, y in pairs) / len(held), 2)


def best(stored: dict, prints: list[dict], least: float) -> list[tuple[int, float]]:
    """(place, score) of all elements of the highest score, if that is least or more."""
    bounds = sorted(((likeness(stored, p, _by_length), i) for i, p in enumerate(prints)), key=lambda x: (-x[0], x[1]))
    top, found = least, []
    for bound, i in bounds:
        if bound < top - MARGIN:
            break
        if likeness(stored, prints[i], _by_counts) < top - MARGIN:
            continue
        score = likeness(stored, prints[i])
        if score > top or (score == top and not found):
            top, found = score, [(i, score)]
        elif score == top:
            found.append((i, score))
    return sorted(found)


_FOUND = pa.list_(pa.struct([("name", pa.string()), ("path", pa.string()), ("text", pa.string()), ("score", pa.float64())]))
_KIND = "array<struct<name:string,path:string,text:string,score:double>>"


def _finder(least: float):
    def found(sources: pa.Array, groups: pa.Array) -> pa.Array:
        out, last = [], (None, [], [])
        for source, group in zip(sources.to_pylist(), groups.to_pylist(), strict=True):
            if last[0] != source or not last[1]:
                nodes = list(dom.parse(source).walk())
                last = (source, nodes, [dom.fingerprint(n) for n in nodes])
            _, nodes, prints = last
            out.append([{"name": g["name"], "path": dom.path(nodes[i]), "text": nodes[i].text(" ", True), "score": s} for g in group or () for i, s in best(json.loads(g["element"]), prints, least)])
        return pa.array(out, type=_FOUND)

    return found


def fingerprints(pages: DataFrame, wanted: dict[str, str], *, site: str = "site", html: str = "html") -> DataFrame:
    """(site, name, element): of each page the first element that each named selector finds, as JSON, to be stored."""
    for s in wanted.values():
        dom.compile_selector(s)

    def run(sources: pa.Array) -> pa.Array:
        out = []
        for source in sources.to_pylist():
            root = dom.parse(source)
            firsts = ((name, next(iter(dom.select(root, s)), None)) for name, s in wanted.items())
            out.append([{"name": name, "element": json.dumps(dom.fingerprint(n), ensure_ascii=False)} for name, n in firsts if n is not None])
        return pa.array(out, type=pa.list_(pa.struct([("name", pa.string()), ("element", pa.string())])))

    made = F.arrow_udf(run, "array<struct<name:string,element:string>>")(F.col(html).cast("string"))
    return pages.select(F.col(site).alias("site"), F.explode(made).alias("x")).select("site", "x.*")


def relocate_all(pages: DataFrame, stored: DataFrame, *, site: str = "site", html: str = "html", least: float = 40) -> DataFrame:
    """pages' other columns with (name, path, text, score): of each stored element (site, name, element) of a page's site
    the page's elements that are most like it, all of equal score, if the score is least or more.
    """
    of, group = fresh("x_site", pages), fresh("x_group", pages)
    count = stored.groupBy("site").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    chunked = stored.join(count, "site").withColumn("chunk", F.pmod(F.xxhash64("name", "element"), F.col("groups")))
    groups = write_out(chunked.groupBy(F.col("site").alias(of), "chunk").agg(F.sort_array(F.collect_list(F.struct("name", "element"))).alias(group)).drop("chunk"), "stored")
    size = groups.select(F.sum(F.aggregate(group, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["element"]) + 64))).first()[0] or 0
    keep = [c for c in pages.columns if c != html]
    met = pages.join(F.broadcast(groups) if size <= BROADCAST_BYTES else groups.hint("merge"), F.col(site) == F.col(of))
    found = fresh("x_found", pages)
    out = met.withColumn(found, F.arrow_udf(_finder(least), _KIND)(F.col(html).cast("string"), F.col(group)))
    return out.select(*keep, F.explode(found).alias("r")).select(*keep, "r.*")


def relocate(pages: DataFrame, stored: dict, *, html: str = "html", least: float = 40) -> DataFrame:
    """pages' other columns with (path, text, score): the elements most like one stored fingerprint, all of equal score."""
    one = pages.sparkSession.createDataFrame([("", "", json.dumps(stored, ensure_ascii=False))], "site string, name string, element string")
    site = fresh("x_any", pages)
    return relocate_all(pages.withColumn(site, F.lit("")), one, site=site, html=html, least=least).drop(site, "name")
