"""Search in pages: XPath, elements by tag, attributes, text or pattern, and their relatives.

XPath: paths with / and //, unions, the axes child, descendant, descendant-or-self, self, parent, ancestor,
ancestor-or-self, following-sibling, preceding-sibling and attribute, name tests, *, text(), node(), predicates
by position and by conditions with and, or, =, !=, <, <=, >, >=, and the functions contains, starts-with,
normalize-space, string, string-length, concat, count, not, position, last, name, true and false.
A page is parsed once for all expressions; a null page is an empty one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators import dom
from sluice.session import fresh

_TOKEN = re.compile(r"\s*(//|/|::|\.\.|\.|@|\[|\]|\(|\)|\||,|!=|<=|>=|=|<|>|\*|'[^']*'|\"[^\"]*\"|\d+(?:\.\d+)?|[A-Za-z_][\w.-]*)")
_AXES = ("child", "descendant", "descendant-or-self", "self", "parent", "ancestor", "ancestor-or-self", "following-sibling", "preceding-sibling", "attribute")


class _Reader:
    """Recursive descent over the tokens of an expression; the tree is made of tuples that name what they are."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while at < len(source.rstrip()):
            m = _TOKEN.match(source, at)
            if not m:
                raise ValueError(f"not an XPath: {source!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at, self.source = 0, source

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self, want: str = "") -> str:
        got = self.peek()
        if not got or (want and got != want):
            raise ValueError(f"not an XPath: {self.source!r}")
        self.at += 1
        return got

    def chain(self, operators: tuple[str, ...], below: Callable):
        left = below()
        while self.peek() in operators:
            left = (self.take(), left, below())
        return left

    def expression(self):
        return self.chain(("or",), lambda: self.chain(("and",), lambda: self.chain(("=", "!="), lambda: self.chain(("<", "<=", ">", ">="), self.union))))

    def union(self):
        return self.chain(("|",), self.primary)

    def primary(self):
        t = self.peek()
        if t[:1] in ("'", '"'):
            return ("value", self.take()[1:-1])
        if t[:1].isdigit():
            return ("value", float(self.take()))
        if t == "(":
            self.take()
            inner = self.expression()
            self.take(")")
            return self.path(("filter", inner, self.predicates())) if self.peek() in ("/", "//") or self.peek() == "[" else inner
        if self.peek(1) == "(" and t not in ("text", "node"):
            name, args = self.take(), []
            self.take("(")
            while self.peek() != ")":
                args.append(self.expression())
                if self.peek() == ",":
                    self.take()
            self.take(")")
            return ("call", name, args)
        return self.path(None)

    def predicates(self) -> list:
        out = []
        while self.peek() == "[":
            self.take()
            out.append(self.expression())
            self.take("]")
        return out

    def path(self, start):
        steps, absolute = [], False
        if start is None and self.peek() in ("/", "//"):
            absolute = True
            if self.peek() == "/" and self.at + 1 == len(self.tokens):
                self.take()
                return ("path", None, True, [])
        elif start is None:
            steps.append(self.step())
        while self.peek() in ("/", "//"):
            if self.take() == "//":
                steps.append(("descendant-or-self", "node()", []))
            steps.append(self.step())
        return ("path", start, absolute, steps)

    def step(self):
        t = self.take()
        if t == ".":
            return ("self", "node()", self.predicates())
        if t == "..":
            return ("parent", "node()", self.predicates())
        axis = "child"
        if t == "@":
            axis, t = "attribute", self.take()
        elif self.peek() == "::":
            axis = t
            self.take()
            t = self.take()
        if axis not in _AXES or not re.match(r"[A-Za-z_*]", t):
            raise ValueError(f"not an XPath: {self.source!r}")
        if self.peek() == "(":
            self.take()
            self.take(")")
            t += "()"
        return (axis, t if axis == "attribute" or t.endswith("()") else t.lower(), self.predicates())


@lru_cache(512)
def compile_xpath(source: str):
    reader = _Reader(source)
    tree = reader.expression()
    if reader.at < len(reader.tokens):
        raise ValueError(f"not an XPath: {source!r}")
    return tree


class _Text(str):
    """A text of a document, at its own place."""


class _Document:
    """Children, parents and places of a document's elements and texts, all numbered in its order."""

    def __init__(self, root: dom.Node):
        self.root = root
        self.kids: dict[int, list] = {}
        self.place: dict[int, tuple] = {}
        self.order: dict[int, int] = {}
        stack: list = [root]
        while stack:
            n = stack.pop()
            self.order[id(n)] = len(self.order)
            if isinstance(n, dom.Node):
                kids = self.kids[id(n)] = [c if isinstance(c, dom.Node) else _Text(c) for c in n.children]
                self.place.update((id(c), (n, i)) for i, c in enumerate(kids))
                stack.extend(reversed(kids))

    def related(self, n, axis: str) -> list:
        if not isinstance(n, (dom.Node, _Text)):  # the value of an attribute
            return [n] if axis in ("self", "descendant-or-self") else []
        if axis == "child":
            return self.kids.get(id(n), [])
        if axis in ("descendant", "descendant-or-self"):
            out, stack = [], [n] if axis == "descendant-or-self" else self.kids.get(id(n), [])[::-1]
            while stack:
                out.append(stack.pop())
                stack.extend(reversed(self.kids.get(id(out[-1]), [])))
            return out
        if axis == "self":
            return [n]
        up, at = self.place.get(id(n), (None, 0))
        if axis == "parent":
            return [] if up is None else [up]
        if axis in ("ancestor", "ancestor-or-self"):
            out = [n] if axis == "ancestor-or-self" else []
            while up is not None and up.tag:
                out.append(up)
                up = self.place.get(id(up), (None, 0))[0]
            return out
        around = [] if up is None else self.kids[id(up)]
        return around[at + 1 :] if axis == "following-sibling" else around[:at][::-1]


def _text(value) -> str:
    if isinstance(value, list):
        return _text(value[0]) if value else ""
    if isinstance(value, dom.Node):
        return value.text()
    if isinstance(value, bool):
        return str(value).lower()
    return str(int(value)) if isinstance(value, float) and value == int(value) else str(value)


def _number(value) -> float:
    if isinstance(value, bool):
        return float(value)
    try:
        return float(_text(value).strip())
    except ValueError:
        return float("nan")


def _true(value) -> bool:
    return bool(value) and value == value


_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_CALLS = {
    "contains": lambda c, a, b: _text(b) in _text(a),
    "starts-with": lambda c, a, b: _text(a).startswith(_text(b)),
    "normalize-space": lambda c, *a: " ".join(_text(a[0] if a else c[0]).split()),
    "string": lambda c, *a: _text(a[0] if a else c[0]),
    "string-length": lambda c, *a: float(len(_text(a[0] if a else c[0]))),
    "concat": lambda c, *a: "".join(map(_text, a)),
    "count": lambda c, a: float(len(a)),
    "not": lambda c, a: not _true(a),
    "position": lambda c: float(c[1]),
    "last": lambda c: float(c[2]),
    "name": lambda c, *a: getattr(a[0][0] if a and a[0] else c[0], "tag", ""),
    "true": lambda c: True,
    "false": lambda c: False,
}


def _compared(op: str, a, b) -> bool:
    if isinstance(a, list) or isinstance(b, list):
        some = lambda v: v if isinstance(v, list) else [v]
        return any(_compared(op, _text(x) if isinstance(x, dom.Node) else x, _text(y) if isinstance(y, dom.Node) else y) for x in some(a) for y in some(b))
    if op in ("=", "!=") and not isinstance(a, (float, bool)) and not isinstance(b, (float, bool)):
        return _COMPARE[op](_text(a), _text(b))
    return _COMPARE[op](_number(a), _number(b))


def _kept(nodes: list, conditions: list, doc: _Document) -> list:
    for condition in conditions:
        total, left = len(nodes), []
        for place, n in enumerate(nodes, 1):
            value = _value(condition, (n, place, total), doc)
            if value == place if isinstance(value, float) else _true(value):
                left.append(n)
        nodes = left
    return nodes


def _value(tree, context: tuple, doc: _Document):
    kind = tree[0]
    if kind == "value":
        return tree[1]
    if kind == "or":
        return _true(_value(tree[1], context, doc)) or _true(_value(tree[2], context, doc))
    if kind == "and":
        return _true(_value(tree[1], context, doc)) and _true(_value(tree[2], context, doc))
    if kind in _COMPARE:
        return _compared(kind, _value(tree[1], context, doc), _value(tree[2], context, doc))
    if kind == "|":
        return _in_order([n for side in tree[1:] for n in _value(side, context, doc)], doc)
    if kind == "filter":
        return _kept(_value(tree[1], context, doc), tree[2], doc)
    if kind == "call":
        if tree[1] not in _CALLS:
            raise ValueError(f"no such XPath function: {tree[1]}")
        return _CALLS[tree[1]](context, *[_value(a, context, doc) for a in tree[2]])
    _, start, absolute, steps = tree
    nodes = _value(start, context, doc) if start else [doc.root if absolute else context[0]]
    for axis, test, conditions in steps:
        met: list = []
        for n in nodes:
            if axis == "attribute":
                attrs = n.attrs if isinstance(n, dom.Node) else {}
                met += list(attrs.values()) if test == "*" else [attrs[test]] if test in attrs else []
                continue
            near = doc.related(n, axis)
            if test == "text()":
                near = [c for c in near if isinstance(c, _Text)]
            elif test != "node()":
                near = [c for c in near if isinstance(c, dom.Node) and c.tag and test in ("*", c.tag)]
            met += _kept(near, conditions, doc)
        nodes = met if axis == "attribute" else _in_order(met, doc)
    return nodes


def _in_order(found: list, doc: _Document) -> list:
    """Elements and texts once each, in the order of the document, and behind them values of attributes as they came."""
    placed = {doc.order[id(n)]: n for n in found if id(n) in doc.order}
    return [placed[k] for k in sorted(placed)] + [n for n in found if id(n) not in doc.order]


def xpath(root: dom.Node, expression: str) -> list:
    """Elements and texts that an expression finds, in document order; a value other than nodes alone."""
    found = _value(compile_xpath(expression), (root, 1, 1), _Document(root))
    return found if isinstance(found, list) else [found]


def css_to_xpath(selector: str) -> str:
    """The XPath that finds what a CSS selector does, for selectors of dom."""

    def condition(t: tuple) -> str:
        if t[0] == "tag":
            return "true()" if t[1] == "*" else f"name() = '{t[1]}'"
        if t[0] == "not":
            return "not(" + " or ".join(" and ".join(map(condition, tests)) for steps in t[1] for _, tests in steps[-1:]) + ")"
        if t[0] == "attr":
            _, name, op, v = t
            own = f"@{name}"
            last = f"contains(concat({own}, '\n'), concat('{v}', '\n'))"
            return {"": own, "=": f"{own} = '{v}'", "~=": f"contains(concat(' ', normalize-space({own}), ' '), ' {v} ')", "^=": f"starts-with({own}, '{v}')", "$=": last, "*=": f"contains({own}, '{v}')", "|=": f"({own} = '{v}' or starts-with({own}, '{v}-'))"}[op]
        if t[0] == "nth-of-type":
            raise ValueError("nth-of-type stands behind a tag")
        return {"first-child": "not(preceding-sibling::*)", "last-child": "not(following-sibling::*)"}.get(t[0]) or f"count(preceding-sibling::*) = {t[1] - 1}"

    alternatives, what = dom.compile_selector(selector)
    out = []
    for steps in alternatives:
        path = ""
        for link, tests in steps:
            tag = next((t[1] for t in tests if t[0] == "tag"), "*")
            rest = [condition(t) if t[0] != "nth-of-type" else f"count(preceding-sibling::{tag}) = {t[1] - 1}" for t in tests if t[0] != "tag"]
            path += {">": "/", "+": "/following-sibling::*[1]/self::", "~": "/following-sibling::"}.get(link, "//") if path else "//"
            path += tag + "".join(f"[{c}]" for c in rest)
        out.append(path + ("/text()" if what == "text" else f"/@{what[1:]}" if what[0] == "@" else ""))
    return " | ".join(out)


def find_all(root: dom.Node, tags: tuple[str, ...] = (), attrs: dict[str, str] | None = None, pattern: str = "", keep: Callable[[dom.Node], bool] | None = None) -> list[dom.Node]:
    """Elements of any of the tags, with all of the attributes, whose own text has the pattern, and that keep holds for."""
    own = re.compile(pattern) if pattern else None
    wanted = {k: v for k, v in (attrs or {}).items()}
    return [n for n in root.walk() if (not tags or n.tag in tags) and all(n.attrs.get(k) == v for k, v in wanted.items()) and (own is None or own.search(n.own_text())) and (keep is None or keep(n))]


def _clean(text: str) -> str:
    return " ".join(text.split())


def find_by_text(root: dom.Node, text: str, partial: bool = False, case_sensitive: bool = False, clean: bool = True) -> list[dom.Node]:
    """Elements whose own text is, or with partial contains, the text."""
    fold = (lambda s: s) if case_sensitive else str.lower
    want = fold(text)
    said = lambda n: fold(_clean(n.own_text()) if clean else n.own_text())
    return [n for n in root.walk() if n.own_text() and ((want in said(n)) if partial else want == said(n))]


def find_by_regex(root: dom.Node, pattern: str, case_sensitive: bool = False, clean: bool = True) -> list[dom.Node]:
    want = re.compile(pattern, 0 if case_sensitive else re.IGNORECASE)
    return [n for n in root.walk() if n.own_text() and want.search(_clean(n.own_text()) if clean else n.own_text())]


def find_ancestor(n: dom.Node, keep: Callable[[dom.Node], bool]) -> dom.Node | None:
    return next((a for a in n.ancestors() if keep(a)), None)


def sibling(n: dom.Node, by: int) -> dom.Node | None:
    """The element so many places behind (or, below 0, before) among its parent's elements."""
    around, at = (n.parent.elements, n.nth + by) if n.parent is not None else ([n], by)
    return around[at] if 0 <= at < len(around) else None


_FOUND = "array<struct<pos:int,node_id:int,tag:string,value:string,path:string>>"
_ARROW = pa.list_(pa.struct([("pos", pa.int32()), ("node_id", pa.int32()), ("tag", pa.string()), ("value", pa.string()), ("path", pa.string())]))


def _rows(found: list) -> list[dict]:
    return [{"pos": k, "node_id": n.index, "tag": n.tag, "value": _clean(n.text(" ", True)), "path": dom.path(n)} if isinstance(n, dom.Node) else {"pos": k, "node_id": None, "tag": None, "value": _text(n).strip(), "path": None} for k, n in enumerate(found)]


def _searched(pages: DataFrame, search: Callable[[dom.Node], list], html: str) -> DataFrame:
    keep = [c for c in pages.columns if c != html]
    name = fresh("x_found", pages)
    found = F.arrow_udf(lambda texts: pa.array([_rows(search(dom.parse(t.as_py()))) for t in texts], type=_ARROW), _FOUND)(F.col(html).cast("string"))
    return pages.withColumn(name, found).select(*keep, F.explode(name).alias(name)).select(*keep, f"{name}.*")


def by_xpath(pages: DataFrame, expression: str, *, html: str = "html") -> DataFrame:
    """pages' other columns with (pos, node_id, tag, value, path) of what an XPath finds."""
    compile_xpath(expression)
    return _searched(pages, lambda root: xpath(root, expression), html)


def by_tag(pages: DataFrame, tags: tuple[str, ...] = (), attrs: dict[str, str] | None = None, pattern: str = "", *, html: str = "html") -> DataFrame:
    return _searched(pages, lambda root: find_all(root, tags, attrs, pattern), html)


def by_text(pages: DataFrame, text: str, partial: bool = False, case_sensitive: bool = False, *, html: str = "html") -> DataFrame:
    return _searched(pages, lambda root: find_by_text(root, text, partial, case_sensitive), html)


def by_regex(pages: DataFrame, pattern: str, case_sensitive: bool = False, *, html: str = "html") -> DataFrame:
    return _searched(pages, lambda root: find_by_regex(root, pattern, case_sensitive), html)


def neighbours(pages: DataFrame, expression: str, *, html: str = "html") -> DataFrame:
    """Of each element that an XPath finds the tags of its parent, of the elements before and behind it, and of its next ancestor with a class."""

    def near(texts: pa.Array) -> pa.Array:
        tag = lambda n: n.tag if n is not None and n.tag else None
        out = []
        for t in texts:
            found = [n for n in xpath(dom.parse(t.as_py()), expression) if isinstance(n, dom.Node)]
            out.append([{"node_id": n.index, "tag": n.tag, "parent": tag(n.parent), "previous": tag(sibling(n, -1)), "next": tag(sibling(n, 1)), "classed": tag(find_ancestor(n, lambda a: bool(a.classes())))} for n in found])
        return pa.array(out, type=pa.list_(pa.struct([("node_id", pa.int32()), *[(k, pa.string()) for k in ("tag", "parent", "previous", "next", "classed")]])))

    keep = [c for c in pages.columns if c != html]
    name = fresh("x_near", pages)
    column = F.arrow_udf(near, "array<struct<node_id:int,tag:string,parent:string,previous:string,next:string,classed:string>>")(F.col(html).cast("string"))
    return pages.withColumn(name, column).select(*keep, F.explode(name).alias(name)).select(*keep, f"{name}.*")


def attributes_with(attrs: Column, keyword: Column | str, partial: bool = False) -> Column:
    """The attributes of a map whose value is, or with partial contains, the keyword."""
    want = F.lit(keyword) if isinstance(keyword, str) else keyword
    return F.map_filter(attrs, lambda _, v: F.contains(v, want) if partial else v == want)


def has_class(attrs: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(attrs["class"], F.lit("")), r"\s+"), name)


def first_where(items: Column, keep: Callable[[Column], Column]) -> Column:
    """The first item of an array that keep holds for, or null."""
    return F.get(F.filter(items, keep), F.lit(0))


def json_of(n: dom.Node):
    """What an element's text says as JSON."""
    return json.loads(n.text())


def remember(pages: DataFrame, expression: str, identifier: str, *, html: str = "html", url: str = "url") -> DataFrame:
    """(domain, identifier, element): of each page's host the fingerprint, as JSON, of the first element that an XPath finds."""

    def first(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            found = next((n for n in xpath(dom.parse(t.as_py()), expression) if isinstance(n, dom.Node)), None)
            out.append(json.dumps(dom.fingerprint(found), sort_keys=True) if found else None)
        return pa.array(out, type=pa.string())

    told = pages.select(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))).alias("domain"), F.lit(identifier).alias("identifier"), F.col(url).alias("_url"), F.arrow_udf(first, "string")(F.col(html).cast("string")).alias("element"))
    return told.filter(F.col("element").isNotNull()).groupBy("domain", "identifier").agg(F.min_by("element", "_url").alias("element"))


def recall(stored: DataFrame, domain: str, identifier: str) -> dict | None:
    """The fingerprint that was kept for an identifier of a domain."""
    row = stored.filter((F.col("domain") == domain.lower()) & (F.col("identifier") == identifier)).first()
    return json.loads(row["element"]) if row else None
