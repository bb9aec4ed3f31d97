"""Shapes of JSON documents: walks, item arrays, field paths, pagination keys, menus and the path dialects."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.pieces import in_pieces
from sluice.operators.extract import absolute
from sluice.session import fresh, write_out

# Key names by meaning.
FIELD_HINTS = {
    "title": ("title", "name", "label", "headline", "productname", "displayname"),
    "price": ("price", "amount", "saleprice", "currentprice", "listprice", "originalprice"),
    "image": ("image", "images", "imageurl", "img", "src", "thumbnail", "picture"),
    "url": ("url", "href", "link", "producturl", "detailurl", "canonical"),
    "description": ("description", "desc", "summary", "body", "text"),
    "id": ("id", "sku", "pid", "productid", "itemid"),
}
PAGE_KEYS = ("page", "currentpage", "totalpage", "totalpages", "offset", "limit", "cursor", "next", "nextcursor", "hasnext", "total", "count")
ARRAY_NAMES = r"(?i)(items|products|results|records|data|list|jobs|articles|albums)"
TITLE_KEYS = ("title", "name", "label", "text", "displayName", "categoryName")
URL_KEYS = ("url", "href", "link", "path", "targetUrl")
CHILD_KEYS = ("children", "childs", "items", "menuItems", "subMenus", "submenus", "categories", "mainMenu")


def kind_of(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "url_or_path" if v.startswith(("http://", "https://", "/")) else "price_like" if re.search(r"\d+[.,]\d{2}", v) else "text"
    return "array" if isinstance(v, list) else "object" if isinstance(v, dict) else "null"


def walk(data, most_depth: int | None = None, most_children: int | None = None):
    """(path, value, depth) in preorder, in the order of the document; of lists at most so many children. The root is $."""
    stack = [("$", data, 0)]
    while stack:
        path, v, depth = stack.pop()
        yield path, v, depth
        if most_depth is None or depth < most_depth:
            head = "" if path == "$" else path
            if isinstance(v, dict):
                named = [(str(k) or '""', x) for k, x in v.items()]
                stack.extend([(k if not head else f"{head}{k}" if k[0] == "[" else f"{head}.{k}", x, depth + 1) for k, x in reversed(named)])
            elif isinstance(v, list):
                some = v[:most_children]
                stack.extend([(f"{head}[{i}]", some[i], depth + 1) for i in range(len(some) - 1, -1, -1)])


def parsed(text: str | None):
    """The JSON that a text is; None for what is none, and for what is nested deeper than the parser goes."""
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def leaf_of(path: str) -> str:
    """The name that a path ends in, as names are compared."""
    return path.rsplit(".", 1)[-1].lower().replace("_", "").replace("-", "")


_NODE = pa.struct([("pos", pa.int32()), ("path", pa.string()), ("leaf", pa.string()), ("kind", pa.string()), ("n", pa.int32()), ("value", pa.string()), ("keys", pa.list_(pa.string())), ("objects", pa.bool_())])


def _walks(most_depth: int | None, most_children: int | None, most_chars: int | None):
    def run(texts: pa.Array) -> pa.Array:
        # A list a column: dictionaries of nodes would take as long again.
        columns: list[list] = [[] for _ in _NODE]
        ends = [0]
        of_pos, of_path, of_leaf, of_kind, of_n, of_value, of_keys, of_objects = (c.append for c in columns)
        for t in texts.to_pylist():
            data = parsed(t)
            for pos, (path, v, _) in enumerate(walk(data, most_depth, most_children) if data is not None else ()):
                listed, named = isinstance(v, list), isinstance(v, dict)
                items = [x for x in v[:most_children] if isinstance(x, dict)] if listed else ()
                of_pos(pos)
                of_path(path)
                of_leaf(leaf_of(path))
                of_kind(kind_of(v))
                of_n(len(v) if listed or named else None)
                of_value(None if listed or named else str(v)[:most_chars])
                of_keys(sorted({str(k) for x in items for k in x}) if items else [str(k) for k in v] if named else [])
                of_objects(bool(items))
            ends.append(len(columns[0]))
        flat = pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _NODE, strict=True)], fields=list(_NODE))
        return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), flat)

    return run


def nodes(docs: DataFrame, text: str, most_depth: int | None = None, most_children: int | None = None, most_chars: int | None = None) -> DataFrame:
    """docs' other columns with (pos, path, leaf, kind, n, value, keys, objects) of every node; bad JSON has none.

    Nodes come in the order of the document, by which ties are decided; a VARIANT would have its keys sorted. Limits of
    depth, of children of a list and of a value's characters are off unless given.
    """
    keep = [c for c in docs.columns if c != text]
    name = fresh("x_nodes", docs)
    kind = "array<struct<pos:int,path:string,leaf:string,kind:string,n:int,value:string,keys:array<string>,objects:boolean>>"
    found = docs.withColumn(name, in_pieces(_walks(most_depth, most_children, most_chars), kind)(F.col(text).cast("string")))
    return found.select(*keep, F.explode(name).alias("n")).select(*keep, "n.*")


def item_arrays(walked: DataFrame, key: str) -> DataFrame:
    """(key, path, n, score): per document its likeliest list of items, of equal scores the first."""
    low = F.transform("keys", lambda k: F.lower(k))
    groups = sum((F.when(F.arrays_overlap(low, F.array(*[F.lit(h) for h in hints])), 8).otherwise(0) for hints in FIELD_HINTS.values()), F.lit(0))
    score = F.least(F.col("n") * 3, F.lit(45)) + F.when(F.col("path").rlike(ARRAY_NAMES), 35).otherwise(0) + F.when(F.col("objects"), 30 + groups).otherwise(5)
    found = walked.filter((F.col("kind") == "array") & (F.col("n") > 0)).withColumn("score", score)
    best = found.groupBy(key).agg(F.max_by(F.struct("path", "n", "score"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select(key, "b.*")


def field_paths(walked: DataFrame, key: str) -> DataFrame:
    """(key, field, path, score, kind, value): per meaning the likeliest leaf, of equal scores the first."""
    leaves = walked.filter(~F.col("kind").isin("array", "object") & (F.col("path") != "$"))
    hints = F.array(*[F.struct(F.lit(f).alias("field"), F.array(*[F.lit(h) for h in hs]).alias("hints")) for f, hs in FIELD_HINTS.items()])
    each = leaves.select("*", F.explode(hints).alias("h"))
    f = F.col("h.field")
    fits = F.when((f == "price") & F.col("kind").isin("number", "price_like"), 25).when(f.isin("image", "url") & (F.col("kind") == "url_or_path"), 20).when(f.isin("title", "description") & (F.col("kind") == "text"), 15).otherwise(0)
    named = F.when(F.array_contains("h.hints", F.col("leaf")), 60).when(F.exists("h.hints", lambda x: F.contains(F.col("leaf"), x)), 35).otherwise(0)
    scored = each.select(key, f.alias("field"), "path", "kind", "value", "pos", (named + fits).alias("score")).filter("score > 0")
    first = F.row_number().over(Window.partitionBy(key, "field").orderBy(F.desc("score"), "pos"))
    return scored.withColumn("_k", first).filter("_k = 1").drop("_k", "pos")


def pagination_keys(walked: DataFrame, key: str) -> DataFrame:
    """(key, path, kind, value): leaves whose names hold a word of paging."""
    return walked.filter(~F.col("kind").isin("array", "object") & F.col("leaf").rlike("|".join(PAGE_KEYS))).select(key, "path", "kind", "value")


_LISTS = pa.struct([("paged", pa.bool_()), ("lists", pa.list_(pa.struct([("path", pa.string()), ("score", pa.int32()), ("pos", pa.int32()), ("fields", pa.int32())])))])
_ARRAY_NAME = re.compile(ARRAY_NAMES, re.ASCII)


@lru_cache(4096)
def _meanings(leaf: str, kind: str) -> int:
    """A bit for each meaning that field_paths would give a leaf of that name and kind."""
    fits = {"number": ("price",), "price_like": ("price",), "url_or_path": ("image", "url"), "text": ("title", "description")}.get(kind, ())
    return sum(1 << i for i, (f, hints) in enumerate(FIELD_HINTS.items()) if f in fits or any(h in leaf for h in hints))


@lru_cache(4096)
def _pages(leaf: str) -> bool:
    return any(k in leaf for k in PAGE_KEYS)


def lists_in(data) -> dict:
    """paged: whether a leaf's name holds a word of paging; lists: (path, score, pos, fields) of each list that holds something.

    Scores are those of item_arrays; fields has a bit for each meaning of a leaf in any item, at any depth.
    """
    paged, found, around = False, [], []

    def leave(depth: int) -> None:
        while around and around[-1][0] >= depth:
            inner = around.pop()[1]
            if around:
                around[-1][1]["fields"] |= inner["fields"]

    for pos, (path, v, depth) in enumerate(walk(data)):
        leave(depth)
        if isinstance(v, list):
            if v:
                items = [x for x in v if isinstance(x, dict)]
                keys = {str(k).lower() for x in items for k in x}
                score = min(3 * len(v), 45) + 35 * bool(_ARRAY_NAME.search(path)) + (30 + 8 * sum(not keys.isdisjoint(hints) for hints in FIELD_HINTS.values()) if items else 5)
                found.append({"path": path, "score": score, "pos": pos, "fields": 0})
                around.append((depth, found[-1]))
        elif not isinstance(v, dict):
            leaf = leaf_of(path)
            paged = paged or _pages(leaf)
            if around:
                around[-1][1]["fields"] |= _meanings(leaf, kind_of(v))
    leave(0)
    return {"paged": paged, "lists": found}


def _lists(texts: pa.Array) -> pa.Array:
    return pa.array([None if (data := parsed(t)) is None else lists_in(data) for t in texts.to_pylist()], type=_LISTS)


def api_models(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, path, score, n_fields, has_pagination, confidence): how well each response serves as an API, by all items of its likeliest list.

    Texts of one key are one response. What is none or bad JSON has no path.
    """
    read = docs.select(key, in_pieces(_lists, "struct<paged:boolean,lists:array<struct<path:string,score:int,pos:int,fields:int>>>")(F.col(text).cast("string")).alias("_read"))
    lists = write_out(read.select(key, F.col("_read.paged").alias("_paged"), F.explode_outer("_read.lists").alias("_l")), "lists")
    # A row a list and not a node; the first of equal scores is the greatest.
    each = lists.groupBy(key, F.col("_l.path").alias("_path")).agg(F.max(F.struct("_l.score", -F.col("_l.pos"))).alias("_rank"), F.bit_or("_l.fields").alias("_fields"), F.max("_paged").alias("_paged"))
    best = each.groupBy(key).agg(F.max_by(F.struct("_path", "_rank.score", "_fields"), "_rank").alias("_b"), F.max("_paged").alias("_paged"))
    out = best.select(key, F.col("_b._path").alias("path"), F.col("_b.score").alias("score"), F.coalesce(F.bit_count("_b._fields"), F.lit(0)).cast("long").alias("n_fields"), F.coalesce("_paged", F.lit(False)).alias("has_pagination"))
    confidence = 0.3 + F.least(F.coalesce(F.col("score"), F.lit(0)) / 160, F.lit(0.45)) + F.least(F.col("n_fields") * 0.06, F.lit(0.2)) + F.when(F.col("has_pagination"), 0.08).otherwise(0.0)
    return out.select("*", F.round(F.least(confidence, F.lit(0.95)), 3).alias("confidence"))


def tokens_a(path: str) -> list[str | int]:
    """Dialect A: a.b[0][*]; items.0 names the key "0"."""
    return [m[1] if m[1] is not None else "*" if m[2] == "*" else int(m[2]) for m in re.finditer(r"([^.\[\]]+)|\[(\d+|\*)\]", path or "")]


def at_a(data, path: str):
    """The values at a path of dialect A; * fans out over lists and objects; None if any step finds nothing."""
    level, fan = [data], False
    for t in tokens_a(path):
        if t == "*":
            fan = True
            level = [x for v in level for x in (v if isinstance(v, list) else v.values() if isinstance(v, dict) else ())]
        else:
            level = [v[t] for v in level if (isinstance(t, int) and isinstance(v, list) and t < len(v)) or (isinstance(t, str) and isinstance(v, dict) and t in v)]
        if not level:
            return None
    return level if fan else level[0]


def at_b(data, path: str):
    """Dialect B: as A without *, and $ or '' for the root."""
    return data if path in ("", "$") else at_a(data, path)


def at_c(data, path: str) -> list:
    """Dialect C: dotted with list positions as numbers, always a list; a list that is found is the result itself."""
    parts = [p for p in re.split(r"\.|\[|\]", path.removeprefix("$").strip(".")) if p]
    level = [data]
    for p in parts:
        level = [x for v in level for x in (v if p == "*" and isinstance(v, list) else v.values() if p == "*" and isinstance(v, dict) else [v[int(p)]] if isinstance(v, list) and p.isdigit() and int(p) < len(v) else [v[p]] if isinstance(v, dict) and p in v else [])]
    found = [x for x in level if x is not None]
    return found[0] if len(found) == 1 and isinstance(found[0], list) else found


def at_d(data, path: str):
    """Dialect D: dotted; a list needs a position; what isn't there raises KeyError."""
    for p in (x for x in path.split(".") if x):
        try:
            data = data[int(p)] if isinstance(data, list) else data[p]
        except (KeyError, IndexError, TypeError, ValueError) as e:
            raise KeyError(path) from e
    return data


def json_path(text: Column, path: str, dialect: str = "a") -> Column:
    """The value at a path of a JSON text, as JSON; null where there is none."""
    reader = {"a": at_a, "b": at_b, "c": at_c}[dialect]

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            data = parsed(t)
            v = None if data is None else reader(data, path)
            out.append(None if v is None else json.dumps(v, ensure_ascii=False))
        return pa.array(out, type=pa.string())

    return F.arrow_udf(run, "string")(text.cast("string"))


def variant_path(text: Column, path: str, kind: str = "string") -> Column:
    """The value at a fixed path without fan-out, read by Spark alone: `a.b[0]`."""
    return F.try_variant_get(F.try_parse_json(text), "$." + path if path not in ("", "$") else "$", kind)


def _first_text(node: dict, keys: tuple[str, ...]) -> str:
    return next((v.strip() for k in keys if isinstance(v := node.get(k), str) and v.strip()), "")


def menu_rows(menu, base: str = "", most_depth: int = 4) -> list[dict]:
    """A menu as rows (node_id, parent_id, depth, pos, title, url, reason); a node with a reason is left out, with all below it."""
    rows: list[dict] = []
    seen: set[tuple[str, str]] = set()

    def url_of(n: dict) -> str:
        return absolute(u, base) if (u := _first_text(n, URL_KEYS)) else url_of(n["link"]) if isinstance(n.get("link"), dict) else ""

    def visit(items: list, parent: int | None, depth: int) -> None:
        for pos, n in enumerate(x for x in items if isinstance(x, dict)):
            title, url, kind = _first_text(n, TITLE_KEYS), url_of(n), str(n.get("type", "")).lower()
            key = (title.lower(), url)
            reason = ""
            if n.get("hidden") is True or n.get("isHidden") is True or n.get("visible") is False:
                reason = "hidden"
            elif n.get("contentPage") is True or kind in ("contentpage", "content_page", "cms"):
                reason = "contentPage"
            elif n.get("externalLink") is True or kind in ("externallink", "external_link"):
                reason = "externalLink"
            elif title and url and key in seen:
                reason = "duplicate"
            below = next((n[k] for k in CHILD_KEYS if isinstance(n.get(k), list)), [])
            if not (title or url or below):
                continue
            me = len(rows)
            rows.append({"node_id": me, "parent_id": parent, "depth": depth, "pos": pos, "title": title, "url": url, "reason": reason})
            if not reason:
                seen.add(key)
                if depth < most_depth:
                    visit(below, me, depth + 1)

    visit(menu if isinstance(menu, list) else next((menu[k] for k in CHILD_KEYS if isinstance(menu, dict) and isinstance(menu.get(k), list)), [menu]), None, 1)
    return rows


def menus(docs: DataFrame, text: str, base: str, most_depth: int = 4) -> DataFrame:
    """docs' other columns with the rows of the menu that each JSON text is."""
    kind = pa.list_(pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("pos", pa.int32()), ("title", pa.string()), ("url", pa.string()), ("reason", pa.string())]))

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            data = parsed(t)
            out.append([] if data is None else menu_rows(data, base, most_depth))
        return pa.array(out, type=kind)

    keep = [c for c in docs.columns if c != text]
    spark_kind = "array<struct<node_id:int,parent_id:int,depth:int,pos:int,title:string,url:string,reason:string>>"
    found = docs.withColumn("x_menu", F.arrow_udf(run, spark_kind)(F.col(text).cast("string")))
    return found.select(*keep, F.explode("x_menu").alias("m")).select(*keep, "m.*")
