"""Main text of web pages by a site style tree.

Each page is read into its branches (elements by tag and class along their path) and blocks of text. The
branches of all pages of a host are merged: for each path the tree holds how often which presentation (the
tags below it) and which content stands there. A branch's importance is its own term of the entropy of the
contents and presentations at its path over the host's pages, between 0 (found on all of them) and 1 (found
on this one), so siblings of one path are judged each on its own. Branches of low importance are removed
from each page with all below them, on every host with two different pages or more. Before that, elements whose tags, roles or
class names say what they are (menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts, styles) are left out, and pages that mark their article or main part keep that part alone. The
tree judges the branches inside that part too, by counts of their own in which equal articles of a host
count once. An article of which the tree would take half of the characters or more is a copy, not a template, and
stays whole.

Inside an article names may be those of its subject (notice-period, related-work, a section login). There a class
leaves a block out only if all of it names a part of the page (comments, share-buttons); where it or an
id merely holds such a word, the block goes if half of its characters or more are links, and otherwise
the tree decides.

A page is read in one pass: an element holds hashes of its path, of the tags below it and of its contents,
which its parent takes over when it closes, so time and memory grow with the page, however deep it is.

Edge cases: a null or empty page gives an empty text; a page cut off anywhere is read as far as it goes,
a tag that is cut off is dropped; pages with a null url or without a host form no tree; equal pages of a
host count once in its tree; repeated rows are each extracted; extra columns stay, whatever their names, but for
one that has the name of the result, which takes its place.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.parts import give_back
from sluice.session import fresh, small_batches, write_out

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([/A-Za-z])[^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
OUT = frozenset("nav footer aside form button select option script style template iframe svg math dialog head menu object canvas audio video noscript textarea".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu menubar breadcrumb breadcrumbs "
    "header masthead footer sidebar aside cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social comment comments commentlist reply replies respond disqus related recommended widget toolbar pagination pager search skip".split()
)
#: Words that say how, not what: with one of OUT_WORDS they make up the name of a part of the page.
FORM_WORDS = frozenset("area bar block body box button buttons container content count form group icon icons inline inner item items link links list outer panel section text title top bottom wrap wrapper".split())
#: Words of OUT_WORDS that inside an article are rather its subject.
SUBJECTS = frozenset(("header", "skip"))
_P_ENDS = BLOCK - {"html", "body", "head"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article section div table ul ol dl main body html td th nav aside footer header form blockquote".split())

#: Weight of contents against presentations, and the importance below which a branch goes.
GAMMA, LEAST_IMPORTANCE = 0.9, 0.25
BROADCAST_BYTES = 8 << 20
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E688 >> 3


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") % _PRIME


#: Where the paths inside an article or main part begin.
PART = _hash("part")


class _Element:
    """An open element: number is its branch; content and tags are polynomial hashes of sequences, of n texts and of tags.

    chars and linked count characters and those in links; since, of a doubted one, tells what there was before it.
    """

    __slots__ = ("tag", "path", "out", "main", "content", "n", "tags", "number", "since", "chars", "linked")

    def __init__(self, tag: str, path: int, out: bool, main: bool, number: int, since: tuple[int, int] | None = None):
        self.tag, self.path, self.out, self.main, self.number, self.since = tag, path, out, main, number, since
        self.content = self.n = self.tags = self.chars = self.linked = 0

    def add(self, content: int, n: int) -> None:
        self.content = (self.content * pow(_BASE, n, _PRIME) + content) % _PRIME
        self.n += n


#: Class names that begin so tell of a neighbour or a state, not of the element itself.
_ABOUT_OTHERS = ("has-", "with-", "no-", "without-", "is-", "not-", "js-")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _names(attrs: dict[str, str], which: tuple[str, ...]) -> list[set[str]]:
    """The words of each class name, or id, that is the element's own."""
    given = [c for a in which for c in (attrs.get(a, "").split() if a == "class" else [attrs.get(a, "")])]
    return [{w.lower() for w in _TOKEN.findall(c)} for c in given if not c.lower().startswith(_ABOUT_OTHERS)]


def _left_out(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element is no part of the article: by its tag, role, style, or the words of its class and id.

    Headers inside the article hold its title and stay; headings and the page's own frame are never judged by
    their class or id, but an article element that says it is a comment is one. Inside an article all words of a
    block's class must name a part of the page.
    """
    if tag in OUT or (tag == "header" and not in_article) or "hidden" in attrs or attrs.get("role", "").strip().lower() in OUT_ROLES:
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if tag in _HEADINGS or tag in ("html", "body", "main"):
        return False
    if in_article or tag == "article":
        parts = OUT_WORDS - SUBJECTS if in_article else {"comment", "comments", "reply"}
        return tag in BLOCK and any(said & parts and all(w in OUT_WORDS or w in FORM_WORDS or w.isdigit() for w in said) for said in _names(attrs, ("class",)))
    return bool(set().union(*_names(attrs, ("class", "id"))) & OUT_WORDS)


def _doubted(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element inside an article may be no part of it, by a word of its class or id."""
    return tag not in _HEADINGS and any(said & OUT_WORDS for said in _names(attrs, ("class", "id")))


def read_page(source: str) -> tuple[list[tuple[int, str]], bool, list[tuple[int, int, int, bool, bool, int]]]:
    """(blocks, main, branches): blocks as (at, text) in page order, those of the article or main part if main.

    Branches are (path, presentation, content, first, inside, last) in page order: those outside that part, and
    those inside it, whose paths begin there; first tells whether path and content are new on the page, and all
    up to the number last are below it. What is left out has none. at is the innermost branch of a block, or -1.
    """
    root = _Element("", 0, False, False, -1)
    stack = [root]
    opened: dict[str, int] = {}
    blocks: list[tuple[int, str, bool]] = []
    branches: list[tuple | None] = []
    text: list[str] = []
    # Of each open element the innermost one that is a block, itself included.
    around = [root]

    def flush() -> None:
        if text:
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                stack[-1].add(_hash(words), 1)
                blocks.append((around[-1].number, words, stack[-1].main))

    def add(piece: str) -> None:
        if not stack[-1].out:
            text.append(html.unescape(piece))
            size = len(text[-1].strip())
            stack[-1].chars += size
            stack[-1].linked += size * bool(opened.get("a"))
        elif words := " ".join(html.unescape(piece).split()):
            stack[-1].add(_hash(words), 1)

    def close(to: int) -> None:
        while len(stack) > to:
            if stack[-1].tag in BLOCK:
                flush()
            e = stack.pop()
            around.pop()
            opened[e.tag] -= 1
            stack[-1].add(e.content, e.n)
            if e.since and e.linked and 2 * e.linked >= e.chars and (e.tag in BLOCK or e.since[0] == len(blocks)):
                # Mostly links: what it has put down goes.
                del blocks[e.since[0] :], text[0 if e.tag in BLOCK else e.since[1] :]
                branches[e.number :] = [None] * (len(branches) - e.number)
                continue
            stack[-1].chars += e.chars
            stack[-1].linked += e.linked
            if e.path not in (0, PART) and e.n and not e.out:
                branches[e.number] = (e.path, e.tags, e.content, e.main, len(branches) - 1)

    at, size = 0, len(source)
    for m in iter(lambda: _TAG.search(source, at), None):
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag in BLOCK:
            flush()
        if tag == "br" and not stack[-1].out:
            text.append(" ")
        if tag in VOID:
            continue
        attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m[3])} if m[3].strip(" /") else {}
        if tag in _P_ENDS or tag in _SAME:
            ends = _SAME.get(tag, set()) | ({"p"} if tag in _P_ENDS else set())
            for k in range(len(stack) - 1, 0, -1) if any(opened.get(x) for x in ends) else ():
                if stack[k].tag in ends:
                    close(k)
                    break
                if stack[k].tag in _SCOPE:
                    break
        up = stack[-1]
        style = tag + "".join(f".{c}" for c in sorted(attrs.get("class", "").split()))
        of = _hash(style)
        for e in stack[-2:]:
            e.tags = (e.tags * _BASE + of) % _PRIME
        main = up.main or (not up.out and (tag in ("article", "main") or attrs.get("role") == "main"))
        out = up.out or _left_out(tag, attrs, up.main)
        # The part itself is no branch of its own, and its classes, which may name one article, are no part of a path.
        path = PART if main and not up.main and not out else (up.path * _BASE + of + 1) % _PRIME
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
            at = end.end() if end else size
            continue
        doubted = up.main and not out and bool(attrs) and _doubted(tag, attrs)
        stack.append(_Element(tag, path, out, main and not out, len(branches), (len(blocks), len(text)) if doubted else None))
        around.append(stack[-1] if tag in BLOCK else around[-1])
        opened[tag] = opened.get(tag, 0) + 1
        branches.append(None)
    if at < size:
        add(source[at:])
    flush()
    close(1)
    main = any(b[2] for b in blocks)
    # Numbers from here on count what has become a branch.
    upto = list(itertools.accumulate((b is not None for b in branches), initial=0))
    met: set[tuple[int, int]] = set()
    told = [(p, s, c, (p, c) not in met and not met.add((p, c)), inside, upto[last + 1] - 1) for p, s, c, inside, last in filter(None, branches)]
    kept = [(upto[k] if k >= 0 and branches[k] else -1, t) for k, t, inside in blocks if inside or not main]
    return kept, main, told


_TYPE = "struct<blocks:array<struct<at:int,text:string>>,main:boolean,branches:array<struct<path:long,style:long,content:long,first:boolean,inside:boolean,last:int>>>"
_BRANCH = ("path", "style", "content", "first", "inside", "last")
_ARROW = pa.struct([
    ("blocks", pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())]))),
    ("main", pa.bool_()),
    ("branches", pa.list_(pa.struct([*[(c, pa.int64()) for c in _BRANCH[:3]], ("first", pa.bool_()), ("inside", pa.bool_()), ("last", pa.int32())]))),
])


def _read_pages(pages: pa.Array) -> pa.Array:
    out = []
    for page in pages:
        blocks, main, branches = read_page(page.as_py() or "")
        # Into Arrow page by page, as Python objects take many times the bytes.
        out.append(pa.array([{"blocks": [{"at": k, "text": t} for k, t in blocks], "main": main, "branches": [dict(zip(_BRANCH, b, strict=True)) for b in branches]}], type=_ARROW))
    give_back()
    return pa.concat_arrays(out) if out else pa.array([], type=_ARROW)


def _cut(pages: pa.Array, keys: pa.Array, low: pa.Array) -> pa.Array:
    """The text without the blocks below branches whose keys are low, on the side of the page that counts."""
    out = []
    for page, own, gone in zip(pages, keys, low, strict=True):
        if not page.is_valid:
            out.append(None)
            continue
        page, gone = page.as_py(), set(gone.as_py())
        edges = np.zeros(len(page["branches"]) + 1, dtype=np.int64)
        for i, (b, key) in enumerate(zip(page["branches"], own.as_py(), strict=True)):
            if key in gone and b["inside"] == page["main"]:
                edges[i] += 1
                edges[b["last"] + 1] -= 1
        below = np.cumsum(edges) > 0
        every = [b["text"] for b in page["blocks"]]
        left = [b["text"] for b in page["blocks"] if b["at"] < 0 or not below[b["at"]]]
        out.append("\n".join(every if page["main"] and 2 * sum(map(len, left)) <= sum(map(len, every)) else left))
    give_back()
    return pa.array(out, type=pa.string())


def style_tree(parsed: DataFrame, host: str, page: str) -> DataFrame:
    """(host, key, importance) of branches whose content is on two pages or more; equal pages of a host count once, and so do equal articles."""
    b = F.col(f"{page}.branches")
    sides = F.array(F.filter(b, lambda x: ~x["inside"]), F.filter(b, lambda x: x["inside"]))
    once = parsed.filter(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.explode(sides).alias("branches")).withColumn("whole", F.xxhash64("host", "branches"))
    once = once.groupBy("host", "whole").agg(F.any_value("branches").alias("branches"))
    # A page counts once for each path, presentation and content it has. These counts take few rows of the hottest host.
    none = F.lit(None).cast("long")

    def counted(x: Column) -> Column:
        kinds = [("path", none, none, F.lit(True)), ("style", x["style"], none, F.lit(True)), ("content", x["style"], x["content"], x["first"])]
        return F.array(*[F.struct(F.lit(kind).alias("kind"), x["path"].alias("path"), s.alias("style"), c.alias("content"), n.alias("first")) for kind, s, c, n in kinds])

    each = once.select("host", F.explode(F.array_distinct(F.flatten(F.transform("branches", counted)))).alias("x")).select("host", "x.*")
    counts = write_out(each.groupBy("host", "kind", "path", "style", "content").agg(F.sum(F.col("first").cast("long")).alias("n")), "tree")
    of = lambda kind, *by: counts.filter(F.col("kind") == kind).select("host", "path", *by, F.col("n").alias(f"n_{kind}"))
    own = lambda n: 1 - F.log2(n) / F.log2("n_path")
    # What the content alone keeps is left out first.
    tree = of("content", "content").groupBy("host", "path", "content").agg(F.sum("n_content").alias("n_content")).filter("n_content > 1")
    tree = tree.join(of("path"), ["host", "path"]).filter(own("n_content") * GAMMA < LEAST_IMPORTANCE)
    tree = of("content", "style", "content").drop("n_content").join(tree, ["host", "path", "content"]).join(of("style", "style"), ["host", "path", "style"])
    return tree.select("host", F.xxhash64("path", "style", "content").alias("key"), (own("n_content") * GAMMA + own("n_style") * (1 - GAMMA)).alias("importance"))


def main_text(pages: DataFrame, url: str = "url", source: str = "html", out: str = "main_text") -> DataFrame:
    """pages, without the source column, with the main text."""
    host, page, low = (fresh(x, pages) for x in ("h_host", "h_page", "h_low"))
    name = F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    keep = [c for c in pages.columns if c.lower() not in (source.lower(), out.lower())]
    of = fresh(f"{host}_of", pages)
    parsed = pages.withColumn(host, F.nullif(name, F.lit(""))).withColumn(page, F.arrow_udf(_read_pages, _TYPE)(F.col(source).cast("string"))).select(*keep, host, page)
    with small_batches(pages.sparkSession):
        parsed = write_out(parsed, "pages")
    tree = style_tree(parsed, host, page)
    drop = tree.filter(F.col("importance") < LEAST_IMPORTANCE)
    drop = write_out(drop.groupBy(F.col("host").alias(of)).agg(F.collect_set("key").alias(low)), "low")
    size = drop.select(F.sum(F.size(low) * 8 + 64)).first()[0] or 0
    joined = parsed.join(F.broadcast(drop) if size <= BROADCAST_BYTES else drop, F.col(host) == F.col(of), "left").drop(of)
    keys = F.transform(F.col(f"{page}.branches"), lambda b: F.xxhash64(b["path"], b["style"], b["content"]))
    # Of the host's list only what the page has goes on, and only pages that have some of it are cut.
    joined = joined.withColumn(low, F.array_intersect(keys, F.coalesce(F.col(low), F.array().cast("array<bigint>"))))
    hit = F.size(low) > 0
    cut = F.arrow_udf(_cut, "string")(F.when(hit, F.col(page)), F.when(hit, keys), F.when(hit, F.col(low)))
    whole = F.array_join(F.transform(F.col(f"{page}.blocks"), lambda b: b["text"]), "\n")
    return joined.withColumn(of, F.coalesce(cut, whole)).select(*keep, F.col(of).alias(out))
