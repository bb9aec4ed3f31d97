"""Pages as Markdown, text or clean HTML.

Noise (scripts, styles, drawings) goes always from Markdown and text; the main-content mode keeps the body alone and
also drops what is hidden, templates, comments and characters of no width. A null page gives an empty text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.pieces import in_pieces
from sluice.operators import dom

# Elements that hold no content, characters of no width, and the marks of Markdown.
NOISE = frozenset(("script", "style", "noscript", "svg"))
NO_TEXT = NOISE | {"iframe"}
ZERO_WIDTH = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
EMPHASIS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}
BLOCKS = frozenset("p div section article main header footer nav aside table tr ul ol li pre blockquote h1 h2 h3 h4 h5 h6 hr figure form dl dt dd body html".split())
FORMATS = ("markdown", "html", "text")
#: What is nested deeper counts as plain text.
DEEPEST = 200


def _hidden(n: dom.Node) -> bool:
    return n.tag == "template" or "hidden" in n.attrs or n.attrs.get("aria-hidden", "").lower() == "true" or bool(HIDDEN_STYLE.search(n.attrs.get("style", "")))


def strip(root: dom.Node, tags: frozenset[str] = NOISE, hidden: bool = False) -> dom.Node:
    """The tree without elements of the tags, and with hidden without what isn't seen."""
    stack = [root]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or (c.tag not in tags and not (hidden and _hidden(c)))]
        if hidden:
            n.children = [ZERO_WIDTH.sub("", c) if isinstance(c, str) else c for c in n.children]
        stack.extend(n.elements)
    return root


def markdown(root: dom.Node) -> str:
    """The tree as Markdown: headings, paragraphs, lists, quotes, code, tables, links, images and emphasis."""
    lines: list[str] = []
    now: list[str] = []

    def end(gap: bool = True) -> None:
        text = re.sub(r"[ \t\n\r\f]+", " ", "".join(now)).strip()
        now.clear()
        if text:
            lines.append(text)
        if gap and lines and lines[-1] != "":
            lines.append("")

    def go(n: dom.Node, depth: int, mark: str, level: int = 0) -> None:
        for c in n.children:
            if not isinstance(c, str) and level >= DEEPEST:
                now.append(c.text(" ", False, NO_TEXT))
                continue
            if isinstance(c, str):
                now.append(c)
                continue
            tag = c.tag
            if tag in NOISE or tag == "title":
                continue
            if tag == "br":
                end(False)
            elif tag == "hr":
                end()
                lines.extend(("---", ""))
            elif tag == "img":
                now.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})")
            elif tag == "pre":
                end()
                lines.extend(("```", *c.text().strip("\n").split("\n"), "```", ""))
            elif tag == "a" and c.attrs.get("href"):
                inner = len(now)
                go(c, depth, mark, level + 1)
                words = " ".join("".join(now[inner:]).split())
                now[inner:] = [f"[{words}]({c.attrs['href']})"] if words else []
            elif tag in EMPHASIS:
                inner = len(now)
                go(c, depth, mark, level + 1)
                words = "".join(now[inner:])
                now[inner:] = [f"{EMPHASIS[tag]}{words.strip()}{EMPHASIS[tag]}"] if words.strip() else [words]
            elif tag in ("td", "th"):
                go(c, depth, mark, level + 1)
                now.append(" | ")
            elif tag in BLOCKS:
                end(tag not in ("li", "tr"))
                first = len(lines)
                if tag == "tr":
                    now.append("| ")
                go(c, depth + (tag in ("ul", "ol")), "1." if tag == "ol" else "-" if tag == "ul" else mark, level + 1)
                end(tag not in ("li", "tr"))
                if re.fullmatch("h[1-6]", tag) and first < len(lines):
                    lines[first] = "#" * int(tag[1]) + " " + lines[first]
                elif tag == "li" and first < len(lines):
                    lines[first] = "  " * max(0, depth - 1) + f"{mark or '-'} {lines[first]}"
                elif tag == "blockquote":
                    lines[first:] = [f"> {x}" if x else x for x in lines[first:]]
                elif tag == "tr" and first < len(lines) and all(e.tag == "th" for e in c.elements):
                    lines.append("|" + " --- |" * len(c.elements))
            else:
                go(c, depth, mark, level + 1)

    go(root, 0, "")
    end()
    return "\n".join(lines).strip("\n")


def content(source: str | None, kind: str = "markdown", selector: str = "", main_only: bool = False) -> list[str]:
    """The page, or each element that the selector finds, as Markdown, HTML or text."""
    root = dom.parse(source)
    if main_only:
        root = strip(next(iter(dom.select(root, "body")), root), NOISE, hidden=True)
    out = []
    for n in dom.select(root, selector) if selector else [root]:
        if kind == "markdown":
            out.append(markdown(n))
        elif kind == "html":
            out.append(n.outer() if n.tag else "".join(c.outer() if isinstance(c, dom.Node) else c for c in n.children))
        else:
            said = n.text("\n", True, NO_TEXT)
            for space in "\n\r\t ":
                said = re.sub(f"{space}+", space, said)
            out.append(said)
    return out


def convert(pages: DataFrame, kind: str = "markdown", selector: str = "", main_only: bool = False, *, html: str = "html", out: str = "content") -> DataFrame:
    """pages' other columns with an array of contents."""
    if kind not in FORMATS:
        raise ValueError(f"no such kind of content: {kind}")
    done = in_pieces(lambda texts: pa.array([content(t.as_py(), kind, selector, main_only) for t in texts], type=pa.list_(pa.string())), "array<string>")(F.col(html).cast("string"))
    return pages.withColumn(out, done).select(*[c for c in pages.columns if c not in (html, out)], out)


def write(pages: DataFrame, path: str, kind: str = "markdown", *, html: str = "html", url: str = "url") -> None:
    """Pages as contents in a folder of text files, a JSON line (url, content) each: Spark's own writer, so lost tasks leave nothing behind."""
    convert(pages.select(url, html), kind, html=html).select(url, F.array_join("content", "\n\n").alias("content")).write.mode("overwrite").json(path)
