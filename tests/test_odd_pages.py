"""URLs that were landed twice, and ampersands that begin no reference."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from sluice.functions import urls
from sluice.operators import dom, extract
from sluice.plans import catalog, diagnose
from sluice.plans.pipeline import Pipeline
from sluice.sources.pages import LandedPages


def test_a_url_landed_twice_is_diagnosed_twice(spark):
    pages = spark.createDataFrame([("http://h/a", "<a href='/x'>x</a>"), ("http://h/a", "<p>captcha</p>"), ("http://h/a", "<p>captcha</p>"), (None, None)], "url string, html string")
    got = sorted((r["url"] or "", r["ok"], r["links"]) for r in diagnose.diagnose(pages).collect())
    assert got == [("", True, 0), ("http://h/a", False, 0), ("http://h/a", False, 0), ("http://h/a", True, 1)]


def test_a_reference_ends_with_a_semicolon():
    root = dom.parse("<title>a&amp;b&amp</title><script>if (a && b) x('&amp', '&amp;')</script><!-- & --><p title='&quot;&lt'>&#65;&#65 &#x42;&copy=1 &eacute; R&D</p><a href='?a=1&copy=2&amp;b=3'>&lt</a>")
    assert dom.values(root, "title::text") == ["a&b&amp"] and root.elements[1].text() == "if (a && b) x('&amp', '&amp;')"
    assert dom.values(root, "p::text") == ["A&#65 B&copy=1 é R&D"] and dom.values(root, "p@title") == ['"&lt']
    assert dom.values(root, "a@href") == ["?a=1&copy=2&b=3"] and dom.values(root, "a::text") == ["&lt"]


def _shape(n):
    return n.tag, n.attrs, n.index, n.nth, n.of_type, [c if isinstance(c, str) else _shape(c) for c in n.children]


def test_plain_tokens_are_read_as_the_tokenizer_reads_them(monkeypatch):
    fed = []
    monkeypatch.setattr(dom._Builder, "feed", lambda self, text, real=dom._Builder.feed: (fed.append(text), real(self, text))[1])
    tokens = ["<div>", "</div>", '<a href="/x">', "</a>", '<a href="a&amp;b">', "<li>", "<ul>", "text", " a &lt; b ", "&copy", "<", "</", "<br>", "<br/>", "<!-- c -->", "<!-->", "<script>", "</script>", '<script>var a = "</p>" & 1;</script>', "<title>T &amp; x</title>", "<title>", "<textarea>", "<!DOCTYPE html>", "<P>", "\r\n", "\0", "<svg>", "<td>", "</ div>", "<p class='x'>", '<p a="1" a="2">', "<?pi x>", "</p"]
    rng = random.Random(12)
    for _ in range(3000):
        source = "".join(rng.choice(tokens) for _ in range(rng.randrange(1, 10)))
        whole = dom._Builder()
        whole.feed(dom.whole_references(source))
        whole.close()
        assert _shape(dom.parse(source)) == _shape(whole.root), source
    fed.clear()
    dom.parse('<!doctype html><html><body><a href="/x">x &amp; y</a><!-- z --></body></html>')
    assert "".join(fed) == ""


def test_plain_links_and_urls_are_what_parsing_makes_of_them(spark):
    rng = random.Random(13)
    piece = lambda of, n: "".join(rng.choice(of) for _ in range(rng.randrange(n)))
    some = [(piece(["http://", "https://", "HTTP://", "ftp://", ""], 2) + piece(["h", "H.example", "a.b", ":80", "..", "-", "u@"], 3) + piece(["/", "/a", "..", "?q=1", "?", "#f", "[", "é", ";x", " ", "\n", "%20"], 5),) for _ in range(2000)]
    for (base,) in some:
        link = piece(["/", "a", ".", "..", "b1", "?", "#", ";", "//", ":", "A"], 6)
        try:
            want = urljoin(base, link) if base else link
        except ValueError:
            want = ""
        assert extract.absolute(link, base) == ("" if not link or link[0] == "#" else want), (link, base)
    url = F.col("url")
    plain = F.when(url.rlike(urls.CANONICAL), url)
    rows = spark.createDataFrame(some, "url string").distinct().select("url", plain.alias("plain"), urls.canonical_url(F.concat(url, F.lit("#"))).alias("parsed"), urls.canonical_url(url).alias("got"))
    told = rows.filter("plain is not null").collect()
    assert told and all(r["plain"] == r["parsed"] == r["got"] for r in told)


def test_pipelines_read_pages_to_their_ends(spark, tmp_path):
    filler = "<p>long</p>" * 10_000
    pages = spark.createDataFrame([(1, "http://h/list", f'{filler}<a class="item" href="/p">p</a>'), (2, "http://h/p", f"{filler}<h1>Last</h1>")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in catalog.QUERIES["pipeline_run"](spark, str(tmp_path)).collect()] == [("http://h/p", "Last")]
    spec = {"steps": [{"step": "crawl_list", "url": "http://h/list", "selector": "a.item"}, {"step": "crawl_products", "fields": {"title": "h1"}}]}
    assert [(r["url"], r["title"]) for r in Pipeline(spec).run(spark, LandedPages(pages), now=1.0).records.collect()] == [("http://h/p", "Last")]
