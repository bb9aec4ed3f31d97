"""Search in pages, conversion, and checks of plans and specifications, on small pages."""

from __future__ import annotations

import time

import pytest

from sluice.operators import convert, dom, search
from sluice.plans import specs

PAGE = """<html><body><div id=a class='x y'><p>One</p><p class=k>Two <b>bold</b></p><a href=/u>L</a></div>
<ul><li>1</li><li>2</li><li>3</li></ul><h2>Head</h2><div class=x><p lang=en-GB>Three</p></div></body></html>"""
ROOT = dom.parse(PAGE)


def told(found):
    return [f"{n.tag}:{n.text()}" if isinstance(n, dom.Node) else n for n in found]


@pytest.mark.parametrize(
    "expression,want",
    [
        ("//div[@id='a']/p[2]", ["p:Two bold"]),
        ("//p[contains(., 'Two')]/@class", ["k"]),
        ("//p/text()", ["One", "Two ", "Three"]),
        ("//p[last()]", ["p:Two bold", "p:Three"]),
        ("(//p)[2]", ["p:Two bold"]),
        ("//li[position() > 1]", ["li:2", "li:3"]),
        ("//li[position() >= 2][1]", ["li:2"]),
        ("//b/ancestor::div/@id", ["a"]),
        ("//p[.='One']/following-sibling::*", ["p:Two bold", "a:L"]),
        ("//a/preceding-sibling::p[1]", ["p:Two bold"]),
        ("count(//li) > 2", [True]),
        ("//b/..", ["p:Two bold"]),
        ("//p | //h2", ["p:One", "p:Two bold", "h2:Head", "p:Three"]),
        ("//*[not(@class) and name()='p']", ["p:One", "p:Three"]),
        ("//p[starts-with(text(),'T') or @none]", ["p:Two bold", "p:Three"]),
        ("//li[. != '2']", ["li:1", "li:3"]),
        ("//li[string-length(.) = 1][. < 2]", ["li:1"]),
        ("concat('a', \"b\", normalize-space('  c  d '))", ["abc d"]),
        ("//none", []),
        ("/html/body/h2", ["h2:Head"]),
    ],
)
def test_xpath(expression, want):
    assert told(search.xpath(ROOT, expression)) == want


@pytest.mark.parametrize(
    ("page", "expression", "want"),
    [
        ("<p>x<b>y</b>z</p>", "//p/node()", ["x", "b:y", "z"]),
        ("<div>a<div>b</div>c</div>", "//div/descendant::text()", ["a", "b", "c"]),
        ("<p>x<b>y</b>z<i>w</i>v</p>", "//b/following-sibling::text()", ["z", "v"]),
        ("<p>x<b>y</b>z</p>", "//b/preceding-sibling::node()", ["x"]),
        ("<p>x<b>y</b>z</p>", "//b/text()/..", ["b:y"]),
        ("<p>x<b>y</b>z</p>", "//text()[. = 'z']/preceding-sibling::b", ["b:y"]),
        ("<p>x<b>y</b>z</p>", "//text() | //b", ["x", "b:y", "y", "z"]),
        ("<p>same<b>same</b></p>", "//text()", ["same", "same"]),
        ("<ul><li>1<li>2<ul><li>a<li>b</ul><li>3</ul>", "//body/li[2] | /ul/li[3]/text()", ["3"]),
        ("<ul><li>1<li>2<li>3</ul>", "//li[2]", ["li:2"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "//td[2]", ["td:b"]),
        ("<dl><dt>t<dd>d<dt>u</dl>", "//dl/*", ["dt:t", "dd:d", "dt:u"]),
    ],
)
def test_texts_have_their_places(page, expression, want):
    assert told(search.xpath(dom.parse(page), expression)) == want


def test_wide_and_deep_pages_take_linear_time():
    began = time.time()
    wide = dom.parse("<div>" + "<p class=a>x<b>y</b></p>" * 20_000 + "</div>")
    assert len(search.xpath(wide, "//b/following-sibling::text()")) == 0 and len(search.xpath(wide, "//p[@class='a']/text()")) == 20_000
    assert len(dom.select(wide, "p:nth-child(7), p:last-child, b:nth-of-type(1)")) == 20_002
    assert dom.path(wide.elements[0].elements[-1]) == "div > p:nth-of-type(20000)" and search.sibling(wide.elements[0].elements[500], 1).index > 0
    assert time.time() - began < 10


@pytest.mark.parametrize("broken", ["//p[", "//p[1", "p]", "//", "//p[foo(1)]", "$x", "//following::p"])
def test_what_is_no_xpath(broken):
    with pytest.raises(ValueError):
        search.xpath(ROOT, broken)


@pytest.mark.parametrize("selector", ["div.x > p", "p + p", "p ~ a", "a[href^='/']::attr(href)", "li:nth-of-type(2)", "li:nth-child(3)", "div:not(#a) p::text", "p:first-child, b", "p[class]", "a[href*='u']", "a[href$='u']", "p[lang|='en']", "ul > li:last-child", "*"])
def test_selectors_as_xpath_find_the_same(selector):
    found = search.xpath(ROOT, search.css_to_xpath(selector))
    if dom.compile_selector(selector)[1] == "node":
        assert [n.index for n in found] == [n.index for n in dom.select(ROOT, selector)]
    else:
        assert found == dom.values(ROOT, selector)


def test_search_by_text_pattern_and_relatives():
    assert told(search.find_by_text(ROOT, "one")) == ["p:One"] and not search.find_by_text(ROOT, "one", case_sensitive=True)
    assert told(search.find_by_text(ROOT, "t", partial=True)) == ["p:Two bold", "p:Three"] and told(search.find_by_regex(ROOT, r"^t\w+$")) == ["p:Two bold", "p:Three"]
    assert told(search.find_all(ROOT, ("p",), {"class": "k"})) == ["p:Two bold"] and told(search.find_all(ROOT, pattern="^[12]$")) == ["li:1", "li:2"]
    bold = search.find_all(ROOT, keep=lambda n: n.tag == "b")[0]
    assert search.find_ancestor(bold, lambda n: "x" in n.classes()).attrs["id"] == "a" and search.sibling(bold.parent, -1).text() == "One" and search.sibling(bold, 1) is None
    assert search.json_of(dom.parse('<script>{"a": 1}</script>').elements[0]) == {"a": 1}


def test_frames(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (2, None, "y"), (3, "", "z")], "id int, html string, x_found string")
    assert [tuple(r) for r in search.by_xpath(df, "//li").orderBy("pos").collect()] == [(1, "x", 0, 8, "li", "1", "html > body > ul > li:nth-of-type(1)"), (1, "x", 1, 9, "li", "2", "html > body > ul > li:nth-of-type(2)"), (1, "x", 2, 10, "li", "3", "html > body > ul > li:nth-of-type(3)")]
    kept = search.remember(spark.createDataFrame([("http://h/1", PAGE)], "url string, html string"), "//p[2]", "second")
    assert search.recall(kept, "H", "second")["attributes"] == {"class": "k"} and search.recall(kept, "h", "other") is None


def test_conversion():
    page = "<body><h1>T</h1><p>A <b>b</b> <a href=u>l</a><br>next<script>x()</script></p><ol><li>one</li><li>two<ul><li>deep</li></ul></li></ol><p hidden>no</p><template>t</template><p style='display: none'>n</p><pre>a\n b</pre><img src=i alt=I><blockquote>q​</blockquote><p aria-hidden=true>z</p></body>"
    text = convert.content(page, main_only=True)[0]
    assert text.startswith("# T\n\nA **b** [l](u)\nnext\n") and "1. one\n1. two\n" in text and "  - deep" in text and "```\na\n b\n```" in text and "![I](i)" in text and text.endswith("> q")
    assert not any(w in text for w in ("x()", "no", "\nt\n", "z"))
    assert convert.content("<p>a</p><p>b</p>", "html", "p") == ["<p>a</p>", "<p>b</p>"] and convert.content(None) == [""]
    assert convert.content("<p>a  b</p>\n<iframe>i</iframe><p>c</p>", "text") == ["a b\nc"]
    assert convert.content("<div>" * 3000 + "x" + "</div>" * 3000)[0] == "x"


def test_faults_of_plans_and_specifications(spark):
    assert specs.plan_faults({}) == {"ok": False, "errors": ["missing_start_url"], "warnings": ["no_list_selector_or_detail_urls", "no_fields"]}
    good = {"start_url": "http://h.example/l", "list_selector": "a", "fields": {"t": "h1", "p": ""}, "mode": "browser", "category_urls": ["http://h.example/c"]}
    assert specs.plan_faults(good) == {"ok": True, "errors": [], "warnings": []}
    assert specs.plan_faults(good | {"category_urls": ["x"]})["errors"] == ["invalid_category_url:x"] and specs.plan_faults(good | {"fields": "t"})["errors"] == ["fields_must_be_object"]
    assert specs.plan_risks(good, challenge=True) == ["category_urls_without_menu_source", "browser_rendering_required", "challenge_detected", "missing_field_selectors:p"]
    assert specs.requested_fields("with description") == ["title", "price", "image_src", "body"] and specs.requested_fields(fields=" a, b ,") == ["a", "b"]
    pages = spark.createDataFrame([("http://h.example/l", PAGE), ("http://h.example/e", "<p>none</p>")], "url string, html string")
    found = specs.validate_plan(good, pages)
    assert found["ok"] and found["sample"]["links"] == ["http://h.example/u"] and found["pipeline"]["steps"][0]["step"] == "crawl_lists"
    none = specs.validate_plan(good | {"start_url": "http://h.example/e"}, pages)
    assert none["sample"]["links_count"] == 0 and none["sample"]["diagnostics"]["anchors"] == 0
    assert specs.spec_faults([]) == ["spec must be a JSON object"] and len(specs.spec_faults({})) == 4
    spec = {"site": "s", "start_urls": ["http://h.example/l"], "list": {"item_link": "a@href"}, "detail": {"t": "h2", "n": "h9"}}
    assert specs.validate_spec(spec, pages, pages) == {"ok": False, "issues": ["detail.n matched 0 values"], "links": 1, "hits": {"t": 1, "n": 0}, "score": 0.667}
    assert specs.draft_spec("s", ["http://h.example/l"], pages.limit(1), ["title"])["list"]["item_link"].endswith("@href")


def test_metadata_and_export(spark, tmp_path):
    plan = specs.with_metadata({"start_url": "http://h.example/", "fields": {"t": "h1"}}, challenge=True)
    assert plan["kind"] == "collection_plan" and plan["assumptions"] == [specs.ASSUMPTIONS["fields"]] and plan["risk_flags"] == ["single_detail_fallback", "challenge_detected"]
    store = specs.SpecStore(spark, f"{tmp_path}/specs")
    spec = {"site": "s", "start_urls": ["http://h.example/"], "list": {"item_link": "a@href"}, "detail": {"t": "h1"}}
    assert store.save(spec, now=1.0) == 1 and store.save(spec | {"goal": "g"}, now=2.0) == 2 and store.rollback("s", now=3.0) == 3 and store.get("s") == spec
    store.export("s", f"{tmp_path}/out", 2)
    assert '"goal": "g"' in spark.read.text(f"{tmp_path}/out").first()[0]
    with pytest.raises(KeyError):
        store.get("s", 9)
    with pytest.raises(ValueError):
        store.save({"site": "s"})
