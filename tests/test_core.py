"""The operators on cases whose results are known."""

from __future__ import annotations

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from sluice.functions import predicates, text, urls
from sluice.operators import dom, extract, frontier, jsonshape, memory, profile, relocate, score, store, tree
from sluice.plans import pipeline, report, spider
from sluice.session import new_path
from sluice.sources import pages as landed
from sluice.sources import records, sitemap
from sluice.streaming import events as streams

H = "http://shop.example"
PRODUCTS = f"""<html><head><link rel="next" href="/products?page=2"></head><body>
<article class="product-card"><a class="product-item-link" href="/p/1">One</a><img class="product-image-photo" src="/i/1.jpg"><span class="price">$19.99</span></article>
<article class="product-card"><a class="product-item-link" href="/p/2">Two</a><img class="product-image-photo" src="/i/2.jpg"><span class="price">$29.99</span></article>
<a rel="next" href="/products?page=2">Next</a></body></html>"""  # noqa: F541
DETAIL = '<h1 class="page-title title">Local Product</h1><span class="price">${p}</span><div class="product-description">{d}</div><img class="main-image" src="/images/x.jpg">'
API = "<script>fetch('/api/catalog/products?page=1&limit=24');x('/graphql');y('/ajax/category/products?offset=24')</script>"


def detail(n: int) -> str:
    return DETAIL.format(p=f"{n}9.99", d="long description " * 8)


@pytest.fixture(scope="module")
def shop(spark):
    rows = [(f"{H}/products", PRODUCTS), (f"{H}/p/1", detail(1)), (f"{H}/p/2", detail(2)), (f"{H}/products?page=2", '<a class="product-item-link" href="/p/3">Three</a>'), (f"{H}/p/3", detail(3)), (f"{H}/api", API)]
    return spark.createDataFrame(rows, "url string, html string")


def values(df):
    return [tuple(r) for r in df.collect()]


# ------------------------------------------------------------------ URLs, texts, conditions


def test_canonical_urls(spark):
    cases = {"HTTP://Example.TEST/a;v=1?x=1#f": "http://example.test/a?x=1", "https://example.test": "https://example.test/", "ftp://example.test/bad": None, "not a url": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", urls.canonical_url(F.col("u")))
    assert dict(values(df)) == cases


def test_url_parts(spark):
    u = "http://a.b.example.com:8080/x/y+z%20w/item.HTML?currentPageType=Search&page=2&qid=123&page=3"
    row = spark.createDataFrame([(u,)], "u string").select(urls.extension(F.col("u")).alias("e"), urls.pagination_params(F.col("u")).alias("p"), urls.path_parts(F.col("u")).alias("s"), urls.host_suffixes(urls.host(F.col("u"))).alias("h"), urls.validate_url(F.lit("http://127.0.0.1/")).alias("v"), urls.domain_matches(urls.host(F.col("u")), [".example.com"]).alias("m")).first()
    assert (row["e"], row["p"], row["s"][1], row["h"], row["v"], row["m"]) == ("html", {"page": "3"}, "y+z w", ["a.b.example.com", "b.example.com", "example.com", "com"], "private", True)


def test_job_record(spark):
    df = spark.createDataFrame([("AI智能体开发工程师", "大连/远程", "10-15K；五险一金、带薪年假", "做智能体开发。" * 30 + "版权所有 某公司")], "title string, loc string, pay string, d string")
    pay, place, told = text.parse_salary(F.col("pay")), text.normalize_location(F.col("loc")), text.clean_description(F.col("d"))
    r = df.select(text.normalize_title(F.col("title")).alias("t"), place.alias("l"), pay.alias("s"), told.alias("d"), text.job_grade(F.lit("parsed_text"), pay, place, told).alias("g"), text.job_category(F.col("title"), told).alias("c")).first()
    assert (r["t"], r["l"]["city"], r["l"]["is_remote"], r["s"]["currency"], r["s"]["salary_min"], r["s"]["salary_max"]) == ("AI Agent Engineer", "大连", True, "CNY", 10000, 15000)
    assert "版权所有" not in r["d"] and r["g"] == "B" and r["c"] == "AI Agent Development"


def test_conditions(spark):
    df = spark.createDataFrame([("$1,299.00", "a", None), ("20-30", "b", "x"), (None, "c", "")], "price string, name string, tag string")
    pick = lambda c: [r["name"] for r in df.filter(predicates.condition(c, df.schema)).collect()]
    assert pick("price > 100") == ["a"] and pick("price <= 20") == ["b"] and pick("tag exists") == ["b"] and pick("price == None") == ["c"] and pick('name contains "b"') == ["b"] and pick("") == ["a", "b", "c"] and pick("nothing exists") == []
    with pytest.raises(ValueError):
        predicates.condition("drop table", df.schema)
    like = spark.createDataFrame([("100% genuine",), ("100 percent fake",)], "title string")
    assert values(like.filter(predicates.where('[{"field":"title","op":"LIKE","value":"100%"}]', like.schema))) == [("100% genuine",)]
    for bad in ("title = 'A' OR 1=1", '{"other": 1}', '[{"field":"title","op":"IN","value":1}]', '[{"field":"a b","value":1}]'):
        with pytest.raises(ValueError):
            predicates.where(bad, like.schema)


# ------------------------------------------------------------------ store


def test_store(spark):
    s = store.Store(spark, new_path(spark, "store"))
    s.register("shop", "items", {"columns": {"url": "TEXT", "title": "TEXT", "price": "REAL"}, "required": ["url", "title"], "unique": ["url"], "strict": True})
    rows = spark.createDataFrame([(0, "u1", "A", "12.5"), (1, "u2", "B", None), (2, "u1", "again", "9")], "n int, url string, title string, price string")
    with pytest.raises(ValueError):
        s.save(rows, "shop", "items")  # n is not declared
    assert s.save(rows.drop("n"), "shop", "items") == {"saved": 2, "skipped": 1, "errors": 0}
    assert s.save(rows.drop("n"), "shop", "items")["saved"] == 0
    total, page = s.query("shop", "items", {"url": "u1"})
    assert total == 1 and page.first()["price"] == 12.5 and page.first()["title"] == "A"
    bad = spark.createDataFrame([("u3", None, "1"), ("u4", "D", "x"), ("u5", "E", "2")], "url string, title string, price string")
    with pytest.raises(ValueError, match="invalid"):
        s.save(bad, "shop", "items")
    assert s.save(bad, "shop", "items", atomic=False) == {"saved": 1, "skipped": 0, "errors": 2}
    assert values(s.tables()) == [("shop", "items", 3)]
    out = new_path(spark, "export")
    s.export("shop", "items", out, "csv", [{"field": "price", "op": ">", "value": 5}])
    assert [r["url"] for r in spark.read.option("header", "true").csv(out).collect()] == ["u1"]
    nested = spark.createDataFrame([("x", ["a", "b"])], "url string, image_src array<string>")
    assert s.save(nested, "shop", "raw")["saved"] == 1 and s.table("shop", "raw").first()["image_src"] == '["a","b"]'
    with pytest.raises(ValueError):
        store.TableSchema.parse({"columns": {"id": "TEXT"}})


# ------------------------------------------------------------------ frontier and memory


def test_frontier(spark):
    empty = spark.createDataFrame([], frontier.SCHEMA)
    raw = spark.createDataFrame([(0, "https://example.test/a"), (1, "https://example.test/a"), (2, "ftp://example.test/bad")], "pos long, url string")
    f, counts = frontier.add_urls(empty, raw, 1.0, order="pos")
    assert dict(values(counts)) == {"added": 1, "skipped": 1, "invalid": 1} and f.count() == 1
    more = spark.createDataFrame([(i, f"https://example.test/{i}") for i in range(5)], "pos long, url string")
    f, _ = frontier.add_urls(empty, more, 1.0, order="pos")
    one = frontier.next_batch(f, 2.0, 3)
    f = frontier.lease(f, one, 2.0, token="t1")
    two = frontier.next_batch(f, 3.0, 3)
    assert one.count() == 3 and two.count() == 2 and one.join(two, "url_hash").count() == 0
    assert frontier.next_batch(f, 2000.0, 9).count() == 5  # the lease has ended
    f = frontier.mark_failed(frontier.mark_done(f, one.limit(1), 4.0), two, 4.0, "boom", retry=False)
    assert dict(values(frontier.status_counts(f))) == {"done": 1, "running": 2, "failed": 2}
    seen = frontier.might_contain(f.select("url_hash"), f.select("url_hash"))
    assert seen.filter("maybe").count() == 5


def test_domain_memory(spark):
    log = spark.createDataFrame([("d", 1, True, "browser"), ("d", 2, False, "x"), ("d", 3, False, "x"), ("e", 1, True, "requests"), ("f", 1, False, "x")], "k string, at int, ok boolean, mode string")
    m = memory.domain_memory(log, "k", ["at"], F.col("ok"), F.col("mode"), F.col("at"))
    assert {r["key"]: (r["preferred_mode"], r["success_streak"], r["fail_streak"]) for r in m.collect()} == {"d": ("browser", 0, 2), "e": ("requests", 1, 0), "f": (None, 0, 1)}
    hits = memory.lookup(m, spark.createDataFrame([("d",), ("f",), ("g",)], "k string"), "k", 10.0)
    assert {r["k"]: r["hit"] for r in hits.collect()} == {"d": True, "f": False, "g": False}


def test_streaks_of_a_key_over_many_ranges(spark):
    marks = "TTFFFTFTTTTTFFFFFFTT" * 5
    rows = [("hot", i, c == "T") for i, c in enumerate(marks)] + [("b", 1, False), (None, 1, True), (None, 2, True)]
    got = {(r["k"], r["at"]): (r["success_streak"], r["fail_streak"]) for r in memory.streaks(spark.createDataFrame(rows, "k string, at int, ok boolean"), "k", ["at"], F.col("ok")).collect()}
    s = f = 0
    for i, c in enumerate(marks):
        s, f = (s + 1, 0) if c == "T" else (0, f + 1)
        assert got[("hot", i)] == (s, f), i
    assert got[("b", 1)] == (0, 1) and got[(None, 2)] == (2, 0)


def test_proxy_health(spark):
    log = spark.createDataFrame([("p", i, c == "T") for i, c in enumerate("FFTFFTFFTF")], "k string, at int, ok boolean")
    last = memory.recent_rates(log, "k", ["at"], F.col("ok")).orderBy(F.desc("at")).first()
    assert last["disabled"] and round(last["rate"], 1) == 0.3 and last["penalty"] == 420


def test_cache(spark):
    entries = spark.createDataFrame([(i, 10) for i in range(100)], "at int, size int")
    assert sorted(r["at"] for r in memory.prune_cache(entries, "size", ["at"], 500).collect()) == list(range(55, 100))
    assert memory.prune_cache(entries, "size", ["at"], 5000).count() == 100


# ------------------------------------------------------------------ profiles and scores


def test_profile(spark):
    rows = [(0, "film", "A", "12", "2024-01-01", "http://x/1"), (1, "music", "B", "7", "2024-02-01", "http://x/2")]
    df = spark.createDataFrame(rows, "pos int, category string, title string, heat string, release_date string, url string")
    p = profile.payload(df, "d", "pos")
    roles = {f["name"]: f["role"] for f in p["schema"]["fields"]}
    assert (roles["category"], roles["heat"], roles["url"]) == ("dimension", "metric", "metadata")
    assert p["suggested_charts"][0]["type"] == "bar" and profile.validate_payload(p)["status"] == "ok" and p["quality"]["duplicate_rate"] == 0
    assert profile.validate_payload({"version": "1.0"})["status"] == "fail"


def test_field_quality(spark):
    samples = [("k", i, {"title": f"A product title {i}", "price": f"${i}9.99", "image_src": f"/i/{i}.jpg", "body": "a long text " * 12}) for i in range(2)]
    df = spark.createDataFrame(samples, "key string, pos int, values map<string,string>")
    q = score.field_quality(df, {"title": "h1", "price": "span.price", "image_src": "img@src", "body": "div.description", "sku": ""}, site_type="ecommerce")
    by = {r["field"]: r for r in q.collect()}
    assert by["title"]["grade"] == "A" and by["price"]["score"] == 0.93 and by["sku"]["risks"] == ["missing_selector", "empty_values"] and "ecommerce_field_review" in by["price"]["checks"]
    assert score.quality_report(q.filter("field <> 'sku'")).first()["overall_grade"] in "AB"


def test_response_scores(spark):
    good = '<script type="application/ld+json">{"@type":"JobPosting"}</script>' + "x" * 600
    r = spark.createDataFrame([(0, good), (1, '<div class="cf-challenge">captcha</div>')], "k int, h string").select("k", score.response_score(F.col("h")).alias("s"))
    s = dict(values(r))
    assert s[0] > 200 > 0 > s[1]


# ------------------------------------------------------------------ pages


def test_selectors():
    root = dom.parse('<div id="m"><ul class="a b"><li>1<li class=x>2</ul><p data-k="v-1">t<b>u</b></p></div>')
    pick = lambda s: dom.values(root, s)
    assert pick("li.x::text") == ["2"] and pick("#m > ul.a.b")[0].startswith("1") and pick('p[data-k^="v"]@data-k') == ["v-1"] and pick("ul ~ p b") == ["u"] and pick("li:nth-of-type(2).x") == ["2"] and pick("li li") == [] and pick("b, li.x") == ["2", "u"] and pick("p:not(.q)::attr(data-k)") == ["v-1"]
    with pytest.raises(ValueError):
        dom.compile_selector("a{")
    b = dom.select(root, "b")[0]
    assert dom.path(b) == "#m > p > b" and dom.select(root, dom.path(b)) == [b]


def test_links_and_fields(shop):
    got = values(extract.links(shop.filter(F.col("url") == f"{H}/products"), "article.product-card").select("link", "text"))
    assert [g[0] for g in got] == [f"{H}/p/1", f"{H}/p/2"]
    f = extract.fields_of(shop.filter(F.col("url") == f"{H}/p/1"), {"title": "h1", "image": "img@src", "none": "i"}).first()["fields"]
    assert f == {"title": ["Local Product"], "image": [f"{H}/images/x.jpg"], "none": []}


def test_selector_inference(shop):
    top = {(r["url"], r["field"]): r["selector"] for r in extract.selector_candidates(shop, ["link", "price", "image", "title"], most=1).collect()}
    assert top[(f"{H}/products", "link")] == "a.product-item-link@href" and top[(f"{H}/products", "price")] == "span.price" and top[(f"{H}/products", "image")].startswith("img.product-image-photo@")
    spec = {r["field"]: r for r in report.site_spec(shop.filter(F.col("url").contains("/p/")), ["title", "price", "image"]).collect()}
    assert spec["title"]["selector"].startswith("h1.") and spec["price"]["confidence"] == 1.0


def test_hints_pagination_states(spark, shop):
    hints = [r["hint"] for r in extract.api_hints(shop.filter(F.col("url") == f"{H}/api")).orderBy("pos").collect()]
    assert f"{H}/api/catalog/products?page=1&limit=24" in hints and f"{H}/graphql" in hints
    best = extract.pagination(shop.filter(F.col("url") == f"{H}/products")).filter("rank = 0").first()
    assert (best["kind"], best["next"], best["params"]) == ("rel_next", f"{H}/products?page=2", {"page": "2"})
    page = '<script>window.__INITIAL_STATE__={"products":[{"url":"/products/sku-1.html"},{"u":"}\\""}]};</script><script type="application/ld+json">[{"@graph":[{"@type":"JobPosting"}]}]</script><meta property="og:title" content="T">'
    df = spark.createDataFrame([("u", page)], "url string, html string")
    assert extract.states(df).filter("state_name = '__INITIAL_STATE__'").select(F.variant_get("data", "$.products[0].url", "string")).first()[0] == "/products/sku-1.html"
    s = extract.structured_data(df).first()["structured"]
    assert json.loads(s["jsonld"][0])["@type"] == "JobPosting" and s["meta"] == {"og:title": "T"}
    assert [r["link"] for r in extract.script_urls(df).collect()] == ["/products/sku-1.html"]
    shell = spark.createDataFrame([("u", '<div id="app"></div>' + "<script src=x></script>" * 10)], "url string, html string")
    assert "js_rendering_likely_required" in report.analyze(shell).first()["findings"]


def test_elements_relocate_similar(spark, shop):
    e = extract.elements(shop.filter(F.col("url") == f"{H}/products"))
    cards = e.filter("tag = 'article'")
    assert cards.count() == 2 and e.join(cards.select(F.col("node_id").alias("parent_id")), "parent_id").count() == 6
    kept = dom.fingerprint(dom.select(dom.parse(PRODUCTS), "span.price")[0])
    moved = spark.createDataFrame([("u", PRODUCTS.replace("<article", "<section").replace("</article", "</section"))], "url string, html string")
    assert "$19.99" in [r["text"] for r in relocate.relocate(moved, kept).collect()]
    assert [r["text"] for r in extract.find_similar(shop.filter(F.col("url") == f"{H}/products"), "span.price").collect()] == ["$29.99"]


# ------------------------------------------------------------------ JSON, trees, sitemaps


def test_json_shapes(spark):
    good = {"items": [{"title": "API Product", "price": 19.99}], "page": 1, "limit": 24}
    df = spark.createDataFrame([("a", json.dumps(good)), ("b", "[1"), ("c", None)], "k string, j string")
    m = {r["k"]: r for r in jsonshape.api_models(df, "j", "k").collect()}
    assert m["a"]["path"] == "items" and m["a"]["n_fields"] == 3 and m["a"]["has_pagination"] and m["b"]["path"] is None
    w = jsonshape.nodes(df, "j")
    inside = w.filter(F.col("path").startswith("items[0]."))
    assert {r["field"]: r["path"] for r in jsonshape.field_paths(inside, "k").collect()} == {"title": "items[0].title", "price": "items[0].price", "description": "items[0].title"}


def test_path_dialects(spark):
    data = {"data": {"items": [{"title": "T1"}, {"title": "T2"}]}}
    assert jsonshape.at_a(data, "data.items[0].title") == "T1" and jsonshape.at_a(data, "data.items[*].title") == ["T1", "T2"] and jsonshape.at_a(data, "data.items.0.title") is None
    assert jsonshape.at_b(data, "$") == data and jsonshape.at_c(data, "data.items.0.title") == ["T1"] and len(jsonshape.at_c(data, "data.items")) == 2 and jsonshape.at_d(data, "data.items.1.title") == "T2"
    with pytest.raises(KeyError):
        jsonshape.at_d(data, "data.items[0]")
    df = spark.createDataFrame([(json.dumps(data),), ("{",)], "j string")
    assert values(df.select(jsonshape.json_path(F.col("j"), "data.items[1].title"), jsonshape.variant_path(F.col("j"), "data.items[0].title"))) == [('"T2"', "T1"), (None, None)]


MENU = [
    {"title": "Women", "children": [{"title": "Dresses", "url": "/cat/dresses"}, {"title": "Hidden", "url": "/h", "hidden": True}, {"title": "Blog", "url": "/blog/x", "contentPage": True}, {"title": "External", "url": "http://x", "externalLink": True}, {"title": "Dresses", "url": "/cat/dresses"}], "url": "/women"},
    {"title": "Sale", "url": "/sale"},
]


def test_menus(spark):
    rows = jsonshape.menus(spark.createDataFrame([("m", json.dumps(MENU))], "k string, j string"), "j", H)
    reasons = {r["reason"]: r["n"] for r in rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert reasons == {"": 3, "hidden": 1, "contentPage": 1, "externalLink": 1, "duplicate": 1}
    kept = rows.filter("reason = ''")
    p = tree.menu_profile(kept, H, 4).first()
    assert p["max_depth"] == 2 and p["url_coverage"] == 1.0 and "hierarchical" in p["signals"] and 0 <= p["business_score"] <= 100
    assert {r["title"]: r["path"] for r in tree.menu_entries(kept).collect()} == {"Women": "Women", "Dresses": "Women > Dresses", "Sale": "Sale"}


def test_category_tree(spark):
    cats = spark.createDataFrame([(f"{H}{p}",) for p in ("/health/", "/health/vitamins/", "/health/vitamins/d3/", "/empty/category/", "/advies/editorial/")], "url string")
    prods = spark.createDataFrame([(f"{H}/health/vitamins/d3/product-1.html",), (f"{H}/health/vitamins/product-2.html",)], "url string")
    pre = tree.product_prefixes(prods)
    assert sorted("/".join(r["parts"]) for r in pre.collect()) == ["health", "health/vitamins", "health/vitamins/d3"]
    kept = tree.with_products(tree.category_paths(cats), pre)
    nested = tree.render_tree(tree.category_tree(kept, H))
    assert nested == [{"name": "Health", "url": f"{H}/health/", "children": [{"name": "Vitamins", "url": f"{H}/health/vitamins/", "children": [{"name": "D3", "url": f"{H}/health/vitamins/d3/"}]}]}]


NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def test_sitemaps(spark):
    index = f"<?xml version='1.0'?><sitemapindex {NS}><sitemap><loc>{H}/sitemap-category.xml</loc></sitemap><sitemap><loc> {H}/sitemap-product.xml </loc></sitemap></sitemapindex>"
    cat = f"<urlset {NS}><url><loc>{H}/a/?x=1&amp;y=2</loc><lastmod>2026-05-03</lastmod></url><url><loc>{H}/b/</loc></url></urlset>"
    df = spark.createDataFrame([(f"{H}/sitemap.xml", index), (f"{H}/sitemap-category.xml", cat), (f"{H}/sitemap-product.xml", "<urlset><url><loc>broken")], "url string, body string")
    assert {r["kind"]: r["loc"] for r in sitemap.pick(sitemap.sources(df)).collect()} == {"category_candidate": f"{H}/sitemap-category.xml", "product_candidate": f"{H}/sitemap-product.xml"}
    got = sitemap.expand(df, spark.createDataFrame([(f"{H}/sitemap.xml",)], "url string"))
    assert sorted((r["loc"], r["lastmod"]) for r in got.collect()) == [(f"{H}/a/?x=1&y=2", "2026-05-03"), (f"{H}/b/", None)]
    assert sitemap.expand(df, spark.createDataFrame([(f"{H}/sitemap.xml",)], "url string"), 0).count() == 0
    zipped = spark.createDataFrame([(bytearray(gzip.compress(cat.encode())),), (bytearray(b"plain"),), (bytearray(b"\x1f\x8bxx"),)], "b binary")
    assert values(zipped.select(sitemap.decompress(F.col("b")))) == [(cat,), ("plain",), (None,)]


def test_robots(spark):
    body = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /blocked # no\nAllow: /blocked/open\nSitemap: http://h/s.xml"
    rules = sitemap.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"))
    u = spark.createDataFrame([("http://h/blocked/x",), ("http://h/blocked/open/1",), ("http://h/",), ("http://i/blocked",)], "url string")
    assert dict(values(sitemap.allowed(u, rules).select("url", "can_fetch"))) == {"http://h/blocked/x": False, "http://h/blocked/open/1": True, "http://h/": True, "http://i/blocked": True}
    assert spark.createDataFrame([(body,)], "b string").select(sitemap.robots_sitemaps(F.col("b"))).first()[0] == ["http://h/s.xml"]


def test_reading_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿title,price\nA,1\n\"B, b\",2\n", encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"data": {"records": [{"t": 1}, {"t": 2}]}}))
    (tmp_path / "c.jsonl").write_text('{"t":1}\n{"t":2}\n')
    assert values(records.read_records(spark, str(tmp_path / "a.csv"))) == [("A", "1"), ("B, b", "2")]
    assert records.read_records(spark, str(tmp_path / "b.json")).count() == 2 and records.read_records(spark, str(tmp_path / "c.jsonl")).count() == 2
    (tmp_path / "e.json").write_text('{"event":"fetch","domain":"d"}\nnot json\n')
    assert records.read_events(spark, str(tmp_path / "e.json")).count() == 1
    df = spark.createDataFrame([('["a","b"]',), ('{"urls":["c"]}',), ("d, e\nf",)], "t string")
    assert values(df.select(records.candidate_urls(F.col("t")))) == [(["a", "b"],), (["c"],), (["d", "e", "f"],)]


# ------------------------------------------------------------------ plans


def test_pipeline(spark, shop):
    s = store.Store(spark, new_path(spark, "store"))
    spec = {"steps": [{"step": "crawl_list", "url": "{{start}}", "selector": "a.product-item-link", "max_items": "{{n}}"}, {"step": "frontier_add"}, {"step": "frontier_next", "limit": 10}, {"step": "crawl_products", "fields": {"title": "h1", "price": ".price", "none": "i"}}, {"step": "filter", "condition": "price > 20"}, {"step": "save", "db": "d", "table": "t"}]}
    state = pipeline.Pipeline.from_json(json.dumps(spec), {"start": f"{H}/products", "n": 5}).run(spark, landed.LandedPages(shop), s, now=1.0)
    assert state.results == [{"step": "save", "db": "d", "table": "t", "saved": 1, "skipped": 0, "errors": 0}]
    row = s.table("d", "t").first()
    assert (row["url"], row["title"], row["price"], row["none"]) == (f"{H}/p/2", "Local Product", "$29.99", "")
    assert dict(values(frontier.status_counts(state.frontier))) == {"running": 2}
    with pytest.raises(ValueError):
        pipeline.Pipeline({"steps": [{"step": "nothing"}]})
    t = pipeline.Templates(spark, new_path(spark, "templates"))
    t.save("a", spec, now=1.0)
    t.save("a", spec, "newer", now=2.0)
    assert values(t.list().select("name", "versions", "description", "variables")) == [("a", 2, "newer", ["n", "start"])] and t.get("a", {"start": H, "n": 1}).spec["steps"][0]["max_items"] == 1
    lists = pipeline.from_plan({"start_url": H, "list_selector": "a", "category_urls": [f"{H}/products", f"{H}/products?page=2"], "fields": {"t": "h1"}, "output": "none"})
    got = pipeline.Pipeline(lists).run(spark, landed.LandedPages(shop), now=1.0)
    assert lists["steps"][0]["step"] == "crawl_lists" and got.records.count() == 4


def test_crawl(spark, shop):
    spec = spider.CrawlSpec.parse({"start_urls": [f"{H}/products"], "deny": [r"/api"], "allowed_domains": ["shop.example"], "max_depth": 2, "selector": "a"})
    reached = spider.crawl(shop, spec)
    assert {r["url"].removeprefix(H): r["depth"] for r in reached.collect()} == {"/products": 0, "/p/1": 1, "/p/2": 1, "/products?page=2": 1, "/p/3": 2}
    got = spider.items(shop, reached, {"title": "h1", "price": ".price"}, ("title",))
    assert got.count() == 3


def test_site_model(shop):
    m = report.site_model(shop, "products", ["title", "price"])
    assert m["selectors"]["price"] == "span.price" and m["api_hints"] and "| shop.example |" in report.markdown(m)


def test_landed_pages(spark, shop):
    got = landed.LandedPages(shop).fetch(spark.createDataFrame([(f"{H}/p/1#x",), (f"{H}/none",)], "url string"))
    assert dict(values(got.select("url", "ok"))) == {f"{H}/p/1#x": True, f"{H}/none": False}


# ------------------------------------------------------------------ streams


def test_streams(spark, tmp_path):
    rows = [{"ts": f"2024-01-01T0{h}:{m:02}:00", "event": "fetch", "success": m != 30, "domain": "d", "url": f"HTTP://a/{h}"} for h in (1, 2, 5) for m in (0, 30, 45)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "ts timestamp, event string, success boolean, domain string, url string"
    batch = spark.read.schema(schema).json(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), schema)
    for n, f in enumerate((lambda d: streams.tumbling(d, "domain"), lambda d: streams.sliding(d), lambda d: streams.sessions(d, "domain"), streams.domain_failures, lambda d: streams.new_urls(d).select("url"))):
        mode = "append" if n == 4 else "complete" if n != 2 else "complete"
        q = f(stream).writeStream.format("memory").queryName(f"s{n}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(str, spark.table(f"s{n}").collect())) == sorted(map(str, f(batch).collect()))
    path = new_path(spark, "appended")
    for _ in range(2):
        streams.append_new(stream.select("url", F.lit(0).alias("pos")), path, str(tmp_path / f"cp{_}"), None).awaitTermination()
    assert spark.read.parquet(path).count() == 3


# ------------------------------------------------------------------ scans over ranges


def _log(spark, rows, parts=5):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    return spark.createDataFrame(rows, "k string, at int, ok boolean, t double, extra int"), before


@pytest.mark.parametrize("keys", [["hot"], ["a", "b", None], ["hot"] * 30 + ["x", "y", None]])
def test_scans_over_ranges_equal_windows(spark, keys):
    rng = random.Random(len(keys))
    rows = [(rng.choice(keys), i, rng.choice([True, True, False, None] if len(keys) == 3 else [True, False]), float(i // 3 + rng.randrange(20)), i % 3) for i in range(700)] + [("one", 1, False, 2.0, 0)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    log, before = _log(spark, rows, 23)
    try:
        rates = {(r["k"], r["at"]): r for r in memory.recent_rates(log, "k", ["at"], F.col("ok")).collect()}
        starts = {(r["k"], r["at"]): r["starts_at"] for r in memory.next_allowed(log, "k", ["at"], F.col("t"), F.lit(4) + F.col("extra")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rates) == len(starts) == len(rows)
    for key in set(keys) | {"one"}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        at, flags = None, []
        for r in own:
            at = r[3] if at is None else max(r[3], at + 4 + r[4])
            flags.append(r[2])
            near = [f for f in flags[-20:] if f is not None]
            got = rates[key, r[1]]
            assert (got["n_recent"], got["rate"], got["total_fail"] or 0) == (len(flags[-20:]), sum(near) / len(near) if near else None, flags.count(False))
            assert starts[key, r[1]] == at


def test_one_key_is_scanned_by_all_tasks(spark):
    rows = [("hot", i, i % 7 != 0, float(i), 0) for i in range(5000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    log, before = _log(spark, rows, 8)
    try:
        dealt = memory._deal(log, "k", ["at"], "attempts").groupBy("_pid").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 2 * 5000 / 8


def test_api_models_walk_each_text_once(spark):
    texts = [(1, '{"data": {"items": [{"title": "a", "price": 1.5, "id": 3}, {"title": "b"}], "page": 1}}'), (2, "[[1, 2], [3]]"), (3, "no json"), (4, '{"[0]": {"title": "t"}, "list": [{"[0]x": [{"name": "n"}]}]}')]
    got = jsonshape.api_models(spark.createDataFrame(texts, "k int, j string"), "j", "k")
    assert "Python" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["k"]: (r["path"], r["n_fields"], r["has_pagination"]) for r in got.collect()} == {1: ("data.items", 4, True), 2: ("$", 1, False), 3: (None, 0, False), 4: ("list[0][0]x", 2, False)}
