"""One reading of a page gives what single readings give."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import dom, extract, fused
from sluice.plans import diagnose, report, specs
from tests.conftest import SF


@pytest.fixture(scope="module")
def pages(spark):
    own = [
        ("http://s.example/a?page=3", '<html><body><a href="/p/1">One</a><a rel=next href="?page=4">next</a><h1>T</h1><span class=price>$5</span><script src="/api/x.json"></script></body></html>'),
        ("http://s.example/b", None), ("http://s.example/c", ""), (None, "<a href='/x'>rel</a>"), ("http://s.example/d", '<div id=app></div><script>var u="/p/9.html"</script>'), ("http://s.example/e", "<a href='javascript:x'>no</a>"),
    ]
    return spark.read.parquet(f"{SF}/pages.parquet").select("url", "html").limit(40).unionByName(spark.createDataFrame(own, "url string, html string")).repartition(4)


def test_equals_single_readings(spark, pages):
    wanted = {"text": fused.TEXT, "links": fused.links(), "hints": fused.HINTS, "paging": fused.PAGINATION, "n": fused.n_links("a"), "titles": fused.values("h1"), "signals": fused.SIGNALS, "c": fused.candidates(["title", "price", "link"], 2)}
    rows = fused.read(pages, wanted).collect()
    assert len(rows) == pages.count()
    for r in rows:
        root = dom.parse(r["html"])
        assert r["text"] == root.text("\n", True, dom.HIDDEN)
        assert [x.asDict() for x in r["links"]] == extract.links_in(root, "a[href]", r["url"])
        assert [x.asDict() for x in r["hints"]] == extract.hints_of(r["html"], r["url"])
        assert [x["next"] for x in r["paging"]] == [x["next"] for x in extract.pagination_of(r["html"], r["url"] or "")]
        assert r["n"] == len(extract.links_in(root, "a", r["url"])) and r["titles"] == dom.values(root, "h1", " ")
        assert r["signals"].asDict() == extract.signals_in(r["html"], root)
        for f in ("title", "price", "link"):
            assert [x["selector"] for x in r["c"] if x["field"] == f] == [x[0] for x in extract.candidates_of(r["html"], r["url"] or "", f)[:2]]


def test_a_page_is_parsed_once(pages, monkeypatch):
    parsed = []
    monkeypatch.setattr(dom, "parse", lambda source, f=dom.parse: parsed.append(source) or f(source))
    page = fused.Page("<a href='/x'>y</a>", "http://h/")
    for x in (fused.TEXT, fused.links(), fused.HINTS, fused.N_HINTS, fused.PAGINATION, fused.SIGNALS, fused.candidates(["title", "link"])):
        x.of(page)
    assert len(parsed) == 1


@pytest.mark.parametrize("made", [lambda p: diagnose.diagnose(p, "a.product"), lambda p: specs.zero_links(p, "a.product"), lambda p: report.analyze(p), lambda p: extract.selector_candidates(p, ["title", "price", "link"])])
def test_plans_have_one_python_node_and_no_join(pages, made):
    plan = made(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan


def test_zero_links(pages):
    got = {r["url"]: (r["html_chars"], r["anchors"], r["script_urls"]) for r in specs.zero_links(pages.filter("url LIKE '%s.example%' OR url IS NULL"), "a.product").collect()}
    assert got[None] == (20, 1, 0) and got["http://s.example/b"] == (0, 0, 0) and got["http://s.example/d"][1:] == (0, 1)
    assert specs.zero_links(pages, "a").filter(F.col("url").startswith("http://s.example/a")).count() == 0


def test_site_model_reads_pages_once(spark, pages):
    model = report.site_model(pages.filter("url LIKE '%s.example%'"), "shop", ["title", "price"])
    assert model["selectors"]["price"] == "span.price" and model["pagination"] == "page_param_guess" or model["pagination"]
    assert model["hosts"][0]["host"] == "s.example" and model["hosts"][0]["pages"] == 5 and model["api_hints"][0]["hint"] == "http://s.example/api/x.json"
