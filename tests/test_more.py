"""Requests handed out by number, bounds, limits that are off, and targets of an analysis."""

import pytest
from pyspark.sql import functions as F

from sluice.functions import text
from sluice.operators import extract, frontier
from sluice.plans import report, specs


def test_requests_are_numbered_as_they_are_handed_out(spark):
    rows = [(f"f{i % 40}", i, (i * 7) % 5, i % 11 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "fingerprint string, seq int, priority int, dont_filter boolean")
    got = [r["seq"] for r in frontier.hand_out(df).orderBy("n").collect()]
    assert got == [r["seq"] for r in frontier.dequeue_order(df).collect()]
    assert [r["n"] for r in frontier.hand_out(df).orderBy("n").select("n").collect()] == list(range(1, len(got) + 1))
    assert frontier.hand_out(df.limit(0)).count() == 0


def test_a_large_bloom_filter_is_not_broadcast(spark):
    keys = spark.createDataFrame([("a",)], "url_hash string")
    with pytest.raises(ValueError, match="too large"):
        frontier.bloom_maybe(keys, frontier.bloom(keys, bits=12), bits=frontier.MOST_BITS + 1)


def test_texts_are_whole_unless_a_limit_is_given(spark):
    df = spark.createDataFrame([("AI Agent " + "t" * 400, "agent " + "x" * 5000)], "title string, page string")
    said = df.select(text.clean_description(F.col("page")).alias("all"), text.clean_description(F.col("page"), 1200).alias("some"), text.generic_job(F.col("title"), F.col("page"), F.lit("u"), F.lit("c")).alias("job"), text.generic_job(F.col("title"), F.col("page"), F.lit("u"), F.lit("c"), 180, 1400, 3000).alias("cut")).first()
    assert len(said["all"]) == 5006 and len(said["some"]) == 1200
    assert len(said["job"]["title"]) == 409 and len(said["cut"]["title"]) == 180 and len(said["job"]["description"]) == 5006


def test_a_function_of_ones_own_changes_and_drops_links(spark):
    pages = spark.createDataFrame([(1, "http://h/", "<a href='/a'>A</a><a href='/b'>B</a><a href='/c'>C</a>")], "id int, url string, html string")
    got = extract.links(pages, process=lambda link: None if link.endswith("b") else link.upper()).orderBy("pos").collect()
    assert [(r["pos"], r["link"], r["text"]) for r in got] == [(0, "HTTP://H/A", "A"), (1, "HTTP://H/C", "C")]


def test_targets_and_interactions_of_hosts(spark):
    shop = "<html><body><h1>T{}</h1><a class=p href='/p/{}.html'>P</a><a rel=next href='?page=2'>next</a><script src='/api/x.json?page=2'></script></body></html>"
    rows = [(f"http://a.example/l{i}", shop.format(i, i)) for i in range(4)] + [("http://b.example/x", "<div class='cf-challenge'>captcha</div>"), (None, "<h1>x</h1>")]
    facts = report.site_facts(spark.createDataFrame(rows, "url string, html string"))
    got = {r["host"]: r for r in report.targets(facts, 5.0).collect()}
    assert set(got) == {"a.example", "b.example", None}
    a = got["a.example"]
    assert (a["pages"], a["pagination_type"], a["selectors"]["title"], a["selectors"]["link"], a["updated_at"]) == (4, "rel_next", "h1", "a.p@href", 5.0)
    assert got["b.example"]["preferred_mode"] == "browser" and a["preferred_mode"] == "requests"
    again = report.remember_targets(report.remember_targets(None, facts, 1.0), facts.filter("url LIKE '%a.example%'"), 2.0)
    assert {r["host"]: r["updated_at"] for r in again.collect() if r["host"]} == {"a.example": 2.0, "b.example": 1.0}
    acts = {(r["host"], r["action"]): (r["strategy"], len(r["samples"])) for r in report.interactions(facts).collect()}
    assert acts["a.example", "paginate"] == ("rel_next", 4) and acts["a.example", "network_pagination"][0] == "json"


def test_plan_faults_follow_the_schema():
    assert specs.plan_faults({"url": "ftp://x", "category_urls": "http://h/a", "fields": {"t": "h1"}, "urls": ["http://h/d"]}) == {"ok": False, "errors": ["invalid_start_url:ftp://x", "category_urls_must_be_array"], "warnings": []}
    assert specs.plan_risks({"category_urls": ["x"], "mode": "browser", "fields": {"a": "", "b": "h1"}}, truncated=True) == ["single_detail_fallback", "category_urls_without_menu_source", "browser_rendering_required", "html_truncated_likely", "missing_field_selectors:a"]


def test_a_bloom_filter_is_as_large_as_its_keys_ask_for(spark):
    keys = spark.range(60_000).selectExpr("cast(id as string) as url_hash", "id % 2 = 0 as even")
    bits = frontier.bloom_bits(30_000)
    stored = frontier.bloom_merge(*[frontier.bloom(keys.filter(f"even and url_hash % 4 = {k}"), bits=bits) for k in (0, 2)]).localCheckpoint()
    shares = {f.__name__: {r["even"]: r["s"] for r in f(keys, stored, bits=bits).groupBy("even").agg(F.avg(F.col("maybe").cast("double")).alias("s")).collect()} for f in (frontier.bloom_maybe, frontier.bloom_joined)}
    assert shares["bloom_maybe"] == shares["bloom_joined"] and shares["bloom_maybe"][True] == 1 and 0 < shares["bloom_maybe"][False] < 0.03
    assert [frontier.bloom_bits(n) for n in (0, 800_000, 3_000_000, 18_000_000)] == [15, 23, 25, 28]
    assert frontier.bloom_joined(spark.createDataFrame([(None,)], "url_hash string"), stored, bits=bits).first()["maybe"] is False


def test_pages_of_one_row_group_are_parsed_in_several_tasks(spark):
    pages = spark.range(200).selectExpr("concat('http://h', id % 3, '.example/', id) as url", "concat('<h1>', id, '</h1>') as html").coalesce(1)
    facts = report.site_facts(pages)
    assert facts.count() == 200 and len(facts.inputFiles()) > 1
