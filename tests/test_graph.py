"""Crawls over a stored link graph against a plain breadth-first search."""

import random
import re
import shutil

import pytest

from sluice.operators import graph
from sluice.plans.spider import CrawlSpec, crawl
from sluice.session import new_path

H = "http://h.example"


def page(targets):
    return "<html><body>" + "".join(f'<a href="{t}">x</a>' for t in targets) + "</body></html>"


def plain(pages, starts, depth):
    """pages: url -> targets. (url -> depth)"""
    seen, level = {u: 0 for u in starts}, list(starts)
    for d in range(1, depth + 1):
        level = [t for u in level for t in pages.get(u, ()) if t not in seen]
        seen |= dict.fromkeys(level, d)
        level = list(dict.fromkeys(level))
    return seen


@pytest.fixture(scope="module")
def site(spark):
    rng = random.Random(9)
    pages = {f"{H}/{i}": [f"{H}/{rng.randrange(400)}" for _ in range(rng.choice([0, 1, 2, 3, 30]))] for i in range(250)}
    pages[f"{H}/0"] = [f"{H}/{i}" for i in range(5)] * 3 + [f"{H}/0"]
    return pages, spark.createDataFrame([(u, page(t)) for u, t in pages.items()] + [(None, page([H])), ("no url", page([f"{H}/1"]))], "url string, html string").repartition(3)


@pytest.mark.parametrize("depth", [0, 1, 4, 50])
def test_crawl_equals_a_plain_search(spark, site, depth):
    pages, df = site
    got = {r["url"]: (r["depth"], r["found"]) for r in crawl(df, CrawlSpec([f"{H}/0", f"{H}/0#x", "none", f"{H}/nowhere"], max_depth=depth)).collect()}
    assert got == {u: (d, u in pages) for u, d in plain(pages, [f"{H}/0", f"{H}/nowhere"], depth).items()}


def test_a_round_shuffles_the_targets_alone(spark, site):
    _, df = site
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = graph.page_graph(df, "a[href]", lambda x: x, spark.createDataFrame([(f"{H}/0",)], "name string"))
        levels = g.levels(spark.createDataFrame([(f"{H}/0",)], "name string"), 2)
        plan = g.following(levels[-1], levels)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "html" not in plan and plan.count("SortMergeJoin") == 4


def test_a_stopped_crawl_goes_on_without_its_pages(spark, site, tmp_path):
    pages, df = site
    start = CrawlSpec([f"{H}/0"], max_depth=1)
    folder = graph.Folder(spark, str(tmp_path / "state"))
    first = {r["url"]: r["depth"] for r in crawl(df, start, folder).collect()}
    assert first == plain(pages, [f"{H}/0"], 1)
    crawl(df, CrawlSpec([f"{H}/0"], max_depth=3), folder).count()
    # The last level lacks its mark, as if its writer had been stopped.
    (tmp_path / "state" / "level-3" / "_SUCCESS").unlink()
    none = spark.createDataFrame([], "url string, html string")
    again = {r["url"]: r["depth"] for r in crawl(none, CrawlSpec([f"{H}/0"], max_depth=6), folder).collect()}
    assert again == plain(pages, [f"{H}/0"], 6)
    # Without names the graph isn't whole: it is built again, here from nothing.
    shutil.rmtree(next((tmp_path / "state").glob("names-*")))
    assert graph.LinkGraph.opened(folder) is None


def test_pages_landed_twice_and_rules(spark):
    rows = [(f"{H}/a#1", page([f"{H}/old"])), (f"{H}/a", page([f"{H}/z", "/rel?b=1#frag", "mailto:x@y", "javascript:x"])), ("HTTP://H.example/a", page([f"{H}/b"])), (f"{H}/a#2", None), (f"{H}/z", page(["http://other.example/x", f"{H}/no"]))]
    df = spark.createDataFrame(rows, "url string, html string")
    greatest = max(h for _, h in rows[:3])
    want = {f"{H}/a"} | ({f"{H}/z", f"{H}/rel?b=1"} if "/z" in greatest else {f"{H}/old"})
    got = {r["url"] for r in crawl(df, CrawlSpec([f"{H}/a"], max_depth=1)).collect()}
    assert got == want
    spec = CrawlSpec([f"{H}/z"], rules=[("other", "o"), ("/no$", "n")], deny=("/no",), max_depth=3)
    assert {r["url"]: r["found"] for r in crawl(df, spec).collect()} == {f"{H}/z": True, "http://other.example/x": False}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "url string, html string")
    assert crawl(none, CrawlSpec(none.select("url"))).count() == 0
    assert [tuple(r) for r in crawl(none, CrawlSpec([f"{H}/q"])).collect()] == [(f"{H}/q", 0, False)]
