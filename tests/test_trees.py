"""Robots rules, category trees and menus against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sluice.operators import menus, tree
from sluice.sources import sitemap


def plain_match(rule, target):
    body, end = (rule[:-1], "$") if rule.endswith("$") else (rule, "")
    return re.match("(?s)" + ".*".join(map(re.escape, body.split("*"))) + (r"\Z" if end else ""), target) is not None


def plain_allowed(rules, target):
    met = [(len(rule), allow) for allow, rule in rules if rule and plain_match(rule, target)]
    return max(met)[1] if met else True


@pytest.mark.parametrize("limit", [8 << 20, -1])
def test_robots_equal_a_plain_matcher(spark, monkeypatch, limit):
    monkeypatch.setattr(sitemap, "BROADCAST_BYTES", limit)
    rng = random.Random(6)
    piece = lambda: "".join(rng.choice(["/", "a", "b", "*", "$", ".", "?q=1", "\\E", "é"]) for _ in range(rng.randrange(1, 6)))
    hosts = {f"h{i}.example": [(rng.random() < 0.5, "/" + piece()) for _ in range(rng.randrange(12))] for i in range(12)}
    hosts["ties.example"] = [(False, "/a"), (True, "/a"), (False, "/a*"), (True, "/b$"), (False, "/b"), (False, "*.pdf$"), (False, "/")]
    robots = [(h, "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {r}" for a, r in rules)) for h, rules in hosts.items()]
    targets = ["/", "/a", "/a/b", "/b", "/bc", "/a.pdf", "/x.pdf?q=1", "/x.pdf"] + ["/" + piece().replace("*", "x").replace("?q=1", "b") for _ in range(40)]
    urls = [(f"http://{h}{t}",) for h in [*hosts, "none.example"] for t in dict.fromkeys(targets)]
    got = {r["url"]: r["can_fetch"] for r in sitemap.allowed(spark.createDataFrame(urls + urls[:3] + [(None,)], "url string").distinct(), sitemap.robots_rules(spark.createDataFrame(robots, "host string, body string"))).collect()}
    parsed = {r["url"]: r["t"] for r in spark.createDataFrame(urls, "url string").select("url", F.concat(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("/")), F.coalesce(F.concat(F.lit("?"), F.try_parse_url("url", F.lit("QUERY"))), F.lit(""))).alias("t"), F.try_parse_url("url", F.lit("HOST")).alias("h")).filter("h is not null").collect()}
    assert len(parsed) > 300
    for url, target in parsed.items():
        host = url.split("/")[2]
        assert got[url] == plain_allowed(hosts.get(host, []), target or "/"), (url, hosts.get(host))


def test_ten_thousand_rules_of_one_host(spark):
    body = "User-agent: *\n" + "\n".join(f"Disallow: /p/{i}/\nAllow: /p/{i}/x*y$" for i in range(5000))
    rules = sitemap.robots_rules(spark.createDataFrame([("h.example", body)], "host string, body string"))
    urls = spark.range(20_000).selectExpr("concat('http://h.example/p/', id % 6000, '/', if(id % 3 = 0, 'x1y', 'z')) as url", "id")
    got = sitemap.allowed(urls, rules)
    assert rules.count() == 10_000
    assert got.filter(F.col("can_fetch") != ((F.col("id") % 6000 >= 5000) | (F.col("id") % 3 == 0))).count() == 0 and got.count() == 20_000


def test_urls_of_one_host_do_not_meet_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(sitemap, "BROADCAST_BYTES", 2000)
    rules = sitemap.robots_rules(spark.createDataFrame([("h.example", "User-agent: *\n" + "\n".join(f"Disallow: /p/{i}/" for i in range(200)))], "host string, body string"))
    urls = spark.range(1000).selectExpr("concat('http://h.example/p/', id, '/') as url", "id")
    got = sitemap.allowed(urls, rules)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ShuffledHashJoin \[_host#\d+, head#\d+\]", plan) and not re.search(r"SortMergeJoin \[_host#\d+\]", plan)
    assert got.filter(F.col("can_fetch") == (F.col("id") < 200)).count() == 0 and got.count() == 1000


def test_the_longest_name_of_an_agent_counts(spark):
    body = "User-agent: *\nDisallow: /\n\nUser-agent: bot\nUser-agent: other\nDisallow: /b\n\nUser-agent: goodbot\nDisallow: /g"
    df = spark.createDataFrame([("h", body), ("i", "User-agent: bot\nDisallow: /x\nUser-agent: *\nDisallow: /y")], "host string, body string")
    rules = lambda agent: {tuple(r) for r in sitemap.robots_rules(df, agent).select("host", "prefix").collect()}
    assert rules("GoodBot/2.1") == {("h", "/g"), ("i", "/x")} and rules("badbot") == {("h", "/b"), ("i", "/x")} and rules("*") == {("h", "/"), ("i", "/y")}


# ------------------------------------------------------------------ category trees


def test_subtree_counts_and_folding(spark):
    rng = random.Random(3)
    paths = [tuple(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 6]))) for _ in range(400)] + [tuple(f"d{i}" for i in range(40))] * 2
    df = spark.createDataFrame([(list(p),) for p in paths] + [([],)], "parts array<string>")
    nodes = {p[:k] for p in paths for k in range(1, len(p) + 1)}
    got = {tuple(r["parts"]): (r["depth"], r["own"], r["total"], r["nodes"], r["children"]) for r in tree.subtree_counts(df).collect()}
    assert got == {n: (len(n), paths.count(n), sum(p[: len(n)] == n for p in paths), sum(m[: len(n)] == n for m in nodes), sum(m[:-1] == n for m in nodes)) for n in nodes}
    for least in (1, 3, 40):
        own = {n: paths.count(n) for n in nodes}
        for n in sorted(nodes, key=len, reverse=True):
            if len(n) > 1 and own[n] < least and not any(m[:-1] == n for m in own):
                own[n[:-1]] += own.pop(n)
        folded = {tuple(r["parts"]): r["own"] for r in tree.fold_small(tree.subtree_counts(df), least).collect()}
        assert folded == own and sum(folded.values()) == len(paths)


# ------------------------------------------------------------------ menus


def rows_of(site, roots):
    """Trees of (title, url, children) as rows; ids in order of visiting."""
    out = []

    def add(items, parent):
        for pos, (title, url, kids) in enumerate(items):
            node = f"{site}{len(out)}"
            out.append((site, node, parent, pos, title, url))
            add(kids, node)

    add(roots, None)
    return out


def plain_compare(a, b):
    size = lambda t: 1 + sum(map(size, t[2]))
    low = lambda t: ((t[0] or "").strip().lower(), (t[1] or "").strip(), tuple(map(low, t[2])))
    a, b = [low(t) for t in a], [low(t) for t in b]
    rows, lost, new = [], [], []

    def pair(x, y, at, to):
        x, y = [(k, t) for k, t in enumerate(x)], [(k, t) for k, t in enumerate(y)]
        name = lambda trail, t: f"{trail} > {t[0]}" if trail is not None else t[0]
        for key, kind in ((lambda t: t[:2], "met"), (lambda t: t[1], "renamed")):
            for one in list(x):
                other = next((o for o in y if key(o[1]) == key(one[1]) and (kind == "met" or o[1][1])), None)
                if other is None:
                    continue
                x.remove(one)
                y.remove(other)
                s, t = one[1], other[1]
                if kind == "met" and s == t:
                    rows.append(("same", name(at, s), name(to, t), size(s)))
                else:
                    rows.append(("changed" if kind == "met" else "renamed", name(at, s), name(to, t), 1))
                    todo.append((s[2], t[2], name(at, s), name(to, t)))
        lost.extend((name(at, t), t) for _, t in x)
        new.extend((name(to, t), t) for _, t in y)

    todo = [(a, b, None, None)]
    while todo:
        pair(*todo.pop(0))
    kinds = {}
    for path, t in lost:
        kinds.setdefault(t, ([], []))[0].append(path)
    for path, t in new:
        kinds.setdefault(t, ([], []))[1].append(path)
    summary = {}
    for t, (x, y) in kinds.items():
        n = min(len(x), len(y))
        for kind, k in (("moved", n), ("removed", len(x) - n), ("added", len(y) - n)):
            if k:
                summary[kind, size(t), t] = k
    return sorted(rows), summary, kinds


def random_menu(rng, depth=4):
    return [(rng.choice(["Women", "Men", "Sale ", "new", "", None]), rng.choice(["/a", "/b", "/c", "", None]), random_menu(rng, depth - 1) if depth > 1 and rng.random() < 0.6 else []) for _ in range(rng.randrange(1, 4))]


def changed(rng, menu):
    out = []
    for title, url, kids in menu:
        p = rng.random()
        if p < 0.1:
            continue
        if p > 0.7 and kids:  # the first child moves up, as it is
            out += [(title, url, kids[1:]), kids[0]]
            continue
        out.append((title + "x" if p < 0.2 and title else title, url, changed(rng, kids)))
    if rng.random() < 0.2:
        out.append(("Added", "/n", []))
    rng.random() < 0.2 and out.reverse()
    return out


def test_menus_equal_a_plain_comparison(spark):
    rng = random.Random(12)
    sites = {f"s{i}.": (m := random_menu(rng), changed(rng, m)) for i in range(25)}
    sites["moved."] = ([("A", "/a", [("B", "/b", [("C", "/c", [])])]), ("D", "/d", [])], [("A", "/a", []), ("D", "/d", [("B", "/b", [("C", "/c", [])])])])
    sites["none."] = ([], [("A", "/a", [])])
    schema = "site string, node_id string, parent_id string, pos int, title string, url string"
    frames = [spark.createDataFrame([r for s, both in sites.items() for r in rows_of(s, both[k])] + [("lost", "x", "not there", 0, "T", "/t")], schema) for k in (0, 1)]
    got = {}
    for r in menus.compare(*frames).collect():
        got.setdefault(r["site"], []).append(tuple(r)[1:])
    moved = 0
    for site, (a, b) in sites.items():
        rows, summary, kinds = plain_compare(a, b)
        mine = got.get(site, [])
        assert sorted(r for r in mine if r[0] in ("same", "changed", "renamed")) == rows, site
        for change in ("moved", "removed", "added"):
            own = [r for r in mine if r[0] == change]
            assert sum(k for (kind, *_), k in summary.items() if kind == change) == len(own)
            assert sorted(r[3] for r in own) == sorted(n for (kind, n, _), k in summary.items() if kind == change for _ in range(k))
            moved += change == "moved" and len(own)
        paths = {p for x, y in kinds.values() for p in [*x, *y]}
        assert all((r[2] if r[1] is None else r[1]) in paths for r in mine if r[0] in ("moved", "removed", "added"))
    assert moved > 3 and ("moved", "a > b", "d > b", 2) in got["moved."] and got["none."] == [("added", None, "a", 1)]
    empty = frames[0].limit(0)
    assert menus.compare(empty, empty).count() == 0


# ------------------------------------------------------------------ JSON documents


def test_walks_have_no_limits_unless_given(spark):
    import json

    from sluice.operators import jsonshape

    deep = json.dumps({"a": list(range(40)), "b": {"c": {"d": {"e": {"f": {"g": {"h": {"i": {"j": {"k": "x" * 500}}}}}}}}}, "": 1})
    df = spark.createDataFrame([("d", deep), ("n", "[" * 100_000), ("bad", "{"), ("e", ""), (None, "3")], "k string, j string")
    rows = jsonshape.nodes(df, "j").collect()
    assert len([r for r in rows if r["path"].startswith("a[")]) == 40 and {len(r["value"]) for r in rows if r["leaf"] == "k"} == {500}
    assert [r["path"] for r in rows if r["k"] is None] == ["$"] and not [r for r in rows if r["k"] in ("n", "bad", "e")] and '""' in {r["path"] for r in rows}
    few = jsonshape.nodes(df, "j", most_depth=2, most_children=3, most_chars=4).collect()
    assert len([r for r in few if r["path"].startswith("a[")]) == 3 and max(r["path"].count(".") for r in few) == 1
    # Of equal scores the first of the document counts.
    two = jsonshape.nodes(spark.createDataFrame([("k", '{"name": "A", "headline": "B"}')], "k string, j string"), "j")
    assert [r["path"] for r in jsonshape.field_paths(two, "k").collect() if r["field"] == "title"] == ["name"]


def test_rounds_of_a_comparison_write_three_tables(spark, monkeypatch):
    written = []
    monkeypatch.setattr(menus, "write_out", lambda df, name, real=menus.write_out: (written.append(name), real(df, name))[1])
    row = lambda node, parent, pos, title, url: ("s", node, parent, pos, title, url)
    kind = "site string, node_id string, parent_id string, pos long, title string, url string"
    one = [row("a", None, 0, "A", "/a"), row("b", "a", 0, "B", "/b"), row("c", "a", 1, "C", "/c"), row("x", "a", 2, "X", ""), row("m", "b", 0, "M", "/m")]
    other = [row("a", None, 0, "A", "/a"), row("b", "a", 0, "New B", "/b"), row("y", "a", 1, "Y", ""), row("m", "a", 2, "M", "/m")]
    got = {tuple(r) for r in menus.compare(spark.createDataFrame(one, kind), spark.createDataFrame(other, kind)).select("change", "one_path", "other_path", "nodes").collect()}
    assert got == {("changed", "a", "a", 1), ("renamed", "a > b", "a > new b", 1), ("removed", "a > c", None, 1), ("removed", "a > x", None, 1), ("added", None, "a > y", 1), ("moved", "a > b > m", "a > m", 1)}
    assert {n: written.count(n) for n in ("menu-pairs", "menu-met", "menu-renamed")} == {"menu-pairs": 3, "menu-met": 3, "menu-renamed": 3}
    assert not {"menu-tree", "menu-rest", "menu-alone"} & set(written)


def test_api_models_read_all_items(spark):
    import json
    import random

    from sluice.operators import jsonshape

    late = [{"sku_code": "x"}] * 12 + [{"Title": "T", "price": 2.5}, {"image": "/i.png", "deep": [{"link": "/u"}]}]
    docs = [("late", json.dumps({"rows": late})), ("first", json.dumps({"rows": [1, {"price": 1}]})), ("two", '{"rows": [{"id": true}]}'), ("two", '{"rows": [{"image": true}]}'), ("a", '{"a": [{"id": true}], "a[0]x": {"price": 1}}'), (None, '{"rows": [{"id": true}]}'), ("bad", "["), ("none", None)]
    got = {r["k"]: r for r in jsonshape.api_models(spark.createDataFrame(docs, "k string, j string"), "j", "k").collect()}
    # Keys and fields that only later items have: titles (with descriptions, as texts), prices, images and URLs, beside ids.
    assert (got["late"]["path"], got["late"]["score"], got["late"]["n_fields"]) == ("rows", 42 + 30 + 8 * 3, 6)
    assert (got["first"]["score"], got["first"]["n_fields"]) == (6 + 30 + 8, 1)
    assert got["two"]["n_fields"] == 2 and got["a"]["n_fields"] == 1 and got[None]["path"] == "rows" and got["bad"]["path"] is got["none"]["path"] is None
    # The same by the parts on nodes.
    rnd = random.Random(4)
    make = lambda d: rnd.choice([1, 2.5, "t", "/p", "1.99", None, True]) if d == 0 or rnd.random() < 0.2 else [make(d - 1) for _ in range(rnd.randint(0, 14))] if rnd.random() < 0.5 else {rnd.choice(["title", "sku", "x", "Page_no", "items", "img-url", "a"]): make(d - 1) for _ in range(3)}
    df = spark.createDataFrame([(i, json.dumps(make(4))) for i in range(150)], "k int, j string")
    walked = jsonshape.nodes(df, "j").cache()
    best = {r["k"]: (r["path"], r["score"]) for r in jsonshape.item_arrays(walked, "k").collect()}
    top = spark.createDataFrame([(k, "[" if p == "$" else p + "[") for k, (p, _) in best.items()], "k int, top string")
    fields = {r["k"]: r["count"] for r in jsonshape.field_paths(walked.join(top, "k").filter("startswith(path, top)").drop("top"), "k").groupBy("k").count().collect()}
    paged = {r["k"] for r in jsonshape.pagination_keys(walked, "k").collect()}
    walked.unpersist()
    got = {r["k"]: (r["path"], r["score"], r["n_fields"], r["has_pagination"]) for r in jsonshape.api_models(df, "j", "k").collect()}
    assert len(best) > 50 and got == {i: (*best.get(i, (None, None)), fields.get(i, 0), i in paged) for i in range(150)}
