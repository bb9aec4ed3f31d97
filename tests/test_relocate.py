"""Relocation of many stored elements against scoring all elements of all pages."""

import json
import random

import pytest

from sluice.operators import dom, relocate

TAGS, CLASSES = ["div", "span", "p", "a", "li", "section"], ["price", "title new", "card", "", "x"]


def random_page(rng, depth=4):
    def part(d):
        if d == 0 or rng.random() < 0.2:
            return rng.choice(["$19.99", "A title", "Read more", "", "longer text of some words"])
        tag = rng.choice(TAGS)
        attrs = "".join(f' {k}="{v}"' for k, v in (("class", rng.choice(CLASSES)), ("id", rng.choice(["", "", "main"])), ("href", rng.choice(["", "/p/1"]))) if v)
        return f"<{tag}{attrs}>" + "".join(part(d - 1) for _ in range(rng.randint(1, 3))) + f"</{tag}>"

    return "<body>" + part(depth) + part(depth) + "</body>"


def plain(stored, page, least):
    nodes = list(dom.parse(page).walk())
    scored = [(relocate.likeness(stored, dom.fingerprint(n)), n) for n in nodes]
    top = max((s for s, _ in scored), default=0)
    return sorted((dom.path(n), n.text(" ", True), s) for s, n in scored if s == top and s >= least)


@pytest.mark.parametrize("least", [0, 40, 90])
def test_many_by_many_equals_scoring_all(spark, monkeypatch, least):
    monkeypatch.setattr(relocate, "GROUP", 5)
    rng = random.Random(least)
    kept = []
    for i in range(40):
        nodes = list(dom.parse(random_page(rng)).walk())
        kept.append((f"s{i % 3}", f"n{i}", json.dumps(dom.fingerprint(rng.choice(nodes)))))
    pages = [(i, f"s{i % 4}", random_page(rng)) for i in range(24)] + [(50, "s0", None), (51, "s1", ""), (52, None, random_page(rng)), (53, "s0", pages_text := random_page(rng)), (54, "s0", pages_text)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id int, site string, html string, x_site string")
    got = {}
    for r in relocate.relocate_all(df, spark.createDataFrame(kept, "site string, name string, element string"), least=least).collect():
        got.setdefault((r["page_id"], r["name"]), []).append((r["path"], r["text"], r["score"]))
    want = {(i, name): rows for i, site, page in pages for s, name, element in kept if s == site and (rows := plain(json.loads(element), page, least))}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > (5 if least > 80 else 200)


def test_bounds_are_bounds_and_spare_most():
    rng = random.Random(7)
    exact = 0
    for _ in range(60):
        prints = [dom.fingerprint(n) for n in dom.parse(random_page(rng, 5)).walk()]
        stored = rng.choice([dom.fingerprint(n) for n in dom.parse(random_page(rng, 5)).walk()])
        for p in prints:
            assert relocate.likeness(stored, p) <= relocate.likeness(stored, p, relocate._by_counts) <= relocate.likeness(stored, p, relocate._by_length)
        scores = [relocate.likeness(stored, p) for p in prints]
        found = relocate.best(stored, prints, 0)
        assert found == [(i, s) for i, s in enumerate(scores) if s == max(scores)]
        exact += sum(relocate.likeness(stored, p, relocate._by_length) >= max(scores) for p in prints) / len(prints)
    assert exact / 60 < 0.7


def test_parts_that_do_not_count():
    node = lambda html, css: dom.fingerprint(dom.select(dom.parse(html), css)[0])
    a = node("<p class=a>x</p>", "p")
    assert relocate.likeness(a, a) == 100.0
    assert relocate.likeness(a, node("<div><p class=a>x</p></div>", "p")) < 100
    # An empty class isn't compared; a lone parent neither.
    assert relocate.likeness(node("<p class=''>x</p>", "p"), node("<p class='b'>x</p>", "p")) == round(100 * (1 + 1 + 0.5 + 1) / 4, 2)


def test_empty(spark):
    none = spark.createDataFrame([], "site string, name string, element string")
    pages = spark.createDataFrame([("s", "<p>x</p>")], "site string, html string")
    assert relocate.relocate_all(pages, none).count() == 0 and relocate.relocate_all(pages.limit(0), none).count() == 0
    assert [tuple(r) for r in relocate.fingerprints(pages, {"p": "p", "q": "q"}).select("site", "name").collect()] == [("s", "p")]
