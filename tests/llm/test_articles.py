"""Main text inside articles: names of subjects stay, parts of the page go; the whole operator against a plain one."""

import random
from html.parser import HTMLParser

import pytest

from sluice.llm import html_text
from tests.llm.test_text_operators import plain_tree

BODY = "The article has a body that is longer than all that surrounds it, by far."


def texts(page):
    return [t for _, t in html_text.read_page(page)[0]]


@pytest.mark.parametrize("part", [
    '<div class="notice-period">Three months.</div>', '<section id="login">How to log in.</section>', '<div class="related-work">Others did this.</div>',
    '<div class="skip-list">A skip list is a list.</div>', '<p><span class="share">Share price</span></p>', '<div class="social-security">Pensions.</div>',
    '<div class="header">Head of it</div>', '<div id="related">See <a href=x>a</a> for this long story about it.</div>', '<table class="menu-of-the-day"><tr><td>Soup</td></tr></table>',
])
def test_names_of_the_subject_stay(part):
    alone, inside = texts(f"<article>{part}</article>"), texts(f"<article><h1>T</h1><p>{BODY}</p>{part}<p>End</p></article>")
    assert alone and inside == ["T", BODY, *alone, "End"]


@pytest.mark.parametrize("part", [
    '<div class="comments"><p>Me too</p></div>', '<div class="share-buttons">Share</div>', '<ol class="commentlist"><li>Hi</ol>', '<div class="post ad">Buy</div>', '<div class="related-posts"><a href=1>One</a><a href=2>Two</a></div>',
    '<div id="related"><ul><li><a href=1>One story</a></li><li><a href=2>Two stories</a> 3</li></ul></div>', '<section class="newsletter-signup">Mail</section>', '<aside>x</aside>', '<div class="menu-of-the-day"><a href=x>Order</a></div>',
])
def test_parts_of_the_page_go(part):
    assert texts(f"<article><h1>T</h1><p>{BODY}</p>{part}<p>End</p></article>") == ["T", BODY, "End"]


def test_an_inline_part_of_links_goes_without_its_sentence():
    assert texts('<article><p>One <span class="share"><a href=x>Share</a></span> two</p></article>') == ["One two"]
    assert texts('<article><p>One <span class="share">Share <a href=x>p</a>rice</span> two</p></article>') == ["One Share price two"]


class Plain(HTMLParser):
    """Blocks of pages whose tags are all closed, with a list of all open elements at each text."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.runs, self.n = [], [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.n += 1
        self.open.append((self.n, tag, dict(attrs)))
        self.runs.append((None, tuple(self.open)))

    def handle_endtag(self, tag):
        self.runs.append((None, tuple(self.open)))
        assert self.open.pop()[1] == tag

    def handle_data(self, data):
        self.runs.append((data, tuple(self.open)))


def plain_blocks(page):
    runs = Plain(page).runs
    in_article = lambda chain, k: any(t in ("article", "main") for _, t, _ in chain[:k])
    words = lambda v: [w for w in v.lower().split("-") if w]

    def fixed(chain):
        """Left out by tag, or by a class all of whose words name a part."""
        for k, (_, tag, attrs) in enumerate(chain):
            if tag in ("nav", "footer", "aside", "form", "script", "style") or (tag == "header" and not in_article(chain, k)):
                return True
            names = attrs.get("class", "").split()
            if in_article(chain, k):
                if tag not in ("span", "b", "a", "h1", "h2") and any(set(words(c)) & (html_text.OUT_WORDS - html_text.SUBJECTS) and set(words(c)) <= html_text.OUT_WORDS | html_text.FORM_WORDS for c in names):
                    return True
            elif tag not in ("h1", "h2", "body", "main", "article") and any(set(words(c)) & html_text.OUT_WORDS for c in [*names, attrs.get("id", "")]):
                return True
        return False

    live = [(d, c) for d, c in runs if d is not None and not fixed(c)]
    doubted = {n: t for _, c in live for k, (n, t, attrs) in enumerate(c) if in_article(c, k) and t not in ("h1", "h2") and any(set(words(x)) & html_text.OUT_WORDS for x in [*attrs.get("class", "").split(), attrs.get("id", "")])}
    links = set()
    for number in sorted(doubted, reverse=True):  # inner ones first; what went inside counts no more
        own = [(d, c) for d, c in live if number in {n for n, *_ in c} and not links & {n for n, *_ in c}]
        size, linked = (sum(len(d.strip()) for d, c in own if keep(c)) for keep in (lambda c: True, lambda c: any(t == "a" for _, t, _ in c)))
        if linked and 2 * linked >= size:
            links.add(number)
    marked = any(in_article(c, len(c)) and d.strip() and not any(n in links for n, *_ in c) for d, c in live)
    out, now = [], []

    def flush():
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            out.append(text)

    for d, c in runs:
        if d is None:
            if c[-1][1] not in ("span", "b", "a"):
                flush()
        elif not fixed(c) and not any(n in links for n, *_ in c) and (not marked or in_article(c, len(c))):
            now.append(d)
    flush()
    return out


def random_page(rng):
    names = ["", "", "", " class=a", " class=comments", ' class="share-box"', ' class="notice-period"', ' class="related-work"', " id=login", " id=related", ' class="post menu"', " class=skip"]

    def part(depth):
        if depth == 0 or rng.random() < 0.25:
            return rng.choice(["Plain words here ", "x ", "A longer run of words in one text ", "<a href=x>link text</a> ", "<b>bold</b> ", "&amp; "])
        tag = rng.choice(["div", "div", "section", "p", "ul", "span", "nav", "h2", "blockquote", "header"])
        inner = part(0) if tag == "p" else "".join(part(depth - 1) for _ in range(rng.randint(1, 3)))
        return f"<{tag}{rng.choice(names)}>{inner}</{tag}>"

    body = "".join(part(4) for _ in range(rng.randint(1, 4)))
    return "<body>" + rng.choice(["{}", "<article>{}</article>", "<div>x</div><main>{}</main><footer>f</footer>", "<p>first</p><article class=comments-on-life>{}</article>"]).format(body) + "</body>"


def closes_itself(page):
    """Pages on which blocks or links inside others would close them are no matter of this test."""
    import re

    return not re.search(r"<p[^>]*>[^<]*<(div|section|ul|p|nav|h2|blockquote|header)", page)


def test_reading_equals_a_plain_one():
    rng = random.Random(21)
    seen = 0
    for _ in range(4000):
        page = random_page(rng)
        # Inline elements around blocks split texts where the plain version does not look.
        if not closes_itself(page) or "<span" in page:
            continue
        seen += 1
        assert texts(page) == plain_blocks(page), page
    assert seen > 800


def test_operator_equals_plain_reading_and_plain_tree(spark):
    rng = random.Random(5)
    shared = ['<div class="notice-period">The same notice everywhere</div>', "<p>Follow us here</p>", '<div id="login">Log in to read on</div>']
    pages = []
    for i in range(60):
        own = "".join(f"<p>Own text {rng.randrange(10**6)} that is long enough to be the story {i}</p>" for _ in range(3))
        pages.append((i, f"h{i % 3}", f"<body><article><h1>T{i}</h1>{own}{"".join(shared)}<div class=related-work>Work of {i}</div></article></body>"))
    df = spark.createDataFrame([(i, f"http://{h}.example/{i}", p) for i, h, p in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r["main_text"] for r in html_text.main_text(df).collect()}
    assert got == plain_tree(pages)
    for i, _, page in pages:
        left = plain_blocks(page)
        # What recurs on the host went by the tree, whatever its name; what is the page's own stays.
        assert got[i].split("\n") == [t for t in left if t not in ("The same notice everywhere", "Follow us here", "Log in to read on")]
        assert f"Work of {i}" in got[i]
