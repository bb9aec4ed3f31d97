"""More queries with their DuckDB equivalents: search in pages, conversion, plans and specifications, crawl state, requests, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import text, urls
from sluice.operators import convert, extract, frontier, memory, profile, score, search
from sluice.plans import diagnose, specs
from sluice.plans.catalog import query, table
from sluice.plans.spider import CrawlState, Jobs, bfs, child_requests
from sluice.session import new_path


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "html")


# ------------------------------------------------------------------ search


@query("""SELECT page_id, (i - 1)::INT AS pos, l[i] AS value FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages))""")
def xpath_attributes(spark, sf_dir):
    return search.by_xpath(_pages(spark, sf_dir), "//a[@href]/@href").select("page_id", "pos", "value")


@query("""WITH n AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="([^"]*)"', 1) AS l FROM pages)
SELECT page_id, l[2] AS second, l[len(l)] AS last FROM n WHERE len(l) >= 2""")
def xpath_positions(spark, sf_dir):
    p = _pages(spark, sf_dir)
    second = search.by_xpath(p, "//nav/ul/li[position() = 2]/a/@href").select("page_id", F.col("value").alias("second"))
    return second.join(search.by_xpath(p, "//nav//li[last()]/a/@href").select("page_id", F.col("value").alias("last")), "page_id")


@query("""SELECT page_id, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<div class="ad">')) FROM pages) GROUP BY page_id""")
def xpath_conditions(spark, sf_dir):
    """Through the XPath that a CSS selector translates to."""
    found = search.by_xpath(_pages(spark, sf_dir), search.css_to_xpath("body > div.ad"))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, t AS tag, len(regexp_extract_all(html, '<' || t || '[ >]'))::BIGINT AS n FROM pages, (SELECT unnest(['h1', 'article']) AS t) WHERE regexp_matches(html, '<' || t || '[ >]')""")
def find_by_tag(spark, sf_dir):
    return search.by_tag(_pages(spark, sf_dir), ("h1", "article")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, len(regexp_extract_all(html, '(?i)<a href="[^"]*">the</a>'))::BIGINT AS n FROM pages WHERE regexp_matches(html, '(?i)<a href="[^"]*">the</a>')""")
def find_by_text(spark, sf_dir):
    return search.by_text(_pages(spark, sf_dir), "The").filter("tag = 'a'").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, 'footer' AS tag FROM pages WHERE regexp_matches(html, '<footer>&copy; ')""")
def find_by_regex(spark, sf_dir):
    return search.by_regex(_pages(spark, sf_dir), r"^© \S+").filter("tag = 'footer'").select("page_id", "tag")


@query("""SELECT page_id, 'body' AS parent, regexp_extract(html, '</([a-z]+)><article>', 1) AS previous, regexp_extract(html, '</article><([a-z]+)>', 1) AS next FROM pages""")
def element_neighbours(spark, sf_dir):
    return search.neighbours(_pages(spark, sf_dir), "//article").select("page_id", "parent", "previous", "next")


@query("""SELECT page_id, len(regexp_extract_all(html, '<div class="ad">'))::BIGINT AS ads, (len(regexp_extract_all(html, 'lang="en"')))::BIGINT AS english FROM pages""")
def attribute_search(spark, sf_dir):
    e = extract.elements(_pages(spark, sf_dir))
    english = F.map_contains_key(search.attributes_with(F.col("attrs"), "en"), "lang")
    return e.groupBy("page_id").agg(F.count_if(search.has_class(F.col("attrs"), "ad")).alias("ads"), F.count_if(english).alias("english"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<h1>[^<]'))::BIGINT AS headings, len(regexp_extract_all(html, '<li>'))::BIGINT AS items FROM pages""")
def markdown_marks(spark, sf_dir):
    lines = F.split(F.get(F.col("content"), F.lit(0)), "\n")
    marked = lambda mark: F.size(F.filter(lines, lambda x: x.startswith(mark))).cast("long")
    return convert.convert(_pages(spark, sf_dir), "markdown").select("page_id", marked("# ").alias("headings"), marked("- [").alias("items"))


@query("""SELECT page_id, false AS scripts, true AS kept FROM pages""")
def main_content(spark, sf_dir):
    c = F.get(F.col("content"), F.lit(0))
    return convert.convert(_pages(spark, sf_dir), "html", main_only=True).select("page_id", (F.contains(c, F.lit("track(")) | F.contains(c, F.lit("<script"))).alias("scripts"), F.contains(c, F.lit("<article>")).alias("kept"))


# ------------------------------------------------------------------ plans and specifications

_SPEC = {"site": "s", "start_urls": ["http://h.example/"], "list": {"item_link": "nav a@href"}, "detail": {"title": "h1", "menu": "nav li", "price": "span.price"}}


@query("""WITH p AS (SELECT page_id, len(regexp_extract_all(html, '<li><a href="'))::INT AS links, len(regexp_extract_all(html, '<h1>[^<]'))::INT AS title FROM pages)
SELECT page_id, links, title, 0 AS price, round(((links > 0)::INT * 2 + (title > 0)::INT) / 4, 3) AS score FROM p""")
def spec_on_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    hits = specs.spec_hits(_SPEC, pages.select(F.col("page_id").cast("string").alias("url"), "html"))
    return hits.select(F.col("url").cast("long").alias("page_id"), "links", F.col("hits")["title"].alias("title"), F.col("hits")["price"].alias("price"), "score")


@query("""SELECT page_id, 'selector_zero_match' AS reason, length(html)::INT AS html_chars, len(regexp_extract_all(html, '<a href="'))::BIGINT AS anchors FROM pages""")
def zero_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    return specs.zero_links(pages, "a.product-link").select(F.col("url").cast("long").alias("page_id"), "reason", "html_chars", "anchors")


@query("""SELECT 'title' AS field, count(*)::BIGINT AS pages, 'h1' AS selector, count(*)::BIGINT AS votes, 1.0::DOUBLE AS agreement FROM pages""")
def detail_samples(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    return specs.detail_samples(pages, ["title"])


@query("SELECT * FROM (VALUES (1::BIGINT, 2), (2::BIGINT, 3), (3::BIGINT, 4), (4::BIGINT, 2)) t(version, n_fields)")
def spec_versions(spark, sf_dir):
    """Three versions and a rollback to the first, which becomes the fourth."""
    store = specs.SpecStore(spark, new_path(spark, "specs"))
    for n in (2, 3, 4):
        store.save(_SPEC | {"detail": {f"f{k}": "h1" for k in range(n)}}, now=float(n))
    store.rollback("s", 1, now=9.0)
    return store.versions("s").select("version", F.size(F.json_object_keys(F.get_json_object("spec", "$.detail"))).alias("n_fields"))


@query("""WITH v AS (SELECT 'p_name' AS field, false AS named, false AS numeric, p_name AS v FROM part UNION ALL SELECT 'p_brand', false, false, p_brand FROM part UNION ALL SELECT 'p_type', true, false, p_type FROM part
    UNION ALL SELECT 'p_size', false, false, p_size::VARCHAR FROM part UNION ALL SELECT 'p_retailprice', false, true, p_retailprice::VARCHAR FROM part),
f AS (SELECT field, any_value(named) AS named, any_value(numeric) AS numeric, avg(regexp_matches(v, '[0-9]')::INT) AS numbers, count(DISTINCT v) AS n, count(*) AS c FROM v GROUP BY field),
k AS (SELECT field, CASE WHEN numeric OR numbers >= 0.8 THEN 'number' WHEN named OR n <= greatest(20, ceil(c * 0.35)) THEN 'category' ELSE 'text' END AS type FROM f)
SELECT field, type, CASE type WHEN 'number' THEN 'metric' WHEN 'category' THEN 'dimension' ELSE 'label' END AS role FROM k""")
def profile_kinds(spark, sf_dir):
    return profile.fields(table(spark, sf_dir, "part"), "p_partkey").select("field", "type", "role")


# ------------------------------------------------------------------ crawl state and requests


@query("""WITH RECURSIVE g AS (SELECT DISTINCT user_id AS u FROM events), b(u, d) AS (SELECT min(u), 0 FROM g UNION SELECT t.u, d + 1 FROM b, LATERAL (SELECT unnest([b.u * 2, b.u * 3, b.u + 1]) AS u) t WHERE d < 3 AND t.u <= (SELECT max(u) FROM g)),
l AS (SELECT u, min(d) AS level FROM b GROUP BY u) SELECT level::INT AS level, count(*)::BIGINT AS rows FROM l GROUP BY level""")
def crawl_resumed(spark, sf_dir):
    """A crawl that is stopped behind its first level and goes on from its folder."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    low, high = u.agg(F.min("user_id"), F.max("user_id")).first()
    follow = lambda front: front.select(F.explode(F.array(F.col("node") * 2, F.col("node") * 3, F.col("node") + 1)).alias("node")).filter(F.col("node") <= high)
    path = new_path(spark, "crawl")
    bfs(spark.createDataFrame([(low,)], "node long"), follow, 1, state=CrawlState(spark, path))
    state = CrawlState(spark, path)
    bfs(spark.createDataFrame([(-1,)], "node long"), follow, 3, state=state)
    return state.snapshot()


@query("SELECT 'b' AS job, 'done' AS status, (SELECT count(*) FROM region)::BIGINT AS rows UNION ALL SELECT 'a', 'failed', 0")
def crawl_jobs(spark, sf_dir):
    jobs, ticks = Jobs(spark, new_path(spark, "jobs")), iter(range(100))
    clock = lambda: float(next(ticks))

    def fails():
        raise RuntimeError("no pages")

    try:
        jobs.run("a", fails, clock)
    except RuntimeError:
        pass
    jobs.run("b", lambda: table(spark, sf_dir, "region"), clock)
    return jobs.list().select("job", "status", "rows")


@query("""SELECT o_orderkey, sha1('{"body":"","method":"GET","sid":"s","url":"http://h.example/p?a=' || o_custkey || '&b=' || o_orderstatus || '"}') AS fp FROM orders""")
def request_fingerprints(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    url = F.concat(F.lit("HTTP://H.example/p?b="), "o_orderstatus", F.lit("&a="), F.col("o_custkey").cast("string"), F.lit("#"), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", urls.request_fingerprint(url, session=F.lit("s")).alias("fp"))


@query("""SELECT o_orderkey, 'http://h.example/l?x=1&page=' || (o_custkey + 2) AS third, 3::INT AS n FROM orders""")
def next_pages(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    told = urls.next_page_urls(F.concat(F.lit("http://h.example/l?x=1&page="), F.col("o_custkey").cast("string")), 3)
    return o.select("o_orderkey", F.get(told, F.lit(2)).alias("third"), F.size(told).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, o_orderpriority AS priority, 's' || (o_custkey % 3) AS sid, CASE WHEN l_linenumber = 1 THEN 'own' ELSE 'parent' END AS a, 'b' AS b, 1 AS depth FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def follow_requests(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderpriority").alias("priority"), F.concat(F.lit("s"), F.col("o_custkey") % 3).alias("sid"), F.create_map(F.lit("a"), F.lit("parent"), F.lit("b"), F.lit("b")).alias("meta"), F.lit(0).alias("depth"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("url"), F.col("l_linenumber").alias("link"), F.when(F.col("l_linenumber") == 1, F.create_map(F.lit("a"), F.lit("own"))).alias("meta"))
    made = child_requests(parents, links)
    return made.select(F.col("referer").alias("l_orderkey"), F.col("url").alias("l_linenumber"), "priority", "sid", F.col("meta")["a"].alias("a"), F.col("meta")["b"].alias("b"), "depth")


# ------------------------------------------------------------------ memory and caches


@query("""WITH e AS (SELECT user_id % 50 AS key, event_type <> 'error' AS ok, ts, event_id FROM events), l AS (SELECT key, max((ts, event_id)) FILTER (ok) AS good, max((ts, event_id)) FILTER (NOT ok) AS bad FROM e GROUP BY key)
SELECT e.key, count(*) FILTER (ok AND (bad IS NULL OR (ts, event_id) > bad))::BIGINT AS success_streak, count(*) FILTER (NOT ok AND (good IS NULL OR (ts, event_id) > good))::BIGINT AS fail_streak, count(*)::BIGINT AS attempts FROM e JOIN l USING (key) GROUP BY e.key""")
def memory_recorded(spark, sf_dir):
    """Attempts up to a moment, and those behind it recorded on top, give the memory of all."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("domain"), (F.col("event_type") != "error").alias("ok"), "ts", "event_id")
    middle = e.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    early = F.unix_micros(F.col("ts").cast("timestamp")) < middle
    args = ("domain", ["ts", "event_id"], F.col("ok"), F.lit("auto"), F.unix_micros(F.col("ts").cast("timestamp")))
    first = memory.domain_memory(e.filter(early), *args)
    return memory.record(first, e.filter(~early), *args).select("key", "success_streak", "fail_streak", "attempts")


@query("""SELECT s_suppkey AS key, count(*) FILTER (l_returnflag <> 'R')::BIGINT AS successes, count(*) FILTER (l_returnflag = 'R')::BIGINT AS failures FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey WHERE s_suppkey % 7 <> 0 GROUP BY 1""")
def memory_counted(spark, sf_dir):
    held = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    told = memory.count_outcomes(held, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_returnflag") != "R").alias("success")))
    return memory.reset(told, held.filter("key % 7 = 0"))


@query("""SELECT user_id AS key, max(event_id) AS event_id FROM events GROUP BY user_id""")
def cache_put(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", F.col("event_id").alias("timestamp"))
    return memory.put(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")).select("key", "event_id")


@query("""SELECT page_id FROM pages WHERE page_id % 3 <> 1 AND url NOT LIKE '%.example.org%'""")
def cache_cleared(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 3).alias("kind"))
    return memory.clear_entries(p, (1,), ".example.org").select("page_id")


# ------------------------------------------------------------------ small functions


@query("""SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'Not Found' WHEN 2 THEN 'Service Unavailable' ELSE 'Unknown Status Code' END AS reason FROM events""")
def status_texts(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(c) for c in (200, 404, 503, 799)]), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.status_text(code).alias("reason"))


@query("""SELECT event_id, event_type = 'error' AS proxy, event_type = 'click' AS agent FROM events""")
def word_checks(spark, sf_dir):
    said = F.when(F.col("event_type") == "error", F.lit("Page.goto: net::ERR_PROXY_CONNECTION_FAILED")).when(F.col("event_type") == "click", F.lit("智能体 engineer")).otherwise(F.lit("plain"))
    return table(spark, sf_dir, "events").select("event_id", text.is_proxy_error(said).alias("proxy"), text.is_agent_related(said).alias("agent"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE (props->>'k')::BIGINT END AS k, CASE WHEN event_type <> 'view' THEN 'dict' END AS type, CASE WHEN event_type <> 'view' THEN 1 END AS size FROM events""")
def relaxed_json(spark, sf_dir):
    said = F.when(F.col("event_type") == "error", F.concat(F.lit(" <!-- "), "props", F.lit(" -->"))).when(F.col("event_type") == "view", F.lit("{broken")).otherwise(F.col("props"))
    plain = text.relaxed_json(said)
    told = text.value_summary(plain)
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(plain, "$.k").cast("long").alias("k"), F.when(plain.isNotNull(), told["type"]).alias("type"), F.when(plain.isNotNull(), told["size"]).alias("size"))


@query("""SELECT event_id, least(CASE WHEN event_type = 'error' THEN user_id::DOUBLE ELSE 2.0 ** (event_id % 8) END, 60.0) AS delay FROM events""")
def retry_delays(spark, sf_dir):
    said = F.when(F.col("event_type") == "error", F.col("user_id").cast("string")).when(F.col("event_type") == "view", F.lit("Wed, 21 Oct"))
    return table(spark, sf_dir, "events").select("event_id", text.retry_delay(said, F.col("event_id") % 8).alias("delay"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'EUR ' || c_nationkey || '-' || (c_nationkey + 5) || ' / HOUR' WHEN c_custkey % 3 = 1 THEN 'EUR 7' END AS salary,
    CASE WHEN c_custkey % 3 = 0 THEN 'Town, Land / Remote' WHEN c_custkey % 3 = 1 THEN 'Elsewhere' ELSE '' END AS place FROM customer""")
def jsonld_jobs(spark, sf_dir):
    n = F.col("c_nationkey").cast("string")
    full = F.concat(F.lit('{"baseSalary":{"currency":"EUR","value":{"minValue":'), n, F.lit(',"maxValue":'), (F.col("c_nationkey") + 5).cast("string"), F.lit(',"unitText":"HOUR"}},"jobLocationType":"TELECOMMUTE","jobLocation":[{"address":{"addressLocality":"Town","addressCountry":"Land"}},{"address":{"addressLocality":"Town","addressCountry":"Land"}}]}'))
    job = F.when(F.col("c_custkey") % 3 == 0, full).when(F.col("c_custkey") % 3 == 1, F.lit('{"baseSalary":{"currency":"EUR","value":7},"jobLocation":{"address":"Elsewhere"}}')).otherwise(F.lit("{}"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.salary_from_jsonld(job).alias("salary"), text.location_from_jsonld(job).alias("place"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'rate_limited,html_truncated' WHEN page_id % 4 = 1 THEN 'js_shell' WHEN page_id % 4 = 2 THEN 'api_hints_found' ELSE 'html_available' END AS categories FROM pages""")
def access_signals(spark, sf_dir):
    k = F.col("page_id") % 4
    found = text.access_categories(F.lit("plain words"), status=F.when(k == 0, F.lit(429)).otherwise(F.lit(200)), truncated=k == 0, js_shell=k == 1, api_hints=k == 2)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found, ",").alias("categories"))


# ------------------------------------------------------------------ diagnosis, filters, kept elements


@query("""SELECT o_orderkey, CASE o_custkey % 6 WHEN 0 THEN 'blocked_or_challenged' WHEN 1 THEN 'api_driven_js_page' WHEN 2 THEN 'browser_rendered_js_page' WHEN 3 THEN 'api_hinted_page' WHEN 4 THEN 'browser_rendered_page' ELSE 'unknown' END AS name FROM orders""")
def access_classes(spark, sf_dir):
    k = F.col("o_custkey") % 6
    categories = F.when(k == 0, F.array(F.lit("challenge"), F.lit("js_shell"))).when(k.isin(1, 2), F.array(F.lit("js_shell"))).otherwise(F.array(F.lit("html_available")))
    c = diagnose.access_class(categories, k.isin(1, 3).cast("int"), F.when(k == 4, F.lit("browser")).otherwise(F.lit("")))
    return table(spark, sf_dir, "orders").select("o_orderkey", c["name"].alias("name"))


@query("""SELECT url, challenge = '' AS ok, CASE WHEN challenge = '' THEN 'preferred_fetch_mode,' ELSE 'manual_access_required,' END || CASE WHEN html LIKE '%<a href="%' THEN 'list_selector' ELSE 'none' END AS recommendations
FROM (SELECT url, html, CASE WHEN contains(lower(html), 'captcha') THEN 'captcha' ELSE '' END AS challenge FROM pages)""")
def page_advice(spark, sf_dir):
    told = diagnose.diagnose(table(spark, sf_dir, "pages").select("url", "html"))
    wanted = F.filter("recommendations", lambda x: x.isin("preferred_fetch_mode", "manual_access_required", "list_selector"))
    return told.select("url", "ok", F.array_join(wanted, ",").alias("recommendations"))


@query("""SELECT e.event_id % 2 = 0 AS even, e.event_id % 2 = 0 AS held FROM events e GROUP BY 1, 2""")
def bloom_filters(spark, sf_dir):
    """A filter of the even ids, built in two parts and merged: all even ones may be in it, and of the odd ones few."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("url_hash"), (F.col("event_id") % 2 == 0).alias("even"), (F.col("event_id") % 4 == 0).alias("fourth"))
    bits = frontier.bloom_bits(e.filter("even").count())
    stored = frontier.bloom_merge(frontier.bloom(e.filter("fourth"), bits=bits), frontier.bloom(e.filter("even and not fourth"), bits=bits))
    asked = frontier.bloom_maybe if bits <= frontier.MOST_BITS else frontier.bloom_joined
    share = asked(e, stored, bits=bits).groupBy("even").agg(F.avg(F.col("maybe").cast("double")).alias("share"))
    return share.select("even", F.when(F.col("even"), F.col("share") == 1).otherwise(F.col("share") > 0.03).alias("held"))


@query("""SELECT domain, 'headline' AS identifier, 'h1' AS tag FROM (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS domain FROM pages WHERE html LIKE '%<h1%')""")
def kept_elements(spark, sf_dir):
    kept = search.remember(table(spark, sf_dir, "pages").select("url", "html"), "//h1", "headline")
    return kept.select("domain", "identifier", F.get_json_object("element", "$.tag").alias("tag"))


@query("""SELECT 'network_api_candidate' AS type, (SELECT 'http://h/' || min(event_id) FROM events) AS url UNION ALL SELECT 'pagination_candidate', (SELECT 'http://h/' || min(event_id) FROM events WHERE user_id % 3 = 0) UNION ALL SELECT 'json_api_candidate', (SELECT 'http://h/' || min(event_id) FROM events WHERE event_type = 'view')""")
def network_advice(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("http://h/"), F.col("event_id").cast("string")).alias("url"), (F.col("event_type") == "view").alias("json_like"), (F.col("user_id") % 3 == 0).alias("paged"))
    return diagnose.network_advice(e)


@query("""SELECT c_custkey, round(CASE WHEN c_nationkey % 3 = 0 THEN least(1.0, c_nationkey / 10) ELSE (least(1.0, c_nationkey / 10) + (0.5 + c_nationkey % 3 / 4) / 2) / 2 END, 3)::DOUBLE AS confidence FROM customer""")
def overall_confidences(spark, sf_dir):
    n = F.col("c_nationkey")
    scores = F.when(n % 3 == 0, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.5), (n % 3) / 4.0))
    return table(spark, sf_dir, "customer").select("c_custkey", score.overall_confidence(n, F.lit(10), scores).alias("confidence"))


@query("""SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'Requirements: one ' || o_custkey WHEN 1 THEN 'plain agent page' END AS description, CASE WHEN o_custkey % 3 < 2 THEN 'parsed_text' END AS status FROM orders""")
def generic_jobs(spark, sf_dir):
    k = F.col("o_custkey") % 3
    page = F.when(k == 0, F.concat(F.lit("An LLM team.  Requirements: one "), F.col("o_custkey").cast("string"))).when(k == 1, F.lit("plain agent page")).otherwise(F.lit("nothing of that kind"))
    job = text.generic_job(F.lit("Engineer"), page, F.lit("http://h/"), F.lit("c"))
    return table(spark, sf_dir, "orders").select("o_orderkey", job["description"].alias("description"), job["fetch_status"].alias("status"))


@query("""SELECT page_id, true AS headed FROM pages WHERE html LIKE '%<h1>%'""")
def written_contents(spark, sf_dir):
    path = new_path(spark, "contents")
    convert.write(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html"), path)
    return spark.read.schema("url string, content string").json(path).select(F.col("url").cast("long").alias("page_id"), F.col("content").rlike(r"(?m)^# ").alias("headed"))
