"""Queries over the driver's tables, one or more per operator, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import predicates, text, urls
from sluice.operators import extract, frontier, jsonshape, memory, metrics, profile, score, store, tree
from sluice.operators.frontier_log import StoredFrontier
from sluice.plans import report
from sluice.plans.pipeline import Pipeline
from sluice.plans.spider import CrawlSpec, bfs, crawl
from sluice.session import new_path
from sluice.sources import sitemap
from sluice.sources.pages import LandedPages
from sluice.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fetch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as fetch events: domain by user, mode by type, errors as failures."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", F.lit("fetch").alias("event"), (F.col("event_type") != "error").alias("success"), (F.col("user_id") % 10).cast("string").alias("domain"), F.col("event_type").alias("mode"),
        (F.col("event_type") == "view").alias("cache_hit"), F.floor("value").alias("duration_ms"), F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.col("user_id") % 3)).alias("error_type"),
    )


_E = """WITH e AS (SELECT event_id, ts, event_type <> 'error' AS success, (user_id % 10)::VARCHAR AS domain, event_type AS mode, event_type = 'view' AS cache_hit,
    floor(value)::BIGINT AS duration_ms, CASE WHEN event_type = 'error' THEN 'E' || (user_id % 3) END AS error_type FROM events)
"""
_COUNTS = "count(*)::BIGINT AS n, count(*) FILTER (success)::BIGINT AS success, count(*) FILTER (NOT success)::BIGINT AS fail, count(*) FILTER (cache_hit)::BIGINT AS cache_hits, round(avg(coalesce(duration_ms, 0)))::BIGINT AS avg_duration_ms"


# ------------------------------------------------------------------ metrics


@query(_E + f"SELECT {_COUNTS} FROM e")
def metrics_overall(spark, sf_dir):
    return metrics.overall(fetch_events(spark, sf_dir))


@query(_E + f"SELECT domain, {_COUNTS} FROM e GROUP BY domain")
def metrics_by_domain(spark, sf_dir):
    return metrics.by(fetch_events(spark, sf_dir), "domain")


@query(_E + f"SELECT mode, {_COUNTS} FROM e GROUP BY mode")
def metrics_by_mode(spark, sf_dir):
    return metrics.by(fetch_events(spark, sf_dir), "mode")


@query(_E + "SELECT error_type, count(*)::BIGINT AS n FROM e WHERE NOT success GROUP BY error_type")
def metrics_failures(spark, sf_dir):
    return metrics.failures(fetch_events(spark, sf_dir))


@query(_E + f"SELECT domain, mode, CASE WHEN grouping(domain) + grouping(mode) = 2 THEN 'all' WHEN grouping(domain) = 0 THEN 'domain' ELSE 'mode' END AS level, {_COUNTS} FROM e GROUP BY GROUPING SETS ((), (domain), (mode))")
def metrics_all(spark, sf_dir):
    return metrics.all_metrics(fetch_events(spark, sf_dir))


@query("WITH t AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000) SELECT event_id, user_id, event_type FROM t WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.col("event_type").alias("event"))
    return metrics.recent(e, ["ts", "event_id"], 50, event="purchase").select("event_id", "user_id", "event_type")


@query("""SELECT count(*)::BIGINT AS requests, count(*) FILTER (event_type = 'error')::BIGINT AS failed, count(*) FILTER (event_type = 'view')::BIGINT AS cached, count(*) FILTER (event_type = 'click')::BIGINT AS retried,
    sum(user_id)::BIGINT AS bytes, round((max(event_id) - min(event_id))::DOUBLE, 3) AS elapsed, round(count(*) / (max(event_id) - min(event_id)), 3) AS per_second FROM events""")
def crawl_run_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    log = e.select((kind != "error").alias("ok"), (kind == "view").alias("cached"), (kind == "click").alias("retried"), F.col("user_id").alias("bytes"), F.col("event_id").cast("double").alias("started"), F.col("event_id").cast("double").alias("ended"))
    return metrics.crawl_stats(log)


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def status_counts(spark, sf_dir):
    return metrics.count_by(table(spark, sf_dir, "events"), "event_type")


@query("SELECT source, sum(n_chars)::BIGINT AS n FROM documents GROUP BY source")
def bytes_per_domain(spark, sf_dir):
    return metrics.count_by(table(spark, sf_dir, "documents"), "source", "n_chars")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE json_exists(props, '$.k')")
def json_path_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    return e.filter(F.col("k").isNotNull())


# ------------------------------------------------------------------ URLs

# Scheme, authority, path without parameters and query of the pages' URLs.
_U = r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS auth,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages)
"""


@query(_U + "SELECT page_id, scheme || '://' || auth || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical, sha256(scheme || '://' || auth || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END) AS hash FROM u")
def page_canonical_url(spark, sf_dir):
    c = urls.canonical_url(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", c.alias("canonical")).withColumn("hash", urls.url_hash(F.col("canonical")))


@query(_U + "SELECT auth AS domain, count(*)::BIGINT AS n FROM u GROUP BY auth")
def page_domain_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(urls.authority(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query(_U + r"SELECT page_id, regexp_extract(lower(path), '\.([^./]+)$', 1) AS extension FROM u")
def page_extension(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.extension(F.col("url")).alias("extension"))


@query(_U + r"""SELECT page_id, coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT split_part(p, '=', 1) AS k FROM (SELECT unnest(string_split(q, '&')) AS p))
    WHERE lower(k) IN ('page','p','offset','limit','cursor','start','from','size','sort','filter','node') OR regexp_matches(lower(k), 'page|offset|limit|cursor|sort|filter|node')), '') AS names,
    regexp_matches(q, '(^|&)(page|p|offset|cursor|start|from)=') AS strong FROM u""")
def page_pagination_params(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", urls.pagination_params(F.col("url")).alias("p"))
    return p.select("page_id", F.array_join(F.array_sort(F.map_keys("p")), ",").alias("names"), urls.has_strong_pagination(F.col("p")).alias("strong"))


@query(_U + r"""SELECT page_id, CASE WHEN regexp_matches(t, '(\.html$|/p/|/product/|/products/|sku=|pid=)') THEN 'product' WHEN regexp_matches(t, '(/blog/|/news/|/article/|/magazine/|/inspiration/|/advies/)') THEN 'content'
    WHEN regexp_matches(t, '(/sale|/deals|/offers|/aanbiedingen|/actie)') THEN 'promotion' ELSE 'category' END AS class,
    regexp_matches(path, '(?i)(/dp/[A-Z0-9]{10}\b|/gp/product/|/detail/|/product/|/products/|/p/|\.html$)') AS detail,
    regexp_matches(lower(path), '\.(js|css|png|jpe?g|gif|webp|svg|ico|woff2?|ttf|map)$') AS asset,
    regexp_matches(lower(path), '(\.json$|\.graphql$|/graphql|/api/)') AS json_like FROM (SELECT *, lower(path) || CASE WHEN q = '' THEN '' ELSE '?' || lower(q) END AS t FROM u)""")
def page_url_class(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.classify_url(u).alias("class"), urls.looks_like_detail(u).alias("detail"), urls.is_static_asset(u).alias("asset"), urls.is_json_like(u).alias("json_like"))


@query(_U + r"SELECT page_id, url FROM u WHERE scheme IN ('http', 'https') AND regexp_matches(url, '/en/') AND NOT regexp_matches(url, '\.html') AND NOT (auth = 'spam-farm.example.org' OR auth LIKE '%.spam-farm.example.org') AND (auth = 'example.com' OR auth LIKE '%.example.com')")
def link_rules_filter(spark, sf_dir):
    ok = urls.url_allowed(F.col("url"), schemes=("http", "https"), allow=("/en/",), deny=(r"\.html",), deny_domains=("spam-farm.example.org",), allow_domains=("example.com",))
    return table(spark, sf_dir, "pages").filter(ok).select("page_id", "url")


BLOCKED = ("example.org", "m.ththth.example.net", "ththre.example.com")


@query(_U + "SELECT page_id, auth AS host FROM u WHERE NOT (auth = 'example.org' OR auth LIKE '%.example.org' OR auth = 'm.ththth.example.net' OR auth LIKE '%.m.ththth.example.net' OR auth = 'ththre.example.com' OR auth LIKE '%.ththre.example.com')")
def blocked_domain_anti(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    listed = spark.createDataFrame([(b,) for b in BLOCKED], "suffix string")
    below = p.select("page_id", F.explode(urls.host_suffixes(F.col("host"))).alias("suffix")).join(listed, "suffix", "left_semi")
    return p.join(below.select("page_id").distinct(), "page_id", "left_anti")


@query(_U + "SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN auth = '' THEN 'host' WHEN auth LIKE '%.example.org' THEN 'blocked' ELSE '' END AS reason FROM u")
def url_validation(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.validate_url(F.col("url"), blocked_domains=["example.org"]).alias("reason"))


@query(_U + """, p AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM u)
SELECT page_id, d AS depth, array_to_string(parts[1:d], '/') AS prefix FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS d FROM p)""")
def url_path_prefixes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(urls.prefixes(urls.path_parts(F.col("url")), 6)).alias("p"))
    return p.select("page_id", F.size("p").cast("long").alias("depth"), F.array_join("p", "/").alias("prefix"))


@query(_U + r""", p AS (SELECT DISTINCT list_filter(string_split(path, '/'), lambda x: x <> '') AS parts, path FROM u),
prod AS (SELECT DISTINCT unnest([parts[1:d] FOR d IN range(1, least(3, len(parts) - 1) + 1)]) AS pre FROM p WHERE len(parts) > 1 AND regexp_matches(parts[len(parts)], '(?i)\.html$')),
c AS (SELECT DISTINCT parts[1:3] AS parts FROM p WHERE len(parts) > 0 AND NOT regexp_matches(path, '(?i)(\.html$|/producten/|/product/|/p/|pid=|sku=)'))
SELECT array_to_string(parts, '/') AS category FROM c WHERE EXISTS (SELECT 1 FROM prod WHERE pre[1:len(parts)] = parts OR parts[1:len(pre)] = pre)""")
def category_prefix_semi(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("url"))
    products = tree.product_prefixes(p, 3, least_parts=2)
    return tree.with_products(tree.category_paths(p, 3, exclude=(), noise=None), products).select(F.array_join("parts", "/").alias("category"))


# ------------------------------------------------------------------ links

_L = "WITH a AS (SELECT page_id, url, html, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)))) AS pos FROM pages)\n"


@query(_L + "SELECT page_id, pos::BIGINT AS pos, href FROM a")
def page_links(spark, sf_dir):
    return tree.anchors(table(spark, sf_dir, "pages"), "page_id").select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query(_L + "SELECT page_id, href, min(pos)::BIGINT AS pos FROM a GROUP BY page_id, href")
def page_links_distinct_first(spark, sf_dir):
    return predicates.select_first(tree.anchors(table(spark, sf_dir, "pages"), "page_id"), ["page_id", "href"], ["pos"]).select("page_id", "href", F.col("pos").cast("long").alias("pos"))


@query(_L + "SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, count(*)::BIGINT AS links, count(DISTINCT href)::BIGINT AS targets FROM a GROUP BY 1")
def links_per_host(spark, sf_dir):
    a = tree.anchors(table(spark, sf_dir, "pages"), "page_id", "url")
    counted = a.groupBy(urls.authority(F.col("url")).alias("host"), "href").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("host").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("targets"))


@query("""SELECT page_id, len(regexp_extract_all(lower(html), '<script'))::BIGINT AS scripts, len(regexp_extract_all(lower(html), '<a href='))::BIGINT AS links, length(html)::BIGINT AS n_chars,
    contains(lower(html), 'captcha') AS challenge, contains(lower(html), 'application/ld+json') AS json_ld FROM pages""")
def page_signals(spark, sf_dir):
    low = F.lower("html")
    n = lambda p: F.size(F.regexp_extract_all(low, F.lit(p), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n("<script").alias("scripts"), n("<a href=").alias("links"), F.length("html").cast("long").alias("n_chars"), (text.challenge_in_html(F.col("html")) != "").alias("challenge"), low.contains("application/ld+json").alias("json_ld"))


@query("""WITH r AS (SELECT 0 AS pos, '/en/' AS p, 'english' AS target UNION ALL SELECT 1, '[.]html', 'article' UNION ALL SELECT 2, 'page=', 'paged')
SELECT page_id, arg_min(target, pos) AS target FROM pages JOIN r ON regexp_matches(url, p) GROUP BY page_id""")
def first_rule_wins(spark, sf_dir):
    return score.first_rule(table(spark, sf_dir, "pages").select("page_id", "url"), "url", [("/en/", "english"), ("[.]html", "article"), ("page=", "paged")]).select("page_id", "target")


# ------------------------------------------------------------------ frontier


def _frontier(spark, sf_dir):
    rank = F.when(F.col("o_orderpriority").startswith("1"), 5).when(F.col("o_orderpriority").startswith("2"), 4).otherwise(1)
    o = table(spark, sf_dir, "orders")
    url = F.concat(F.lit("http://h"), (F.col("o_custkey") % 20).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"))
    created = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double")
    rows = o.select(url.alias("url"), created.alias("created_at"), rank.alias("priority"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"))
    blank = frontier.incoming(rows.select("url"), 0.0).limit(0).drop("outcome", "priority", "status", "created_at")
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in blank.schema if f.name not in ("url", "url_hash", "domain", "locked_at", "attempts")]
    return rows.select("url", urls.url_hash(F.col("url")).alias("url_hash"), urls.authority(F.col("url")).alias("domain"), "priority", "status", "created_at", F.when(F.col("status") == "running", F.col("created_at")).otherwise(0.0).alias("locked_at"), F.lit(0).alias("attempts"), *more)


_F = """WITH f AS (SELECT 'http://h' || (o_custkey % 20) || '/' || o_orderkey AS url, epoch(o_orderdate)::DOUBLE AS created_at, CASE WHEN o_orderpriority LIKE '1%' THEN 5 WHEN o_orderpriority LIKE '2%' THEN 4 ELSE 1 END AS priority,
    CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status, 'h' || (o_custkey % 20) AS domain FROM orders),
b AS (SELECT * FROM f WHERE status = 'queued' OR (status = 'running' AND created_at < 880000000 - 900) ORDER BY priority DESC, created_at, sha256(url) LIMIT 25)
"""


@query(_F + "SELECT url, priority::INT AS priority, status FROM b")
def frontier_next_batch(spark, sf_dir):
    return frontier.next_batch(_frontier(spark, sf_dir), 880000000.0, 25).select("url", "priority", "status")


@query(_F + "SELECT url, CASE WHEN url IN (SELECT url FROM b) THEN 'done' ELSE status END AS status FROM f")
def frontier_mark(spark, sf_dir):
    f = _frontier(spark, sf_dir)
    batch = frontier.next_batch(f, 880000000.0, 25)
    leased = frontier.lease(f, batch, 880000000.0, token="t")
    return frontier.mark_done(leased, leased.filter(F.col("lease_token") == "t"), 880000001.0).select("url", "status")


@query(_F + "SELECT status, count(*)::BIGINT AS n FROM f GROUP BY status")
def frontier_stats(spark, sf_dir):
    return frontier.status_counts(_frontier(spark, sf_dir))


@query(_F + "SELECT domain, count(*)::BIGINT AS n FROM f GROUP BY domain ORDER BY n DESC, domain LIMIT 20")
def frontier_top_domains(spark, sf_dir):
    return frontier.top_domains(_frontier(spark, sf_dir))


@query(_U + """, c AS (SELECT page_id, scheme || '://' || auth || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS c FROM u),
old AS (SELECT DISTINCT c FROM c WHERE page_id % 2 = 0), new AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY page_id) AS k FROM c)
SELECT CASE WHEN k = 1 AND c NOT IN (SELECT c FROM old) THEN 'added' ELSE 'skipped' END AS outcome, count(*)::BIGINT AS n FROM new GROUP BY 1""")
def frontier_add(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    empty = spark.createDataFrame([], frontier.SCHEMA)
    known, _ = frontier.add_urls(empty, p.filter("page_id % 2 = 0"), 1.0, order="page_id")
    return frontier.add_urls(known, p, 2.0, order="page_id")[1]


@query("""WITH u AS (SELECT DISTINCT 'http://h' || (o_custkey % 20) || '/' || o_orderkey AS url FROM orders), a AS (SELECT url, row_number() OVER (ORDER BY sha256(url)) <= 500 AS first, sha256(url) AS h FROM u),
d AS (SELECT *, first AND right(h, 1) BETWEEN '0' AND '7' AS done FROM a), b AS (SELECT *, NOT done AND row_number() OVER (PARTITION BY done ORDER BY h) <= 500 AS second FROM d)
SELECT url, CASE WHEN done THEN 'done' WHEN second THEN 'running' ELSE 'queued' END AS status, first::INT + second::INT AS attempts FROM b""")
def frontier_log_state(spark, sf_dir):
    """All orders' URLs through a stored frontier: added, leased, done or failed, leased again, with compactions between."""
    stored = StoredFrontier(spark, new_path(spark, "frontier"), buckets=16)
    given = table(spark, sf_dir, "orders").select(F.concat(F.lit("http://h"), F.col("o_custkey") % 20, F.lit("/"), F.col("o_orderkey")).alias("url"), F.col("o_orderkey").alias("pos"))
    stored.add(given, 1.0, order="pos", priority=1)
    stored.compact()
    stored.add(given, 1.5, order="pos", priority=9)
    leased = stored.lease(2.0, 500, token="a")
    low = F.substring("url_hash", 64, 1).between("0", "7")
    stored.done(leased.filter(low), 3.0)
    stored.failed(leased.filter(~low), 4.0, "later")
    stored.lease(5.0, 500, token="b")
    stored.compact()
    return stored.table().select("url", "status", "attempts")


# ------------------------------------------------------------------ memory


@query("""WITH e AS (SELECT *, (event_type <> 'error')::INT AS ok FROM events), i AS (SELECT *, sum(1 - ok) OVER w AS a, sum(ok) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, sum(ok) OVER (PARTITION BY user_id, a ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS success_streak, sum(1 - ok) OVER (PARTITION BY user_id, b ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS fail_streak FROM i""")
def domain_streaks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return memory.streaks(e, "user_id", ["ts", "event_id"], F.col("event_type") != "error").select("event_id", "success_streak", "fail_streak")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, event_type <> 'error' AS ok FROM events),
l AS (SELECT user_id, max((ts, event_id)) FILTER (ok) AS g, max((ts, event_id)) FILTER (NOT ok) AS b, arg_max(event_type, (ts, event_id)) FILTER (ok) AS mode, count(*) AS n FROM e GROUP BY user_id)
SELECT user_id, any_value(mode) AS preferred_mode, count(*) FILTER (ok AND (b IS NULL OR (ts, event_id) > b))::BIGINT AS success_streak, count(*) FILTER (NOT ok AND (g IS NULL OR (ts, event_id) > g))::BIGINT AS fail_streak, any_value(n)::BIGINT AS attempts
FROM e JOIN l USING (user_id) GROUP BY user_id""")
def domain_memory_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    state = memory.domain_memory(e, "user_id", ["ts", "event_id"], F.col("event_type") != "error", F.col("event_type"), F.col("ts"))
    return state.select(F.col("key").alias("user_id"), "preferred_mode", "success_streak", "fail_streak", "attempts")


@query("""WITH s AS (SELECT user_id % 50 AS key, max(epoch(ts)) FILTER (event_type <> 'error') AS last, arg_max(event_type, (ts, event_id)) AS newest FROM events GROUP BY 1)
SELECT o_orderkey, coalesce(last >= 1700000000 - 7 * 86400 AND newest <> 'error', false) AS hit FROM orders LEFT JOIN s ON key = o_custkey % 70""")
def domain_memory_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.col("user_id") % 50)
    state = memory.domain_memory(e, "k", ["ts", "event_id"], F.col("event_type") != "error", F.col("event_type"), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    state = state.withColumn("fail_streak", F.when(F.col("fail_streak") > 0, F.lit(3)).otherwise(F.lit(0)))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 70).alias("k"))
    return memory.lookup(state, o, "k", 1700000000.0).select("o_orderkey", "hit")


@query("""WITH e AS (SELECT *, event_type <> 'error' AS ok FROM events)
SELECT event_id, count(*) OVER w::BIGINT AS n_recent, round(avg(ok::INT) OVER w, 6) AS rate FROM e WINDOW w AS (PARTITION BY user_id % 7 ORDER BY ts, event_id ROWS 19 PRECEDING)""".replace("count(*) OVER w::BIGINT", "(count(*) OVER w)::BIGINT"))
def proxy_recent_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("proxy", F.col("user_id") % 7)
    return memory.recent_rates(e, "proxy", ["ts", "event_id"], F.col("event_type") != "error").select("event_id", "n_recent", F.round("rate", 6).alias("rate"))


@query("""WITH e AS (SELECT event_id, ts, user_id % 7 AS p, (event_type IN ('view', 'click'))::INT AS ok FROM events),
i AS (SELECT *, sum(ok) OVER w AS b, sum(1 - ok) OVER w AS total, count(*) OVER r AS n, avg(ok) OVER r AS rate FROM e WINDOW w AS (PARTITION BY p ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY p ORDER BY ts, event_id ROWS 19 PRECEDING)),
s AS (SELECT *, sum(1 - ok) OVER (PARTITION BY p, b ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
SELECT event_id, least(60 * greatest(streak, total), 600)::BIGINT AS penalty FROM s WHERE ok = 0 AND (streak >= 3 OR (n >= 10 AND rate < 0.5))""")
def proxy_disabled(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("proxy", F.col("user_id") % 7)
    r = memory.recent_rates(e, "proxy", ["ts", "event_id"], F.col("event_type").isin("view", "click"))
    return r.filter("disabled").select("event_id", F.col("penalty").cast("long").alias("penalty"))


@query("SELECT event_id, max(s - 5 * (k - 1)) OVER w + 5 * (k - 1) AS starts_at FROM (SELECT event_id, user_id % 20 AS d, epoch(ts)::BIGINT AS s, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS k FROM events) WINDOW w AS (PARTITION BY d ORDER BY k ROWS UNBOUNDED PRECEDING)".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def rate_limit_schedule(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"d": F.col("user_id") % 20, "s": F.unix_seconds(F.col("ts").cast("timestamp"))})
    return memory.next_allowed(e, "d", ["ts", "event_id"], F.col("s"), F.lit(5)).select("event_id", "starts_at")


@query("""WITH t AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS gone, sum(n_chars) OVER () AS total FROM documents) SELECT doc_id FROM t WHERE gone >= total - 0.9 * 1000000 OR total <= 1000000""")
def cache_prune(spark, sf_dir):
    return memory.prune_cache(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", ["doc_id"], 1000000).select("doc_id")


@query("SELECT page_id, md5(url || '1' || 'v') AS key FROM pages")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", memory.cache_key(F.col("url"), F.lit(1), F.lit("v")).alias("key"))


@query("SELECT doc_id % 100 AS key, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY 1")
def target_memory_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("key"), "doc_id", "lang", F.col("doc_id").alias("at"))
    return memory.upsert_latest(d, "key", "at").select("key", "doc_id", "lang")


@query("SELECT user_id, arg_min(mode, k) AS mode FROM (SELECT user_id, CASE event_type WHEN 'view' THEN 'browser' WHEN 'click' THEN 'curl_cffi' ELSE 'requests' END AS mode, CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS k, value FROM events) WHERE k > 0 AND value > 20 GROUP BY user_id")
def escalation_chain(spark, sf_dir):
    m = F.when(F.col("event_type") == "view", "browser").when(F.col("event_type") == "click", "curl_cffi").otherwise("requests")
    e = table(spark, sf_dir, "events").select("user_id", m.alias("mode"), "value")
    return memory.first_working_mode(e, "user_id", "mode", F.col("value") > 20, F.lit(False)).select("user_id", "mode")


# ------------------------------------------------------------------ conditions and tables


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND p_size = 7")
def where_eq_and(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.filter(predicates.where('{"p_brand": "Brand#11", "p_size": 7}', p.schema)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'part 1')")
def where_like_literal(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.filter(predicates.where('[{"field": "p_name", "op": "LIKE", "value": "Part 1"}]', p.schema)).select("p_partkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_acctbal <= 5000 AND c_mktsegment <> 'BUILDING' ORDER BY c_custkey LIMIT 50 OFFSET 20")
def where_range_page(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    spec = [{"field": "c_acctbal", "op": ">", "value": 1000}, {"field": "c_acctbal", "op": "<=", "value": 5000}, {"field": "c_mktsegment", "op": "!=", "value": "BUILDING"}]
    return c.filter(predicates.where(spec, c.schema)).orderBy("c_custkey").offset(20).limit(50).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey FROM orders WHERE try_cast(regexp_extract(o_orderpriority, '-?[0-9]+(?:[.][0-9]+)?') AS DOUBLE) >= 3")
def condition_numeric(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.filter(predicates.condition("o_orderpriority >= 3", o.schema)).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE contains(text, 'the ')")
def condition_contains(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.filter(predicates.condition("text contains \"the \"", d.schema)).select("doc_id")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
def condition_exists(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.filter(predicates.condition("quality exists", d.schema)).select("doc_id")


@query("""WITH a AS (SELECT s_suppkey AS k, s_nationkey AS n, 0 AS side FROM supplier UNION ALL SELECT c_custkey, c_nationkey, 1 FROM customer)
SELECT n AS nationkey, min(k) AS first FROM a WHERE side = 1 AND n NOT IN (SELECT n FROM a WHERE side = 0) GROUP BY n""")
def sole_id_append(spark, sf_dir):
    schema = store.TableSchema.parse({"columns": {"pos": "INTEGER", "nationkey": "INTEGER"}, "unique": ["nationkey"]})
    side = lambda t, k, n: table(spark, sf_dir, t).select(F.col(k).alias("pos"), F.col(n).alias("nationkey"))
    ready = lambda df: store.prepare(df, schema).drop("errors")
    stored = store.new_records(None, ready(side("supplier", "s_suppkey", "s_nationkey")), schema, F.col("pos"))
    added = store.new_records(stored, ready(side("customer", "c_custkey", "c_nationkey")), schema, F.col("pos"))
    return added.select(F.col("nationkey").cast("int").alias("nationkey"), F.col("pos").alias("first"))


@query("SELECT d.doc_id, l.quality IS NULL AS missing, length(d.text) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def prepare_required_strict(spark, sf_dir):
    schema = store.TableSchema.parse({"columns": {"doc_id": "INTEGER", "text": "TEXT", "quality": "REAL"}, "required": ["doc_id", "quality"]})
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return store.prepare(d, schema).select("doc_id", F.array_contains("errors", "missing:quality").alias("missing"), F.length("text").cast("long").alias("n"))


@query("SELECT s_suppkey, s_name, NULL::BIGINT AS c_custkey, NULL::VARCHAR AS c_name FROM supplier UNION ALL SELECT NULL, NULL, c_custkey, c_name FROM customer")
def schema_evolve_union(spark, sf_dir):
    return store.evolve(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), table(spark, sf_dir, "customer").select("c_custkey", "c_name"))


@query("SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY source")
def format_by_source(spark, sf_dir):
    return store.group_by_source(table(spark, sf_dir, "documents"), F.col("source"))


@query("SELECT p_brand AS title, arg_max(p_name, p_partkey) AS url, min(p_partkey) AS pos FROM part GROUP BY p_brand")
def format_title_dict(spark, sf_dir):
    return store.title_dict(table(spark, sf_dir, "part"), "p_brand", "p_name", F.col("p_partkey"))


# ------------------------------------------------------------------ profiles


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("""WITH t AS (SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'doc_id' AS field, round(avg((doc_id IS NULL)::INT), 4) AS missing_rate FROM t UNION ALL SELECT 'lang', round(avg((lang IS NULL OR lang = '')::INT), 4) FROM t UNION ALL SELECT 'source', round(avg((source IS NULL OR source = '')::INT), 4) FROM t
UNION ALL SELECT 'quality', round(avg((quality IS NULL)::INT), 4) FROM t UNION ALL SELECT 'toxic', round(avg((toxic IS NULL)::INT), 4) FROM t""")
def profile_missing(spark, sf_dir):
    return profile.missing_rates(_labelled(spark, sf_dir))


@query("""WITH t AS (SELECT lang, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), m AS (SELECT count(*) AS n, round(avg((quality IS NULL)::INT), 4) AS a, round(avg((toxic IS NULL)::INT), 4) AS b FROM t)
SELECT n::BIGINT AS records, 4::BIGINT AS fields, round((n - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))) / n, 4) AS duplicate_rate, round(1 - (a + b) / 4, 4) AS completeness, 0::BIGINT AS empty_records FROM m""")
def profile_quality(spark, sf_dir):
    return profile.quality(_labelled(spark, sf_dir).drop("doc_id"))


@query("""WITH v AS (SELECT 'p_brand' AS field, p_brand AS v FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part UNION ALL SELECT 'p_type', p_type FROM part)
SELECT field, count(*)::BIGINT AS n, count(DISTINCT v)::BIGINT AS unique_count, round(avg(regexp_matches(v, '[0-9]')::INT), 6) AS number_ratio, round(avg(length(v)), 6) AS average_length FROM v GROUP BY field""")
def profile_fields(spark, sf_dir):
    s = profile.field_stats(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type"), "p_partkey")
    return s.select("field", "n", "unique_count", F.round("number_ratio", 6).alias("number_ratio"), F.round("average_length", 6).alias("average_length"))


@query("""WITH f AS (SELECT p_brand AS v, min(p_partkey) AS k FROM part GROUP BY 1), g AS (SELECT p_type AS v, min(p_partkey) AS k FROM part GROUP BY 1)
SELECT 'p_brand' AS field, string_agg(v, '|' ORDER BY k) AS samples FROM (SELECT * FROM f ORDER BY k LIMIT 5) UNION ALL SELECT 'p_type', string_agg(v, '|' ORDER BY k) FROM (SELECT * FROM g ORDER BY k LIMIT 5)""")
def profile_samples(spark, sf_dir):
    s = profile.field_stats(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), "p_partkey")
    return s.select("field", F.array_join("samples", "|").alias("samples"))


# ------------------------------------------------------------------ texts and scores


@query("SELECT doc_id, trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g')) AS text FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), a AS (SELECT doc_id, CASE WHEN strpos(t, 'All Rights Reserved') > 0 THEN left(t, strpos(t, 'All Rights Reserved') - 1) ELSE t END AS t FROM
    (SELECT doc_id, CASE WHEN strpos(t, 'Copyright') > 0 THEN left(t, strpos(t, 'Copyright') - 1) ELSE t END AS t FROM c)) SELECT doc_id, trim(t) AS t FROM a""")
def clean_description(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_description(F.col("text")).alias("t"))


@query("SELECT p_partkey, try_cast(regexp_extract(replace('about ' || p_retailprice || ' for ' || p_size, ',', ''), '-?[0-9]+(?:[.][0-9]+)?') AS DOUBLE) AS x FROM part")
def extract_number(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.extract_number(F.concat(F.lit("about "), F.col("p_retailprice").cast("string"), F.lit(" for "), F.col("p_size").cast("string"))).alias("x"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'USD' WHEN 2 THEN 'CNY' ELSE '' END AS currency,
    CASE o_orderkey % 4 WHEN 0 THEN 10000 + o_custkey WHEN 1 THEN CASE WHEN o_custkey < 1000 THEN o_custkey * 1000 ELSE o_custkey END WHEN 2 THEN o_custkey % 50 * 1000 END AS salary_min,
    CASE o_orderkey % 4 WHEN 0 THEN 'YEAR' WHEN 1 THEN 'YEAR' WHEN 2 THEN 'MONTH' ELSE '' END AS salary_period, o_orderkey % 4 = 3 AS salary_negotiable FROM orders""")
def salary_parse(spark, sf_dir):
    k, n = F.col("o_orderkey") % 4, F.col("o_custkey")
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    raw = F.when(k == 0, c("USD ", 10000 + n, " - 99,000 / year")).when(k == 1, c("$", n, "k-$", n + 5, "k")).when(k == 2, c(n % 50, "-", n % 50 + 5, "K")).otherwise(F.lit("面议"))
    s = table(spark, sf_dir, "orders").select("o_orderkey", text.parse_salary(raw).alias("s"))
    return s.select("o_orderkey", "s.currency", "s.salary_min", "s.salary_period", "s.salary_negotiable")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'China' ELSE 'United States' END AS country, CASE WHEN n_nationkey % 2 = 0 THEN '北京/上海' ELSE 'New York' END AS city, n_nationkey % 3 = 0 AS is_remote FROM nation""")
def location_dictionary(spark, sf_dir):
    raw = F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.lit("上海, 北京 ")).otherwise(F.lit("office in new york ")), F.col("n_name"), F.when(F.col("n_nationkey") % 3 == 0, F.lit(" Remote")).otherwise(F.lit("")))
    x = table(spark, sf_dir, "nation").select("n_nationkey", text.normalize_location(raw).alias("l"))
    return x.select("n_nationkey", "l.country", "l.city", "l.is_remote")


_SITE = {k: v for k, v in text.SITE_WORDS.items()}


@query("SELECT doc_id, " + ", ".join(f"round(least(1.0, ({' + '.join(f'''contains(lower(text), '{w}')::INT''' for w in ws)}) / 5.0{' + 0.25' if k == 'ecommerce' else ''}), 3) AS {k}" for k, ws in _SITE.items()) + " FROM documents")
def site_type_scores(spark, sf_dir):
    s = text.site_type_scores(F.col("text"), ["title", "price"])
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in s.items()])


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{p}') THEN '{p}'" for p in text.CHALLENGE_PATTERNS) + " ELSE '' END AS challenge FROM documents")
def challenge_first_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.challenge_in_html(F.col("text")).alias("challenge"))


def _any(words):
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


@query("WITH d AS (SELECT doc_id, lower(text) AS t, length(text) AS n FROM documents), c AS (SELECT doc_id, list_filter([CASE WHEN " + _any(text.PAGE_CHALLENGE_PATTERNS) + " THEN 'challenge' END, " + ", ".join(f"CASE WHEN {_any(ws)}{' AND n <= 2000' if k == 'login_required' else ''} THEN '{k}' END" for k, ws in text.ACCESS_KEYWORDS.items()) + "], lambda x: x IS NOT NULL) AS c FROM d) SELECT doc_id, CASE WHEN len(c) = 0 THEN 'html_available' ELSE array_to_string(c, ',') END AS categories FROM c")
def access_categories(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.access_categories(F.col("text")), ",").alias("categories"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'cf-mitigated' WHEN event_type = 'click' THEN 'akamai_abck' WHEN user_id % 5 = 0 THEN 'status=503' ELSE '' END AS challenge,
    CASE WHEN (event_type = 'error' AND user_id % 2 = 0) OR event_type = 'click' THEN 'high' WHEN user_id % 5 = 0 THEN 'low' ELSE 'none' END AS confidence FROM events""")
def challenge_in_response(spark, sf_dir):
    kind, u = F.col("event_type"), F.col("user_id")
    heads = F.when((kind == "error") & (u % 2 == 0), F.create_map(F.lit("CF-Mitigated"), F.lit("1"))).otherwise(F.create_map(F.lit("server"), F.lit("x")))
    jars = F.when(kind == "click", F.create_map(F.lit("_abck"), F.lit("1"))).otherwise(F.create_map(F.lit("a"), F.lit("x")))
    c = text.challenge_in_response(F.when(u % 5 == 0, 503).otherwise(200), heads, jars, F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", c.alias("c")).select("event_id", "c.challenge", "c.confidence")


@query("""WITH e AS (SELECT event_id, user_id, event_type, 'http://h/' || CASE user_id % 3 WHEN 0 THEN 'api/x?page=' || user_id WHEN 1 THEN 'a.png' || user_id ELSE 'plain' || user_id END AS url FROM events),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY url ORDER BY event_id) = 1)
SELECT url, CASE WHEN event_type IN ('view', 'click') THEN 35 ELSE 0 END + CASE WHEN user_id % 3 = 0 THEN 25 + 20 + 20 ELSE 0 END + 10 AS score FROM f ORDER BY score DESC, event_id LIMIT 30""")
def network_summary(spark, sf_dir):
    u = F.col("user_id")
    url = F.concat(F.lit("http://h/"), F.when(u % 3 == 0, F.concat(F.lit("api/x?page="), u)).when(u % 3 == 1, F.concat(F.lit("a.png"), u)).otherwise(F.concat(F.lit("plain"), u)))
    e = table(spark, sf_dir, "events").select(url.alias("url"), F.when(F.col("event_type").isin("view", "click"), "xhr").otherwise("image").alias("resource_type"), F.lit("").alias("content_type"), F.lit(200).alias("status"), F.col("event_id").alias("pos"))
    return score.network_candidates(e, "pos", 30).select("url", "score")


@query("""SELECT p_partkey % 40 AS sample, round(0.3 + 0.45 + CASE WHEN bool_and(length(p_name) BETWEEN 5 AND 180) THEN 0.12 ELSE 0 END, 3)::DOUBLE AS title_score, round(0.3 + 0.45 + 0.18, 3)::DOUBLE AS price_score
FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS k FROM part) WHERE k <= 5 GROUP BY 1""")
def field_quality_scores(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select((F.col("p_partkey") % 40).alias("sample"), F.col("p_partkey").alias("pos"), F.create_map(F.lit("title"), F.col("p_name"), F.lit("price"), F.col("p_retailprice").cast("string")).alias("values"))
    q = score.field_quality(rows, {"title": "h1", "price": "span.price"}, key="sample", order="pos")
    return q.groupBy("sample").agg(F.max(F.when(F.col("field") == "title", F.col("score"))).alias("title_score"), F.max(F.when(F.col("field") == "price", F.col("score"))).alias("price_score"))


@query("""WITH v AS (SELECT l_linestatus AS field, l_returnflag AS selector, min(l_orderkey * 10 + l_linenumber) AS first, count(*) AS votes FROM lineitem GROUP BY 1, 2)
SELECT field, selector, votes::BIGINT AS votes FROM v QUALIFY row_number() OVER (PARTITION BY field ORDER BY votes DESC, first) = 1""")
def selector_vote(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("field"), F.col("l_returnflag").alias("selector"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return score.vote(v, "field", "selector", "pos").select("field", "selector", "votes")


@query("SELECT url, any_value(kind) AS kind, max(confidence) AS confidence FROM (SELECT p_brand AS url, 'network' AS kind, p_size AS confidence FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_brand, 'network', p_size FROM part WHERE p_partkey % 2 = 1) GROUP BY url ORDER BY confidence DESC, url LIMIT 12")
def rank_sources_union(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    half = lambda k: p.filter(F.col("p_partkey") % 2 == k).select(F.col("p_brand").alias("url"), F.lit("network").alias("kind"), F.col("p_size").alias("confidence"))
    return score.rank_sources([half(0), half(1)], ["kind", "url"], [F.desc("confidence"), F.asc("url")], 12).select("url", "kind", "confidence")


@query("""WITH c AS (SELECT 'p_name' AS field UNION ALL SELECT 'p_brand' UNION ALL SELECT 'p_retailprice' UNION ALL SELECT 'p_image'), q AS (SELECT 'p_name' AS field, 0.9 AS score UNION ALL SELECT 'p_brand', 0.5)
SELECT field, CASE WHEN field = 'p_retailprice' THEN 'REAL' ELSE 'TEXT' END AS type, coalesce(q.score, 0.0)::DOUBLE AS score, CASE WHEN q.score >= 0.82 THEN 'A' WHEN q.score >= 0.65 THEN 'B' WHEN q.score >= 0.45 THEN 'C' ELSE 'D' END AS grade FROM c LEFT JOIN q USING (field)""")
def recommend_schema_left_join(spark, sf_dir):
    plan = spark.createDataFrame([("p_name",), ("p_brand",), ("p_retailprice",), ("p_image",)], "field string")
    q = spark.createDataFrame([("p_name", 0.9), ("p_brand", 0.5)], "field string, score double")
    return score.recommend_schema(plan, q)


@query("""WITH a AS (SELECT DISTINCT p_type AS t FROM part WHERE p_brand = 'Brand#11'), b AS (SELECT DISTINCT p_type AS t FROM part WHERE p_brand = 'Brand#12')
SELECT coalesce(a.t, b.t) AS title, CASE WHEN a.t IS NULL THEN 'missing' WHEN b.t IS NULL THEN 'only' ELSE 'shared' END AS side FROM a FULL JOIN b ON a.t = b.t""")
def menu_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    of = lambda b: p.filter(F.col("p_brand") == b).select(F.col("p_type").alias("title")).distinct()
    return tree.menu_diff(of("Brand#11"), of("Brand#12"), "title")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn)::BIGINT AS nth FROM conversations")
def nth_of_type(spark, sf_dir):
    return tree.nth_of_type(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn").select("conv_id", "turn", "role", F.col("nth").cast("long").alias("nth"))


@query("SELECT conv_id, turn, (length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS delta FROM conversations")
def lag_delta(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("long"))
    return tree.deltas(c, ["conv_id"], "turn", "n").select("conv_id", "turn", "delta")


@query("""WITH RECURSIVE g AS (SELECT DISTINCT user_id AS u FROM events), b(u, d) AS (SELECT min(u), 0 FROM g UNION SELECT t.u, d + 1 FROM b, LATERAL (SELECT unnest([b.u * 2, b.u * 3, b.u + 1]) AS u) t WHERE d < 3 AND t.u <= (SELECT max(u) FROM g))
SELECT u AS node, min(d)::INT AS depth FROM b GROUP BY u""")
def bfs_levels(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    low, high = u.agg(F.min("user_id"), F.max("user_id")).first()
    start = spark.createDataFrame([(low,)], "node long")
    follow = lambda front: front.select(F.explode(F.array(F.col("node") * 2, F.col("node") * 3, F.col("node") + 1)).alias("node")).filter(F.col("node") <= high)
    return bfs(start, follow, 3).select("node", "depth")


# ------------------------------------------------------------------ extensions on event time


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("WITH s AS (SELECT time_bucket(INTERVAL 15 minute, ts) AS b FROM events) SELECT b - INTERVAL (k * 15) minute AS start, count(*)::BIGINT AS n FROM s, range(4) r(k) GROUP BY 1")
def ext_sliding(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""WITH l AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 minute AS gap FROM events), s AS (SELECT *, sum(coalesce(gap, true)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def ext_session(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


# ------------------------------------------------------------------ documents parsed

# Pages with their canonical URL, the decoded text of their h1 and of their title, and their links as absolute URLs.
_DECODED = "replace(replace(replace(replace(replace(replace({}, '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&middot;', chr(183)), '&copy;', chr(169)), '&amp;', '&')"
_P = (
    _U
    + f""", c AS (SELECT page_id, scheme || '://' || auth AS root, scheme || '://' || auth || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical FROM u),
p AS (SELECT c.*, url, html, trim(regexp_replace({_DECODED.format("regexp_extract(html, '<h1>([^<]*)', 1)")}, '\\s+', ' ', 'g')) AS h1, trim(regexp_replace({_DECODED.format("regexp_extract(html, '<title>([^<]*)', 1)")}, '\\s+', ' ', 'g')) AS title,
    list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: c.root || {_DECODED.format('x')}) AS links FROM c JOIN pages USING (page_id))
"""
)
# And their text: what stands between tags, without scripts, styles and comments, a piece a line.
_T = (
    _P
    + f""", r AS (SELECT *, regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<!--.*?-->', chr(1), 'gs') AS bare FROM p),
t AS (SELECT *, array_to_string(list_filter(list_transform(string_split(regexp_replace(bare, '<[^>]*(>|$)', chr(1), 'g'), chr(1)), lambda x: trim({_DECODED.format('x')}, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), chr(10)) AS text FROM r)
"""
)
_WORDS_IN = lambda goal, words: "(" + " + ".join(f"contains(lower({goal}), '{w}')::INT" for w in words) + ")"


def _analysis(goal: str, asked: str = "") -> str:
    """The columns of an analysis over _T, by its definitions: challenge, score and site type."""
    challenge = "CASE " + " ".join(f"WHEN contains(lower(html), '{p}') THEN '{p}'" for p in text.CHALLENGE_PATTERNS) + " ELSE '' END"
    scores = {k: f"round(least(1.0, {_WORDS_IN(goal, ws)} / 5.0{' + 0.25' if k == asked else ''}), 3)" for k, ws in text.SITE_WORDS.items()}
    top = f"greatest({', '.join(scores.values())})"
    kind = f"CASE WHEN {top} < 0.2 THEN 'unknown' " + " ".join(f"WHEN {v} = {top} THEN '{k}'" for k, v in scores.items()) + " END"
    return f"{challenge} AS challenge, ((least(length(html), 500000) + 5) // 10 - CASE WHEN {challenge} <> '' THEN 25000 ELSE 0 END - CASE WHEN length(html) < 500 THEN 5000 ELSE 0 END) / 100 AS response_score, {kind} AS site_type"



@query(_U + """, a AS (SELECT page_id, scheme || '://' || auth AS root, unnest(regexp_extract_all((SELECT html FROM pages p WHERE p.page_id = u.page_id), '<a href="([^"]*)"', 1)) AS href FROM u)
SELECT page_id, root || replace(href, '&amp;', '&') AS link, count(*)::BIGINT AS n FROM a WHERE href LIKE '/%' GROUP BY 1, 2""")
def dom_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.links(pages, 'a[href^="/"]').groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, tag, len(regexp_extract_all(html, '<' || tag || '[ >]'))::BIGINT AS n FROM pages, (SELECT unnest(['li', 'a', 'nav', 'h1', 'article']) AS tag)""")
def dom_element_counts(spark, sf_dir):
    e = extract.elements(table(spark, sf_dir, "pages").select("page_id", "html"))
    return e.filter(F.col("tag").isin("li", "a", "nav", "h1", "article")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&')) AS title, length(html)::BIGINT AS html_chars, 1::BIGINT AS scripts FROM pages")
def dom_fields_and_signals(spark, sf_dir):
    pages = extract.signals(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    got = extract.fields_of(pages, {"title": "title::text"})
    return got.select("page_id", F.col("fields")["title"][0].alias("title"), "signals.html_chars", "signals.scripts")


@query(_T + "SELECT page_id, length(text)::INT AS n, md5(text) AS text FROM t")
def dom_page_text(spark, sf_dir):
    return extract.page_text(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.length("text").alias("n"), F.md5("text").alias("text"))


@query(_P + """SELECT page_id, 'link' AS field, 0::INT AS rank, 'a@href' AS selector, round(list_sum(list_transform(links, lambda x: 1.0 + 3 * regexp_matches(x, '(?i)(\\.html$|/producten/|/product/|/p/|pid=|sku=)')::INT)) + 5 * len(list_distinct(links)), 3)::DOUBLE AS score, len(list_distinct(links))::INT AS hits FROM p WHERE len(links) > 0
UNION ALL SELECT page_id, 'title', 0, 'h1', round(least(length(h1), 120) / 12 + 13, 3), 1 FROM p WHERE length(h1) >= 2
UNION ALL SELECT page_id, 'title', (length(h1) >= 2)::INT, 'title', round(least(length(title), 120) / 12 + 5, 3), 1 FROM p WHERE length(title) >= 2""")
def selector_candidates(spark, sf_dir):
    return extract.selector_candidates(table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["link", "title"]).select("page_id", "field", "rank", "selector", "score", "hits")


@query(_P + """SELECT field, selector, votes, (SELECT count(*) FROM p) AS rows, round(votes / (SELECT count(*) FROM p), 3)::DOUBLE AS confidence FROM
    (SELECT 'link' AS field, 'a@href' AS selector, count(*) FILTER (len(links) > 0)::BIGINT AS votes FROM p UNION ALL SELECT 'title', 'h1', count(*) FILTER (length(h1) >= 2) FROM p)""")
def site_spec(spark, sf_dir):
    return report.site_spec(table(spark, sf_dir, "pages").select("url", "html"), ["link", "title"])


@query(_U + """SELECT page_id, 0::INT AS rank, CASE WHEN regexp_matches(q, '(^|&)page=[0-9]+') THEN 'current_query_pattern' ELSE 'page_param_guess' END AS kind,
    CASE WHEN regexp_matches(q, '(^|&)page=[0-9]+') THEN regexp_replace(url, '([?&])page=[0-9]+', '\\1page=' || (regexp_extract(q, '(?:^|&)page=([0-9]+)', 1)::BIGINT + 1)) ELSE url || CASE WHEN q <> '' THEN '&' ELSE '?' END || 'page=2' END AS next,
    CASE WHEN regexp_matches(q, '(^|&)page=[0-9]+') THEN 0.78 ELSE 0.45 END::DOUBLE AS confidence FROM u""")
def pagination_candidates(spark, sf_dir):
    return extract.pagination(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "rank", "kind", "next", "confidence")


@query("SELECT page_id, 0::INT AS pos, '' AS hint, '' AS source, false AS json_like, false AS paged FROM pages WHERE regexp_matches(html, '(?i)<script[^>]*>[^<]*(https?:)?/[a-z0-9]+[^<]*(api|graphql|ajax)')")
def api_hints(spark, sf_dir):
    return extract.api_hints(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "pos", "hint", "source", "json_like", "paged")


@query(_T + f""", a AS (SELECT page_id, lower(text) AS t, {_analysis("'news articles ' || url || ' ' || text")} FROM t),
k AS (SELECT *, list_filter([CASE WHEN {_any(text.PAGE_CHALLENGE_PATTERNS)} THEN 'challenge' END, {", ".join(f"CASE WHEN {_any(ws)}{' AND length(t) <= 2000' if k == 'login_required' else ''} THEN '{k}' END" for k, ws in text.ACCESS_KEYWORDS.items())}], lambda x: x IS NOT NULL) AS c FROM a)
SELECT page_id, challenge, false AS js_shell, CASE WHEN len(c) = 0 THEN 'html_available' ELSE array_to_string(c, ',') END AS categories, response_score, site_type, challenge = '' AS ok FROM k""")
def page_analysis(spark, sf_dir):
    a = report.analyze(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "news articles", ["title"])
    return a.select("page_id", "challenge", "js_shell", F.array_join("categories", ",").alias("categories"), "response_score", "site_type", "ok")


@query(_T + f""", a AS (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, {_analysis("' ' || url || ' ' || text")} FROM t),
n AS (SELECT host, site_type, count(*) AS n FROM a GROUP BY host, site_type), m AS (SELECT host, max((n, site_type)) AS best FROM n GROUP BY host)
SELECT host, count(*)::BIGINT AS pages, count(*) FILTER (challenge = '')::BIGINT AS ok, (2 * round(sum(response_score) * 100)::BIGINT + count(*)) // (2 * count(*)) / 100 AS mean_score, any_value(best[2]) AS site_type FROM a JOIN m USING (host) GROUP BY host""")
def site_summary(spark, sf_dir):
    return report.site_summary(report.analyze(table(spark, sf_dir, "pages").select("url", "html")))


@query("SELECT event_id, 'k' AS path, 'number' AS kind, props->>'$.k' AS value FROM events WHERE json_exists(props, '$.k')")
def json_walk(spark, sf_dir):
    return jsonshape.nodes(table(spark, sf_dir, "events").select("event_id", "props"), "props").filter("path <> '$'").select("event_id", "path", "kind", "value")


@query("SELECT event_id, props->>'$.k' AS k FROM events")
def json_path_dialect(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", jsonshape.json_path(F.col("props"), "k").alias("k"))


@query("SELECT page_id, url AS loc, '2024-01-0' || (page_id % 9 + 1) AS lastmod FROM pages")
def sitemap_entries(spark, sf_dir):
    p = table(spark, sf_dir, "pages").filter("url is not null")
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2024-01-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("</lastmod></url></urlset>"))
    return sitemap.entries(p.select("page_id", xml.alias("body"))).select("page_id", "loc", "lastmod")


@query(_U + "SELECT page_id, NOT (path LIKE '/en/%' AND NOT path LIKE '/en/1%') AS can_fetch FROM u")
def robots_allowed(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = p.select(urls.host(F.col("url")).alias("host")).distinct().withColumn("body", F.lit("User-agent: *\nDisallow: /en/\nAllow: /en/1"))
    return sitemap.allowed(p, sitemap.robots_rules(hosts)).select("page_id", "can_fetch").distinct()


@query("SELECT s_nationkey AS nationkey, min(s_suppkey) AS suppkey, 'n' || s_nationkey AS name FROM supplier GROUP BY s_nationkey")
def store_round_trip(spark, sf_dir):
    s = store.Store(spark, new_path(spark, "store"))
    s.register("d", "t", {"columns": {"nationkey": "INTEGER", "suppkey": "INTEGER", "name": "TEXT"}, "unique": ["nationkey"]})
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_suppkey").alias("suppkey"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("name"))
    s.save(rows, "d", "t", order="suppkey")
    s.save(rows, "d", "t", order="suppkey")
    return s.table("d", "t").select(F.col("nationkey").cast("int").alias("nationkey"), "suppkey", "name")


@query(_P + "SELECT DISTINCT canonical AS url, h1 AS title FROM p WHERE canonical IS NOT NULL AND h1 <> ''")
def pipeline_run(spark, sf_dir):
    pages = LandedPages(table(spark, sf_dir, "pages").select("url", "html"))
    spec = {"steps": [{"step": "frontier_add", "source": "pages"}, {"step": "frontier_next", "limit": "all"}, {"step": "crawl_products", "fields": {"title": "h1", "links": "a@href"}}, {"step": "filter", "condition": "title exists"}]}
    return Pipeline(spec).run(spark, pages, now=1.0).records.select("url", "title")


@query(_P + """, s AS (SELECT DISTINCT canonical AS url FROM p WHERE canonical LIKE 'http%://_%'), l AS (SELECT DISTINCT regexp_replace(unnest(links), '#.*$', '') AS url FROM (SELECT max_by(links, html) AS links FROM p GROUP BY canonical))
SELECT url, 0::INT AS depth, true AS found FROM s UNION ALL SELECT url, 1, false FROM l WHERE url NOT IN (SELECT url FROM s)""")
def crawl_levels(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("url", "html")
    return crawl(pages, CrawlSpec(pages.select("url"), max_depth=2))


_SITE = """WITH e AS (SELECT 'http://shop.example/region/' || n_regionkey AS s, 'http://shop.example/nation/' || n_nationkey AS t FROM nation
    UNION SELECT 'http://shop.example/nation/' || c_nationkey, 'http://shop.example/customer/' || c_custkey FROM customer UNION SELECT 'http://shop.example/customer/' || c_custkey, 'http://shop.example/region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION SELECT 'http://shop.example/customer/' || o_custkey, 'http://shop.example/order/' || o_orderkey FROM orders UNION SELECT 'http://shop.example/order/' || l_orderkey, 'http://shop.example/part/' || l_partkey FROM lineitem
    UNION SELECT 'http://shop.example/order/' || o_orderkey, 'http://shop.example/customer/' || o_custkey FROM orders)
"""


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (url, html) of a shop of the tables: regions link to nations, those to customers, these to orders and back, orders to parts, which have no pages."""
    t = {x: table(spark, sf_dir, x) for x in ("nation", "customer", "orders", "lineitem")}
    at = lambda kind, key: F.concat(F.lit(f"/{kind}/"), F.col(key))
    edge = lambda df, *ends: df.select(at(*ends[:2]).alias("s"), at(*ends[2:]).alias("t"))
    home = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    edges = [edge(t["nation"], "region", "n_regionkey", "nation", "n_nationkey"), edge(t["customer"], "nation", "c_nationkey", "customer", "c_custkey"), edge(home, "customer", "c_custkey", "region", "n_regionkey")]
    edges += [edge(t["orders"], "customer", "o_custkey", "order", "o_orderkey"), edge(t["lineitem"], "order", "l_orderkey", "part", "l_partkey"), edge(t["orders"], "order", "o_orderkey", "customer", "o_custkey")]
    linked = edges[0]
    for e in edges[1:]:
        linked = linked.unionByName(e)
    anchors = F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.array_sort(F.collect_set("t")), lambda x: F.concat(F.lit('<a href="'), x, F.lit('">x</a>'))), ""), F.lit("</body></html>"))
    return linked.groupBy("s").agg(anchors.alias("html")).select(F.concat(F.lit("http://shop.example"), "s").alias("url"), "html")


@query(_SITE + """, l0 AS (SELECT DISTINCT 'http://shop.example/region/' || r_regionkey AS u FROM region), l1 AS (SELECT DISTINCT t AS u FROM e JOIN l0 ON s = u WHERE t NOT IN (SELECT u FROM l0)),
l2 AS (SELECT DISTINCT t AS u FROM e JOIN l1 ON s = u WHERE t NOT IN (SELECT u FROM l0 UNION SELECT u FROM l1)), l3 AS (SELECT DISTINCT t AS u FROM e JOIN l2 ON s = u WHERE t NOT IN (SELECT u FROM l0 UNION SELECT u FROM l1 UNION SELECT u FROM l2)),
l4 AS (SELECT DISTINCT t AS u FROM e JOIN l3 ON s = u WHERE t NOT IN (SELECT u FROM l0 UNION SELECT u FROM l1 UNION SELECT u FROM l2 UNION SELECT u FROM l3)),
a AS (SELECT u, 0 AS d FROM l0 UNION ALL SELECT u, 1 FROM l1 UNION ALL SELECT u, 2 FROM l2 UNION ALL SELECT u, 3 FROM l3 UNION ALL SELECT u, 4 FROM l4)
SELECT u AS url, d::INT AS depth, u IN (SELECT s FROM e) AS found FROM a""")
def crawl_site_depths(spark, sf_dir):
    start = table(spark, sf_dir, "region").select(F.concat(F.lit("http://shop.example/region/"), F.col("r_regionkey")).alias("url"))
    return crawl(site_pages(spark, sf_dir), CrawlSpec(start, max_depth=4))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """The same windows by a stream that reads all there is, into a memory table, and ends."""
    source = table(spark, sf_dir, "events")
    path = new_path(spark, "stream")
    source = source.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    source.write.parquet(path)
    stream = spark.readStream.schema(source.schema).parquet(path)
    name = "stream_tumbling_result"
    q = streams.tumbling(stream, "event_type").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
