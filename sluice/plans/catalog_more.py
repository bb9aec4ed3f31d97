"""More queries over the driver's tables, each with its DuckDB equivalent; added to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import predicates, text, urls
from sluice.operators import extract, frontier, jsonshape, memory, score, store, tree
from sluice.plans import report
from sluice.plans.catalog import _P, _T, _U, _analysis, query, table
from sluice.session import new_path
from sluice.sources import records, sitemap

# ------------------------------------------------------------------ URLs and texts


@query(_U + """SELECT page_id, auth = 'example.org' OR auth LIKE '%.example.org' AS of_org, regexp_matches(path, '(?i)(/dp/[A-Z0-9]{10}\\b|/gp/product/|/detail/|/product/|/products/|/p/|\\.html$)') AS detail,
    regexp_matches(lower(path), '\\.(json|graphql)$|/graphql|/api/') AS json_like, regexp_matches(lower(path), '\\.(js|css|png|jpe?g|gif|webp|svg|ico|woff2?|ttf|map)$') AS static, regexp_matches(q, '(^|&)page=') AS paged, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS extension FROM u""")
def url_kinds(spark, sf_dir):
    u = F.col("url")
    params = urls.pagination_params(u)
    checks = {"of_org": urls.domain_matches(urls.host(u), ["example.org"]), "detail": urls.looks_like_detail(u), "json_like": urls.is_json_like(u), "static": urls.is_static_asset(u), "paged": urls.has_strong_pagination(params), "extension": urls.extension(u)}
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(k) for k, c in checks.items()])


@query(_P + """, l AS (SELECT page_id, root, unnest(links) AS link FROM p) SELECT page_id, count(*)::BIGINT AS n, count(*) FILTER (starts_with(link, root || '/') OR link = root)::BIGINT AS same FROM l GROUP BY page_id""")
def same_site_links(spark, sf_dir):
    found = extract.links(table(spark, sf_dir, "pages").select("page_id", "url", "html").withColumn("base", F.col("url")))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(urls.same_site(F.col("link"), F.col("base"))).alias("same"))


@query("""SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || lower(substr(split_part(p_name, ' ', 2), 2)) AS label,
    'brand_' || lower(substr(p_brand, 7)) || '_' || p_size AS safe, replace(p_brand, '#', '\\#') AS css, '| ' || p_name || ' | ' || p_size || ' |' AS row FROM part""")
def part_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    slug, raw = F.replace("p_name", F.lit(" "), F.lit("-_")), F.concat(F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit(" / ")), F.lit(" "), F.col("p_size").cast("string"), F.lit("! "))
    return p.select("p_partkey", text.label(slug).alias("label"), text.safe_name(raw).alias("safe"), text.css_escape(F.col("p_brand")).alias("css"), text.markdown_row(F.col("p_name"), F.col("p_size")).alias("row"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[0-9]{2,}'))::BIGINT AS numbers, regexp_extract(text, '([a-z]+) ([0-9]+)', 2) AS first, array_to_string(list_sort(string_split(left(text, 12), '')), '') AS sorted
FROM documents WHERE NOT regexp_matches(left(text, 12), '[^\\x00-\\x7F]')""")
def document_patterns(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    first = F.coalesce(F.get(text.regex_all(F.col("text"), "([a-z]+) ([0-9]+)", 2), F.lit(0)), F.lit(""))
    ascii_head = ~F.substring("text", 1, 12).rlike(r"[^\x00-\x7F]")
    return d.filter(ascii_head).select("doc_id", F.size(text.regex_all(F.col("text"), "[0-9]{2,}")).cast("long").alias("numbers"), first.alias("first"), text.sort_characters(F.substring("text", 1, 12)).alias("sorted"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 400 + o_custkey % 100 WHEN 1 THEN 500 + o_custkey % 100 END::INT AS status FROM orders""")
def error_statuses(spark, sf_dir):
    code = lambda base: (base + F.col("o_custkey") % 100).cast("string")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("failed: http "), code(400), F.lit(" for url"))).when(F.col("o_orderkey") % 3 == 1, F.concat(code(500), F.lit(" Server Error"))).otherwise(F.concat(F.lit("after "), F.col("o_custkey").cast("string"), F.lit(" ms")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.http_status(said).alias("status"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'bolt')")
def where_like_word(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.filter(predicates.where('[{"field": "p_name", "op": "LIKE", "value": "BOLT"}]', p.schema)).select("p_partkey")


# ------------------------------------------------------------------ stores and records


@query("""SELECT c_custkey AS key, c_custkey * 2 AS first FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def append_unseen(spark, sf_dir):
    """Customers that no event names, appended to a store that has the events' users; each is offered twice."""
    schema = store.TableSchema.parse({"columns": {"pos": "INTEGER", "key": "INTEGER"}, "unique": ["key"]})
    ready = lambda df: store.prepare(df, schema).drop("errors")
    seen = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("key"))
    stored = store.new_records(None, ready(seen), schema, F.col("pos"))
    c = table(spark, sf_dir, "customer").select(F.explode(F.array(F.col("c_custkey") * 2 + 1, F.col("c_custkey") * 2)).alias("pos"), F.col("c_custkey").alias("key"))
    return store.new_records(stored, ready(c), schema, F.col("pos")).select("key", F.col("pos").alias("first"))


@query("""SELECT 'nation' AS t, n_nationkey::VARCHAR AS key, n_name AS name FROM nation UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_name FROM supplier""")
def store_export_read(spark, sf_dir):
    """Two tables saved, listed, exported as CSV and as JSON lines, and read as records again."""
    s = store.Store(spark, new_path(spark, "store"))
    s.save(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), "d", "nation", order="key")
    s.save(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), "d", "supplier", order="key")
    out = None
    for row, kind in zip(s.tables().orderBy("table").collect(), ("csv", "jsonl"), strict=True):
        path = f"{new_path(spark, 'export')}"
        s.export(row["db"], row["table"], path, kind)
        read = records.read_records(spark, path, kind).select(F.lit(row["table"]).alias("t"), F.col("key").cast("string").alias("key"), "name")
        out = read if out is None else out.unionByName(read)
    return out


@query("""SELECT c_custkey, unnest(['http://a.example/' || c_custkey, 'http://b.example/' || c_nationkey]) AS url FROM customer""")
def candidate_urls(spark, sf_dir):
    """Lists of URLs told in three ways, by customer."""
    a, b = F.concat(F.lit("http://a.example/"), F.col("c_custkey").cast("string")), F.concat(F.lit("http://b.example/"), F.col("c_nationkey").cast("string"))
    k = F.col("c_custkey") % 3
    said = F.when(k == 0, F.to_json(F.array(a, b))).when(k == 1, F.to_json(F.struct(F.array(a, b).alias("urls")))).otherwise(F.concat(a, F.lit(",\n "), b))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(records.candidate_urls(said)).alias("url"))


@query("""WITH e AS (SELECT event_type AS key, event_id, ts FROM events) SELECT key, arg_max(event_id, (ts, event_id)) AS latest FROM e GROUP BY key""")
def cache_latest(spark, sf_dir):
    """Cache entries written over each other: of each key the latest is read."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("text"), F.struct("ts", "event_id").alias("timestamp"))
    entries = memory.put(e.filter("cast(text as long) % 2 = 0"), e.filter("cast(text as long) % 2 = 1"))
    return entries.select("key", F.col("text").cast("long").alias("latest"))


@query("""WITH r AS (SELECT event_id AS seq, user_id AS f, event_id % 3 AS p, event_type = 'error' AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT seq, row_number() OVER (ORDER BY p DESC, seq) AS n FROM r WHERE d OR k = 1""")
def scheduler_order(spark, sf_dir):
    """Requests once each, but for those that may repeat, in the order they are handed out."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("fingerprint"), (F.col("event_id") % 3).alias("priority"), (F.col("event_type") == "error").alias("dont_filter"))
    return frontier.hand_out(e).select("seq", "n")


# ------------------------------------------------------------------ pages with data in them


def _shop(spark, sf_dir):
    """A page for every brand: its parts as a list, JSON-LD of the first, a state with all, a script that calls an API."""
    p = table(spark, sf_dir, "part")
    item = F.struct("p_partkey", "p_name", F.col("p_retailprice").cast("double").alias("price"))
    by = p.groupBy("p_brand").agg(F.sort_array(F.collect_list(item)).alias("items")).withColumn("n", F.substring("p_brand", 7, 9))
    cards = F.array_join(F.transform("items", lambda x: F.concat(F.lit('<li class="item"><a href="/p/'), x["p_partkey"].cast("string"), F.lit('">'), x["p_name"], F.lit("</a></li>"))), "")
    first = F.get("items", F.lit(0))
    jsonld = F.to_json(F.struct(F.lit("Product").alias("@type"), first["p_name"].alias("name"), first["p_partkey"].alias("sku")))
    state = F.to_json(F.struct(F.struct(F.transform("items", lambda x: F.struct(x["p_partkey"].alias("id"), x["p_name"].alias("title"))).alias("list")).alias("catalog")))
    html = F.concat(
        F.lit('<html><head><title>Shop</title><meta property="og:title" content="'), F.col("p_brand"), F.lit('"><meta name="viewport" content="x"><script type="application/ld+json">'), jsonld,
        F.lit("</script></head><body><h1>Brand "), F.col("n"), F.lit('</h1><ul class="list">'), cards, F.lit("</ul><script>window.__INITIAL_STATE__ = "), state, F.lit(';fetch("/api/brands/'), F.col("n"), F.lit('?page=2&limit=10")</script></body></html>'),
    )
    return by.select(F.col("n").cast("int").alias("brand"), F.concat(F.lit("http://shop.example/b/"), "n").alias("url"), html.alias("html"))


_BRANDS = "WITH b AS (SELECT substr(p_brand, 7)::INT AS brand, min(p_partkey) AS sku, arg_min(p_name, p_partkey) AS name, count(*) AS n FROM part GROUP BY 1) "


@query(_BRANDS + "SELECT brand, 'Brand ' || brand AS title, 'Brand#' || brand AS og, name, sku::VARCHAR AS sku FROM b")
def page_structured_data(spark, sf_dir):
    s = F.col("structured")
    one = F.get(s["jsonld"], F.lit(0))
    return extract.structured_data(_shop(spark, sf_dir)).select("brand", s["title"].alias("title"), s["meta"]["og:title"].alias("og"), F.get_json_object(one, "$.name").alias("name"), F.get_json_object(one, "$.sku").alias("sku"))


@query(_BRANDS + "SELECT brand, '__INITIAL_STATE__' AS state, n::BIGINT AS n, name AS first FROM b")
def page_states(spark, sf_dir):
    found = extract.states(_shop(spark, sf_dir).select("brand", "html")).filter("state_name = '__INITIAL_STATE__'")
    items = F.variant_get("data", "$.catalog.list", "array<struct<id:bigint,title:string>>")
    return found.select("brand", F.col("state_name").alias("state"), F.size(items).cast("long").alias("n"), F.get(items, F.lit(0))["title"].alias("first"))


@query(_BRANDS + "SELECT brand, 'http://shop.example/api/brands/' || brand || '?page=2&limit=10' AS hint, 'script' AS source, true AS json_like, true AS paged FROM b")
def api_hints_landed(spark, sf_dir):
    hints = extract.api_hints(_shop(spark, sf_dir)).filter(F.contains("hint", F.lit("/api/")))
    return hints.select("brand", "hint", "source", "json_like", "paged")


@query("""SELECT substr(p_brand, 7)::INT AS brand, p_name AS text FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) > 1""")
def similar_items(spark, sf_dir):
    """The items of each list that stand where its first does."""
    return extract.find_similar(_shop(spark, sf_dir).select("brand", "html"), "li.item").select("brand", "text")


@query(_BRANDS + "SELECT brand, 'catalog.list' AS path, n::INT AS n, 'catalog.list[0].title' AS title, 'catalog.list[0].id' AS id FROM b")
def state_shapes(spark, sf_dir):
    """Of each page's state its list of items and the paths of titles and ids in it."""
    found = extract.states(_shop(spark, sf_dir).select("brand", "html")).select("brand", F.to_json("data").alias("j"))
    walked = jsonshape.nodes(found, "j")
    arrays = jsonshape.item_arrays(walked, "brand")
    inside = walked.filter(F.col("path").startswith("catalog.list[0]"))
    paths = jsonshape.field_paths(inside, "brand").groupBy("brand").agg(F.max(F.when(F.col("field") == "title", F.col("path"))).alias("title"), F.max(F.when(F.col("field") == "id", F.col("path"))).alias("id"))
    return arrays.join(paths, "brand").select("brand", "path", "n", "title", "id")


# ------------------------------------------------------------------ sitemaps and menus


@query("""SELECT 'http://h.example/c/' || c_custkey AS loc, '2024-02-' || lpad((1 + c_nationkey)::VARCHAR, 2, '0') AS lastmod FROM customer""")
def sitemap_expand(spark, sf_dir):
    """An index of indexes of urlsets, by region and nation, expanded to all customers."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    at = lambda kind, key: F.concat(F.lit(f"http://h.example/{kind}-"), F.col(key).cast("string"), F.lit(".xml"))
    wrap = lambda outer, inner: F.concat(F.lit(f"<{outer}>"), F.array_join(F.collect_list(inner), ""), F.lit(f"</{outer}>"))
    child = lambda where: F.concat(F.lit("<sitemap><loc>"), where, F.lit("</loc></sitemap>"))
    row = F.concat(F.lit("<url><loc>http://h.example/c/"), F.col("c_custkey").cast("string"), F.lit("</loc><lastmod>2024-02-"), F.lpad((1 + F.col("c_nationkey")).cast("string"), 2, "0"), F.lit("</lastmod></url>"))
    top = n.agg(F.array_join(F.transform(F.collect_set("n_regionkey"), lambda k: F.concat(F.lit("<sitemap><loc>http://h.example/region-"), k.cast("string"), F.lit(".xml</loc></sitemap>"))), "").alias("b")).select(F.lit("http://h.example/sitemap.xml").alias("url"), F.concat(F.lit("<sitemapindex>"), "b", F.lit("</sitemapindex>")).alias("body"))
    regions = n.groupBy("n_regionkey").agg(wrap("sitemapindex", child(at("nation", "n_nationkey"))).alias("body")).select(at("region", "n_regionkey").alias("url"), "body")
    nations = c.groupBy("c_nationkey").agg(wrap("urlset", row).alias("body")).select(at("nation", "c_nationkey").alias("url"), "body")
    landed = top.unionByName(regions).unionByName(nations)
    return sitemap.expand(landed, top.select("url")).select("loc", "lastmod")


@query("""WITH t AS (SELECT DISTINCT p_brand, p_type FROM part), s AS (SELECT DISTINCT p_brand, p_type, p_size FROM part) SELECT p_brand AS brand, p_type AS path, '/t/' || lower(p_type) AS url FROM t
UNION ALL SELECT p_brand, p_type || ' > Size ' || p_size, '/s/' || p_type || '/' || p_size FROM s WHERE p_size % 5 <> 0""")
def menu_trails(spark, sf_dir):
    """The menus of all brands as JSON, flattened to trails; hidden entries are left out."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size").distinct()
    size = F.col("p_size").cast("string")
    leaf = F.struct(F.concat(F.lit("Size "), size).alias("title"), F.concat(F.lit("/s/"), "p_type", F.lit("/"), size).alias("url"), (F.col("p_size") % 5 == 0).alias("hidden"))
    kinds = p.groupBy("p_brand", "p_type").agg(F.collect_list(leaf).alias("children"))
    menus = kinds.groupBy("p_brand").agg(F.to_json(F.collect_list(F.struct(F.col("p_type").alias("name"), F.concat(F.lit("/t/"), F.lower("p_type")).alias("href"), "children"))).alias("j"))
    rows = jsonshape.menus(menus, "j", "").filter("reason = ''")
    keyed = rows.select("p_brand", F.concat("p_brand", F.lit(":"), F.col("node_id").cast("string")).alias("node_id"), F.when(F.col("parent_id").isNotNull(), F.concat("p_brand", F.lit(":"), F.col("parent_id").cast("string"))).alias("parent_id"), "pos", "title", "url")
    brands = keyed.select("p_brand", "node_id")
    entries = tree.menu_entries(keyed.select("node_id", "parent_id", F.struct("pos", "node_id").alias("pos"), "title", "url"))
    return entries.join(brands, entries["pos"]["node_id"] == brands["node_id"]).select(F.col("p_brand").alias("brand"), "path", "url")


@query("""SELECT p_type AS path, 20 + CASE WHEN lower(p_type) LIKE '%standard%' THEN 0 ELSE 0 END + 25 + least(count(*), 20)::INT AS score FROM part GROUP BY p_type""")
def menu_source_scores(spark, sf_dir):
    n = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("p_type").alias("path"), score.menu_source_score(F.concat(F.lit("a.mainMenu."), "p_type"), F.lit(True), F.col("n")).cast("int").alias("score"))


@query("""SELECT p_partkey, ((CASE WHEN p_size % 2 = 0 THEN 7 ELSE 0 END) + (CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 0 END) + (CASE WHEN p_size % 5 = 0 THEN 6 ELSE 0 END) - (CASE WHEN p_partkey % 7 = 0 THEN 6 ELSE 0 END))::INT AS points FROM part""")
def selector_points(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    selector = F.concat(F.lit("div"), F.when(size % 2 == 0, "#main").otherwise(""), F.when(key % 3 == 0, ".price").otherwise(""), F.when(size % 5 == 0, "[itemprop='x']").otherwise(""), F.when(key % 7 == 0, " css-abcd").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", score.selector_stability(selector).cast("int").alias("points"))


# ------------------------------------------------------------------ what an analysis leaves


@query(_T + f""", a AS (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, {_analysis("' ' || url || ' ' || text")}, CASE WHEN regexp_matches(url, '[?&]page=[0-9]+') THEN 'current_query_pattern' ELSE 'page_param_guess' END AS paging FROM t),
k AS (SELECT host, max((n, site_type)) AS best FROM (SELECT host, site_type, count(*) AS n FROM a GROUP BY host, site_type) GROUP BY host), g AS (SELECT host, max((n, paging)) AS best FROM (SELECT host, paging, count(*) AS n FROM a GROUP BY host, paging) GROUP BY host)
SELECT lower(k.best[2] || '|' || host || '|http://' || host || '/') AS target_key, k.best[2] AS target_type, g.best[2] AS pagination_type, (SELECT count(*) FROM a WHERE a.host = k.host)::BIGINT AS pages, 'h1' AS title, 2.0::DOUBLE AS updated_at FROM k JOIN g USING (host)""")
def targets_remembered(spark, sf_dir):
    """The hosts of all pages as targets, remembered twice: the later record of each stays."""
    facts = report.site_facts(table(spark, sf_dir, "pages").select("url", "html"))
    known = report.remember_targets(None, facts, 1.0)
    known = report.remember_targets(known, facts, 2.0)
    return known.select("target_key", "target_type", "pagination_type", "pages", F.col("selectors")["title"].alias("title"), "updated_at")


@query(_BRANDS + "SELECT 'shop.example' AS host, 'network_pagination' AS action, 'json' AS strategy, 0.78::DOUBLE AS confidence, 5::BIGINT AS n FROM (SELECT count(*) AS c FROM b) WHERE c >= 5 UNION ALL SELECT 'shop.example', 'paginate', 'page_param_guess', 0.45, 5 FROM (SELECT count(*) AS c FROM b) WHERE c >= 5")
def interaction_map(spark, sf_dir):
    facts = report.site_facts(_shop(spark, sf_dir).select("url", "html"))
    return report.interactions(facts).select("host", "action", "strategy", F.col("confidence").cast("double").alias("confidence"), F.size("samples").cast("long").alias("n"))


@query(_P + "SELECT page_id, replace(link, '/', '|') AS link FROM (SELECT page_id, unnest(links) AS link FROM p) WHERE NOT contains(link, 'the')")
def processed_links(spark, sf_dir):
    """Links through a function of one's own, which changes some and drops others."""
    found = extract.links(table(spark, sf_dir, "pages").select("page_id", "url", "html"), process=lambda link: None if "the" in link else link.replace("/", "|"))
    return found.select("page_id", "link")
