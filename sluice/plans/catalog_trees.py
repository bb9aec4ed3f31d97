"""Queries over trees, rules, documents, streams and by table functions; added to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import udtf, urls
from sluice.operators import jsonshape, menus, relocate, tree
from sluice.plans.catalog import _P, query, table
from sluice.session import new_path, write_out
from sluice.sources import sitemap, tail
from sluice.streaming import leases


@query("""WITH u AS (SELECT DISTINCT l_partkey AS k, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS f, l_linenumber AS n, CASE WHEN l_linenumber % 3 <> 0 THEN 'html' ELSE 'pdf' END AS e FROM lineitem),
r AS (SELECT '/part/' || k || '/' || f || n || '.' || e AS path, k, f, e FROM u)
SELECT 'http://shop.example' || path AS url, greatest(CASE WHEN path LIKE '/part/9%' THEN 7 ELSE 0 END, CASE WHEN k % 2 = 0 AND f = 'a' AND e = 'html' THEN length('/part/' || k || '/a*.html$') ELSE 0 END)
    >= greatest(CASE WHEN e = 'pdf' THEN 7 ELSE 0 END, CASE WHEN k % 3 = 0 THEN length('/part/' || k || '/') ELSE 0 END) AS can_fetch FROM r""")
def robots_longest_match(spark, sf_dir):
    """A host with rules for all parts, plain ones, with * and with $, against a URL for each part and line."""
    k = F.col("p_partkey").cast("string")
    own = F.concat_ws("\n", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Disallow: /part/"), k, F.lit("/"))), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Allow: /part/"), k, F.lit("/a*.html$"))))
    lines = table(spark, sf_dir, "part").agg(F.array_join(F.collect_list(own), "\n").alias("lines"))
    robots = lines.select(F.lit("shop.example").alias("host"), F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /*.pdf$\nAllow: /part/9\n"), "lines").alias("body"))
    n = F.col("l_linenumber")
    file = F.concat(F.when(n % 2 == 0, "a").otherwise("b"), n.cast("string"), F.when(n % 3 != 0, ".html").otherwise(".pdf"))
    urls = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("http://shop.example/part/"), F.col("l_partkey").cast("string"), F.lit("/"), file).alias("url")).distinct()
    return sitemap.allowed(urls, sitemap.robots_rules(robots)).select("url", "can_fetch")


def _paths(spark, sf_dir):
    """A category path of five levels for every part."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.array("p_brand", "p_type", F.concat(F.lit("s"), F.col("p_size").cast("string"))), F.slice(F.split("p_name", " "), 1, 2)).alias("parts"))


_PATHS = """p AS (SELECT [p_brand, p_type, 's' || p_size] || string_split(p_name, ' ')[1:2] AS parts FROM part), leaf AS (SELECT parts, count(*) AS n FROM p GROUP BY parts)"""


@query(f"""WITH RECURSIVE {_PATHS}, up AS (SELECT parts, n, true AS here FROM leaf UNION ALL SELECT parts[:-2], n, false FROM up WHERE len(parts) > 1),
t AS (SELECT parts, coalesce(sum(n) FILTER (here), 0) AS own, sum(n) AS total FROM up GROUP BY parts),
below AS (SELECT parts AS node, parts FROM t UNION ALL SELECT node, parts[:-2] FROM below WHERE len(parts) > 1),
k AS (SELECT parts, count(*) AS nodes, count(*) FILTER (len(node) = len(parts) + 1) AS children FROM below GROUP BY parts)
SELECT array_to_string(parts, '/') AS path, len(parts)::INT AS depth, own::BIGINT AS own, total::BIGINT AS total, nodes::BIGINT AS nodes, children::BIGINT AS children FROM t JOIN k USING (parts)""")
def category_counts(spark, sf_dir):
    counts = tree.subtree_counts(_paths(spark, sf_dir))
    return counts.select(F.array_join("parts", "/").alias("path"), F.col("depth").cast("int").alias("depth"), "own", "total", "nodes", "children")


_FOLDED = ", ".join(f"l{d} AS (SELECT p, sum(n) AS n, bool_or(i) AS i FROM (SELECT p[:{d}] AS p, CASE WHEN s THEN 0 ELSE n END AS n, s AS i FROM k{d + 1}) GROUP BY p), k{d} AS (SELECT p, n, i, i OR n >= 5 OR {d} = 1 AS s FROM l{d})" for d in (4, 3, 2, 1))


@query(f"WITH {_PATHS}, k5 AS (SELECT parts AS p, n, false AS i, n >= 5 AS s FROM leaf), {_FOLDED} " + " UNION ALL ".join(f"SELECT array_to_string(p, '/') AS path, {d}::INT AS depth, n::BIGINT AS own FROM k{d} WHERE s" for d in range(1, 6)))
def category_fold(spark, sf_dir):
    """The category tree with leaves of five parts or more."""
    folded = tree.fold_small(tree.subtree_counts(_paths(spark, sf_dir)), 5)
    return folded.select(F.array_join("parts", "/").alias("path"), F.col("depth").cast("int").alias("depth"), "own")


_MENU = """WITH p AS (SELECT p_brand AS site, lower(p_type) AS t, p_size AS z, p_partkey AS k, lower(p_name) AS name, CASE p_partkey % 100 WHEN 0 THEN 'removed' WHEN 1 THEN 'renamed' WHEN 2 THEN 'added' ELSE 'same' END AS c FROM part),
q AS (SELECT *, bool_or(c <> 'same') OVER (PARTITION BY site, t) AS tc, bool_or(c <> 'same') OVER (PARTITION BY site, t, z) AS zc FROM p)
SELECT site, CASE WHEN tc THEN 'changed' ELSE 'same' END AS change, t AS one_path, t AS other_path, (CASE WHEN tc THEN 1 ELSE 1 + count(DISTINCT z) + count(*) END)::BIGINT AS nodes FROM q GROUP BY site, t, tc
UNION ALL SELECT site, CASE WHEN zc THEN 'changed' ELSE 'same' END, t || ' > ' || z, t || ' > ' || z, CASE WHEN zc THEN 1 ELSE 1 + count(*) END FROM q WHERE tc GROUP BY site, t, z, zc
UNION ALL SELECT site, CASE c WHEN 'added' THEN 'same' ELSE c END, t || ' > ' || z || ' > ' || name, CASE WHEN c <> 'removed' THEN t || ' > ' || z || ' > ' || CASE c WHEN 'renamed' THEN 'new ' ELSE '' END || name END, 1 FROM q WHERE zc
UNION ALL SELECT site, 'added', NULL, t || ' > ' || z || ' > added ' || k, 1 FROM q WHERE c = 'added'"""


@query(_MENU)
def menu_compare(spark, sf_dir):
    """The menus of all brands (types, sizes, parts) against later ones with parts removed, renamed and added."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("site"), "p_type", F.col("p_size").cast("string").alias("z"), F.col("p_partkey").alias("k"), "p_name")
    t, z = F.concat(F.lit("t"), "p_type"), F.concat(F.lit("z"), "p_type", F.lit("/"), "z")
    upper = p.select("site", t.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("pos"), F.col("p_type").alias("title"), t.alias("url")).distinct()
    upper = upper.unionByName(p.select("site", z.alias("node_id"), t.alias("parent_id"), F.lit(0).cast("long").alias("pos"), F.col("z").alias("title"), z.alias("url")).distinct())
    leaf = lambda df, name, title: df.select("site", F.concat(F.lit(name), "k").alias("node_id"), z.alias("parent_id"), F.col("k").cast("long").alias("pos"), title.alias("title"), F.concat(F.lit(f"/{name}/"), "k").alias("url"))
    before = upper.unionByName(leaf(p, "p", F.col("p_name")))
    named = F.when(F.col("k") % 100 == 1, F.concat(F.lit("New "), "p_name")).otherwise(F.col("p_name"))
    after = upper.unionByName(leaf(p.filter("k % 100 <> 0"), "p", named)).unionByName(leaf(p.filter("k % 100 = 2"), "n", F.concat(F.lit("Added "), "k")))
    return menus.compare(before, after)


@query(_P + """SELECT page_id, 'title' AS name, h1 AS text FROM p UNION ALL SELECT page_id, 'advert', trim(regexp_replace(regexp_extract(html, '<div class="ad">([^<]*)', 1), '\\s+', ' ', 'g')) FROM p""")
def relocated_elements(spark, sf_dir):
    """A heading and an advert stored from the least page of each host, found again on all pages of the host after a change of tags and classes."""
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("site"), "html")
    first = pages.join(pages.groupBy("site").agg(F.min("page_id").alias("least")), "site").filter("page_id = least")
    stored = write_out(relocate.fingerprints(first, {"title": "h1", "advert": "div.ad"}), "fingerprints")
    changed = pages.withColumn("html", F.replace(F.replace(F.replace("html", F.lit("<article"), F.lit("<section class='new'")), F.lit("</article"), F.lit("</section")), F.lit('<div class="ad"'), F.lit('<div class="promo"')))
    found = relocate.relocate_all(changed, stored)
    return found.groupBy("page_id", "name").agg(F.min_by(F.trim(F.regexp_replace("text", r"\s+", " ")), F.length("path")).alias("text"))


@query("""WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), s AS (SELECT k, least(3 * n, 45) + 35 + 30 + 24 AS score FROM c)
SELECT k, 'data.items' AS path, score::INT AS score, 4::BIGINT AS n_fields, true AS has_pagination, round(least(0.3 + least(score / 160, 0.45) + 0.2 + 0.08, 0.95), 3) AS confidence FROM s""")
def api_models(spark, sf_dir):
    """The responses of an API: the orders of each customer as items, nested two levels down, beside a page number."""
    o = table(spark, sf_dir, "orders")
    item = F.struct(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderkey").alias("id"))
    by = o.groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    docs = by.select("k", F.to_json(F.struct(F.struct("items", F.lit(1).alias("page")).alias("data"))).alias("j"))
    return jsonshape.api_models(docs, "j", "k").select("k", "path", F.col("score").cast("int").alias("score"), F.col("n_fields").cast("long").alias("n_fields"), "has_pagination", "confidence")


@query("""WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS j FROM lineitem),
o AS (SELECT o_custkey AS k, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT k, 'orders[' || i || '].parts[' || j || ']' AS path, 'number' AS kind, p::VARCHAR AS value FROM o JOIN l USING (o)""")
def json_walk_nested(spark, sf_dir):
    """Leaves of nested documents, a customer's orders with their parts: every child of every list, at any depth."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("parts"))  # noqa: E741
    o = table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    by = o.groupBy(F.col("o_custkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "parts"))), lambda x: F.struct(x["parts"].alias("parts"))).alias("orders"))
    docs = by.select("k", F.to_json(F.struct("orders")).alias("j"))
    return jsonshape.nodes(docs, "j").filter("kind = 'number'").select("k", "path", "kind", "value")


@query("""WITH e AS (SELECT user_id % 20 AS d, event_id::VARCHAR AS u, epoch_us(ts::TIMESTAMP) // 1000 AS ms FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ms, u) - 1 AS k FROM e)
SELECT d::VARCHAR AS domain, u AS url, 1 AS attempt, (max(ms - 5000 * k) OVER (PARTITION BY d ORDER BY k ROWS UNBOUNDED PRECEDING) + 5000 * k)::BIGINT AS starts_at FROM k""")
def stream_leases(spark, sf_dir):
    """All events as found URLs through the lease stream, and one far ahead that moves the watermark past them."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).cast("string").alias("domain"), F.col("event_id").cast("string").alias("url"), F.lit("found").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    ahead = e.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("domain"), F.lit("end").alias("url"), F.lit("found").alias("kind"), F.expr("ts + INTERVAL 10 DAYS").alias("ts"))
    path, out = new_path(spark, "found"), new_path(spark, "leases")
    e.unionByName(ahead).write.parquet(path)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    try:
        stream = leases.with_state(spark).readStream.schema(e.schema).parquet(path)
        q = leases.leases(stream, 5, most=1).writeStream.format("parquet").option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start(out)
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(leases.OUT).parquet(out).filter("domain <> 'end'")


@query(_P + "SELECT page_id, unnest(links) AS link FROM p")
def udtf_links(spark, sf_dir):
    udtf.register(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("sluice_landed")
    return spark.sql("SELECT page_id, link FROM extract_links(TABLE(SELECT page_id, url, html FROM sluice_landed), 'a[href]')")


@query("SELECT event_id, url FROM (SELECT event_id, 'u' || user_id AS url, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 500)")
def log_tail(spark, sf_dir):
    """The last 500 errors of a log of all events, written in the order of their time, read from its end."""
    tail.register(spark)
    path = new_path(spark, "log")
    rows = table(spark, sf_dir, "events").select("ts", "event_id", F.col("event_type").alias("event"), F.concat(F.lit("u"), "user_id").alias("url"))
    rows.repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id").write.json(path)
    return spark.read.format("log_tail").schema("event_id long, url string").option("path", path).option("lines", 500).option("event", "error").load()
