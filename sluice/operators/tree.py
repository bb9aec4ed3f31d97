"""Links, category trees and menus as tables: paths, prefixes, adjacency, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import urls
from sluice.functions.text import label
from sluice.session import write_out

# First path segments and patterns that are no categories.
EXCLUDED_FIRST = (
    "advies", "blog", "blogs", "inspiratie", "merken", "brand", "brands", "service", "klantenservice", "customer-service", "winkel", "winkels",
    "store", "stores", "cart", "checkout", "account", "mijn-etos", "search", "zoeken", "folder", "folders", "nieuws", "pers", "100jaar",
    "aanbiedingen", "acties", "actievoorwaarden", "about-us", "advies-inspiratie", "andc", "bezorgen-op-vakantieadres", "community-richtlijnen",
    "dagjeweg", "folder-acties", "https:", "international", "keurmerk-zelfzorg-online", "kwetsbaarheid-melden", "over-etos",
    "persbericht-leidschendam", "persevent", "social-media", "specialisten", "terugroepacties-en-veiligheidswaarschuwingen",
    "toegankelijkheidsverklaring", "vouchers", "zakelijk",
)
NOISE = (
    r"(?i)(dummy|test|old|preview|actievoorwaarden|privacy|cookies|about-us|over-etos|toegankelijkheidsverklaring|kwetsbaarheid|community|"
    r"zakelijk|international|persbericht|persevent|social-media|loyalty|eerdergekocht)"
)


def anchors(pages: DataFrame, *keep: str, html: str = "html") -> DataFrame:
    """(keep, pos, href): the href of every plain anchor in page order, without a parser."""
    return pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


def category_paths(rows: DataFrame, depth: int = 3, *, url: str = "url", base: str | None = None, exclude: tuple[str, ...] = EXCLUDED_FIRST, noise: str | None = NOISE) -> DataFrame:
    """(parts): the different category paths, cut at depth, of URLs that are no products, excluded or noise."""
    u = F.col(url)
    p = rows.select(u.alias("u"), urls.path_parts(u).alias("parts"), F.coalesce(urls.path(u), F.lit("")).alias("path")).filter((F.size("parts") > 0) & ~F.col("path").rlike(urls.PRODUCT_URL))
    if base is not None:
        p = p.filter(F.coalesce(urls.part(F.col("u"), "AUTHORITY"), F.lit(base)) == base)
    if exclude:
        p = p.filter(~F.lower(F.col("parts")[0]).isin(*exclude))
    if noise:
        p = p.filter(~F.col("path").rlike(noise))
    return p.select(F.slice("parts", 1, depth).alias("parts")).distinct()


def product_prefixes(rows: DataFrame, depth: int = 3, *, url: str = "url", least_parts: int = 3) -> DataFrame:
    """(parts): all path prefixes above product pages whose own segment looks like a product's."""
    parts = urls.path_parts(F.col(url))
    p = rows.select(parts.alias("parts")).filter((F.size("parts") >= least_parts) & F.element_at("parts", -1).rlike(urls.PRODUCT_URL))
    return p.select(F.explode(urls.prefixes(F.col("parts"), F.least(F.lit(depth), F.size("parts") - 1))).alias("parts")).distinct()


def with_products(categories: DataFrame, products: DataFrame) -> DataFrame:
    """Categories that a product prefix extends or that extend one. Both ways are equi joins on prefixes."""
    below = products.select(F.explode(urls.prefixes(F.col("parts"))).alias("parts")).distinct()
    one = categories.join(below, "parts", "left_semi")
    own = categories.select(F.col("parts").alias("whole"), F.explode(urls.prefixes(F.col("parts"))).alias("parts"))
    two = own.join(products, "parts", "left_semi").select(F.col("whole").alias("parts"))
    return one.union(two).distinct()


def category_tree(paths: DataFrame, base_url: str) -> DataFrame:
    """(path, parent, depth, name, url): one node for every prefix of the paths."""
    nodes = paths.select(F.explode(urls.prefixes(F.col("parts"))).alias("p")).distinct()
    join = lambda c: F.array_join(c, "/")
    root = F.concat(urls.part(F.lit(base_url), "PROTOCOL"), F.lit("://"), urls.part(F.lit(base_url), "AUTHORITY"))
    return nodes.select(join(F.col("p")).alias("path"), F.when(F.size("p") > 1, join(F.slice("p", F.lit(1), F.size("p") - 1))).alias("parent"), F.size("p").alias("depth"), label(F.element_at("p", -1)).alias("name"), F.concat(root, F.lit("/"), join(F.col("p")), F.lit("/")).alias("url"))


def subtree_counts(paths: DataFrame, weight: Column | None = None) -> DataFrame:
    """(parts, depth, own, total, nodes, children): of each node of the paths what stands at it, what stands at it or
    below, the nodes of its subtree with itself, and its children. A path counts as often as it is there, or by its weight.

    Every path tells its ancestors at once, whatever its depth; equal ones are summed on their way, so a root that
    all paths have takes a row from each task.
    """
    given = paths.groupBy("parts").agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("n")).filter(F.size("parts") > 0)
    up = given.select(F.posexplode(urls.prefixes(F.col("parts"))).alias("k", "node"), F.size("parts").alias("size"), "n")
    sums = write_out(up.groupBy(F.col("node").alias("parts")).agg(F.sum(F.when(F.col("k") + 1 == F.col("size"), F.col("n")).otherwise(F.lit(0))).alias("own"), F.sum("n").alias("total")), "nodes")
    below = sums.select(F.posexplode(urls.prefixes(F.col("parts"))).alias("k", "node"), F.size("parts").alias("size"))
    kin = below.groupBy(F.col("node").alias("parts")).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("size") == F.col("k") + 2).alias("children"))
    return sums.join(kin, "parts").select("parts", F.size("parts").alias("depth"), "own", "total", "nodes", "children")


def fold_small(counts: DataFrame, least: int) -> DataFrame:
    """(parts, depth, own): the tree whose leaves all have least or more: smaller leaves are folded into their parents,
    which may make these large enough, or leaves that are folded in turn. Roots stay.

    counts: (parts, depth, own). From the deepest level up, each level is folded once, so there are as many rounds
    as levels; a round has the rows of its level and what was folded into it.
    """
    rows = write_out(counts.select("parts", "depth", "own"), "tree")
    kept, deepest = [], rows.agg(F.max("depth")).first()[0] or 0
    folded = None
    for depth in range(deepest, 0, -1):
        level = rows.filter(F.col("depth") == depth).select("parts", "own", F.lit(False).alias("inner"))
        both = (level if folded is None else level.unionByName(folded)).groupBy("parts").agg(F.sum("own").alias("own"), F.bool_or("inner").alias("inner"))
        both = write_out(both, "level")
        stays = F.col("inner") | (F.col("own") >= least) | F.lit(depth == 1)
        kept.append(both.filter(stays).select("parts", F.lit(depth).alias("depth"), "own"))
        # A node that stays tells its parent so; one that goes gives it what it has.
        folded = both.select(F.slice("parts", 1, depth - 1).alias("parts"), F.when(stays, F.lit(0)).otherwise(F.col("own")).alias("own"), stays.alias("inner")) if depth > 1 else None
    out = kept[0] if kept else rows
    for level in kept[1:]:
        out = out.unionByName(level)
    return out


def render_tree(nodes: DataFrame) -> list[dict]:
    """The nested form of category_tree's rows, for one site: a document for people, so it meets on the driver."""
    rows = nodes.orderBy("path").collect()
    made = {r["path"]: {"name": r["name"], "url": r["url"]} for r in rows}
    roots = []
    for r in rows:
        (made[r["parent"]].setdefault("children", []) if r["parent"] in made else roots).append(made[r["path"]])
    return roots


def menu_diff(recommended: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """(key, side): shared, only (in the recommended one) or missing (from it)."""
    a, b = recommended.select(F.col(key), F.lit(1).alias("_a")), other.select(F.col(key), F.lit(1).alias("_b"))
    side = F.when(F.col("_a").isNull(), F.lit("missing")).when(F.col("_b").isNull(), F.lit("only")).otherwise(F.lit("shared"))
    return a.join(b, key, "full").select(key, side.alias("side"))


def in_all_sources(entries: DataFrame, key: str, source: str) -> DataFrame:
    """Keys that every source has."""
    pairs = entries.select(key, source).distinct()
    n = pairs.select(source).distinct().count()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n).select(key)


def nth_of_type(nodes: DataFrame, parent: list[str], tag: str, order: str) -> DataFrame:
    return nodes.withColumn("nth", F.row_number().over(Window.partitionBy(*parent, tag).orderBy(order)))


def deltas(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """rows with delta: the value less the one before it."""
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(*key).orderBy(order)))


def menu_profile(nodes: DataFrame, base: str | None = None, filtered: int = 0) -> DataFrame:
    """One row of figures about a menu (title, url, depth): sizes, coverage, kinds of URLs, business score and signals."""
    kind = urls.classify_url(F.col("url"), F.lit(base) if base else None)
    has = F.coalesce(F.col("url"), F.lit("")) != ""
    n = F.count(F.lit(1))
    a = nodes.withColumn("kind", F.when(has, kind)).agg(
        n.alias("nodes"), F.count_if(F.col("depth") == 1).alias("top"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.round(F.avg("depth"), 2).alias("avg_depth"), F.count_if(has).alias("urls"),
        F.countDistinct(F.when(has, F.col("url"))).alias("unique_urls"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("category", "content", "external", "product", "promotion")],
    )
    rate = lambda x, y: F.when(y > 0, F.round(x / y, 3)).otherwise(F.lit(0.0))
    a = a.withColumns({"filtered": F.lit(filtered), "duplicates": F.col("urls") - F.col("unique_urls"), "valid_ratio": rate(F.col("nodes"), F.col("nodes") + filtered), "url_coverage": rate(F.col("unique_urls"), F.col("nodes")), "category_ratio": rate(F.col("category"), F.col("unique_urls"))})
    most = lambda c, points: F.least(c, F.lit(points))
    part = lambda c, weight: F.floor(F.col(c) * weight)
    score = most(F.col("nodes"), 60) + most(F.col("top") * 3, 18) + most(F.col("max_depth") * 8, 24) + part("valid_ratio", 20) + part("url_coverage", 15) + part("category_ratio", 15)
    score = score - most(F.col("filtered") * 2, 30) - most(F.col("duplicates") * 3, 24) - most(F.col("content") * 2, 20) - most(F.col("external") * 3, 24)
    signals = {"hierarchical": F.col("max_depth") >= 2, "category_url_dominant": F.col("category_ratio") >= 0.6, "low_filter_noise": F.col("valid_ratio") >= 0.8, "high_url_coverage": F.col("url_coverage") >= 0.7, "mixed_content_links": F.col("content") > 0, "external_links_present": F.col("external") > 0, "filtered_nodes_present": F.col("filtered") > 0}
    return a.withColumns({"business_score": F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int"), "signals": F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in signals.items()]))})


def menu_entries(nodes: DataFrame) -> DataFrame:
    """(pos, title, title_key, url, path): a menu's nodes (node_id, parent_id, pos, title, url) with their trails of titles."""
    level = nodes.filter(F.col("parent_id").isNull()).withColumn("path", F.coalesce("title", F.lit("")))
    out = level
    while not level.isEmpty():
        up = level.select(F.col("node_id").alias("parent_id"), F.col("path").alias("trail"))
        level = nodes.join(up, "parent_id").withColumn("path", F.when(F.coalesce("title", F.lit("")) == "", F.col("trail")).otherwise(F.concat_ws(" > ", F.nullif("trail", F.lit("")), "title"))).select(*out.columns)
        out = out.union(level)
    return out.filter((F.coalesce("title", F.lit("")) != "") | (F.coalesce("url", F.lit("")) != "")).select("pos", "title", F.lower("title").alias("title_key"), "url", "path")


def filter_reason(title: Column, url: Column, hidden: Column, content_page: Column, external: Column, first: Column) -> Column:
    """Why a menu node is left out, or ''."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    repeat = (F.coalesce(title, F.lit("")) != "") & (F.coalesce(url, F.lit("")) != "") & ~first
    return F.when(yes(hidden), F.lit("hidden")).when(yes(content_page), F.lit("contentPage")).when(yes(external), F.lit("externalLink")).when(repeat, F.lit("duplicate")).otherwise(F.lit(""))
