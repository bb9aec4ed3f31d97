"""Sitemaps and robots.txt that have been landed as texts: (url, body)."""

from __future__ import annotations

import gzip
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.urls import host, path, query
from sluice.session import write_out

MOST_DEPTH, MOST_BYTES = 10, 64 << 20


def _safe(xml: Column) -> Column:
    """The text if it is a sitemap as a whole, else an empty document: a broken one gives nothing."""
    whole = F.coalesce(xml, F.lit("")).rlike(r"(?s)^\s*(<\?xml[^>]*\?>)?\s*(<!--.*?-->\s*)*<(urlset|sitemapindex)[\s>].*</(urlset|sitemapindex)>\s*$")
    return F.when(whole, xml).otherwise(F.lit("<urlset/>"))


def locs(xml: Column, index: bool = False) -> Column:
    """The locations of a urlset, or of a sitemap index."""
    return F.transform(F.xpath(_safe(xml), F.lit("sitemapindex/sitemap/loc/text()" if index else "urlset/url/loc/text()")), lambda x: F.trim(x))


def entries(sitemaps: DataFrame, body: str = "body") -> DataFrame:
    """(other columns, pos, loc, lastmod, changefreq, priority) of urlsets, one row an URL."""
    keep = [c for c in sitemaps.columns if c != body]
    blocks = F.regexp_extract_all(_safe(F.col(body)), F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    rows = sitemaps.select(*keep, F.posexplode(blocks).alias("pos", "b"))
    child = lambda name: F.nullif(F.trim(F.regexp_extract("b", rf"(?s)<{name}>\s*(.*?)\s*</{name}>", 1)), F.lit(""))
    return rows.select(*keep, "pos", F.replace(child("loc"), F.lit("&amp;"), F.lit("&")).alias("loc"), *[child(n).alias(n) for n in ("lastmod", "changefreq", "priority")])


def sources(sitemaps: DataFrame, body: str = "body") -> DataFrame:
    """(other columns, pos, loc, kind): children of an index as category_candidate, product_candidate or other."""
    keep = [c for c in sitemaps.columns if c != body]
    low = F.lower("loc")
    kind = F.when(low.contains("category") | low.contains("categorie"), F.lit("category_candidate")).when(low.contains("product"), F.lit("product_candidate")).otherwise(F.lit("other"))
    return sitemaps.select(*keep, F.posexplode(locs(F.col(body), index=True)).alias("pos", "loc")).withColumn("kind", kind)


def pick(found: DataFrame) -> DataFrame:
    """(kind, loc): the first child of each kind."""
    return found.filter(F.col("kind") != "other").groupBy("kind").agg(F.min_by("loc", "pos").alias("loc"))


def expand(landed: DataFrame, start: DataFrame, most_depth: int = 5) -> DataFrame:
    """(url, loc, lastmod, changefreq, priority): URLs of all sitemaps reached from start (url) by way of indexes.

    Each round joins the sitemaps of one level with the landed ones; visited ones are not read again.
    """
    level = write_out(start.select("url").distinct(), "sitemaps")
    seen = level
    for _ in range(min(most_depth, MOST_DEPTH)):
        below = landed.join(level, "url").select(F.explode(locs(F.col("body"), index=True)).alias("url")).distinct()
        level = write_out(below.join(seen, "url", "left_anti"), "sitemaps")
        if level.isEmpty():
            break
        seen = write_out(seen.union(level), "sitemaps")
    return entries(landed.join(seen, "url").select("url", "body")).drop("pos")


def robots_sitemaps(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, pos, allow, prefix) of the groups for an agent, of robots.txt files (host, body).

    Of the groups whose name the agent's begins with, or holds, the longest name counts, and * if there is none.
    """
    # Lines are spread before they are taken apart: a file is a row, so its lines come out of one task.
    lines = robots.select("host", F.posexplode(F.split("body", r"\R")).alias("pos", "line")).repartition("host", "pos").withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    name, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    lines = lines.select("host", "pos", name.alias("name"), value.alias("value"))
    by = Window.partitionBy("host").orderBy("pos")
    # A group is a run of user-agent lines and the rules up to the next run.
    starts = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(by), F.lit("")) != "user-agent")
    grouped = lines.filter(F.col("name").isin("user-agent", "allow", "disallow")).withColumn("s", starts.cast("int"))
    # Written once: a file of millions of lines is one task's work, and what follows reads it several times.
    grouped = write_out(grouped.withColumn("g", F.sum("s").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("s"), "robots")
    called = F.lower("value")
    fit = F.when(called == "*", F.lit(0)).when((called != "") & F.contains(F.lit(agent.lower()), called), F.length("value"))
    named = grouped.filter(F.col("name") == "user-agent").withColumn("fit", fit).filter("fit is not null")
    best = named.groupBy("host").agg(F.max("fit").alias("fit"))
    mine = named.join(best, ["host", "fit"]).select("host", "g").distinct()
    rules = grouped.filter(F.col("name").isin("allow", "disallow") & (F.col("value") != "")).join(mine, ["host", "g"])
    return rules.select("host", "pos", (F.col("name") == "allow").alias("allow"), F.col("value").alias("prefix"))


#: Rules of at most this many bytes are broadcast; more are joined by host and head.
BROADCAST_BYTES = 8 << 20
#: Into so many parts a host's URLs are dealt where even the lengths of heads, a row a host, are more than that.
SALTS = 32


def compiled_rules(rules: DataFrame) -> DataFrame:
    """Rules with head, the literal text that a target must begin with, exact, and pattern where * stands in them.

    A $ at the end ties a rule to the target's end; a * at the end says nothing.
    """
    tied = F.col("prefix").endswith("$")
    bare = F.when(tied, F.expr("left(prefix, length(prefix) - 1)")).otherwise(F.regexp_replace("prefix", r"\*+$", ""))
    rows = rules.withColumns({"_bare": bare, "exact": tied})
    quoted = F.array_join(F.transform(F.split("_bare", r"\*+"), lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), ".*")
    pattern = F.when(F.contains("_bare", F.lit("*")), F.concat(F.lit("(?s)^"), quoted, F.when(tied, F.lit("$")).otherwise(F.lit(""))))
    return rows.withColumns({"head": F.substring_index("_bare", "*", 1), "pattern": pattern}).drop("_bare")


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with can_fetch: the longest rule that matches decides, an allowing one of equal length wins; no rule allows.

    A URL meets the rules of its host by equality of the rule's head with as many of its first characters; only
    lengths that heads of the host have are tried. Rules with * are matched as patterns on what is left then.
    """
    target = F.concat(F.coalesce(F.nullif(path(F.col(url)), F.lit("")), F.lit("/")), F.when(query(F.col(url)) != "", F.concat(F.lit("?"), query(F.col(url)))).otherwise(F.lit("")))
    u = urls.select(url).distinct().withColumns({"_host": host(F.col(url)), "_target": target})
    ready = write_out(compiled_rules(rules).groupBy(F.col("host").alias("_host"), "head", "exact", "pattern").agg(F.max(F.struct(F.length("prefix").alias("size"), "allow")).alias("says")), "rules")
    size = ready.agg(F.sum(F.octet_length("_host") + 2 * F.octet_length("head") + F.coalesce(F.octet_length("pattern"), F.lit(0)) + 64)).first()[0] or 0
    # Lengths are joined by host alone, so they have a bound of their own: by a shuffle all URLs of a host would meet in one task.
    lengths = write_out(ready.groupBy("_host").agg(F.sort_array(F.collect_set(F.length("head"))).alias("_lengths")), "lengths")
    if (lengths.agg(F.sum(F.octet_length("_host") + 4 * F.size("_lengths") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        sized = u.join(F.broadcast(lengths), "_host")
    else:
        dealt = lengths.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        sized = u.withColumn("_salt", F.pmod(F.xxhash64(F.col(url)), F.lit(SALTS)).cast("int")).join(dealt.hint("merge"), ["_host", "_salt"])
    heads = F.transform(F.filter("_lengths", lambda n: n <= F.length("_target")), lambda n: F.substring(F.col("_target"), F.lit(1), n))
    tried = sized.select(url, "_host", "_target", F.explode(heads).alias("head"))
    # Rules are few beside what is tried: hashed, they leave that unsorted.
    hit = tried.join(F.broadcast(ready) if size <= BROADCAST_BYTES else ready.hint("shuffle_hash"), ["_host", "head"]).filter(F.when(F.col("pattern").isNotNull(), F.expr("_target rlike pattern")).otherwise(~F.col("exact") | (F.length("_target") == F.length("head"))))
    verdict = hit.groupBy(F.col(url).alias("_url")).agg(F.max("says").alias("says"))
    out = urls.join(verdict, F.col(url) == F.col("_url"), "left")
    return out.withColumn("can_fetch", F.coalesce(F.col("says")["allow"], F.lit(True))).drop("_url", "says")


def decompress(body: Column, most: int | None = MOST_BYTES) -> Column:
    """Texts of bodies (binary), gunzipped if they are gzip; more than so many bytes of text are null, as a small body may hold very many."""

    def run(bodies: pa.Array) -> pa.Array:
        out = []
        for b in bodies.to_pylist():
            try:
                data = gzip.GzipFile(fileobj=io.BytesIO(b)).read(-1 if most is None else most + 1) if b and b[:2] == b"\x1f\x8b" else b
            except (OSError, EOFError):
                data = None
            out.append(None if data is None or (most is not None and len(data) > most) else data.decode("utf-8", "replace"))
        return pa.array(out, type=pa.string())

    return F.arrow_udf(run, "string")(body)
