"""A link graph stored in buckets, and what is reached in it step by step.

The graph is built once: names (node, name, landed) and edges (source, target, name), a node being the MD5 of
its name in 16 bytes. Both, and each level that is reached, are tables in the same number of buckets by node.
A round joins ids alone: the frontier with the edges, bucket by bucket, and the targets, which alone are
shuffled, with the nodes seen, again bucket by bucket. Each edge is followed once in a crawl. Names join the
ids at the end.

A graph and its levels may be kept in a folder; a crawl that was stopped goes on behind its last whole level.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.urls import canonical_url
from sluice.operators.extract import link_lists
from sluice.session import new_path, open_buckets, write_buckets, write_out

NAMES, EDGES, LEVEL = "node binary, name string, landed boolean", "source binary, target binary, name string", "node binary, depth int"


def node(name: Column) -> Column:
    return F.unhex(F.md5(name.cast("binary")))


class Folder:
    """Where a graph and its levels are kept: a table for each, whole once its writer has ended."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def there(self, name: str) -> bool:
        return self._fs().exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS"))

    def buckets(self) -> int | None:
        """The number of buckets of the graph that is here, if one is."""
        found = self._fs().globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/names-*/_SUCCESS"))
        return int(found[0].getPath().getParent().getName().removeprefix("names-")) if found else None


class LinkGraph:
    """names and edges in buckets; made by build or opened from a folder."""

    def __init__(self, names: DataFrame, edges: DataFrame, buckets: int, folder: Folder | None = None):
        self.names, self.edges, self.buckets, self.folder = names, edges, buckets, folder

    @staticmethod
    def opened(folder: Folder) -> LinkGraph | None:
        """The graph that the folder has, or None."""
        n = folder.buckets()
        if n is None or not folder.there(f"edges-{n}"):
            return None
        at = lambda name, schema, by: open_buckets(folder.spark, f"{folder.path}/{name}-{n}", schema, by, n)
        return LinkGraph(at("names", NAMES, "node"), at("edges", EDGES, "source"), n, folder)

    @staticmethod
    def build(named: DataFrame, linked: DataFrame, folder: Folder | None = None, buckets: int | None = None) -> LinkGraph:
        """named: (name, landed), a name any number of times; linked: (name, target) by names.

        Edges are written before names, so that names mark a whole graph.
        """
        spark = named.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = lambda name: f"{folder.path}/{name}-{n}" if folder else new_path(spark, name)
        rows = linked.select(node(F.col("name")).alias("source"), node(F.col("target")).alias("target"), F.col("target").alias("name"))
        edges = write_buckets(rows.repartition(n, "source"), path("edges"), "source", n)
        both = named.select("name", "landed").unionByName(edges.select("name", F.lit(False).alias("landed")))
        # Equal names meet on their way: a target of very many links comes once from each task.
        names = both.groupBy(node(F.col("name")).alias("node")).agg(F.min("name").alias("name"), F.max("landed").alias("landed"))
        return LinkGraph(write_buckets(names, path("names"), "node", n), edges, n, folder)

    def _keep(self, level: DataFrame, depth: int) -> DataFrame:
        at = f"{self.folder.path}/level-{depth}" if self.folder else new_path(level.sparkSession, "level")
        return write_buckets(level.select("node", F.lit(depth).alias("depth")), at, "node", self.buckets)

    def following(self, level: DataFrame, seen: list[DataFrame]) -> DataFrame:
        """(node): targets of a level that none of the levels has. Of this only the targets are shuffled."""
        targets = level.select("node").join(self.edges.select("source", "target"), F.col("node") == F.col("source"))
        fresh = targets.select(F.col("target").alias("node")).distinct()
        for one in seen:
            fresh = fresh.join(one.select("node"), "node", "left_anti")
        return fresh

    def levels(self, start: DataFrame, most_depth: int) -> list[DataFrame]:
        """Tables (node, depth) of start (name) and what is reached from it in up to so many steps."""
        levels: list[DataFrame] = []
        while self.folder and self.folder.there(f"level-{len(levels)}"):
            levels.append(open_buckets(self.folder.spark, f"{self.folder.path}/level-{len(levels)}", LEVEL, "node", self.buckets))
        if not levels:
            levels.append(self._keep(start.select(node(F.col("name")).alias("node")).distinct(), 0))
        for depth in range(len(levels), most_depth + 1):
            if levels[-1].isEmpty():
                break
            levels.append(self._keep(self.following(levels[-1], levels), depth))
        return levels[: most_depth + 1]

    def reached(self, start: DataFrame, most_depth: int) -> DataFrame:
        """(name, depth, landed) of all levels."""
        ids = reduce(DataFrame.unionByName, self.levels(start, most_depth))
        return ids.join(self.names, "node").select("name", "depth", "landed")


def page_graph(pages: DataFrame, selector: str, targets: Callable[[DataFrame], DataFrame], start: DataFrame, folder: Folder | None = None, buckets: int | None = None) -> LinkGraph:
    """The graph of pages (url, html) by canonical URL. targets: which of (name, target) are followed. start: (name).

    Each page is parsed once, and its links are written beside the hash of its text. Of pages that are one in
    canonical form the one with the greatest text counts; texts are compared, in a second reading of them, only
    where a URL was landed with different ones.
    """
    named = pages.select(canonical_url(F.col("url")).alias("name"), "html").filter(F.col("name").isNotNull())
    listed = link_lists(named.withColumn("hash", F.md5(F.col("html").cast("binary"))), selector, html="html", url="name", out="links")
    listed = write_out(listed.select("name", "hash", F.array_distinct(F.transform("links", lambda x: x["link"])).alias("links")), "links")
    twice = listed.groupBy("name").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).filter("low <> high").select("name")
    twice = write_out(twice, "landed-twice")
    if not twice.isEmpty():
        greatest = named.join(twice, "name", "left_semi").groupBy("name").agg(F.max("html").alias("html")).select("name", F.md5(F.col("html").cast("binary")).alias("one"))
        greatest = write_out(greatest, "greatest")
        listed = listed.join(greatest, "name", "left").filter(F.col("one").isNull() | (F.col("one") == F.col("hash"))).drop("one")
    linked = listed.select("name", F.explode("links").alias("link")).select("name", canonical_url(F.col("link")).alias("target")).filter(F.col("target").isNotNull())
    all_named = listed.select("name", F.lit(True).alias("landed")).unionByName(start.select("name", F.lit(False).alias("landed")))
    return LinkGraph.build(all_named, targets(linked), folder, buckets)
