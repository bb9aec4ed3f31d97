"""Crawling over landed pages, level by level, by their link graph; following anything else level by level; jobs.

Rounds are written to the shared folder, so the plan of a round never holds those before it. Priorities order
work inside a round only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import urls
from sluice.operators.extract import fields_of
from sluice.operators.graph import Folder, LinkGraph, page_graph
from sluice.operators.score import first_rule
from sluice.session import write_out


def bfs(start: DataFrame, follow: Callable[[DataFrame], DataFrame], most_depth: int, key: str = "node", state: CrawlState | None = None) -> DataFrame:
    """(key, depth): everything reached from start, with the least number of steps. follow maps a level to its targets.

    Each level is written once and never again. With a state the levels stay in its folder, and a crawl that was
    stopped goes on behind its last whole level.
    """
    levels: list[DataFrame] = state.levels() if state else []

    def keep(level: DataFrame, depth: int) -> DataFrame:
        level = level.withColumn("depth", F.lit(depth))
        return state.add(level, depth) if state else write_out(level, "level")

    if not levels:
        levels.append(keep(start.select(key).distinct(), 0))
    seen = lambda: reduce(DataFrame.unionByName, levels)
    for depth in range(len(levels), most_depth + 1):
        if levels[-1].isEmpty():
            break
        levels.append(keep(follow(levels[-1]).select(key).distinct().join(seen().select(key), key, "left_anti"), depth))
    return seen()


class CrawlState:
    """A crawl's levels in a folder that all can reach: a Parquet table for each, whole once its writer has ended."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def levels(self) -> list[DataFrame]:
        """The levels that are whole, in order."""
        out: list[DataFrame] = []
        while self._there(f"level-{len(out)}/_SUCCESS"):
            out.append(self.spark.read.parquet(f"{self.path}/level-{len(out)}"))
        return out

    def add(self, level: DataFrame, depth: int) -> DataFrame:
        level.write.mode("overwrite").parquet(f"{self.path}/level-{depth}")
        return self.spark.read.parquet(f"{self.path}/level-{depth}")

    def snapshot(self) -> DataFrame:
        """(level, rows): what has been reached so far."""
        levels = self.levels()
        return reduce(DataFrame.unionByName, levels).groupBy(F.col("depth").alias("level")).agg(F.count(F.lit(1)).alias("rows")) if levels else self.spark.createDataFrame([], "level int, rows long")


class Jobs:
    """Crawls by name: when they started and how they stand, appended as JSON; the latest line of a name counts."""

    SCHEMA = "job string, status string, at double, depth int, rows long, error string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def tell(self, job: str, status: str, at: float, depth: int = 0, rows: int = 0, error: str = "") -> None:
        self.spark.createDataFrame([(job, status, at, depth, rows, error)], self.SCHEMA).write.mode("append").json(self.path)

    def run(self, job: str, work: Callable[[], DataFrame], clock: Callable[[], float]) -> DataFrame:
        """The result of the work, written out; its start and its end, or what stopped it, are told."""
        self.tell(job, "running", clock())
        try:
            done = write_out(work(), "job")
        except Exception as stopped:
            self.tell(job, "failed", clock(), error=str(stopped)[:500])
            raise
        self.tell(job, "done", clock(), int(done.agg(F.max("depth")).first()[0] or 0) if "depth" in done.columns else 0, done.count())
        return done

    def list(self, status: str = "", most: int | None = None) -> DataFrame:
        """One row a job, the latest first."""
        rows = self.spark.read.schema(self.SCHEMA).json(self.path)
        latest = rows.groupBy("job").agg(F.max_by(F.struct("status", "at", "depth", "rows", "error"), "at").alias("r"), F.min("at").alias("started")).select("job", "started", "r.*")
        latest = latest.filter(F.col("status") == status) if status else latest
        ordered = latest.orderBy(F.desc("at"), "job")
        return ordered if most is None else ordered.limit(most)


def child_requests(parents: DataFrame, links: DataFrame, on: str = "url", link: str = "link") -> DataFrame:
    """Requests that follow from links of parents (url, priority, sid, meta, depth): what they inherit, the referer and their own depth.

    links: (on, link[, meta]); a link's own meta goes above its parent's.
    """
    own = F.col("_meta") if "meta" in links.columns else F.create_map().cast("map<string,string>")
    given = links.withColumnRenamed("meta", "_meta") if "meta" in links.columns else links
    inherited = parents.select(F.col(on).alias("_parent"), *[c for c in ("priority", "sid", "meta", "depth") if c in parents.columns])
    made = given.join(inherited, F.col(on).eqNullSafe(F.col("_parent")))
    merged = F.map_concat(F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce(own, F.create_map().cast("map<string,string>"))), k)), F.coalesce(own, F.create_map().cast("map<string,string>")))
    return made.select(F.col(link).alias("url"), "priority", "sid", merged.alias("meta"), F.col("_parent").alias("referer"), (F.col("depth") + 1).alias("depth"))


@dataclass
class CrawlSpec:
    """What to crawl: start URLs (a list or a DataFrame with url), link rules in order (pattern, label), allowed domains and depth."""

    start_urls: list[str] | DataFrame
    rules: list[tuple[str, str]] = field(default_factory=list)
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    allowed_domains: tuple[str, ...] = ()
    max_depth: int = 2
    selector: str = "a[href]"

    @staticmethod
    def parse(spec: dict) -> CrawlSpec:
        if not spec.get("start_urls"):
            raise ValueError("a crawl needs start_urls")
        rules = [(r["pattern"], r.get("label", "")) if isinstance(r, dict) else tuple(r) for r in spec.get("rules", ())]
        return CrawlSpec(list(spec["start_urls"]), rules, tuple(spec.get("allow", ())), tuple(spec.get("deny", ())), tuple(spec.get("allowed_domains", ())), int(spec.get("max_depth", 2)), spec.get("selector", "a[href]"))


def crawl(pages: DataFrame, spec: CrawlSpec, state: Folder | None = None) -> DataFrame:
    """(url, depth, found): every URL reached, whether a landed page answers it. pages: (url, html).

    Pages become a link graph once, and levels are reached in it by ids. A folder as state keeps both, so that a crawl
    goes on where it stopped. Of pages that are one in canonical form the one with the greatest text counts, so that
    reruns agree.
    """
    spark = pages.sparkSession
    given = spec.start_urls if isinstance(spec.start_urls, DataFrame) else spark.createDataFrame([(u,) for u in spec.start_urls], "url string")
    start = given.select(urls.canonical_url(F.col("url")).alias("name")).filter(F.col("name").isNotNull())

    def followed(linked: DataFrame) -> DataFrame:
        ok = urls.url_allowed(F.col("target"), allow=spec.allow, deny=spec.deny, allow_domains=spec.allowed_domains)
        return first_rule(linked.filter(ok).withColumnRenamed("target", "to"), "to", spec.rules).select("name", F.col("to").alias("target"))

    graph = (LinkGraph.opened(state) if state else None) or page_graph(pages, spec.selector, followed, start, state)
    return graph.reached(start, spec.max_depth).select(F.col("name").alias("url"), "depth", F.col("landed").alias("found"))


def items(pages: DataFrame, reached: DataFrame, fields: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """A record per reached page: (source_url, fields), without those that lack a required field or all of them."""
    landed = pages.withColumn("_node", urls.canonical_url(F.col("url"))).join(reached.filter("found").select(F.col("url").alias("_node")), "_node")
    out = fields_of(landed, fields, html="html", url="url").select(F.col("url").alias("_source_url"), *[F.array_join(F.col("fields")[k], " ").alias(k) for k in fields])
    empty = F.lit(True)
    for k in fields:
        empty = empty & (F.coalesce(F.col(k), F.lit("")) == "")
    out = out.filter(~empty)
    for k in required:
        out = out.filter(F.coalesce(F.col(k), F.lit("")) != "")
    return out
