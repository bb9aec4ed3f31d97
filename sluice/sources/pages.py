"""Landed pages in place of fetching: a batch of URLs is answered by a join with what has been landed."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.urls import canonical_url

#: Characters of a page that are kept, unless the whole is asked for.
MOST_CHARS = 80_000


class PageSource(Protocol):
    def fetch(self, urls: DataFrame, whole: bool = False) -> DataFrame: ...

    def urls(self) -> DataFrame: ...


class LandedPages:
    """Pages (url, html, ...) landed as Parquet."""

    def __init__(self, pages: DataFrame):
        self.pages = pages

    @staticmethod
    def read(spark: SparkSession, path: str) -> LandedPages:
        return LandedPages(spark.read.parquet(path))

    def urls(self) -> DataFrame:
        return self.pages.select("url")

    def fetch(self, urls: DataFrame, whole: bool = False) -> DataFrame:
        """urls (url, ...) with html, ok and truncated. Of pages landed twice any one answers."""
        landed = self.pages.select(canonical_url(F.col("url")).alias("_key"), "html").filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.any_value("html").alias("_html"))
        out = urls.withColumn("_key", canonical_url(F.col("url"))).join(landed, "_key", "left")
        cut = F.col("_html") if whole else F.substring("_html", 1, MOST_CHARS)
        return out.select(*urls.columns, cut.alias("html"), F.col("_html").isNotNull().alias("ok"), (F.lit(not whole) & (F.length("_html") > MOST_CHARS)).alias("truncated"))
