"""Counts and rates of fetch events, crawl runs and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "ts string, event string, success boolean, url string, domain string, requested_mode string, mode string, cache_hit boolean, escalations array<string>, duration_ms bigint, error_type string, error string"

MOST_RECENT = 500


def known(c: Column | str) -> Column:
    return F.coalesce(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit("unknown"))


def _counts() -> list[Column]:
    ok = F.coalesce(F.col("success"), F.lit(False))
    return [F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("fail"), F.count_if(F.coalesce(F.col("cache_hit"), F.lit(False))).alias("cache_hits"), F.round(F.avg(F.coalesce("duration_ms", F.lit(0)))).cast("long").alias("avg_duration_ms")]


def fetches(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event") == "fetch")


def overall(events: DataFrame) -> DataFrame:
    return fetches(events).agg(*_counts())


def by(events: DataFrame, column: str) -> DataFrame:
    """Per value of a column (unknown for none): n, success, fail, cache_hits, avg_duration_ms."""
    return fetches(events).groupBy(known(column).alias(column)).agg(*_counts())


def failures(events: DataFrame) -> DataFrame:
    return fetches(events).filter(~F.coalesce(F.col("success"), F.lit(False))).groupBy(known("error_type").alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def all_metrics(events: DataFrame) -> DataFrame:
    """Overall, per domain and per mode in one pass by grouping sets: (domain, mode, level, counts)."""
    f = fetches(events).withColumns({"domain": known("domain"), "mode": known("mode")})
    sets = [[], [F.col("domain")], [F.col("mode")]]
    level = F.when(F.grouping("domain") + F.grouping("mode") == 2, F.lit("all")).when(F.grouping("domain") == 0, F.lit("domain")).otherwise(F.lit("mode"))
    return f.groupingSets(sets, "domain", "mode").agg(level.alias("level"), *_counts())


def recent(events: DataFrame, order: list[str], limit: int | None = 50, event: str = "", domain: str = "", tail: int | None = 5000) -> DataFrame:
    """The last matching events of the log's tail, in order of time; None takes a limit off."""
    down = [F.desc(c) for c in order]
    last = events if tail is None else events.orderBy(*down).limit(tail)
    if event:
        last = last.filter(F.col("event") == event)
    if domain:
        last = last.filter(F.contains(F.col("domain"), F.lit(domain)))
    return (last if limit is None else last.orderBy(*down).limit(max(1, min(limit, MOST_RECENT)))).orderBy(*order)


def crawl_stats(requests: DataFrame) -> DataFrame:
    """One row of counters of a request log: (url, domain, status, bytes, sid, ok, cached, retried, started, ended)."""
    n = lambda c: F.count_if(c)
    seconds = F.max("ended") - F.min("started")
    return requests.agg(F.count(F.lit(1)).alias("requests"), n(~F.col("ok")).alias("failed"), n(F.col("cached")).alias("cached"), n(F.col("retried")).alias("retried"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.round(seconds, 3).alias("elapsed"), F.round(F.when(seconds > 0, F.count(F.lit(1)) / seconds).otherwise(F.lit(0.0)), 3).alias("per_second"))


def count_by(rows: DataFrame, column: str, value: str | None = None) -> DataFrame:
    """Rows, or the sum of a column, per value: status counts, bytes per domain, requests per session, log levels."""
    return rows.groupBy(column).agg((F.sum(value) if value else F.count(F.lit(1))).alias("n"))
