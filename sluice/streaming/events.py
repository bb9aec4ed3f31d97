"""Streams of events: windows on event time, metrics and a frontier without repeats. Beyond the batch operators.

Late events count up to the watermark. The functions take streaming and batch DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.functions.urls import authority, canonical_url, url_hash
from sluice.operators.metrics import EVENT
from sluice.operators.store import new_records, prepare


def read_stream(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late) if events.isStreaming else events


def tumbling(events: DataFrame, *keys: str, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = _timed(events, ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, *keys: str, ts: str = "ts", width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    w = _timed(events, ts, late).groupBy(F.window(ts, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, key: str, *, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = _timed(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def new_urls(found: DataFrame, *, url: str = "url", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Discovered URLs in canonical form, each once within the watermark: the stream's frontier_add."""
    canon = found.select(canonical_url(F.col(url)).alias("url"), ts).filter(F.col("url").isNotNull())
    keyed = canon.select("url", url_hash(F.col("url")).alias("url_hash"), authority(F.col("url")).alias("domain"), ts)
    return keyed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["url_hash"]) if found.isStreaming else keyed.dropDuplicates(["url_hash"])


def domain_failures(events: DataFrame, *, ts: str = "ts", width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Fetches and failures per domain and window."""
    fetched = _timed(events, ts, late).filter(F.col("event") == "fetch")
    w = fetched.groupBy(F.window(ts, width).alias("w"), "domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("fail"))
    return w.select(F.col("w.start").alias("start"), "domain", "n", "fail")


def append_new(stream: DataFrame, path: str, checkpoint: str, schema=None, order: str = "pos") -> StreamingQuery:
    """Append each micro-batch's records that aren't stored yet. One writer at a time; a repeated batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        ready = prepare(batch, schema).filter(F.size("errors") == 0).drop("errors")
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
        new_records(spark.read.parquet(path) if there else None, ready, schema, F.col(order)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
