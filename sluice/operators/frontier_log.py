"""A frontier that is kept in a folder and merged when read.

base/ has a row a URL, in directories by bucket of the URL's hash. log/ has batches: the full rows that a step
has changed, each with the batch's number as its version. The present state is the latest row of each URL:
of the log's, which are few, and of the base's that no row of the log replaces, so the base is not shuffled.
A step reads the buckets of the URLs that it is about and writes these URLs' rows, nothing else. Compaction
folds batches into the base: only buckets that they touch are written anew, by overwriting their directories.

One writer at a time. A batch counts once its writer has ended. If a compaction is cut off between the
base and its mark, the batches are merged again, to the same rows. Batches stay, so that the state behind
any of them can be told (replay), until forget() drops those that are folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.urls import url_hash
from sluice.operators import frontier
from sluice.session import write_out

#: Listed buckets up to this many are named in a filter on directories; of more, all are read.
MOST_NAMED = 4096


class StoredFrontier:
    """The frontier at a path; buckets are fixed when it is first written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.n = spark, path.rstrip("/"), buckets
        self.schema = T.StructType([*spark.createDataFrame([], frontier.SCHEMA).schema, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def bucket(self, url_hash: Column) -> Column:
        return F.pmod(F.xxhash64(url_hash), F.lit(self.n)).cast("int")

    # ------------------------------------------------------------ files

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, pattern: str) -> list[str]:
        found = self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(self._at(pattern))
        return [x.getPath().getParent().getName() for x in found] if found else []

    def versions(self) -> list[int]:
        """Numbers of the batches that are whole, in order."""
        return sorted(int(x.removeprefix("batch-")) for x in self._names("log/batch-*/_SUCCESS"))

    def folded(self) -> int:
        """The last batch that the base holds; 0 if none."""
        return max((int(x.removeprefix("upto-")) for x in self._names("folded/upto-*/_SUCCESS")), default=0)

    def _batch(self, version: int) -> str:
        return f"{self.path}/log/batch-{version:010d}"

    def _append(self, rows: DataFrame) -> int:
        """Write the rows as the next batch, in order of buckets, so that readers can pass over row groups."""
        version = max([self.folded(), *self.versions()], default=0) + 1
        rows = rows.withColumn("version", F.lit(version).cast("long")).withColumn("bucket", self.bucket(F.col("url_hash")))
        self._hashed(rows.drop("url_hash").repartitionByRange("bucket").sortWithinPartitions("bucket")).write.mode("overwrite").parquet(self._batch(version))
        return version

    def _hashed(self, rows: DataFrame) -> DataFrame:
        """rows with the hash of their URLs, which doesn't compress: it is most of a row, so rows move without it."""
        return rows.withColumn("url_hash", url_hash(F.col("url"))).select(*self.schema.names)

    def batch(self, version: int) -> DataFrame:
        """The rows that a batch has changed, as it left them."""
        return self.spark.read.schema(self.schema).parquet(self._batch(version))

    # ------------------------------------------------------------ reading

    def _latest(self, versions: list[int], of: Column) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*map(self._batch, versions)).filter(of)
        if len(versions) == 1:
            return rows
        rest = [c for c in self.schema.names if c not in ("url_hash", "bucket")]
        return rows.groupBy("bucket", "url_hash").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("bucket", "url_hash", "r.*").select(*self.schema.names)

    def _present(self, of: Column) -> DataFrame:
        upto = self.folded()
        latest = self._latest([v for v in self.versions() if v > upto], of)
        if not upto:
            return latest
        base = self.spark.read.schema(self.schema).parquet(f"{self.path}/base").filter(of)
        return base.join(latest.select("bucket", "url_hash"), ["bucket", "url_hash"], "left_anti").select(*self.schema.names).unionByName(latest)

    def table(self) -> DataFrame:
        """The present state, a row a URL."""
        return self._present(F.lit(True)).drop("version", "bucket")

    def replay(self, upto: int | None = None) -> DataFrame:
        """The state behind a batch, or the last, from batches alone. Those that forget() dropped are missing."""
        return self._latest([v for v in self.versions() if upto is None or v <= upto], F.lit(True)).drop("version", "bucket")

    def _within(self, items: DataFrame) -> Column:
        """A filter on the buckets that items (url_hash) lie in: their directories of the base alone are listed and read."""
        if self.n > MOST_NAMED:
            return F.lit(True)
        touched = [r["b"] for r in items.select(self.bucket(F.col("url_hash")).alias("b")).distinct().collect()]
        return F.col("bucket").isin(touched) if len(touched) < self.n else F.lit(True)

    def rows_of(self, items: DataFrame) -> DataFrame:
        """The present rows of items (url_hash), read from their buckets."""
        wanted = items.select("url_hash").distinct().withColumn("bucket", self.bucket(F.col("url_hash")))
        return self._present(self._within(items)).join(wanted, ["bucket", "url_hash"], "left_semi").drop("version", "bucket").select(*self.schema.names[:-2])

    # ------------------------------------------------------------ steps

    def add(self, urls: DataFrame, now: float, **options) -> DataFrame:
        """Append what is new; (outcome, n) as frontier.add_urls counts them."""
        given = {k: options.pop(k) for k in ("url", "order") if k in options}
        rows = write_out(frontier.outcomes(urls, **given), "incoming")
        new = rows.filter("outcome = 'new'").select("url", url_hash(F.col("url")).alias("url_hash"))
        keys = lambda df: df.select(self.bucket(F.col("url_hash")).alias("bucket"), F.unhex("url_hash").alias("key"))
        known = write_out(keys(self._present(self._within(new))).join(keys(new), ["bucket", "key"], "left_semi").select("key"), "known")
        fresh = new.select("url", F.unhex("url_hash").alias("key")).join(known, "key", "left_anti").select("url")
        self._append(frontier.filled(fresh, now, **options))
        n_known = known.count()
        outcome = F.when(F.col("outcome") == "invalid", F.lit("invalid")).when(F.col("outcome") == "new", F.lit("added")).otherwise(F.lit("skipped"))
        counts = rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
        moved = self.spark.createDataFrame([("added", -n_known), ("skipped", n_known)], "outcome string, n long")
        return counts.unionByName(moved).groupBy("outcome").agg(F.sum("n").alias("n")).filter("n > 0")

    def lease(self, now: float, limit: int | None = 10, domain: str = "", lease_seconds: float = 900, worker_id: str = "local", token: str = "") -> DataFrame:
        """Hand out the next rows: they are appended as running and returned so."""
        ready = write_out(frontier.next_batch(self.table(), now, limit, domain, lease_seconds), "batch")
        return self.batch(self._append(frontier.lease(ready, ready, now, worker_id, token, most=None))).drop("version", "bucket")

    def done(self, items: DataFrame, now: float) -> int:
        """Mark items (url_hash); the number of the batch."""
        rows = write_out(self.rows_of(items), "rows")
        return self._append(frontier.mark_done(rows, rows, now))

    def failed(self, items: DataFrame, now: float, error: str = "", retry: bool = True) -> int:
        rows = write_out(self.rows_of(items), "rows")
        return self._append(frontier.mark_failed(rows, rows, now, error, retry))

    # ------------------------------------------------------------ compaction

    def touched(self, versions: list[int] | None = None) -> list[int]:
        """Buckets that batches (those not folded yet, unless told) have rows in; a number a bucket."""
        upto = self.folded()
        log = self._latest([v for v in self.versions() if v > upto] if versions is None else versions, F.lit(True))
        return sorted(r["bucket"] for r in log.select("bucket").distinct().collect())

    def compact(self) -> list[int]:
        """Fold the log into the base. Only the buckets that it touches are written; these are returned."""
        upto, versions = self.folded(), self.versions()
        touched = self.touched()
        if touched:
            # Written aside first: the base is overwritten by what was read from it.
            merged = write_out(self._present(F.col("bucket").isin(touched)).drop("url_hash"), "merged")
            self._hashed(merged.repartition(F.col("bucket"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/base")
        if versions and versions[-1] > upto:
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.path}/folded/upto-{versions[-1]:010d}")
        return touched

    def forget(self) -> None:
        """Delete the batches that the base holds."""
        upto = self.folded()
        fs = self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())
        for v in self.versions():
            if v <= upto:
                fs.delete(self._at(f"log/batch-{v:010d}"), True)
