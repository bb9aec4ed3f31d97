"""Session set-up and the shared folder in which intermediate tables are written."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "sluice", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on. A session that runs already is reused."""
    b = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master, one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_made: list[str] = []
_tables: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table or archive in the shared folder."""
    _made.append(f"{shared_folder(spark)}/sluice-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Delete the tables and archives that this process has written to the shared folder.

    Call it when no DataFrame of an operator is needed any more: they read these tables when they run.
    """
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_out(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    It cuts the lineage: what is lost with an executor is read again, not computed again, and later
    plans see the table's true size. The tables stay until clear().
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bucket_table() -> str:
    _tables.append(f"sluice_{uuid.uuid4().hex}")
    return _tables[-1]


def write_buckets(df: DataFrame, path: str, by: str, buckets: int) -> DataFrame:
    """Write df as a table at path in so many buckets of a column: joins on it, of tables in as many buckets, need no shuffle.

    What is dealt by that column into as many partitions already is written a file a bucket.
    """
    name = _bucket_table()
    df.write.format("parquet").mode("overwrite").option("path", path).option("compression", "zstd").bucketBy(buckets, by).saveAsTable(name)
    return df.sparkSession.table(name)


def open_buckets(spark: SparkSession, path: str, schema: str, by: str, buckets: int) -> DataFrame:
    """The table that write_buckets has left at path, also in another session."""
    name = _bucket_table()
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


@contextmanager
def small_batches(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """Arrow batches of at most so many bytes in what is written out inside the block: long texts and large sets come few at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name derived from name that none of the frames has, compared without case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name
