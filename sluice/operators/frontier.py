"""A crawl frontier as a table: adding, leasing, marking and counting URLs. Each step is a rewrite of the table.

The clock is always an argument. State: queued, running, done, failed; a running row whose lease has ended
may be leased again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.urls import authority, canonical_url, url_hash
from sluice.session import write_out

SCHEMA = (
    "url string, url_hash string, domain string, priority int, status string, kind string, depth int, parent_url string, payload_json string, "
    "attempts int, worker_id string, error string, created_at double, updated_at double, locked_at double, completed_at double, lease_token string"
)
MOST_LEASED, MOST_ERROR = 500, 500


def outcomes(urls: DataFrame, *, url: str = "url", order: str | None = None) -> DataFrame:
    """(url, outcome) of raw URLs: canonical ones, new or repeat, of equal ones the first in order is new; null and invalid otherwise."""
    canon = canonical_url(F.col(url))
    rows = urls.select(canon.alias("url"), (F.col(order) if order else F.monotonically_increasing_id()).alias("pos"))
    # What is no URL has no equals: each such row is a group of its own, so that they don't meet in one task.
    group = F.coalesce(F.col("url"), F.concat(F.lit(" "), F.col("pos").cast("string")))
    first = F.row_number().over(Window.partitionBy(group).orderBy("pos")) == 1
    return rows.select("url", F.when(F.col("url").isNull(), F.lit("invalid")).when(first, F.lit("new")).otherwise(F.lit("repeat")).alias("outcome"))


def filled(rows: DataFrame, now: float, *, priority: int = 0, kind: str = "page", depth: int = 0, parent_url: str = "", payload_json: str = "{}") -> DataFrame:
    """Frontier rows of rows with url, with their other columns."""
    return rows.select(
        "url", url_hash(F.col("url")).alias("url_hash"), authority(F.col("url")).alias("domain"), F.lit(priority).alias("priority"), F.lit("queued").alias("status"),
        F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), F.lit(parent_url).alias("parent_url"), F.lit(payload_json).alias("payload_json"), F.lit(0).alias("attempts"),
        F.lit("").alias("worker_id"), F.lit("").alias("error"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit(0.0).alias("locked_at"), F.lit(0.0).alias("completed_at"), F.lit("").alias("lease_token"),
        *[c for c in rows.columns if c != "url"],
    )


def incoming(urls: DataFrame, now: float, *, url: str = "url", order: str | None = None, **values) -> DataFrame:
    """Frontier rows, and outcome invalid or new, of raw URLs; of equal ones the first in order is kept, others are repeat."""
    return filled(outcomes(urls, url=url, order=order), now, **values)


def add_urls(frontier: DataFrame, urls: DataFrame, now: float, **options) -> tuple[DataFrame, DataFrame]:
    """(frontier with the new URLs, counts (outcome, n)); outcomes are added, skipped and invalid."""
    rows = incoming(urls, now, **options)
    known = rows.join(frontier.select("url_hash", F.lit(True).alias("known")), "url_hash", "left")
    outcome = F.when(F.col("outcome") == "invalid", F.lit("invalid")).when((F.col("outcome") == "new") & F.col("known").isNull(), F.lit("added")).otherwise(F.lit("skipped"))
    judged = known.withColumn("outcome", outcome).drop("known")
    fresh = judged.filter(F.col("outcome") == "added").select(*frontier.columns)
    return frontier.unionByName(fresh), judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def eligible(now: float, lease_seconds: float, domain: str = "") -> Column:
    free = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("locked_at") < now - lease_seconds))
    return free & (F.col("domain") == domain.lower()) if domain else free


def next_batch(frontier: DataFrame, now: float, limit: int | None = 10, domain: str = "", lease_seconds: float = 900) -> DataFrame:
    """The rows to work on next, as they stand: highest priority, then oldest, then by hash. A top-k, no global window; all rows if limit is None."""
    order = [F.desc("priority"), F.asc("created_at"), F.asc("url_hash")]
    ready = frontier.filter(eligible(now, lease_seconds, domain)).orderBy(*order)
    return ready if limit is None else ready.limit(max(1, min(limit, MOST_LEASED)))


def lease(frontier: DataFrame, batch: DataFrame, now: float, worker_id: str = "local", token: str = "", most: int | None = MOST_LEASED) -> DataFrame:
    """The frontier after the batch, or its first `most` rows, is handed to a worker."""
    mine = batch.select("url_hash", F.lit(True).alias("_mine"))
    mine = mine if most is None else mine.limit(most)
    return _update(frontier.join(mine, "url_hash", "left"), {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "worker_id": F.lit(worker_id), "locked_at": F.lit(now), "updated_at": F.lit(now), "lease_token": F.lit(token)}, frontier)


def _update(joined: DataFrame, values: dict[str, Column], like: DataFrame) -> DataFrame:
    hit = F.col("_mine").isNotNull()
    return joined.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(like.schema[c].dataType).alias(c) if c in values else F.col(c) for c in like.columns])


def mark_done(frontier: DataFrame, items: DataFrame, now: float) -> DataFrame:
    """items: rows with url_hash."""
    mine = items.select("url_hash").distinct().withColumn("_mine", F.lit(True))
    return _update(frontier.join(mine, "url_hash", "left"), {"status": F.lit("done"), "error": F.lit(""), "updated_at": F.lit(now), "completed_at": F.lit(now), "locked_at": F.lit(0.0), "lease_token": F.lit("")}, frontier)


def mark_failed(frontier: DataFrame, items: DataFrame, now: float, error: str = "", retry: bool = True) -> DataFrame:
    mine = items.select("url_hash").distinct().withColumn("_mine", F.lit(True))
    state = {"status": F.lit("queued" if retry else "failed"), "error": F.lit(error[:MOST_ERROR]), "updated_at": F.lit(now), "completed_at": F.lit(0.0 if retry else now), "locked_at": F.lit(0.0), "lease_token": F.lit("")}
    return _update(frontier.join(mine, "url_hash", "left"), state, frontier)


def status_counts(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def top_domains(frontier: DataFrame, most: int = 20) -> DataFrame:
    return frontier.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("domain")).limit(most)


def might_contain(items: DataFrame, seen: DataFrame, key: str = "url_hash", bits: int = 24) -> DataFrame:
    """items with `maybe`: false says for certain that the key isn't in seen.

    Keys are folded to 2**bits values; the different ones of seen (at most that many) are joined.
    """
    fold = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    some = seen.select(fold.alias("_fold")).distinct().withColumn("_in", F.lit(True))
    return items.withColumn("_fold", fold).join(some, "_fold", "left").withColumn("maybe", F.col("_in").isNotNull()).drop("_fold", "_in")


def dequeue_order(requests: DataFrame) -> DataFrame:
    """Requests of a scheduler in the order it hands them out: priority, then first in; repeats of a fingerprint once unless exempt."""
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("seq")) == 1
    kept = requests.withColumn("_first", first).filter(F.col("dont_filter") | F.col("_first")).drop("_first")
    return kept.orderBy(F.desc("priority"), F.asc("seq"))


def hand_out(requests: DataFrame) -> DataFrame:
    """The requests of dequeue_order with their number n from 1 in that order, without a sort in one task.

    Range partitions are numbered each on its own; only their sizes meet on the driver.
    """
    order = [F.desc("priority"), F.asc("seq")]
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("seq")) == 1
    kept = requests.withColumn("_first", first).filter(F.col("dont_filter") | F.col("_first")).drop("_first")
    dealt = write_out(kept.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "requests")
    starts, total = [], 0
    for r in sorted(dealt.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r["_pid"], total))
        total += r["n"]
    base = requests.sparkSession.createDataFrame(starts, "_pid int, _base long")
    own = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return dealt.withColumn("n", own).join(F.broadcast(base), "_pid").withColumn("n", F.col("n") + F.col("_base")).drop("_pid", "_base")


#: Bits of a bucket of a Bloom filter, as Spark's bitmap functions have them.
BUCKET = 32768
#: A filter of 8 MB.
MOST_BITS = 26


def bloom_bits(keys: int) -> int:
    """The bits of a filter that holds so many keys at 1 %, with 7 hashes."""
    return max(15, (max(keys, 1) * 52 // 5 - 1).bit_length())


def _bloom_bucket(key: Column, bits: int) -> Column:
    """The bucket that all bits of a key lie in, so that one row of the filter tells about it."""
    return F.pmod(F.xxhash64(key), F.lit(max(1, (1 << bits) // BUCKET)))


def _bloom_places(key: Column, bits: int, hashes: int) -> Column:
    """The places, from 0, of a key in its bucket."""
    return F.transform(F.array(*[F.lit(k) for k in range(hashes)]), lambda k: F.pmod(F.xxhash64(k, key), F.lit(min(1 << bits, BUCKET))))


def bloom(seen: DataFrame, key: str = "url_hash", bits: int = 23, hashes: int = 7) -> DataFrame:
    """(bucket, bitmap): a Bloom filter of the keys, of 2**bits bits however many they are; 2**23 bits hold 800,000 keys at 1 %, bloom_bits tells how many are needed."""
    place = seen.filter(F.col(key).isNotNull()).select(_bloom_bucket(F.col(key), bits).alias("bucket"), F.explode(_bloom_places(F.col(key), bits, hashes)).alias("p"))
    return place.groupBy("bucket").agg(F.bitmap_construct_agg("p").alias("bitmap"))


def bloom_merge(*filters: DataFrame) -> DataFrame:
    """One filter of all keys of filters of one size: what is added to a stored filter, or filters of parts of a frontier."""
    both = filters[0]
    for other in filters[1:]:
        both = both.unionByName(other)
    return both.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _bloom_held(items: DataFrame, stored: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    byte = lambda p: F.conv(F.hex(F.substring(F.col("_bitmap"), F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = lambda p: F.coalesce(F.floor(byte(p) / F.pow(F.lit(2), p % 8)) % 2 == 1, F.lit(False))
    met = items.withColumn("_bucket", _bloom_bucket(F.col(key), bits)).join(stored, F.col("_bucket") == F.col("_of"), "left")
    return met.withColumn("maybe", F.coalesce(F.forall(_bloom_places(F.col(key), bits, hashes), bit), F.lit(False))).drop("_bucket", "_of", "_bitmap")


def bloom_maybe(items: DataFrame, stored: DataFrame, key: str = "url_hash", bits: int = 23, hashes: int = 7) -> DataFrame:
    """items with `maybe`: false says for certain that the key isn't in the filter, which is a megabyte for 2**23 bits and goes to all tasks."""
    if bits > MOST_BITS:
        raise ValueError(f"a filter of 2**{bits} bits is too large to be broadcast: use bloom_joined, join the keys, or use might_contain")
    return _bloom_held(items, F.broadcast(stored.select(F.col("bucket").alias("_of"), F.col("bitmap").alias("_bitmap"))), key, bits, hashes)


def bloom_joined(items: DataFrame, stored: DataFrame, key: str = "url_hash", bits: int = 23, hashes: int = 7) -> DataFrame:
    """As bloom_maybe, for filters of any size: items meet the filter by bucket and nothing is broadcast."""
    return _bloom_held(items, stored.select(F.col("bucket").alias("_of"), F.col("bitmap").alias("_bitmap")).hint("merge"), key, bits, hashes)
