"""Memory of domains, targets, proxies and caches, computed from logs of attempts by scans over ranges of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import write_out

DAY = 86400
MODES = ("requests", "curl_cffi", "browser")


def _deal(log: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """log, written in ranges of key and order with the range's number: a key with very many rows is spread over ranges."""
    return write_out(log.repartitionByRange(F.col(key), *order).withColumn("_pid", F.spark_partition_id()), name)


def _carried(log: DataFrame, ends: DataFrame, key: str, state: str, none: tuple, fold: Callable[[tuple, Row], tuple]) -> DataFrame:
    """(_key, _at, state): what each range of a key takes over from those before it. ends: a row a range and key.

    Only keys that lie in several ranges count, of which there are fewer than ranges; their ends, each of a fixed
    size, meet on the driver.
    """
    spread = ends.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(key).alias("_key"))
    pieces = ends.join(spread, F.col(key).eqNullSafe(F.col("_key"))).drop(key)
    carried, last = [], None
    for r in sorted(pieces.collect(), key=lambda r: (r["_key"] is None, r["_key"], r["_pid"])):
        now = last[1] if last and last[0] == r["_key"] else none
        carried.append((r["_key"], r["_pid"], *now))
        last = (r["_key"], fold(now, r))
    fields = [T.StructField("_key", log.schema[key].dataType), T.StructField("_at", T.IntegerType()), *T.StructType.fromDDL(state)]
    return log.sparkSession.createDataFrame(carried, T.StructType(fields))


def _taking(own: DataFrame, carry: DataFrame, key: str) -> DataFrame:
    return own.join(F.broadcast(carry), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_pid") == F.col("_at")), "left")


def _run_columns(dealt: DataFrame, key: str, order: list[str]) -> DataFrame:
    """dealt (with _ok, _pid) and, inside each range, the runs that end at a row (_s, _f) and what broke them (_bad, _good)."""
    frame = lambda *by: Window.partitionBy("_pid", key, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda c, *by: F.coalesce(F.sum(c).over(frame(*by)), F.lit(0))
    went, failed = F.col("_ok"), 1 - F.col("_ok")  # an attempt of unknown outcome neither counts nor breaks a run
    return dealt.withColumns({"_bad": total(failed), "_good": total(went)}).withColumns({"_s": total(went, "_bad"), "_f": total(failed, "_good")})


_RUNS = "_cs long, _cf long"


def _fold_runs(now: tuple, e: Row) -> tuple:
    return e["_s"] + (now[0] if not e["_bad"] else 0), e["_f"] + (now[1] if not e["_good"] else 0)


def _runs(own_run: str, broken: str, carried: str) -> Column:
    return F.col(own_run) + F.when(F.col(broken) == 0, F.coalesce(F.col(carried), F.lit(0))).otherwise(F.lit(0))


def streaks(log: DataFrame, key: str, order: list[str], success: Column) -> DataFrame:
    """log with success_streak and fail_streak as they stand after each attempt.

    Attempts are dealt by ranges of key and order. Each range counts on its own; the runs with which ranges
    end are carried over.
    """
    own = _run_columns(_deal(log.withColumn("_ok", success.cast("int")), key, order, "attempts"), key, order)
    ends = own.groupBy(key, "_pid").agg(F.max_by(F.struct("_s", "_f", "_bad", "_good"), F.struct(*order)).alias("e")).select(key, "_pid", "e.*")
    both = _taking(own, _carried(log, ends, key, _RUNS, (0, 0), _fold_runs), key)
    return both.select(*log.columns, _runs("_s", "_bad", "_cs").alias("success_streak"), _runs("_f", "_good", "_cf").alias("fail_streak"))


def domain_memory(log: DataFrame, key: str, order: list[str], success: Column, mode: Column, at: Column) -> DataFrame:
    """(key, preferred_mode, success_streak, fail_streak, attempts, last_success): the state after all attempts of each key."""
    seq = F.struct(*order)
    run = log.select(F.col(key).alias("key"), success.alias("ok"), mode.alias("mode"), at.alias("at"), seq.alias("seq"))
    last = run.groupBy("key").agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("last_ok"), F.max(F.when(~F.col("ok"), F.col("seq"))).alias("last_bad"), F.max_by("mode", F.when(F.col("ok"), F.col("seq"))).alias("preferred_mode"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"), F.count(F.lit(1)).alias("attempts"))
    both = run.join(last, "key")
    good = F.col("ok") & (F.col("last_bad").isNull() | (F.col("seq") > F.col("last_bad")))
    bad = ~F.col("ok") & (F.col("last_ok").isNull() | (F.col("seq") > F.col("last_ok")))
    return both.groupBy("key").agg(F.any_value("preferred_mode").alias("preferred_mode"), F.sum(good.cast("long")).alias("success_streak"), F.sum(bad.cast("long")).alias("fail_streak"), F.any_value("attempts").alias("attempts"), F.any_value("last_success").alias("last_success"))


def lookup(memory: DataFrame, urls: DataFrame, on: str, now: float, fresh_seconds: float = DAY, valid_seconds: float = 7 * DAY) -> DataFrame:
    """urls with the memory of their key where it holds: fewer than 3 failures in a row, last success not too old."""
    holds = (F.col("fail_streak") < 3) & (F.col("last_success") >= now - valid_seconds)
    good = memory.filter(holds).withColumn("fresh", F.col("last_success") >= now - fresh_seconds)
    return urls.join(good, urls[on] == good["key"], "left").withColumn("hit", F.col("key").isNotNull())


def by_mode(memory: DataFrame) -> DataFrame:
    return memory.groupBy(F.coalesce(F.nullif("preferred_mode", F.lit("")), F.lit("unknown")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


def upsert_latest(records: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the latest record."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def target_key(kind: Column, name: Column, url: Column) -> Column:
    return F.lower(F.concat_ws("|", *[F.trim(F.coalesce(c, F.lit(""))) for c in (kind, name, url)]))


def recent_rates(log: DataFrame, key: str, order: list[str], success: Column, last: int = 20) -> DataFrame:
    """log with n_recent and rate over the last attempts, fails in a row, and whether the key is disabled then and for how long.

    Attempts are dealt by ranges of key and order, as for streaks. A range takes over, beside the runs and the
    failures so far, a halo: whether the last - 1 attempts before it went well, from as many ranges as it takes.
    """
    own = _run_columns(_deal(log.withColumn("_ok", success.cast("int")), key, order, "attempts"), key, order)
    by = Window.partitionBy("_pid", key)
    upto = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = by.orderBy(*order).rowsBetween(-(last - 1), Window.currentRow)
    own = own.withColumns({"_i": F.count(F.lit(1)).over(upto), "_c": F.count(F.lit(1)).over(by), "_n": F.count(F.lit(1)).over(near), "_known": F.count("_ok").over(near), "_went": F.coalesce(F.sum("_ok").over(near), F.lit(0)), "_failed": F.coalesce(F.sum(1 - F.col("_ok")).over(upto), F.lit(0))})
    tail = F.sort_array(F.collect_list(F.when(F.col("_i") > F.col("_c") - (last - 1), F.struct("_i", "_ok"))))
    ends = own.groupBy(key, "_pid").agg(F.max_by(F.struct("_s", "_f", "_bad", "_good"), F.struct(*order)).alias("e"), F.coalesce(F.sum(1 - F.col("_ok")), F.lit(0)).alias("_all"), tail.alias("_tail"))

    def fold(now: tuple, r: Row) -> tuple:
        halo = [*now[3], *(x["_ok"] for x in r["_tail"])]
        return *_fold_runs(now, r), now[2] + r["_all"], halo[max(0, len(halo) - (last - 1)) :]

    carry = _carried(log, ends.select(key, "_pid", "e.*", "_all", "_tail"), key, f"{_RUNS}, _cfailed long, _halo array<int>", (0, 0, 0, []), fold)
    both = _taking(own, carry, key)
    # Of the halo as many attempts as the row's own range lacks, from its end.
    lacking = F.greatest(F.lit(last) - F.col("_i"), F.lit(0)).cast("int")
    halo = F.coalesce("_halo", F.array().cast("array<int>"))
    before = F.slice(halo, F.greatest(F.size(halo) - lacking + 1, F.lit(1)), lacking)
    known = F.filter(before, lambda x: x.isNotNull())
    n_known, went = F.col("_known") + F.size(known), F.col("_went") + F.aggregate(known, F.lit(0).cast("long"), lambda a, x: a + x)
    out = both.select(
        *log.columns, _runs("_s", "_bad", "_cs").alias("success_streak"), _runs("_f", "_good", "_cf").alias("fail_streak"), (F.col("_n") + F.size(before)).alias("n_recent"),
        F.when(n_known > 0, went / n_known).alias("rate"), (F.col("_failed") + F.coalesce("_cfailed", F.lit(0))).alias("total_fail"),
    )
    failing = ~success & ((F.col("fail_streak") >= 3) | ((F.col("n_recent") >= 10) & (F.col("rate") < 0.5)))
    return out.withColumns({"disabled": failing, "penalty": F.when(failing, F.least(60 * F.greatest("fail_streak", "total_fail"), F.lit(600)))})


def next_allowed(requests: DataFrame, key: str, order: list[str], at: Column, gap: Column) -> DataFrame:
    """requests with starts_at: when each request of a domain may start, if it starts gap behind the one before it.

    A start is the greater of the request's own time and the start before it plus gap. Over a range of rows that
    is again a maximum and a sum, so ranges are scanned each on its own, and the start with which a range ends,
    and its sum of gaps, are carried over.
    """
    dealt = _deal(requests.withColumns({"_time": at, "_gap": gap}), key, order, "requests")
    upto = Window.partitionBy("_pid", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.withColumn("_gaps", F.sum("_gap").over(upto))
    own = own.withColumn("_start", F.max(F.col("_time") - F.col("_gaps")).over(upto) + F.col("_gaps"))
    ends = own.groupBy(key, "_pid").agg(F.max("_start").alias("_last"), F.sum("_gap").alias("_sum"))

    def fold(now: tuple, r: Row) -> tuple:
        return (r["_last"] if now[0] is None else max(now[0] + r["_sum"], r["_last"]),)

    kind = own.schema["_start"].dataType.simpleString()
    both = _taking(own, _carried(requests, ends, key, f"_before {kind}", (None,), fold), key)
    return both.select(*requests.columns, F.greatest("_start", F.col("_before") + F.col("_gaps")).alias("starts_at"))


def prune_cache(entries: DataFrame, size: str, order: list[str], most: int) -> DataFrame:
    """Entries that stay: if their sizes exceed most, the oldest go until at most 90 % of it is left.

    Running sums over a whole cache would meet in one task. So sizes are summed by range partition first,
    and only partitions' sums meet; the boundary partition alone is summed row by row.
    """
    total = entries.agg(F.sum(size)).first()[0] or 0
    if total <= most:
        return entries
    spare = total - 0.9 * most
    dealt = entries.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id())
    dealt = write_out(dealt, "cache")
    sums, before, starts = sorted((r["_pid"], r["s"]) for r in dealt.groupBy("_pid").agg(F.sum(size).alias("s")).collect()), 0, []
    for pid, s in sums:
        starts.append((pid, float(before)))
        before += s
    base = entries.sparkSession.createDataFrame(starts, "_pid int, _base double")
    run = F.sum(size).over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    kept = dealt.join(F.broadcast(base), "_pid").withColumn("_gone", F.col("_base") + F.coalesce(run, F.lit(0)))
    return kept.filter(F.col("_gone") >= spare).select(*entries.columns)


def cache_key(url: Column, kind: Column, variant: Column) -> Column:
    return F.md5(F.concat(url, kind.cast("string"), F.coalesce(variant, F.lit(""))))


def cached(entries: DataFrame, wanted: DataFrame, now: float, ttl: float) -> DataFrame:
    """wanted (key) with text and hit of entries (key, text, timestamp) that are not older than ttl."""
    live = entries.filter(F.col("timestamp") > now - ttl).select("key", "text")
    return wanted.join(live, "key", "left").withColumn("hit", F.col("text").isNotNull())


def first_working_mode(attempts: DataFrame, key: str, mode: str, ok: Column, challenged: Column, start: str = "curl_cffi") -> DataFrame:
    """(key, mode): of each key's attempts the first mode, from start on, that succeeded without a challenge."""
    chain = MODES[MODES.index(start) :]
    rank = F.array_position(F.array(*[F.lit(m) for m in chain]), F.col(mode))
    return attempts.filter((rank > 0) & ok & ~challenged).groupBy(key).agg(F.min_by(mode, rank).alias("mode"))


def record(memory: DataFrame, log: DataFrame, key: str, order: list[str], success: Column, mode: Column, at: Column) -> DataFrame:
    """The memory (as domain_memory gives it) after more attempts: streaks go on where no attempt of the other kind has ended them."""
    new = domain_memory(log, key, order, success, mode, at).toDF("_k", "_mode", "_good", "_bad", "_n", "_at")
    both = memory.join(new, F.col("key").eqNullSafe(F.col("_k")), "full")
    seen = F.col("_n").isNotNull()
    goes_on = lambda old, more: F.when(~seen, F.col(old)).when(F.col(more) == F.col("_n"), F.coalesce(F.col(old), F.lit(0)) + F.col(more)).otherwise(F.col(more)).alias(old)
    return both.select(
        F.coalesce("key", "_k").alias("key"),
        F.coalesce("_mode", "preferred_mode").alias("preferred_mode"),
        goes_on("success_streak", "_good"),
        goes_on("fail_streak", "_bad"),
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("attempts"),
        F.coalesce("_at", "last_success").alias("last_success"),
    )


def count_outcomes(memory: DataFrame, outcomes: DataFrame, key: str = "key", success: str = "success") -> DataFrame:
    """memory with successes and failures counted up by outcomes (key, success)."""
    new = outcomes.groupBy(F.col(key).alias("_k")).agg(F.count_if(success).alias("_s"), F.count_if(~F.col(success)).alias("_f"))
    more = lambda c, by: (F.coalesce(F.col(c) if c in memory.columns else F.lit(0), F.lit(0)) + F.coalesce(by, F.lit(0))).cast("long").alias(c)
    kept = [F.col(c) for c in memory.columns if c not in ("successes", "failures")]
    return memory.join(new, F.col(key).eqNullSafe(F.col("_k")), "left").select(*kept, more("successes", "_s"), more("failures", "_f"))


def reset(memory: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """memory without the keys (a table with the same key column)."""
    gone = keys.select(F.col(key).alias("_k")).distinct()
    return memory.join(gone, F.col(key).eqNullSafe(F.col("_k")), "left_anti")


def put(entries: DataFrame, new: DataFrame, key: str = "key", at: str = "timestamp") -> DataFrame:
    """Cache entries with the new ones; of a key the latest stays."""
    return upsert_latest(entries.unionByName(new), key, at).select(*entries.columns)


def clear_entries(entries: DataFrame, kinds: tuple[int, ...] = (), domain: str = "", *, kind: str = "kind", url: str = "url") -> DataFrame:
    """Cache entries that stay when those of the kinds, or of URLs that hold the domain, go; without both all go."""
    gone = F.lit(not kinds and not domain)
    if kinds:
        gone = gone | F.coalesce(F.col(kind).isin(*kinds), F.lit(False))
    if domain:
        gone = gone | F.coalesce(F.contains(F.col(url), F.lit(domain)), F.lit(False))
    return entries.filter(~gone)


def variant(*parts: Column) -> Column:
    """What tells cache entries of one URL apart: the hash of the parts as a JSON list."""
    return F.md5(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])).cast("binary"))
