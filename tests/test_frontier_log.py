"""The stored frontier against the frontier that is rewritten as a whole, step by step."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sluice.operators import frontier
from sluice.operators.frontier_log import StoredFrontier
from sluice.session import new_path, write_out

COLUMNS = ("url", "status", "attempts", "worker_id", "error", "updated_at", "locked_at", "completed_at", "lease_token", "priority", "depth")


def state(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return sorted(rows)


def urls(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "url string, pos long")


@pytest.mark.parametrize("seed", [1, 2])
def test_steps_equal_those_on_a_whole_table(spark, seed):
    rng = random.Random(seed)
    stored = StoredFrontier(spark, new_path(spark, "frontier"), buckets=7)
    whole = spark.createDataFrame([], frontier.SCHEMA)
    behind = {}
    for step in range(9):
        now = float(step * 500)
        kind = "add" if step in (0, 4) else rng.choice(["lease", "done", "failed", "compact", "lease"])
        if kind == "add":
            new = urls(spark, [f"http://h/{rng.randrange(40)}#{i}" for i in range(30)] + ["no url", None])
            counts = stored.add(new, now, order="pos", priority=step)
            whole, want = frontier.add_urls(whole, new, now, order="pos", priority=step)
            assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in want.collect()}
        elif kind == "lease":
            got = stored.lease(now, 6, lease_seconds=900, token=f"t{step}")
            batch = frontier.next_batch(whole, now, 6, lease_seconds=900)
            assert sorted(r["url"] for r in got.collect()) == sorted(r["url"] for r in batch.collect())
            whole = frontier.lease(whole, batch, now, token=f"t{step}")
        elif kind in ("done", "failed"):
            some = whole.filter(F.col("status") == "running").orderBy("url").limit(4)
            some = write_out(some.unionByName(some), "some")
            if kind == "done":
                stored.done(some, now)
                whole = frontier.mark_done(whole, some, now)
            else:
                stored.failed(some, now, "x" * 600, retry=bool(step % 2))
                whole = frontier.mark_failed(whole, some, now, "x" * 600, retry=bool(step % 2))
        else:
            stored.compact()
        whole = write_out(whole, "whole")
        assert state(stored.table()) == state(whole), (step, kind)
        behind[max(stored.versions())] = state(whole)
    stored.compact()
    assert state(stored.table()) == state(whole) == state(stored.replay())
    for version, want in behind.items():
        assert state(stored.replay(version)) == want
    stored.forget()
    assert state(stored.table()) == state(whole) and stored.versions() == []
    # Numbers go on behind those forgotten.
    stored.lease(1e6, 1)
    assert stored.versions() == [stored.folded() + 1]


def parts(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_step_touches_the_buckets_of_its_rows(spark):
    path = new_path(spark, "frontier")
    stored = StoredFrontier(spark, path, buckets=32)
    stored.add(urls(spark, [f"http://h/{i}" for i in range(2000)]), 1.0, order="pos")
    assert len(stored.compact()) == 32
    before = parts(f"{path}/base")
    leased = stored.lease(2.0, 3)
    hit = {r["b"] for r in leased.select(stored.bucket(F.col("url_hash")).alias("b")).collect()}
    version = stored.versions()[-1]
    assert stored.batch(version).count() == 3 and set(stored.touched()) == hit and len(hit) <= 3
    assert parts(f"{path}/base") == before
    # Reading rows of these names their directories.
    plan = stored.rows_of(leased)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=) ", plan)
    stored.compact()
    after = parts(f"{path}/base")
    changed = {f.split("bucket=")[1].split("/")[0] for f in before.keys() ^ after.keys()}
    assert {int(x) for x in changed} == hit


def test_what_was_cut_off_does_not_count(spark):
    path = new_path(spark, "frontier")
    stored = StoredFrontier(spark, path, buckets=4)
    stored.add(urls(spark, [f"http://h/{i}" for i in range(20)]), 1.0, order="pos")
    stored.lease(2.0, 5, token="a")
    want = state(stored.table())
    # A compaction that wrote the base but not its mark.
    stored.compact()
    local = path.removeprefix("file:")
    mark = next(d for d, _, names in os.walk(f"{local}/folded") if "_SUCCESS" in names)
    os.unlink(f"{mark}/_SUCCESS")
    assert state(stored.table()) == want
    stored.compact()
    assert state(stored.table()) == want
    # A batch that was not ended.
    stored.lease(3.0, 5, token="b")
    last = stored.versions()[-1]
    os.unlink(f"{local}/log/batch-{last:010d}/_SUCCESS")
    assert state(stored.table()) == want
    again = stored.lease(3.0, 5, token="c")
    assert stored.versions()[-1] == last and {r["lease_token"] for r in again.collect()} == {"c"}


def test_empty(spark):
    stored = StoredFrontier(spark, new_path(spark, "frontier"))
    assert stored.table().count() == 0 and stored.compact() == [] and stored.lease(1.0).count() == 0
    assert stored.add(urls(spark, []), 1.0, order="pos").count() == 0


def test_what_is_written_aside_has_no_hashes_of_urls(spark, monkeypatch):
    from sluice.operators import frontier_log

    aside = {}
    monkeypatch.setattr(frontier_log, "write_out", lambda df, name: (aside.update({name: df.columns}), write_out(df, name))[1])
    stored = StoredFrontier(spark, new_path(spark, "frontier"), buckets=4)
    stored.add(spark.range(50).selectExpr("concat('http://h/', id) as url"), 1.0)
    stored.compact()
    assert not any("url_hash" in columns for columns in aside.values()) and set(aside["incoming"]) == {"url", "outcome"}
    counts = {r["outcome"]: r["n"] for r in stored.add(spark.range(40, 60).selectExpr("concat('http://h/', id) as url"), 2.0, priority=3).collect()}
    rows = stored.table()
    assert counts == {"added": 10, "skipped": 10} and rows.count() == 60 and rows.filter(F.col("url_hash") != F.sha2("url", 256)).count() == 0
    assert rows.filter("priority = 3").count() == 10
