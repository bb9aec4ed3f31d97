"""Leases as a stream, table functions in SQL texts, and the end of a log."""

import heapq
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sluice.functions import udtf
from sluice.sources import tail
from sluice.streaming import leases
from tests.conftest import SF


def plain_leases(events, gap, lease, most, until):
    """(domain, url, attempt, start) by one pass over all events in the order of time."""
    out = set()
    for domain in {e[0] for e in events}:
        heap = [(at, kind, url) for d, url, kind, at in events if d == domain]
        heapq.heapify(heap)
        attempts, ends, done, last = {}, {}, set(), None
        while heap and heap[0][0] <= until:
            at, kind, url = heapq.heappop(heap)
            if kind == 0:
                done.add(url)
                continue
            again = kind == 2 and ends.get(url) == at and url not in done and attempts[url] < most
            if not again and (kind == 2 or url in attempts or url in done):
                continue
            last = at if last is None else max(at, last + gap)
            attempts[url] = attempts.get(url, 0) + 1
            ends[url] = last + lease
            out.add((domain, url, attempts[url], last))
            heapq.heappush(heap, (last + lease, 2, url))
    return out


@pytest.mark.parametrize("cuts", [(1,), (3,), (2, 5)])
def test_a_restarted_stream_gives_the_same_leases(spark, tmp_path, cuts):
    rng = random.Random(8)
    events = [(f"d{rng.randrange(3)}", f"u{rng.randrange(25)}", rng.choice([1, 1, 1, 0]), 1000 * rng.randrange(1, 600)) for _ in range(160)]
    events = sorted(events, key=lambda e: e[3] + 1000 * rng.randrange(20)) + [("flush", "x", 1, 4_000_000)]
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    (tmp_path / "in").mkdir()
    parts = [events[k * len(events) // 8 : (k + 1) * len(events) // 8] for k in range(8)]
    schema = "domain string, url string, kind string, ts timestamp"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for end in (*cuts, 8):
            for k in range(end):
                path = tmp_path / "in" / f"{k}.json"
                if not path.exists():
                    path.write_text("\n".join(json.dumps({"domain": d, "url": u, "kind": ["done", "found"][kind], "ts": f"1970-01-01T{at // 3_600_000:02}:{at // 60_000 % 60:02}:{at // 1000 % 60:02}Z"}) for d, u, kind, at in parts[k]))
                    os.utime(path, (1e9 + k, 1e9 + k))  # files are taken in the order of their times
            stream = leases.with_state(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
            q = leases.leases(stream, 7, lease=60, most=3, late="30 seconds").writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    rows = [tuple(r) for r in spark.read.parquet(out).select("domain", "url", "attempt", "starts_at").collect()]
    want = plain_leases(events, 7000, 60_000, 3, (4_000_000 - 30_000) // leases.SLOT * leases.SLOT - 1)
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert max(r[2] for r in rows) == 3 and len(rows) > 75


# ------------------------------------------------------------------ table functions


def test_table_functions(spark):
    udtf.register(spark)
    rows = [(1, "http://h/a", "<h1>Title</h1><a class=p href='/x'>X</a><a href='y'>Y</a><table><tr><td>sum<td>total 5</table>", "k"), (2, "http://h/b", None, "k"), (3, None, "<a href='/z'>Z</a>", "k")]
    spark.createDataFrame(rows, "page_id int, url string, html string, text string").createOrReplaceTempView("udtf_pages")
    links = spark.sql("SELECT * FROM extract_links(TABLE(udtf_pages), 'a') ORDER BY page_id, pos")
    assert links.columns == ["page_id", "url", "text", "pos", "link", "text_"]
    assert [(r["page_id"], r["link"], r["text_"], r["text"]) for r in links.collect()] == [(1, "http://h/x", "X", "k"), (1, "http://h/y", "Y", "k"), (3, "/z", "Z", "k")]
    fields = spark.sql("SELECT page_id, title, price FROM page_fields(TABLE(SELECT page_id, html FROM udtf_pages), map('title', 'h1', 'price', '.price')) ORDER BY 1")
    assert [tuple(r) for r in fields.collect()] == [(1, "Title", None), (2, None, None), (3, None, None)]
    found = spark.sql("SELECT * FROM find_elements(TABLE(SELECT page_id, html FROM udtf_pages), 'td', '^total [0-9]')")
    assert [r["text"] for r in found.collect()] == ["total 5"]
    best = spark.sql("SELECT field, selector FROM field_scores(TABLE(SELECT page_id, html FROM udtf_pages), 'title, link') WHERE page_id = 1")
    assert {tuple(r) for r in best.collect()} == {("title", "h1"), ("link", "a.p@href")}
    for bad in ("extract_links(TABLE(udtf_pages), 'a[')", "extract_links(TABLE(SELECT 1 AS x), 'a')", "find_elements(TABLE(udtf_pages), 'a', '(')"):
        with pytest.raises(Exception, match="(?i)selector|column html|analy|regular|missing|unterminated"):
            spark.sql(f"SELECT * FROM {bad}").collect()


# ------------------------------------------------------------------ the end of a log


@pytest.fixture
def log(tmp_path):
    rng = random.Random(2)
    rows = []
    for k in range(3):
        lines = []
        for i in range(4000):
            row = {"ts": f"{k}-{i:05}", "event": rng.choice(["fetch", "parse"]), "domain": f"d{rng.randrange(50)}.é", "duration_ms": i, "success": i % 2 == 0}
            lines.append(rng.choice(["{broken", "[1]", "", "3"]) if i % 50 == 0 else json.dumps(row, ensure_ascii=False))
            if i % 50:
                rows.append(row)
        (tmp_path / f"events-{k}.jsonl").write_text("\n".join(lines) + ("" if k == 1 else "\n"), encoding="utf-8")
    return str(tmp_path), rows


@pytest.mark.parametrize("block", [1, 7, 4096, 1 << 20])
def test_lines_from_the_end(block):
    for data in (b"", b"\n", b"a", b"a\nb", b"a\n\nb\n", "é\n漢\n".encode() * 5):
        got = [x for x in tail.lines_back(lambda at, n, data=data: data[at : at + n], len(data), block) if x]
        assert got == [x for x in data.split(b"\n") if x][::-1]


def test_tail_equals_a_full_read_and_reads_a_share(spark, log):
    path, rows = log
    tail.register(spark)
    size = sum(s for _, s in tail.files_of(path)[1])
    for lines, event, domain in ((10, "", ""), (500, "fetch", ""), (40, "parse", "d7."), (10**6, "", "")):
        want = [r for r in rows if (not event or r["event"] == event) and domain in r["domain"]][-lines:]
        found, taken = tail.tail(path, lines, tail.matching(event, domain), 4096)
        assert found == want
        # What is read follows what is asked for, within a block.
        needed = len(rows) if lines > len(rows) else rows[::-1].index(want[0]) + 1
        assert taken <= 1.1 * size * needed / len(rows) + 3 * 4096
        df = spark.read.format("log_tail").option("path", path).option("lines", lines).option("event", event).option("domain", domain).load()
        got = [(r["ts"], r["event"], r["domain"], r["duration_ms"], r["success"]) for r in df.collect()]
        assert got == [(r["ts"], r["event"], r["domain"], float(r["duration_ms"]), r["success"]) for r in want]
    own = spark.read.format("log_tail").schema("ts string, nope long, duration_ms string").option("path", path).option("lines", 1).load().first()
    assert tuple(own) == (rows[-1]["ts"], None, str(rows[-1]["duration_ms"]))
    assert spark.read.format("log_tail").option("path", f"{path}/none").load().count() == 0


def test_a_call_to_the_state_is_about_many_urls():
    class State(dict):
        calls = 0

        def getValue(self, key):
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    state, told = State(), {"n": 0, "bits": 0}
    for first in range(0, 20_000, 4_000):
        seen = leases._Seen(state, told)
        for i in range(max(0, first - 500), first + 4_000):
            assert seen.get(f"u{i}") == ((1, i) if i < first else None)
            seen.put(f"u{i}", (1, i))
        seen.flush()
    assert told["n"] == 20_000 and told["n"] <= leases.FULL << told["bits"] and len(state) == 1 << told["bits"]
    assert state.calls < 3_000 and all(leases._Seen(state, told).get(f"u{i}") == (1, i) for i in (0, 777, 19_999))
