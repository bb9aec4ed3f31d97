"""A frontier as a stream: requests are handed out by domain, apart from each other, and again if nobody answers.

Events (domain, url, kind, ts) say that a URL was found or that its request is done. Of each domain every URL is
handed out once, `gap` seconds behind the one before; a request that is not done within `lease` seconds is handed
out again, up to `most` times. State is kept by domain in RocksDB: URLs that were seen, for good, so repeats are
known however late; what is due; and the last start. URLs lie in buckets that are split as they grow, and what is due
in parts by the hour, so that one call to the state is about many. What comes is held until the watermark has passed its slot
of SLOT ms and then taken in the order of its time, so the result doesn't depend on how the stream is cut into
batches, nor on where it was stopped and started again. One timer by event time wakes a domain up when its first slot ends.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "domain string, url string, attempt int, starts_at long"
#: Kinds of events in the order in which those of one time are taken; the last is a lease that has run out.
DONE, FOUND, EXPIRED = range(3)
SLOT = 60_000
#: What is due is kept by so many ms; URLs that a bucket holds on average; and events that are taken at once.
HOLD, FULL, GROUP = 60 * SLOT, 128, 100_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Schedule:
    """The rules for one domain, on a map of URLs to (attempt, end of the lease or -1) and the last start; times in ms."""

    def __init__(self, gap: int, lease: int, most: int):
        self.gap, self.lease, self.most = gap, lease, most

    def take(self, at: int, kind: int, url: str, seen, last: int | None) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, str]], int | None]:
        """(handed out, further events, last start) of one event. seen: get and put."""
        known = seen.get(url)
        if kind == DONE:
            seen.put(url, (known[0] if known else 0, -1))
            return [], [], last
        attempt, until = known if known else (0, -1)
        fresh = kind == FOUND and known is None
        if not fresh and (kind != EXPIRED or until != at or attempt >= self.most):
            return [], [], last
        start = at if last is None else max(at, last + self.gap)
        seen.put(url, (attempt + 1, start + self.lease))
        # The end of the last lease changes nothing.
        return [(url, attempt + 1, start)], [(start + self.lease, EXPIRED, url)] if attempt + 1 < self.most else [], start


class _Seen:
    """URLs in 2**bits buckets of one map state; a bucket is read once, and written by flush if it was changed."""

    def __init__(self, state, told: dict):
        self.state, self.told = state, told
        self.read: dict[int, dict] = {}
        self.changed: set[int] = set()

    def _bucket(self, url: str) -> int:
        return zlib.crc32(url.encode("utf-8", "surrogatepass")) & ((1 << self.told["bits"]) - 1)

    def _held(self, bucket: int) -> dict:
        if bucket not in self.read:
            found = self.state.getValue((bucket,))
            self.read[bucket] = json.loads(found[0]) if found else {}
        return self.read[bucket]

    def get(self, url: str) -> tuple[int, int] | None:
        known = self._held(self._bucket(url)).get(url)
        return tuple(known) if known else None

    def put(self, url: str, value: tuple[int, int]) -> None:
        bucket = self._bucket(url)
        held = self._held(bucket)
        self.told["n"] += url not in held
        held[url] = value
        self.changed.add(bucket)

    def flush(self) -> None:
        for bucket in self.changed:
            self.state.updateValue((bucket,), (json.dumps(self.read[bucket]),))
        self.read, self.changed = {}, set()
        while self.told["n"] > FULL << self.told["bits"]:
            before = 1 << self.told["bits"]
            self.told["bits"] += 1
            for bucket in range(before):
                parts: tuple[dict, dict] = {}, {}
                for url, value in self._held(bucket).items():
                    parts[self._bucket(url) >= before][url] = value
                for k, part in ((bucket, parts[0]), (bucket + before, parts[1])):
                    self.state.updateValue((k,), (json.dumps(part),))
                del self.read[bucket]


class LeaseProcessor(StatefulProcessor):
    def __init__(self, schedule: Schedule):
        self.schedule = schedule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "bucket int", "urls string")
        self.due = handle.getMapState("due", "hour long, part int", "events string")
        self.told = handle.getValueState("told", "data string")

    def _told(self) -> dict:
        """last: the last start; n and bits: of the URLs seen; due: by hour the parts there are and the first time in them; wake: the timer."""
        found = self.told.get() if self.told.exists() else None
        return json.loads(found[0]) if found else {"last": None, "n": 0, "bits": 0, "due": {}, "wake": None}

    def _tell(self, told: dict) -> None:
        """Keep what is told, with a timer at the end of the first slot that is due."""
        first = min((x[1] for x in told["due"].values()), default=None)
        wake = None if first is None else (first // SLOT + 1) * SLOT - 1
        if wake != told["wake"]:
            if told["wake"] is not None:
                self.handle.deleteTimer(told["wake"])
            if wake is not None:
                self.handle.registerTimer(wake)
        told["wake"] = wake
        self.told.update((json.dumps(told),))

    @staticmethod
    def _horizon(timerValues) -> int:
        """What was before this time has been taken."""
        return (timerValues.getCurrentWatermarkInMs() + 1) // SLOT * SLOT

    def _hold(self, told: dict, events: list) -> None:
        hours: dict[int, list] = {}
        for event in events:
            hours.setdefault(event[0] // HOLD, []).append(event)
        for hour, held in hours.items():
            known = told["due"].setdefault(str(hour), [0, held[0][0]])
            self.due.updateValue((hour, known[0]), (json.dumps(held),))
            told["due"][str(hour)] = [known[0] + 1, min(known[1], *(e[0] for e in held))]

    def _ready(self, told: dict, taken: int) -> tuple[list, int]:
        """Events of the first hours that are due, GROUP of them or some more, out of the state, and the time before which these are all."""
        out: list = []
        end = 0
        for hour in sorted(int(h) for h, (_, first) in told["due"].items() if first < taken):
            if len(out) >= GROUP:
                break
            for part in range(told["due"].pop(str(hour))[0]):
                out += map(tuple, json.loads(self.due.getValue((hour, part))[0]))
                self.due.removeKey((hour, part))
            end = min(taken, (hour + 1) * HOLD)
        return out, end

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken, told, events = self._horizon(timerValues), self._told(), []
        for pdf in rows:
            for at, kind, url in zip(pdf["at"], pdf["kind"], pdf["url"], strict=True):
                # What comes behind the watermark is taken next: it is late, not lost.
                events.append((max(int(at), taken), DONE if kind == "done" else FOUND, url))
            if len(events) >= GROUP:
                self._hold(told, events)
                events = []
        self._hold(told, events)
        self._tell(told)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        taken, told = self._horizon(timerValues), self._told()
        told["wake"] = None if told["wake"] == expiredTimerInfo.getExpiryTimeInMs() else told["wake"]
        while (ready := self._ready(told, taken))[0]:
            events, end = ready
            heap = [e for e in events if e[0] < end]
            later = [e for e in events if e[0] >= end]
            heapq.heapify(heap)
            seen, out = _Seen(self.seen, told), []
            while heap:
                at, kind, url = heapq.heappop(heap)
                handed, further, told["last"] = self.schedule.take(at, kind, url, seen, told["last"])
                out += [(key[0], u, attempt, start) for u, attempt, start in handed]
                for event in further:
                    if event[0] < end:
                        heapq.heappush(heap, event)
                    else:
                        later.append(event)
            seen.flush()
            self._hold(told, later)
            if out:
                yield pd.DataFrame(out, columns=["domain", "url", "attempt", "starts_at"]).astype({"attempt": "int32", "starts_at": "int64"})
        self._tell(told)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def leases(events: DataFrame, gap: float, lease: float = 900, most: int = 3, late: str = "10 minutes") -> DataFrame:
    """(domain, url, attempt, starts_at in ms) of a stream of (domain, url, kind, ts); gap and lease in seconds.

    The query that runs it needs a state store that has timers and maps: see with_state.
    """
    rows = events.select(F.col("domain").cast("string").alias("domain"), "url", "kind", "ts", F.unix_millis(F.col("ts")).alias("at")).filter("domain is not null and url is not null and ts is not null")
    schedule = Schedule(int(gap * 1000), int(lease * 1000), most)
    return rows.withWatermark("ts", late).groupBy("domain").transformWithStateInPandas(statefulProcessor=LeaseProcessor(schedule), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def with_state(spark: SparkSession) -> SparkSession:
    """The session, with the state store that leases needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark
