"""Benchmark decontamination by greedy string tiling.

Words are compared in lower case, without punctuation. Runs of SEED words (seeds) of the benchmark items are
joined with those of the documents, but for each item's commonest ones, which alone can't make a hit. A
pair of a document and an item goes on if the item's words under shared seeds could reach the threshold. Then the item is tiled: the longest matches between the item and
the document that overlap no earlier ones are marked again and again, found by Karp-Rabin hashes; their
length is searched by bisection, as two texts that share a run share its parts. The share of the item's
words under tiles is its coverage, which neither the order of its passages nor text put between them
changes. An item of coverage LEAST or more, and with FLOOR words under tiles or all it has, is a hit.

The benchmark stays in tables. Documents emit their seeds; if the benchmark's seeds take up to FILTER_BYTES,
only those that are among them. The join is by seed, pairs and hits are known by the hash of the text, so
equal texts are tiled once, and the joins' sides are broadcast only below a count of their bytes.

Edge cases: null and empty texts have no hits; an item without words is never hit, one of fewer than SEED
words only if all of it stands in the document; items of equal text are hit each, rows that repeat an id
and a text count once; ids may have any type that sorts; an empty benchmark hits nothing; long texts are
scanned whole, and texts of one word in about linear time; repeated rows get equal hits; extra columns stay,
whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from sluice.llm.parts import give_back
from sluice.session import fresh, small_batches, write_out

SEED, LEAST, FLOOR = 5, 0.5, 8
#: Seeds of the benchmark that take up to so many bytes go to the tasks, which then emit no others.
FILTER_BYTES = 8 << 20
#: Tables of pairs and hits that take up to so many bytes are broadcast.
BROADCAST_BYTES = 8 << 20

_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def tokens(text: str | None) -> np.ndarray:
    """The 64-bit hashes of the text's words, the same in all processes."""
    found = words(text)
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def seeds(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words."""
    out = np.full(max(ids.size - n + 1, 0), n, np.uint64)
    for j in range(n):
        out = (out ^ ids[j : j + out.size]) * _ODD
        out ^= out >> np.uint64(29)
    return out


class _Text:
    """Words of which some are marked, with Karp-Rabin hashes of all windows of a length."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.free = ids, np.ones(ids.size, bool)
        self.powers = np.multiply.accumulate(np.full(ids.size + 1, _ODD)) if ids.size else np.full(1, _ODD)
        self.sums = np.zeros(ids.size + 1, np.uint64)
        np.cumsum(ids * self.powers[: ids.size], out=self.sums[1:])

    def windows(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of s unmarked words, and their hashes."""
        marked = np.concatenate(([0], np.cumsum(~self.free)))
        at = np.flatnonzero(marked[s:] == marked[:-s]) if self.ids.size >= s else np.zeros(0, np.int64)
        # Brought to one power of the base, as they stand at different places.
        return at, (self.sums[at + s] - self.sums[at]) * self.powers[self.ids.size - at]


def tile(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (length, position in item, position in doc): the longest common runs of unmarked words, longest first.

    Of equally long ones the first in the item comes first, at its first free place in the document.
    """
    a, b = _Text(item), _Text(doc)
    # Hashes of both texts are brought to one power: that of the longer one.
    lift = lambda t, other: np.multiply.accumulate(np.full(other.ids.size - t.ids.size, _ODD))[-1] if other.ids.size > t.ids.size else np.uint64(1)
    up_a, up_b = lift(a, b), lift(b, a)

    def shared(s: int) -> bool:
        return np.isin(a.windows(s)[1] * up_a, b.windows(s)[1] * up_b).any()

    tiles: list[tuple[int, int, int]] = []
    top = min(item.size, doc.size)
    while top >= least and shared(least):
        low, high = least, top
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if shared(mid) else (low, mid - 1)
        s = low
        at_b, of_b = b.windows(s)
        order = np.argsort(of_b * up_b, kind="stable")
        at_b, of_b = at_b[order], (of_b * up_b)[order]
        at_a, of_a = a.windows(s)
        of_a = of_a * up_a
        start, end = np.searchsorted(of_b, of_a, "left"), np.searchsorted(of_b, of_a, "right")
        passed: dict[int, int] = {}  # places of one hash that are taken are taken for all that follow
        for k in np.flatnonzero(end > start).tolist():
            x = int(at_a[k])
            if not (a.free[x] and a.free[x + s - 1]):
                continue
            to = passed.get(int(start[k]), int(start[k]))
            while to < end[k] and not (b.free[at_b[to]] and b.free[at_b[to] + s - 1]):
                to += 1
            passed[int(start[k])] = to
            if to < end[k] and np.array_equal(item[x : x + s], doc[at_b[to] : at_b[to] + s]):
                y = int(at_b[to])
                a.free[x : x + s] = b.free[y : y + s] = False
                tiles.append((s, x, y))
        top = s - 1
    return tiles


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), ordered.size - 1)] == values if ordered.size else np.zeros(values.size, bool)


def _parts(ids: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """What of a document lies under seeds of the item, with 0, which no word has, between the parts."""
    hit = _among(seeds(ids, n), np.unique(seeds(item, n)))
    under = np.zeros(ids.size + 1, bool)
    for j in range(n):
        under[j : j + hit.size] |= hit
    kept = under.copy()
    kept[1:] |= under[:-1]
    return np.where(under[:-1], ids, np.uint64(0))[kept[:-1]]


def is_hit(covered: int, size: int, least: float = LEAST) -> bool:
    return covered >= least * size and covered >= min(size, FLOOR)


_FOUND_TYPE = "array<struct<nth:int,tokens:int,covered:int,tiles:int>>"
_FOUND = pa.list_(pa.struct([("nth", pa.int32()), ("tokens", pa.int32()), ("covered", pa.int32()), ("tiles", pa.int32())]))


def _tiler(least: float):
    def tiled(texts: pa.Array, items: pa.Array) -> pa.Array:
        out = []
        for text, of in zip(texts, items, strict=True):
            ids, hits = tokens(text.as_py()), []
            for nth, one in enumerate(of):
                item = tokens(one.as_py())
                n = min(SEED, item.size)
                tiles = tile(item, _parts(ids, item, n), n)
                covered = sum(t[0] for t in tiles)
                if is_hit(covered, item.size, least):
                    hits.append({"nth": nth, "tokens": item.size, "covered": covered, "tiles": len(tiles)})
            out.append(hits)
        give_back()
        return pa.array(out, type=_FOUND)

    return tiled


def _item_seeds(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts:
        ids = tokens(t.as_py())
        n = min(SEED, ids.size)
        out.append({"tokens": ids.size, "seeds": seeds(ids, n).view(np.int64) if n else []})
    return pa.array(out, type=pa.struct([("tokens", pa.int32()), ("seeds", pa.list_(pa.int64()))]))


def _doc_seeds(lengths: list[int], wanted: np.ndarray | None):
    """The different seeds of each text: of all the lengths that items have, and among those wanted."""
    bits = 22
    some = None
    if wanted is not None:
        some = np.zeros(1 << bits, bool)
        some[wanted >> np.uint64(64 - bits)] = True

    def emit(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            ids, found = tokens(t.as_py()), []
            for n in lengths:
                h = seeds(ids, n)
                if some is not None:
                    h = h[some[h >> np.uint64(64 - bits)]]
                    h = h[_among(h, wanted)]
                found.append(h)
            out.append(np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64))
        give_back()
        return pa.array(out, type=pa.list_(pa.int64()))

    return emit


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item, text, tokens, seeds) of items that have words, each once."""
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).distinct()
    items = items.withColumn("s", F.arrow_udf(_item_seeds, "struct<tokens:int,seeds:array<long>>")("text"))
    return items.select("item", "text", F.md5(F.col("text").cast("binary")).alias("ikey"), "s.*").filter("tokens > 0")


def _rare(least: float):
    def rare(tokens_of: pa.Array, seeds_of: pa.Array, counts_of: pa.Array) -> pa.Array:
        """Of each item the seeds but for the commonest: as many as may go without their words reaching the threshold."""
        out = []
        for size, own, counts in zip(tokens_of.to_pylist(), seeds_of.to_pylist(), counts_of.to_pylist(), strict=True):
            n, need = min(SEED, size), max(-(-least * size // 1), min(size, FLOOR))
            under, n_under, kept = [False] * size, 0, set()
            for _, seed, at in sorted(((c, s, k) for k, (s, c) in enumerate(zip(own, counts, strict=True))), reverse=True):
                new = under[at : at + n].count(False)
                if n_under + new < need:
                    under[at : at + n] = [True] * n
                    n_under += new
                else:
                    kept.add(seed)
            out.append(sorted(kept))
        return pa.array(out, type=pa.list_(pa.int64()))

    return rare


def candidate_pairs(emitted: DataFrame, texts: DataFrame, places: DataFrame, least: float) -> DataFrame:
    """(key, ikey): documents and items that share one of the item's rarer seeds.

    Of an item the seeds that most documents have are left out, as many as together lie over fewer words than
    the threshold asks for: a document that shares none but these is no hit. So a run of words that stands
    in very many documents and items pairs them only where it makes up a hit.
    """
    held = places.select("seed").distinct()
    shared = write_out(emitted.select("key", F.explode("seeds").alias("seed")).join(held, "seed", "left_semi"), "shared")
    count = shared.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    counted = places.join(count, "seed", "left").groupBy("ikey").agg(F.any_value("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("pos", "seed", F.coalesce("n", F.lit(0)).alias("n")))).alias("p"))
    of = lambda c: F.transform("p", lambda x: x[c])
    rare = counted.select("ikey", F.explode(F.arrow_udf(_rare(least), "array<long>")("tokens", of("seed"), of("n"))).alias("seed"))
    return write_out(shared.join(write_out(rare, "rare"), "seed").select("key", "ikey").distinct(), "candidates")


def _hits(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, least: float) -> DataFrame:
    """(key, found): by the hash of a text the items that it hits."""
    items = write_out(_items(benchmark, item_id, item_text), "items")
    # Items of equal text are compared once.
    texts = items.groupBy("ikey").agg(F.any_value("text").alias("item_text"), F.any_value("tokens").alias("tokens"), F.any_value("seeds").alias("seeds"))
    places = write_out(texts.select("ikey", "tokens", F.posexplode("seeds").alias("pos", "seed")), "item_seeds")
    lengths = sorted(r["n"] for r in places.select(F.least("tokens", F.lit(SEED)).alias("n")).distinct().collect())
    wanted = None
    if places.count() * 8 <= FILTER_BYTES:
        wanted = np.unique(places.select("seed").distinct().toArrow().column("seed").to_numpy().view(np.uint64))
    source = docs.select(F.col(text).cast("string").alias("text")).filter("text is not null")
    emitted = source.select(_key(F.col("text")).alias("key"), F.arrow_udf(_doc_seeds(lengths, wanted), "array<long>")("text").alias("seeds")).filter(F.size("seeds") > 0)
    some = write_out(emitted, "seeds")
    pairs = candidate_pairs(some.dropDuplicates(["key"]), texts, places, least)
    # An item's words under shared seeds bound what tiles can cover.
    both = pairs.join(some.dropDuplicates(["key"]).withColumnRenamed("seeds", "own"), "key").join(texts.select("ikey", "tokens", "seeds"), "ikey")
    both = both.withColumn("own", F.array_intersect("seeds", "own"))
    both = both.withColumn("at", F.filter(F.transform("seeds", lambda s, i: F.when(F.array_contains("own", s), i)), lambda i: i.isNotNull()))
    size = F.least("tokens", F.lit(SEED))
    upto = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, p: F.struct((s["n"] + p + size - F.greatest(s["end"], p)).alias("n"), (p + size).alias("end")))["n"]
    pairs = write_out(both.filter((upto >= least * F.col("tokens")) & (upto >= F.least("tokens", F.lit(FLOOR)))).select("key", "ikey"), "pairs")
    candidates = pairs.join(texts.select("ikey", "item_text"), "ikey").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ikey", "item_text"))).alias("of"))
    candidates = write_out(candidates, "candidates")
    side = lambda df, n: F.broadcast(df) if df.count() * n <= BROADCAST_BYTES else df
    keys = pairs.select("key").distinct()
    bodies = source.withColumn("key", _key(F.col("text"))).join(side(keys, 48), "key", "left_semi").groupBy("key").agg(F.any_value("text").alias("text"))
    tiled = candidates.join(bodies, "key").withColumn("t", F.arrow_udf(_tiler(least), _FOUND_TYPE)(F.col("text"), F.transform("of", lambda x: x["item_text"])))
    hits = tiled.select("key", F.explode("t").alias("t"), "of").select("key", F.get(F.col("of"), F.col("t.nth"))["ikey"].alias("ikey"), "t.tokens", "t.covered", "t.tiles")
    hits = hits.join(items.select("ikey", "item"), "ikey").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("item", "tokens", "covered", "tiles"))).alias("found"))
    return write_out(hits, "hits")


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST, out: str = "hits") -> DataFrame:
    """docs with an array of (item, tokens, covered, tiles) of the items that are hit, in the order of their ids."""
    kind = dict(benchmark.dtypes)[item_id]
    with small_batches(docs.sparkSession):
        hits = _hits(docs, benchmark, text, item_id, item_text, least)
    taken = hits.select(F.sum(F.size("found") * 64 + 64)).first()[0] or 0
    key, got = fresh("hit_key", docs), fresh("hit_list", docs)
    hits = hits.toDF(key, got)
    joined = docs.join(F.broadcast(hits) if taken <= BROADCAST_BYTES else hits, _key(F.col(text).cast("string")) == F.col(key), "left")
    none = F.array().cast(f"array<struct<item:{kind},tokens:int,covered:int,tiles:int>>")
    return joined.select(*[F.col(c) for c in docs.columns if c != out], F.coalesce(F.col(got), none).alias(out))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of docs that hit no item."""
    name = fresh("hits", docs)
    return find_hits(docs, benchmark, text, least=least, out=name).filter(F.size(name) == 0).drop(name)
