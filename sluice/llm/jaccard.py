"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents are sets of shingles of five words. Documents of equal sets form a class; classes are compared
by 128 MinHash values of 16 bits. Candidates share one of 32 bands of 4 values, which a pair of similarity
0.8 misses with a probability below 1e-7. A candidate's values are compared 32 at a time: after m of n
agree, it is dropped if the posterior probability that its similarity reaches the threshold (uniform
prior, a beta distribution) is below TOLERANCE. What is left is verified on the whole shingle sets.

A pair is looked at only in the first band that both share, so it is verified and counted once. Buckets
of a band are cut into chunks by number and by bytes of shingles, and tasks compare a chunk with another
or with itself in blocks; a block's memory is bounded by CHUNK and CHUNK_BYTES and one document. A row
names its partners by a bit for each later row of its block, and verification emits a document's links as
a count and one edge per document to the group it joins, so rows stay few however large a group of near
copies is. Groups are the connected components of the links.

Edge cases: words are runs of characters other than space and U+0009 to U+000D; a text of fewer than five
words is one shingle of all its words; null texts and texts without words are linked to none and are
groups of their own; rows that repeat an id and a text are one class; a null id comes first in the order
of ids; long texts are read in slices; an empty table gives an empty table; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.parts import give_back, text_hash
from sluice.session import fresh, small_batches, write_out

N_GRAM, THRESHOLD = 5, 0.8
HASHES, BAND, STEP, TOLERANCE = 128, 4, 32, 1e-5
#: Members of a bucket in one chunk and bytes of their shingles, both on average; two chunks are a block.
CHUNK, CHUNK_BYTES = 512, 4 << 20
#: Blocks of at most so many rows are compared together, and so many shingles looked up at once.
SMALL, PART = 512, 1 << 20
#: A text is read in slices of so many bytes, each up to the end of a word.
SLICE = 1 << 17
#: Ids of candidates that take up to this many bytes are broadcast; more of them are joined by id.
BROADCAST_BYTES = 8 << 20

_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_XOR = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_ORDER = _rng.integers(0, 2**63, N_GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[0x20, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_grown: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, for at least n bytes; they grow with the longest text."""
    if not _grown or _grown[0].size < n:
        size = 1 << max(14, n.bit_length())
        _grown[:] = [_powers(_BASE, size), _powers(_INVERSE, size)]
    return _grown


def _words(data: np.ndarray) -> np.ndarray:
    """The 64-bit hashes of a slice's words."""
    inside = np.empty(data.size + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_IS_GAP[data], out=inside[1:-1])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    up, down = _tables(data.size)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: data.size], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | bytes | None) -> np.ndarray:
    """The sorted different 64-bit hashes of the text's five-word shingles."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"", np.uint8)
    at, found = 0, [np.zeros(0, np.uint64)]
    while at < data.size:
        to = at + SLICE
        while to < data.size and not (gap := _IS_GAP[data[to : to + SLICE]]).any():
            to += SLICE
        to = to + int(gap.argmax()) if to < data.size else data.size
        found.append(_words(data[at:to]))
        at = to
    words = np.concatenate(found)
    if not words.size:
        return words
    k = min(N_GRAM, words.size)
    n = words.size - k + 1
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams += words[j : j + n] * _ORDER[j]
    return np.unique(_mix(grams))


def signature(grams: np.ndarray) -> np.ndarray:
    """128 MinHash values of 16 bits."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, grams.size, 2048):
        block = grams[at : at + 2048, None] ^ _XOR[None, :]
        block *= _MUL
        np.minimum(least, block.min(axis=0), out=least)
    # The least value is small; its low bits after mixing are uniform.
    return (_mix(least) & np.uint64(0xFFFF)).astype("<u2")


def _sketches(texts: pa.Array) -> pa.Array:
    keys, sizes, sigs, bands = [], [], [], []
    for t in texts:
        grams = shingles(t.as_py())
        sizes.append(int(grams.size))
        if not grams.size:
            keys.append(None)
            sigs.append(None)
            bands.append([])
            continue
        sig = signature(grams)
        keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
        sigs.append(sig.tobytes())
        bands.append(_mix(sig.view("<u8") + np.arange(HASHES // BAND, dtype=np.uint64) * np.uint64(_BASE)).view(np.int64))
    give_back()
    return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["key", "size", "sig", "bands"])


def sketch(docs: DataFrame) -> DataFrame:
    """(id, hash, key, size, sig, bands) of each row (id, text); hash is that of the text and key is the hash of the whole set, null if it is empty."""
    s = F.arrow_udf(_sketches, "struct<key:binary,size:int,sig:binary,bands:array<long>>")("text")
    return docs.select("id", text_hash(F.col("text")).alias("hash"), s.alias("s")).select("id", "hash", "s.*")


def _beta_tail(a: int, b: int, x: float) -> float:
    """P(X > x) of a beta distribution with whole parameters: a binomial sum."""
    n = a + b - 1
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(x) + (n - j) * math.log1p(-x)) for j in range(a))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each STEP values: the least matches with which a candidate stays."""
    return [next(m for m in range(n + 1) if _beta_tail(m + 1, n - m + 1, threshold) >= tolerance or m == n) for n in range(STEP, HASHES + 1, STEP)]


def _lots(batches: Iterator[pa.RecordBatch], alone: bool = False) -> Iterator[pa.Table]:
    """Rows, sorted by block, in lots of whole blocks: each block alone, or small ones of a batch together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        block = batch.column("block")
        cuts = [0, *(np.flatnonzero(pc.not_equal(block.slice(1), block.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1).tolist()]
        if held and block[0].as_py() != last:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for start, end in zip(cuts, [*cuts[1:], n], strict=True):
            # What is held is one block; what began at `at` are small blocks that go together.
            if end < n and (alone or held or end - start > SMALL or end - at > SMALL * 16):
                yield pa.Table.from_batches([*held, batch.slice(at, end - at)])
                held, at = [], end
        if at < cuts[-1]:
            yield pa.Table.from_batches([batch.slice(at, cuts[-1] - at)])
        held.append(batch.slice(cuts[-1]))
        last = block[n - 1].as_py()
    if held:
        yield pa.Table.from_batches(held)


def _joined(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _pairs(sig: np.ndarray, bucket: np.ndarray, across: np.ndarray, chunk: np.ndarray, code: np.ndarray, least: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one block that pruning leaves; rows are sorted by block."""
    n = code.size
    band = sig.view("<u8").reshape(n, HASHES // BAND)
    open_ = np.arange(n)
    for d in range(1, n):
        open_ = open_[open_ + d < n]
        open_ = open_[code[open_] == code[open_ + d]]
        if not open_.size:
            break
        for at in range(0, open_.size, 4096):
            i = open_[at : at + 4096]
            i = i[~across[i] | (chunk[i] != chunk[i + d])]
            shared = (band[i] == band[i + d]).argmax(axis=1)
            mixed = _mix(band[i, shared] + shared.astype(np.uint64) * np.uint64(_BASE)).view(np.int64)
            i = i[mixed == bucket[i]]  # else an earlier band has the pair
            m = np.zeros(i.size, int)
            for step, need in enumerate(least):
                part = slice(step * STEP, (step + 1) * STEP)
                m += (sig[i, part] == sig[i + d, part]).sum(axis=1)
                i, m = i[m >= need], m[m >= need]
            if i.size:
                yield i, i + d


def _prune(least: list[int]):
    """Of each block the rows that have partners, with a bit for each later such row that is one."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.string()), ("key", pa.binary()), ("bits", pa.binary())])
        for t in _lots(batches):
            block = t.column("block")
            n = t.num_rows
            code = np.concatenate(([0], np.cumsum(pc.not_equal(block.slice(1), block.slice(0, n - 1)).to_numpy()))) if n > 1 else np.zeros(1, int)
            sig = _joined(t.column("sig"), "<u2").reshape(n, HASHES)
            bucket, across, chunk = (t.column(c).to_numpy() for c in ("bucket", "across", "chunk"))
            low, high = [], []
            for i, j in _pairs(sig, bucket, across, chunk, code, least):
                low.append(i.astype(np.int32))
                high.append(j.astype(np.int32))
            if not low:
                continue
            a, b = np.concatenate(low), np.concatenate(high)
            used = np.zeros(n, bool)
            used[a] = used[b] = True
            rank = np.cumsum(used, dtype=np.int32) - 1
            order = np.argsort(a, kind="stable")
            a, b = a[order], rank[b[order]] - rank[a[order]] - 1
            rows = np.flatnonzero(used)
            ends = np.searchsorted(a, rows, "right")
            bits = []
            for at, to in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                one = np.zeros(int(b[at:to].max()) + 1 if to > at else 0, bool)
                one[b[at:to]] = True
                bits.append(np.packbits(one).tobytes())
            kept = t.select(["block", "key"]).take(rows)
            yield pa.RecordBatch.from_arrays([kept.column("block").combine_chunks(), kept.column("key").combine_chunks(), pa.array(bits, pa.binary())], schema=schema)
        give_back()

    return prune


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])
        for t in _lots(batches, alone=True):
            keys, bits, n = t.column("key"), t.column("bits"), t.num_rows
            sizes = pc.binary_length(t.column("grams")).to_numpy() // 8
            starts = np.concatenate(([0], np.cumsum(sizes)))
            # The block's shingles by number, so that a row's can be marked in one array.
            ids = np.unique(_joined(t.column("grams"), "<u8"), return_inverse=True)[1].astype(np.int32)
            marked = np.zeros(int(ids.max()) + 1, bool)
            links, root = np.zeros(n, np.int64), list(range(n))

            def top(x, root=root):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x in range(n):
                js = np.flatnonzero(np.unpackbits(np.frombuffer(bits[x].as_py(), np.uint8))) + x + 1
                js = js[np.minimum(sizes[js], sizes[x]) >= threshold * np.maximum(sizes[js], sizes[x])]
                if not js.size:
                    continue
                own = ids[starts[x] : starts[x + 1]]
                marked[own] = True
                lot = max(1, PART // int(sizes[js].max()))
                for at in range(0, js.size, lot):
                    some = js[at : at + lot]
                    rows = np.concatenate([ids[starts[j] : starts[j + 1]] for j in some])
                    same = np.add.reduceat(marked[rows], np.concatenate(([0], np.cumsum(sizes[some])[:-1])), dtype=np.int64)
                    for y in some[same >= threshold * (sizes[x] + sizes[some] - same) - 1e-9].tolist():
                        links[x] += 1
                        links[y] += 1
                        p, q = sorted((top(x), top(y)))
                        root[q] = p
                marked[own] = False
            found = np.flatnonzero(links)
            if found.size:
                roots = pa.array([top(x) for x in found.tolist()])
                yield pa.RecordBatch.from_arrays([keys.take(found).combine_chunks(), pa.array(links[found]), keys.take(roots).combine_chunks()], schema=schema)
        give_back()

    return verify


def _sets(texts: pa.Array) -> pa.Array:
    keys, grams = [], []
    for t in texts:
        g = shingles(t.as_py())
        keys.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest() if g.size else None)
        grams.append(g.tobytes())
    give_back()
    return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(grams, pa.binary())], ["key", "grams"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): of edges (a, b) the connected components, each labelled by its least node.

    Each round takes the least label among neighbours and then the label's own label, so that chains
    shorten by half; a round is written out and the loop ends when none has changed.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = write_out(both, "edges")
    labels = write_out(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        lower = write_out(lower, "labels")
        up = lower.select(F.col("node").alias("via"), F.col("to").alias("further"))
        step = write_out(lower.join(up, lower["to"] == up["via"]).select("node", F.least("to", "further").alias("label"), (F.least("to", "further") != F.col("old")).alias("changed")), "labels")
        labels = step.select("node", "label")
        if step.filter("changed").isEmpty():
            return labels


def _least_id(name: str) -> Column:
    """The least value, null before all others."""
    return F.min(F.struct(F.col(name).isNotNull(), F.col(name).alias("v")))["v"]


def classes(sketches: DataFrame) -> DataFrame:
    """(key, id, n, size, sig, bands): one row per set of shingles, with its least id (a null one first) and its number of rows."""
    by = sketches.filter(F.col("key").isNotNull()).groupBy("key")
    return by.agg(_least_id("id").alias("id"), F.count(F.lit(1)).alias("n"), F.any_value("size").alias("size"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))


def near_links(docs: DataFrame, reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, links, root): per class and task its links, and a class of the same component; docs has id and text."""
    spread = reps.select("key", "size", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), (F.sum(F.col("size").cast("long")) * 8).alias("bytes")).filter("members > 1")
    members = spread.join(buckets, "bucket")
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK), F.least(F.col("members"), F.ceil(F.col("bytes") / CHUNK_BYTES))).cast("int")
    members = members.select("bucket", "key", chunks.alias("chunks"), F.pmod(F.xxhash64("key"), chunks).cast("int").alias("chunk"))
    # A chunk meets each other chunk of its bucket, and itself, in one block.
    members = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("chunk", "with"), F.greatest("chunk", "with")
    members = members.select(F.concat_ws(":", "bucket", low, high).alias("block"), "bucket", (low != high).alias("across"), "chunk", "key")
    members = members.join(reps.select("key", "sig"), "key").repartition("block").sortWithinPartitions("block", "key")
    kept = members.select("block", "bucket", "across", "chunk", "key", "sig").mapInArrow(_prune(least_matches(threshold)), "block string, key binary, bits binary")
    kept = write_out(kept, "candidates")

    wanted = write_out(reps.select("key", "id").join(kept.select("key").distinct(), "key", "left_semi").select(F.col("id").alias("wanted")).distinct(), "wanted")
    bounded = wanted.count() * 24 <= BROADCAST_BYTES
    some = docs.join(F.broadcast(wanted) if bounded else wanted, docs["id"].eqNullSafe(wanted["wanted"]), "left_semi")
    grams = some.select(F.arrow_udf(_sets, "struct<key:binary,grams:binary>")("text").alias("s")).select("s.*")
    grams = grams.filter(F.col("key").isNotNull()).groupBy("key").agg(F.any_value("grams").alias("grams"))
    blocks = kept.join(grams, "key").repartition("block").sortWithinPartitions("block", "key")
    return write_out(blocks.select("block", "key", "bits", "grams").mapInArrow(_verify(threshold), "key binary, links long, root binary"), "links")


def _grouped(docs: DataFrame, text: str, doc_id: str, threshold: float) -> DataFrame:
    """(doc_id, hash, group, class_id, copy_id, n_links), one row per row of docs; group is null for those alone."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        sketches = write_out(sketch(docs), "sketches")
        reps = write_out(classes(sketches), "classes")
        links = near_links(docs, reps, threshold)
    count = links.groupBy("key").agg(F.sum("links").alias("n_links"))
    label = components(links.filter(F.col("key") != F.col("root")).select(F.col("key").alias("a"), F.col("root").alias("b")))
    copies = reps.select("key", F.col("id").alias("copy_id"), "n")
    copies = copies.join(count, "key", "left").join(label.withColumnRenamed("node", "key"), "key", "left")
    copies = write_out(copies.filter("n > 1 or n_links > 0").withColumn("group", F.coalesce("label", "key")), "copies")
    least = copies.groupBy("group").agg(_least_id("copy_id").alias("class_id"))
    copies = copies.join(least, "group").select("key", "group", "copy_id", "class_id", "n_links")
    own = lambda c: F.when(F.col("group").isNull(), F.col("id")).otherwise(F.col(c)).alias(c)
    out = sketches.select("id", "hash", "key").join(copies, "key", "left")
    return out.select(F.col("id").alias("doc_id"), "hash", "group", own("class_id"), own("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links): one row per row of docs.

    copy_id: the least id with the same shingles. class_id: the least id of the group of near duplicates.
    n_links: classes other than its own that reach the threshold.
    """
    return _grouped(docs, text, doc_id, threshold).select("doc_id", "class_id", "copy_id", "n_links")


def one_per_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each group: that of its least id, and of rows that share it, that of the least text hash."""
    groups = write_out(_grouped(docs, text, doc_id, threshold).filter("group is not null").select("doc_id", "hash", "group"), "grouped")
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "hash")).alias("f"), F.count(F.lit(1)).alias("n"))
    first = first.select(F.col("group").alias("of"), F.col("f.doc_id").alias("fid"), F.col("f.hash").alias("fhash"))
    # What doesn't stand is what the first leaves: this join has the row itself in its key, so no group is hot.
    same = (F.col("group") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("fid")) & (F.col("hash") == F.col("fhash"))
    gone = groups.join(first, same, "left_anti").select("doc_id", "hash").distinct()
    ties = groups.join(first, same, "left_semi").groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "hash")
    gid, ghash, row = (fresh(x, docs) for x in ("gone_id", "gone_hash", "row"))
    gone, ties = write_out(gone.toDF(gid, ghash), "gone"), write_out(ties.toDF(gid, ghash), "ties")
    hit = F.col(doc_id).eqNullSafe(F.col(gid)) & (text_hash(F.col(text)) == F.col(ghash))
    kept = docs.join(F.broadcast(gone) if gone.count() * 32 <= BROADCAST_BYTES else gone, hit, "left_anti")
    if ties.isEmpty():
        return kept
    once = kept.join(ties, hit).groupBy(gid, ghash).agg(F.any_value(F.struct(*[F.col(c) for c in docs.columns])).alias(row))
    return kept.join(ties, hit, "left_anti").unionByName(once.select(f"{row}.*"))
