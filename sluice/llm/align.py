"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) stand for which of a piece BPE (B).

Both tokenizers cut the bytes of a text with a space in front; where tokens of both end at one byte, they
cut it into groups, and an A token is linked with each B token of its group. Per document the distinct
pairs are kept as sorted int64 keys, a id * size of B's vocabulary + b id, with the links of each. Counts
over the corpus, of documents that hold a pair, come in three steps: tasks count their keys by np.unique
and emit partial counts; these are sorted by range partitions, and each partition sums its runs of equal
keys and writes a sorted shard of keys and counts to the shared folder; documents then look their keys up
in the shards, memory-mapped, by searchsorted. A task has in memory a batch of documents, its partial
counts (at most HELD) and the pages of shards that it touches.

The tokenizers' files are parameters and must be at the same path on every node, as installed libraries
are. A's vocabulary is read from its own file and run by a faster encoder of the same merges; load()
checks that ids are in the order of the merges, on which that rests. Numbers bounded by the vocabulary
(the highest count of each A id) and by the partitions (the keys at which shards begin) go to all tasks.

Edge cases: a null or empty text, and one whose tokens' bytes don't give space + text again (B's
normalisation, a character U+2581), has no tokens and no links; special tokens inside texts are plain
text; a document that repeats counts as often as it stands there; texts are encoded whole; groups of very
many tokens are paired by their distinct ids, in slices of SLICE pairs; an empty table gives an empty
result; columns of the input stay, whatever their names, but for the one that takes the result's name.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.parts import give_back
from sluice.session import new_path, small_batches, write_out

#: Pairs expanded at once; keys that a task gathers before it counts them; distinct keys that it holds.
SLICE, GATHERED, HELD = 1 << 20, 1 << 21, 1 << 22
#: A group of more links than this is paired by its distinct ids.
LARGE_GROUP = 256
# Fixed value: how the byte-level vocabulary splits a text before it merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 as itself and the other bytes as U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """An encoder of texts, and the bytes of its tokens by id."""

    def __init__(self, encode, token_bytes: list[bytes]) -> None:
        self.encode, self.bytes = encode, token_bytes
        self.lengths = np.array([len(x) for x in token_bytes], dtype=np.int64)


@functools.cache
def load(byte_level: str, pieces: str) -> tuple[Vocabulary, Vocabulary]:
    """A from a file of the tokenizers library, B from one of sentencepiece; once in each worker."""
    import sentencepiece
    import tiktoken

    with open(byte_level, encoding="utf-8") as f:
        given = json.load(f)
    special = {x["content"] for x in given["added_tokens"]}
    of = _byte_of_character()
    ranks = {bytes(of[c] for c in token): i for token, i in given["model"]["vocab"].items() if token not in special}
    merged = [m.split(" ") if isinstance(m, str) else m for m in given["model"]["merges"]]
    ids = [given["model"]["vocab"]["".join(m)] for m in merged]
    if ids != sorted(ids) or given.get("normalizer") is not None:
        raise ValueError(f"{byte_level}: ids are not in the order of the merges, or texts are normalised")
    encoder = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(given["model"]["vocab"].values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    a = Vocabulary(lambda text: encoder.encode_ordinary(" " + text), table)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    own = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
    return a, Vocabulary(lambda text: model.encode(text, num_threads=1), own)


@functools.cache
def _decimals(most: int) -> list[bytes]:
    """For id * 4 + end, its decimal with one of the four ends."""
    return [b"%d%s" % (i, end) for i in range(most) for end in (b",", b"|", b";", b"")]


class Aligned:
    """Tokens of one text and their groups."""

    def __init__(self, text: str | None, a: Vocabulary, b: Vocabulary) -> None:
        self.a = self.b = self.group_a = self.group_b = np.zeros(0, dtype=np.int64)
        self.size_a = self.size_b = self.a
        if not text:
            return
        ids_a, ids_b, data = a.encode(text), b.encode(text), b" " + text.encode()
        if b"".join(map(a.bytes.__getitem__, ids_a)) != data or b"".join(map(b.bytes.__getitem__, ids_b)) != data:
            return
        self.a, self.b = np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)
        ends_a, ends_b = a.lengths[self.a].cumsum(), b.lengths[self.b].cumsum()
        is_end = np.zeros(len(data) + 1, dtype=bool)
        is_end[ends_a] = True
        cuts = ends_b[is_end[ends_b]]
        self.group_a, self.group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=len(cuts)), np.bincount(self.group_b, minlength=len(cuts))

    @property
    def groups(self) -> int:
        return len(self.size_a)

    @property
    def links(self) -> int:
        return int((self.size_a * self.size_b).sum())

    def listing(self) -> bytes:
        """a1,a2|b1;a3|b2,b3: the ids of the groups in order."""
        n, m = len(self.a), len(self.b)
        code = np.empty(n + m, dtype=np.int64)
        code[np.arange(n) + (self.size_b.cumsum() - self.size_b)[self.group_a]] = self.a * 4 + np.append(self.group_a[1:] != self.group_a[:-1], True)
        end_b = 2 * np.append(self.group_b[1:] != self.group_b[:-1], True)
        end_b[-1] = 3
        code[np.arange(m) + self.size_a.cumsum()[self.group_b]] = self.b * 4 + end_b
        return b"".join(map(_decimals(1 + int(max(self.a.max(), self.b.max())) | 0xFFFF).__getitem__, code.tolist()))

    def pairs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys a * size + b of all linked ids, and how many links have each."""
        large = self.size_a * self.size_b > LARGE_GROUP
        (group_a, a, times_a), (group_b, b, times_b) = (_distinct(g, ids, large) for g, ids in ((self.group_a, self.a), (self.group_b, self.b)))
        partners = np.bincount(group_b, minlength=self.groups)
        first = (partners.cumsum() - partners)[group_a]
        many = partners[group_a]
        upto = many.cumsum()
        keys, links, at = [], [], 0
        while at < len(a):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
            n = many[at:end]
            other = np.arange(n.sum()) + np.repeat(first[at:end] - (n.cumsum() - n), n)
            key, weight = np.repeat(a[at:end], n) * size + b[other], None
            if large.any():
                weight = np.repeat(times_a[at:end], n) * times_b[other]
            k, w = _summed(key, weight)
            keys.append(k)
            links.append(w)
            at = end
        if len(keys) == 1:
            return keys[0], links[0]
        return _summed(np.concatenate(keys), np.concatenate(links)) if keys else (self.a, self.a)


def _distinct(group: np.ndarray, ids: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with their times, in the order of groups; in large groups each id once."""
    here = large[group]
    if not here.any():
        return group, ids, np.ones(len(ids), dtype=np.int64)
    most = int(ids.max()) + 1
    key, times = np.unique(group[here] * most + ids[here], return_counts=True)
    groups, every = np.concatenate([group[~here], key // most]), np.concatenate([ids[~here], key % most])
    order = np.argsort(groups, kind="stable")
    return groups[order], every[order], np.concatenate([np.ones((~here).sum(), dtype=np.int64), times])[order]


def _summed(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their weights, or how often each stands there."""
    if not len(keys):
        return keys, keys
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sums = np.diff(np.append(starts, len(keys))) if weights is None else np.add.reduceat(weights, starts)
    return keys[starts], sums


_ALIGNED = pa.struct([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("gaps", pa.binary()), ("links", pa.binary())])
ALIGNED = "struct<n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,gaps:binary,links:binary>"


def _aligner(byte_level: str, pieces: str):
    def aligned(texts: pa.Array) -> pa.Array:
        a, b = load(byte_level, pieces)
        out = []
        for x in texts:
            one = Aligned(x.as_py(), a, b)
            keys, links = one.pairs(len(b.bytes))
            digest = hashlib.sha256(one.listing()).hexdigest() if len(one.a) else ""
            # Sorted keys as gaps, which are written in few bytes.
            gaps = np.diff(keys, prepend=0)
            out.append((len(one.a), len(one.b), one.groups, one.links, digest, gaps.astype("<i8").tobytes(), links.astype("<i4").tobytes()))
        give_back()
        return pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), _ALIGNED, strict=True)], fields=list(_ALIGNED)) if out else pa.array([], type=_ALIGNED)

    return aligned


def align(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", out: str = "aligned") -> DataFrame:
    """docs with a struct of counts, the digest of the groups, and the pairs: gaps between sorted keys (int64), links of each (int32).

    Written once, as the counts and the lookup both read it, without the text.
    """
    with small_batches(docs.sparkSession):
        return write_out(docs.withColumn(out, F.arrow_udf(_aligner(byte_level, pieces), ALIGNED)(F.col(text).cast("string"))).drop(*[c for c in docs.columns if c == text and c != out]), "aligned")


_PARTIAL = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def _keys(gaps: pa.Scalar) -> np.ndarray:
    return np.frombuffer(gaps.as_buffer() if gaps.is_valid else b"", dtype="<i8").cumsum()


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    gathered, size = [], 0

    def counted() -> tuple[np.ndarray, np.ndarray]:
        some = np.unique(np.concatenate(gathered), return_counts=True) if gathered else held
        return _summed(np.concatenate([held[0], some[0]]), np.concatenate([held[1], some[1]])) if gathered else held

    for batch in batches:
        for gaps in batch.column(0):
            gathered.append(_keys(gaps))
            size += len(gathered[-1])
            if size >= GATHERED:
                held, gathered, size = counted(), [], 0
                if len(held[0]) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], schema=_PARTIAL)
                    held = tuple(x[:0] for x in held)
    held = counted()
    if len(held[0]):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], schema=_PARTIAL)
    give_back()


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def _shard_writer(folder: str, size: int):
    """Sums runs of equal keys of a sorted partition into a shard: a file of keys and one of counts.

    They are written under a name of the attempt and then renamed, so a lost or repeated task leaves whole files only.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _place(folder)
        files.create_dir(top, recursive=True)
        name, attempt = f"{top}/{TaskContext.get().partitionId():06d}", uuid.uuid4().hex
        best: dict[int, int] = {}
        first, last, rows, carry = None, None, 0, (np.zeros(0, dtype=np.int64),) * 2
        with files.open_output_stream(f"{name}-{attempt}.keys") as to_keys, files.open_output_stream(f"{name}-{attempt}.counts") as to_counts:

            def put(keys: np.ndarray, counts: np.ndarray) -> None:
                nonlocal first, last, rows
                if len(keys):
                    first, last, rows = int(keys[0]) if first is None else first, int(keys[-1]), rows + len(keys)
                    to_keys.write(keys.astype("<i8").tobytes())
                    to_counts.write(counts.astype("<i8").tobytes())
                    a = keys // size
                    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                    for i, most in zip(a[starts].tolist(), np.maximum.reduceat(counts, starts).tolist(), strict=True):
                        best[i] = max(most, best.get(i, 0))

            for batch in batches:
                keys, counts = _summed(np.concatenate([carry[0], batch.column(0).to_numpy()]), np.concatenate([carry[1], batch.column(1).to_numpy()]))
                put(keys[:-1], counts[:-1])  # the last key may go on in the next batch
                carry = keys[-1:], counts[-1:]
            put(*carry)
        if rows:
            for kind in ("keys", "counts"):
                files.move(f"{name}-{attempt}.{kind}", f"{name}.{kind}")
            yield pa.RecordBatch.from_pylist([{"shard": name.rpartition("/")[2], "first": first, "last": last, "rows": rows, "a": list(best), "best": list(best.values())}], schema=_SHARD)
        give_back()

    return write


_SHARD = pa.schema([("shard", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("rows", pa.int64()), ("a", pa.list_(pa.int64())), ("best", pa.list_(pa.int64()))])


class Counts:
    """Sorted shards of pair counts: the folder, where each shard begins, and the highest count of each A id."""

    def __init__(self, folder: str, size: int, shards: DataFrame, most: int) -> None:
        self.folder, self.size = folder, size
        self.shards = sorted((r["first"], r["shard"]) for r in shards.select("first", "shard").collect())
        top = shards.select(F.explode(F.arrays_zip("a", "best")).alias("x")).groupBy("x.a").agg(F.max("x.best").alias("n")).collect()
        self.best = np.zeros(most, dtype=np.int64)
        for r in top:
            self.best[r["a"]] = r["n"]

    def _column(self, shard: str, kind: str) -> np.ndarray:
        files, top = _place(self.folder)
        if isinstance(files, pafs.LocalFileSystem):
            return np.memmap(f"{top}/{shard}.{kind}", dtype="<i8", mode="r")
        return np.frombuffer(files.open_input_file(f"{top}/{shard}.{kind}").read(), dtype="<i8")

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, all of which the shards have."""
        out = np.zeros(len(keys), dtype=np.int64)
        if not len(keys):
            return out
        ends = np.append(np.searchsorted(keys, [first for first, _ in self.shards[1:]]), len(keys))
        start = 0
        for (_, shard), end in zip(self.shards, ends.tolist(), strict=True):
            if end > start:
                out[start:end] = self._column(shard, "counts")[np.searchsorted(self._column(shard, "keys"), keys[start:end])]
            start = end
        return out


def pair_counts(aligned: DataFrame, byte_level: str, pieces: str, column: str = "aligned") -> Counts:
    """The number of documents that hold each linked pair, over all of aligned."""
    spark = aligned.sparkSession
    a, b = load(byte_level, pieces)
    with small_batches(spark):
        partial = write_out(aligned.select(F.col(column)["gaps"].alias("gaps")).mapInArrow(_partial_counts, "key long, n long"), "partial")
    folder = new_path(spark, "shards")
    by_range = partial.repartitionByRange("key").sortWithinPartitions("key")
    shards = write_out(by_range.mapInArrow(_shard_writer(folder, len(b.bytes)), "shard string, first long, last long, rows long, a array<long>, best array<long>"), "shard-list")
    return Counts(folder, len(b.bytes), shards, len(a.bytes))


def count_table(spark, counts: Counts) -> DataFrame:
    """(a, b, documents): the shards as a table."""
    names = spark.createDataFrame([(s,) for _, s in counts.shards], "shard string").repartition(max(1, len(counts.shards)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                keys, n = counts._column(shard, "keys"), counts._column(shard, "counts")
                for at in range(0, len(keys), SLICE):
                    some = np.asarray(keys[at : at + SLICE])
                    yield pa.RecordBatch.from_arrays([pa.array(some // counts.size), pa.array(some % counts.size), pa.array(np.asarray(n[at : at + SLICE]))], names=["a", "b", "documents"])

    return names.mapInArrow(rows, "a long, b long, documents long")


_SCORED = pa.struct([("n_best", pa.int64()), ("count_sum", pa.int64())])


def _lookup(counts: Counts):
    def scored(gaps: pa.Array, links: pa.Array) -> pa.Array:
        each = [_keys(x) for x in gaps]
        ends = np.cumsum([len(x) for x in each])
        keys = np.concatenate(each) if each else np.zeros(0, dtype=np.int64)
        times = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<i4") for x in links if x.is_valid] or [np.zeros(0, dtype="<i4")]).astype(np.int64)
        distinct = np.unique(keys)
        n = counts.of(distinct)[np.searchsorted(distinct, keys)]

        def sums(values: np.ndarray) -> np.ndarray:
            return np.diff(np.append(0, values.cumsum())[ends], prepend=0)

        out = pa.StructArray.from_arrays([pa.array(sums(times * (n == counts.best[keys // counts.size]))), pa.array(sums(times * n))], fields=list(_SCORED))
        give_back()
        return out

    return scored


def score(aligned: DataFrame, counts: Counts, column: str = "aligned", out: str = "scores") -> DataFrame:
    """aligned with a struct: n_best (links whose pair has its A id's highest count) and count_sum (of all links' counts)."""
    a = F.col(column)
    return aligned.withColumn(out, F.arrow_udf(_lookup(counts), "struct<n_best:long,count_sum:long>")(a["gaps"], a["links"]))
