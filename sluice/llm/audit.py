"""Filter interaction audit: what each filter removes, alone and behind others, in every order of filters.

Documents become mask cells once: a bit for each filter that a document fails, counted by (part, mask).
Everything else follows from the cells, at most 2^n a part, so the work after the one reading of the texts
doesn't grow with them. A task holds the cells of some parts as arrays and visits all orders by adjacent
transpositions (plain changes): each order differs from the one before by one swap of neighbours, so only
those two steps are summed anew from the cells. Each filter's removals add up along the walk to its
Shapley sum.

Five filters of texts are given here: A few words, B repeated words, C capitals, D symbols, E copies of a
text with a smaller id. `audit` takes any masks.

Edge cases: a null text is an empty one, a null part the empty string; a null id is smaller than none and
its row no copy; rows that repeat an id and a text are no copies of each other and count each; an id with
several labels has a flag if any of them has; ids without a label, and null ids, have none; an empty table gives an empty
audit; texts are read whole, as bytes, whatever their length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.parts import give_back
from sluice.session import small_batches, write_out

LETTERS = "ABCDE"
COPY = LETTERS.index("E")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#$%&*|"
#: Parts whose orders are built at once; each takes n! * n rows.
PARTS = 64


def text_bits(data: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    words = data.split()  # of bytes: at space, \t, \n, \v, \f and \r only
    n = len(words)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    points = len(data.translate(None, CONTINUATION))
    symbols = len(data.translate(None, SYMBOLS)) < len(data)
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 2 * points) << 2 | symbols << 3


_MASKED = pa.struct([("bits", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _masked(texts: pa.Array) -> pa.Array:
    out = []
    for x in texts:
        data = x.as_buffer().to_pybytes() if x.is_valid else b""
        digest = hashlib.blake2b(data, digest_size=16).digest()
        out.append({"bits": int(text_bits(data)), "h1": int.from_bytes(digest[:8], "little", signed=True), "h2": int.from_bytes(digest[8:], "little", signed=True)})
    give_back()
    return pa.array(out, type=_MASKED)


def masks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: Column | str = "source") -> DataFrame:
    """(id, part, mask) of every document: a bit for each of the five filters that it fails."""
    part = F.col(part) if isinstance(part, str) else part
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.arrow_udf(_masked, "struct<bits:int,h1:long,h2:long>")(F.col(text).cast("string")).alias("m"))
    with small_batches(docs.sparkSession):
        rows = write_out(rows.select("id", "part", "m.*"), "masks")
    first = rows.filter("id is not null").groupBy("h1", "h2").agg(F.min("id").alias("first")).toDF("f1", "f2", "first")
    # The id stands in the key, so a text of very many copies is no hot key.
    judged = rows.join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")) & (F.col("id") == F.col("first")), "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return judged.select("id", "part", F.col("bits").bitwiseOR(F.when(copy, F.lit(1 << COPY)).otherwise(F.lit(0))).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask, and those labelled quality = 1 and toxic = 1."""
    flags = labels.groupBy(F.col(doc_id).alias("of")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    joined = masked.join(flags, F.col("id") == F.col("of"), "left")
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c)
    return joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("good"), count("toxic"))


def plain_changes(n: int) -> Iterator[int | None]:
    """None for the first order, then for each further one the step that is swapped with the next: all n! orders."""
    order, ways = list(range(n)), [-1] * n
    yield None
    while True:
        movable = [x for x in order if 0 <= (to := order.index(x) + ways[x]) < n and order[to] < x]
        if not movable:
            return
        x = max(movable)
        at = order.index(x)
        to = at + ways[x]
        order[at], order[to] = order[to], order[at]
        for y in range(x + 1, n):
            ways[y] = -ways[y]
        yield min(at, to)


def walk(counts: np.ndarray, n: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Along the walk, each order with what its steps remove: an array of (step, part, kind).

    counts: (part, mask, kind). The array is the walk's own and changes with the next order.
    """
    index = np.arange(1 << n)
    order = list(range(n))
    removed = np.zeros((n, counts.shape[0], counts.shape[2]), dtype=np.int64)

    def step(at: int) -> None:
        before = sum(1 << f for f in order[:at])
        removed[at] = counts[:, ((index >> order[at]) & 1 == 1) & (index & before == 0)].sum(axis=1)

    for swap in plain_changes(n):
        if swap is None:
            changed = range(n)
        else:
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
            changed = (swap, swap + 1)
        for at in changed:
            step(at)
        yield tuple(order), removed


def _orders(letters: str):
    n = len(letters)
    fields = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def rows(parts: list[str], counts: np.ndarray) -> pa.RecordBatch:
        index = np.arange(1 << n)
        total = counts[:, :, 0].sum(axis=1)
        fails = np.stack([counts[:, (index >> f) & 1 == 1, 0].sum(axis=1) for f in range(n)])
        alone = np.stack([counts[:, 1 << f, 0] for f in range(n)])
        shapley = np.zeros_like(fails)
        names, steps, filters, values = [], [], [], []
        for order, removed in walk(counts, n):
            own = list(order)
            shapley[own] += removed[:, :, 0]
            kept = total - np.cumsum(removed[:, :, 0], axis=0)
            values.append(np.stack([kept, removed[:, :, 0], fails[own] - removed[:, :, 0], alone[own], removed[:, :, 1], removed[:, :, 2]]))
            names += ["".join(letters[f] for f in order)] * n
            steps += range(1, n + 1)
            filters += own
        table = np.concatenate(values, axis=1)  # (field, order and step, part)
        table = np.concatenate([table, shapley[filters][None]])
        width = len(names)
        out = [pa.array(parts).take(pa.array(np.repeat(np.arange(len(parts)), width))), pa.array(names * len(parts)), pa.array(steps * len(parts), type=pa.int32())]
        out += [pa.array(np.ascontiguousarray(table[i].T).ravel()) for i in range(len(fields))]
        return pa.RecordBatch.from_arrays(out, names=["part", "filter_order", "step", *fields])

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS):
                some = batch.slice(start, PARTS).to_pylist()
                counts = np.zeros((len(some), 1 << n, 3), dtype=np.int64)
                for i, row in enumerate(some):
                    for c in row["cells"]:
                        counts[i, c["mask"]] += (c["n"], c["good"], c["toxic"])
                yield rows([row["part"] for row in some], counts)

    return orders


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Of cells (part, mask, n, good, toxic), a row for each part, order of the filters and step.

    kept: left after the step; removed: by it; redundant: what fails its filter and went before;
    unique_fails: what fails its filter alone; good_lost, toxic_lost: labelled ones that it removes;
    shapley: what its filter removes, summed over all orders. Bit i of a mask is letters[i].
    """
    own = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return own.mapInArrow(_orders(letters), "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def filter_audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """The audit of the five filters of texts over all documents."""
    return audit(cells(masks(docs, text, doc_id, part), labels, doc_id))
