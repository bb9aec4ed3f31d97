"""Removing parts (lines, sentences) of documents, by their positions. Used by the operators that find repeats.

A document is known by its id and the hash of its text: rows that repeat both are one document to these
operators and share one result.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.session import fresh, write_out


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers live on from task to task, beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, split: Callable[[Column], Column], glue: str, text: str, doc_id: str, out: str, prefix: str) -> DataFrame:
    """docs with out (the text without its gone parts) and, behind prefix, parts and removed (counts).

    gone: rows (id, hash, at) of positions from 0, each once or more often. Their lists grow with the documents,
    so they are joined by document at every size: documents are shuffled once, and a hot one is split.
    """
    of, by, at, parts = (fresh(x, docs) for x in ("r_id", "r_hash", "r_at", "r_parts"))
    lists = write_out(gone.groupBy(F.col("id").alias(of), F.col("hash").alias(by)).agg(F.sort_array(F.collect_set("at")).alias(at)), "removed")
    hit = (F.col(by) == text_hash(F.col(text))) & F.col(of).eqNullSafe(F.col(doc_id))
    joined = docs.join(lists.hint("merge"), hit, "left")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    joined = joined.withColumn(parts, split(whole))
    n = F.size(parts)
    left = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col(at)), lambda i: F.get(F.col(parts), i))
    cut = F.when(F.col(at).isNull(), F.col(text).cast("string")).otherwise(F.array_join(left, glue))
    counts = {f"{prefix}parts": n.cast("long"), f"{prefix}removed": F.when(F.col(at).isNull(), F.lit(0)).otherwise(F.size(at)).cast("long")}
    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in (out, *counts)}]
    return joined.select(*[F.col(c) for c in kept], cut.alias(out), *[c.alias(k) for k, c in counts.items()])
