"""Arrow functions that take a batch in pieces, so that a worker's memory is that of a piece and not of ten thousand long texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Bytes of text, and rows, of a piece; a longer text is a piece of its own.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 512


def cut(arrays: tuple[pa.Array, ...]) -> Iterator[list[pa.Array]]:
    """The rows of arrays of texts, in order, in pieces."""
    n = len(arrays[0])
    sizes = sum((pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64) for a in arrays), np.zeros(n, np.int64))
    before = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < n:
        end = min(int(np.searchsorted(before, before[at] + PIECE_BYTES, "right")) - 1, at + PIECE_ROWS)
        end = max(end, at + 1)
        yield [a.slice(at, end - at) for a in arrays]
        at = end


def in_pieces(f: Callable[..., pa.Array], kind: str, arguments: int = 1):
    """f, of arrays of texts, as a function of columns of Spark type kind."""

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch):
                yield f(batch)
            for piece in cut((batch,)):
                yield f(*piece)

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch[0]):
                yield f(*batch)
            for piece in cut(tuple(batch)):
                yield f(*piece)

    return F.arrow_udf(one if arguments == 1 else several, kind)
