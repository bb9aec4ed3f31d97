"""Batches of long texts are taken in pieces."""

import pyarrow as pa
from pyspark.sql import functions as F

from sluice.functions import pieces
from sluice.operators import extract, jsonshape


def test_cut_keeps_rows_and_order():
    texts = ["x" * n for n in (10, pieces.PIECE_BYTES * 3, 0, 5, pieces.PIECE_BYTES - 1)] + [None] * 1200
    a, b = pa.array(texts), pa.array([str(i) for i in range(len(texts))])
    got = list(pieces.cut((a, b)))
    assert [x for p in got for x in p[0].to_pylist()] == texts and [x for p in got for x in p[1].to_pylist()] == b.to_pylist()
    for p in got:
        assert len(p[0]) == 1 or (len(p[0]) <= pieces.PIECE_ROWS and sum(len(x or "") for q in p for x in q.to_pylist()) <= pieces.PIECE_BYTES)


def test_elements_see_a_batch_in_pieces(spark):
    sizes = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("<p>"), F.col("id"), F.lit("</p>")).alias("html"), "id")
    seen = pieces.in_pieces(lambda texts: pa.array([len(texts)] * len(texts), type=pa.int64()), "long")
    rows = sizes.select("id", seen("html").alias("n")).collect()
    assert len(rows) == 3000 and max(r["n"] for r in rows) <= pieces.PIECE_ROWS
    e = extract.elements(sizes).select("id", "text").collect()
    assert len(e) == 3000 and all(r["text"] == str(r["id"]) for r in e)
    assert extract.elements(sizes.limit(0)).count() == 0


def test_json_is_walked_in_pieces(spark, monkeypatch):
    sizes = []
    docs = spark.range(0, 2000, 1, 1).select("id", F.concat(F.lit('{"k":['), "id", F.lit(',null]}')).alias("j"))
    monkeypatch.setattr(jsonshape, "in_pieces", lambda f, kind, n=1: sizes.append(n) or pieces.in_pieces(f, kind, n))
    got = jsonshape.nodes(docs, "j").filter("path = 'k[0]'").collect()
    assert sizes == [1] and len(got) == 2000 and all(r["value"] == str(r["id"]) for r in got)
