"""Cross-tokenizer alignment against a plain version: tokenizers by their own libraries, offsets one by one, all pairs."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sluice.llm import align
from sluice.llm.queries import TOKENIZERS, op12_token_alignment
from sluice.session import new_path

FILES = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
BYTES = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
BYTES |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in BYTES.values())}


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def tokens(tools, text):
    a, b = tools
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(BYTES[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    return ids_a, bytes_a, ids_b, bytes_b


def plain(tools, texts):
    """Rows of (n_a, n_b, n_groups, n_links, n_best, count_sum, digest), and the documents by pair."""
    links, rows, documents = [], [], Counter()
    for text in texts:
        one, groups = Counter(), []
        if text:
            ids_a, bytes_a, ids_b, bytes_b = tokens(tools, text)
            data = (" " + text).encode()
            if b"".join(bytes_a) == data and b"".join(bytes_b) == data:
                ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
                x = y = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    p, q = ends_a.index(cut, x) + 1, ends_b.index(cut, y) + 1
                    groups.append((ids_a[x:p], ids_b[y:q]))
                    x, y = p, q
        for g, h in groups:
            for i, k in Counter(g).items():
                for j, m in Counter(h).items():
                    one[i, j] += k * m
        documents.update(one.keys())
        links.append(one)
        listing = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        rows.append((sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(one.values()), hashlib.sha256(listing.encode()).hexdigest() if groups else ""))
    best = Counter()
    for (i, _), n in documents.items():
        best[i] = max(best[i], n)
    full = [(*r[:4], sum(k for p, k in one.items() if documents[p] == best[p[0]]), sum(k * documents[p] for p, k in one.items()), r[4]) for r, one in zip(rows, links, strict=True)]
    return full, documents


HOSTILE = [
    None, "", " ", "  ", "\n", "a", "▁", "a▁b", "<|endoftext|> and <s> </s> <unk> <0x41>", "\0 x", "tab\tand\x0bfeeds\x0c", "é́ ﬁ Å ½ ²", "漢字かな交じり文。" * 30, "😀👩‍👩‍👧" * 20, "=-" * 3000, "a" * 5000,
    " " * 3000, "\n" * 900, "don't we'LL I'm", "x" * 200 + "漢" * 200, "0123456789" * 100, "﻿bom", "no break space", "أهلا وسهلا", "word " * 4000,
]


def check(spark, tools, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, aligned string, gaps int").repartition(3)
    aligned = align.align(docs, *FILES)
    counts = align.pair_counts(aligned, *FILES)
    got = align.score(aligned, counts).collect()
    want, documents = plain(tools, texts)
    assert len(got) == len(texts)
    for r in got:
        a, s = r["aligned"], r["scores"]
        assert (a["n_a"], a["n_b"], a["n_groups"], a["n_links"], s["n_best"], s["count_sum"], a["groups_sha256"]) == want[r["doc_id"]], (r["doc_id"], str(texts[r["doc_id"]])[:40])
    table = {(r["a"], r["b"]): r["documents"] for r in align.count_table(spark, counts).collect()}
    assert table == dict(documents)
    return counts


def test_hostile_texts_equal_the_plain_version(spark, tools):
    check(spark, tools, HOSTILE + HOSTILE[8:12] + HOSTILE[8:9])


def test_random_bytes_and_slices(spark, tools, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é漢=- \n'sthe😀́") for _ in range(rng.randrange(1, 400))) for _ in range(120)]
    check(spark, tools, texts)
    a, b = align.load(*FILES)
    for text in [*texts[:40], "=-" * 3000]:
        whole = align.Aligned(text, a, b).pairs(len(b.bytes))
        monkeypatch.setattr(align, "SLICE", 7)
        sliced = align.Aligned(text, a, b).pairs(len(b.bytes))
        monkeypatch.undo()
        assert all(np.array_equal(x, y) for x, y in zip(whole, sliced, strict=True))


def test_small_bounds_give_the_same_partial_counts(monkeypatch):
    rng = np.random.default_rng(3)
    import pyarrow as pa

    docs = [np.unique(rng.integers(0, 500, rng.integers(0, 60))) for _ in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array([np.diff(d, prepend=0).astype("<i8").tobytes() for d in docs[i : i + 30]], type=pa.binary())], names=["gaps"]) for i in range(0, 300, 30)]
    want = Counter(np.concatenate(docs).tolist())
    for gathered, held in ((1 << 21, 1 << 22), (50, 100), (1, 1)):
        monkeypatch.setattr(align, "GATHERED", gathered)
        monkeypatch.setattr(align, "HELD", held)
        got = Counter()
        for out in align._partial_counts(iter(batches)):
            for k, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                got[k] += n
        assert got == want


def test_query_equals_the_plain_version(spark, sf_dir, tools):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, _ = plain(tools, [t for _, t in texts])
    got = op12_token_alignment(spark, sf_dir).collect()
    fields = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((r["doc_id"], *(r[f] for f in fields)) for r in got) == sorted((i, *w) for (i, _), w in zip(texts, want, strict=True))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    aligned = align.align(docs, *FILES)
    counts = align.pair_counts(aligned, *FILES)
    assert align.score(aligned, counts).count() == 0 and counts.shards == []
    assert align.count_table(spark, counts).count() == 0
    blank = align.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *FILES)
    assert [tuple(r["scores"]) for r in align.score(blank, align.pair_counts(blank, *FILES)).collect()] == [(0, 0), (0, 0)]


def test_shards_are_written_whole_under_their_names(spark, tools):
    import os

    folder = new_path(spark, "shards-test")
    keys = spark.range(10_000).selectExpr("id % 700 as key", "1L as n").repartitionByRange(4, "key").sortWithinPartitions("key")
    rows = keys.mapInArrow(align._shard_writer(folder, 100), "shard string, first long, last long, rows long, a array<long>, best array<long>").collect()
    files = sorted(os.listdir(align._place(folder)[1]))
    assert files == sorted(f"{r['shard']}.{kind}" for r in rows for kind in ("keys", "counts"))
    assert sum(r["rows"] for r in rows) == 700
    spans = sorted((r["first"], r["last"]) for r in rows)
    assert all(a[1] < b[0] for a, b in itertools.pairwise(spans))
