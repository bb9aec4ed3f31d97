"""Decontamination where one run of words stands in all documents and all items."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.llm import decontaminate
from sluice.llm.decontaminate import SEED, is_hit, tile, tokens

PROMPT = "answer the following question with one word and no more than that please"  # 13 words


def plain(docs, items):
    out = {}
    for i, text in docs:
        doc = tokens(text)
        found = []
        for k, item in items:
            ids = tokens(item)
            tiles = tile(ids, doc, min(SEED, ids.size)) if ids.size else []
            covered = sum(t[0] for t in tiles)
            if ids.size and is_hit(covered, ids.size):
                found.append((k, ids.size, covered))
        out[i] = sorted(found)
    return out


def made(rng, n_docs, n_items):
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(k, f"{PROMPT} " + " ".join(word() for _ in range(rng.choice([14, 20, 40])))) for k in range(n_items)]
    items += [(n_items, PROMPT), (n_items + 1, "short one"), (n_items + 2, f"{PROMPT} yes or no"), (n_items + 3, "")]
    docs = []
    for i in range(n_docs):
        own = [word() for _ in range(30)]
        if i % 10 == 0:
            own += rng.choice(items)[1].split()[8:]
        docs.append((i, " ".join([*own, PROMPT, *own[:5]]) if i % 7 else " ".join(own)))
    return docs, items


@pytest.mark.parametrize("few", [True, False])
def test_hot_seeds_give_the_same_hits(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(decontaminate, "FILTER_BYTES", -1)
    docs, items = made(random.Random(4), 60, 25)
    found = decontaminate.find_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: sorted((h["item"], h["tokens"], h["covered"]) for h in r["hits"]) for r in found.collect()}
    assert got == plain(docs, items)
    assert sum(map(len, got.values())) > 50


def test_candidates_do_not_multiply(spark):
    """All of 1,500 documents share a run with all of 400 items: 600,000 pairs by it, and few candidates."""
    docs, items = made(random.Random(8), 1500, 400)
    items = items[:400]
    bench = decontaminate._items(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    texts = bench.select("ikey", F.col("text").alias("item_text"), "tokens", "seeds")
    places = texts.select("ikey", "tokens", F.posexplode("seeds").alias("pos", "seed"))
    emit = F.arrow_udf(decontaminate._doc_seeds([SEED], None), "array<long>")
    emitted = spark.createDataFrame(docs, "doc_id long, text string").select(F.col("doc_id").cast("string").alias("key"), emit("text").alias("seeds"))
    by_any = emitted.select("key", F.explode("seeds").alias("seed")).join(places, "seed").select("key", "ikey").distinct().count()
    pairs = decontaminate.candidate_pairs(emitted, texts, places, decontaminate.LEAST).count()
    assert by_any > 400_000 and pairs < 2 * len(docs)


def test_only_what_cannot_hit_is_left_out():
    """Any set of left-out seeds lies over fewer words than the threshold."""
    import pyarrow as pa

    rng = random.Random(1)
    for _ in range(300):
        size = rng.randrange(1, 60)
        n = min(SEED, size)
        own = [rng.randrange(30) for _ in range(size - n + 1)]
        freq = {s: rng.randrange(5) for s in own}
        kept = set(decontaminate._rare(0.5)(pa.array([size]), pa.array([own]), pa.array([[freq[s] for s in own]])).to_pylist()[0])
        covered = {w for at, s in enumerate(own) if s not in kept for w in range(at, at + n)}
        assert not is_hit(len(covered), size)
