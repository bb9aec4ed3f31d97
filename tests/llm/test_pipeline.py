"""Each stage of the pipeline against a plain version of it, on what the stage before has kept."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from sluice.llm import decontaminate, line_dedup, mixing
from sluice.session import write_out
from tests.llm.test_text_operators import WORD, brute_jaccard, brute_lines, brute_measures

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = " ".join(f"fresh{i}" for i in range(90))
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    filler = " ".join(f"other{i}" for i in range(60))
    rows = [(9001, clean, "en", "src1", 1), (9002, clean, "en", "src2", 1), (9002, clean, "en", "src2", 1), (9003, clean + " tail", "en", None, None), (9004, f"{filler} {item} {filler.upper()}", None, "src1", 1), (9005, None, None, None, None), (9006, "", "en", "src1", 0), (None, clean.replace("fresh", "calm"), "en", "new", 1)]
    df = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    frames = [write_out(df, "in")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(write_out(stage(spark, frames[-1], sf_dir), name))
    return frames


def rows(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_columns_and_order(staged):
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "mixing"]
    assert all(f.columns == COLUMNS and f.dtypes == staged[0].dtypes for f in staged[:5])


def test_quality(staged):
    before, after = rows(staged[0]), rows(staged[1])
    fails = lambda t: (m := brute_measures(t))[0] < 50 or 100 * m[5] > 50 * m[0]
    assert Counter(after) == Counter(r for r in before if not fails(r[1]))


def test_lines(staged):
    before, after = rows(staged[1]), {r[:1] + r[2:4]: r for r in rows(staged[2])}
    gone = brute_lines([r[:2] for r in before], line_dedup.WORDS)
    for r in set(before):
        cut = "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone.get(r[:2], ()))
        got = after.get(r[:1] + r[2:4])
        assert (got is None and not cut.strip()) or (got[1] == cut and got[4] == len(cut)), r[0]


def test_near_duplicates(staged):
    before, after = rows(staged[2]), rows(staged[3])
    want = brute_jaccard([r[:2] for r in before])
    groups = {v[0] for v in want.values()}
    assert len(after) == len(groups) and {r[0] for r in after} == groups


def test_decontamination(staged, spark, sf_dir):
    before, after = rows(staged[3]), {r[0] for r in rows(staged[4])}
    items = [" ".join(decontaminate.words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for r in before:
        said = " ".join(decontaminate.words(r[1]))
        if any(i and f" {i} " in f" {said} " for i in items):
            assert r[0] not in after
    assert 9004 not in after and 9001 in after and None in after
    assert len(before) - len(after) < 0.3 * len(before)


def test_mix(staged):
    docs, mix = staged[4].collect(), staged[5].collect()
    size = defaultdict(int)
    for r in docs:
        size[r["source"]] += len(WORD.findall(r["text"]))
    goal, taken = mixing.targets(list(size.items())), defaultdict(int)
    for r in mix:
        assert 0 < r["mix_taken"] <= 3 * r["mix_size"]
        taken[r["source"]] += r["mix_taken"]
    most = max(r["mix_size"] for r in mix)
    assert all(abs(taken[s] - goal[s]) <= most / 2 + 1 for s in goal)


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
