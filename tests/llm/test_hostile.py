"""Every operator over documents, and every stage of the pipeline, on hostile tables: null values in every column,
empty, very long and repeated texts, no rows at all, and columns with the names that operators use themselves."""

from __future__ import annotations

import time
from collections import Counter

import corpus_pipeline
import pytest

from sluice.llm import chat, decontaminate, html_text, jaccard, licenses, line_dedup, mixing, pii, quality, substring_dedup, warc
from sluice.session import new_path
from tests.conftest import SF

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = """id hash at last a b n s k key rank part pos block bucket chunk across members bytes chunks with sig size bands bits grams links root group of f
fid fhash wanted gone_id gone_hash row tie r_id r_hash r_at r_parts q_body q_words q_lines q_ordered q_base q_host q_bad q_salt q_rest q_cut q_before q_times
q_target q_source_size q_chosen q_size q_pattern q_part q_key q_of pat words start hit_key hit_list hits seed seeds item ikey tokens found lines_parts
lines_removed dedup_parts stage_lines_removed mix_size mix_taken pii_spans host rate rejected""".split()  # fmt: skip


def bench(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


OPERATORS = {
    "op1": lambda s, d: substring_dedup.substring_dedup(d),
    "op3": lambda s, d: mixing.mix(d),
    "op4": lambda s, d: quality.quality_rules(d),
    "op5": lambda s, d: jaccard.jaccard_groups(d),
    "op5_one": lambda s, d: jaccard.one_per_group(d),
    "op6": lambda s, d: pii.redact(pii.find_pii(d)),
    "op8": lambda s, d: decontaminate.decontaminate(d, bench(s)),
    "op9": lambda s, d: line_dedup.line_dedup(d),
    "op13": lambda s, d: licenses.scan(d),
    **{f"stage_{name}": (lambda s, d, f=f: f(s, d, SF)) for name, f in corpus_pipeline.STAGES},
}
# The names that results of an operator have take the place of such columns.
RESULTS = {"op1": {"dedup_parts"}, "op3": {"mix_size", "mix_taken"}, "op9": {"lines_parts", "lines_removed"}, "stage_mixing": {"mix_size", "mix_taken"}}
FEWER = {"op5_one", "op8", *(f"stage_{name}" for name, _ in corpus_pipeline.STAGES)}


@pytest.fixture(scope="module")
def hostile(spark):
    prose = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(12).collect()]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)]
    rows += [rows[0], rows[0], (None, prose[1], None, None, None), (None, prose[1], None, None, None), (3, None, None, None, None), (4, "", "", "", 0), (5, " \n\t\n ", "en", "s1", 5)]
    rows += [(100, "\0 ﻿ é 😀 " * 40, "en", "s1", None), (101, "\n" * 500, "en", None, 500), (102, "same line of words here\n" * 300, "en", "s2", 0), (103, "No. " * 300, "en", "s2", 0)]
    extra = [None if i % 2 else i for i in range(len(NAMES))]
    return spark.createDataFrame([(*r, *extra) for r in rows], COLUMNS + "".join(f", `{n}` int" for n in NAMES)), rows, extra


@pytest.mark.parametrize("name", OPERATORS)
def test_names_nulls_and_repeats(spark, hostile, name):
    df, rows, extra = hostile
    got = OPERATORS[name](spark, df)
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    taken = got.collect()
    if name != "op5":
        kept = [n for n in NAMES if n not in RESULTS.get(name, ())]
        assert all([r[n] for n in kept] == [x for n, x in zip(NAMES, extra, strict=True) if n in kept] for r in taken)
    counts = Counter(r["doc_id"] for r in taken)
    if name in FEWER:
        assert taken and all(n <= Counter(r[0] for r in rows)[i] for i, n in counts.items())
    else:
        assert counts == Counter(r[0] for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, hostile, name):
    assert OPERATORS[name](spark, hostile[0].limit(0)).count() == 0


LONG = {
    "one line of a million words": " ".join(f"w{i * 7919 % 50_021}" for i in range(1_000_000)),
    "one word, often": "word " * 300_000,
    "lines, of which all repeat": "".join(f"line number {i % 40_000} of these\n" for i in range(80_000)),
    "sentences, of which all repeat": "".join(f"This is number {i % 20_000}. " for i in range(40_000)),
}


@pytest.mark.parametrize("name", [n for n in OPERATORS if not n.startswith("stage")])
def test_long_texts(spark, name):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(LONG.values())], COLUMNS).repartition(4)
    began = time.time()
    got = OPERATORS[name](spark, df).collect()
    assert len(got) == len(LONG) and time.time() - began < 120


def test_pages_and_conversations(spark):
    names = "id url_ body digest size of h_host h_page h_low h_of h_spans h_all h_left path style content key branches whole file at block t turns name said".split()
    page = "<body><article><p>One {} of a page</p><p>Follow us</p></article></body>"
    rows = [(i if i % 5 else None, f"http://h.example/{i}" if i % 3 else None, page.format(i) if i % 4 else None) for i in range(24)] * 2
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "page_id long, url string, html string, " + ", ".join(f"{n} int" for n in names))
    got = html_text.main_text(df).collect()
    assert len(got) == 48 and all([r[n] for n in names] == list(range(len(names))) for r in got)
    path = new_path(spark, "archive")
    warc.write_warc(df, path)
    assert warc.read_warc(spark, path, payloads=False).count() == 48
    talk = spark.createDataFrame([(*r, *range(len(names))) for r in [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (2, 1, "assistant", "x " * 500_000)]], "conv_id long, turn long, role string, text string, " + ", ".join(f"{n} int" for n in names))
    back = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(chat.prefix_examples(talk)).collect()}
    assert back == {1: (2, 0), None: (1, 0), 2: (1, 1_000_000)}
    assert chat.read_back(chat.prefix_examples(talk.limit(0))).count() == 0 and html_text.main_text(df.limit(0)).count() == 0
