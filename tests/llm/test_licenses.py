"""License scans against every block of every document and every template."""

import random
import re

import pytest

from sluice.llm import licenses
from sluice.llm.licenses import BASE, TEMPLATES, Template, phrase

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans(licenses.CAPITALS, licenses.SMALL)


def plain(text, templates, base):
    """(n_words, n_base, first, last, base labels, labels, score, found)"""
    ws = WORD.findall((text or "").translate(AZ))
    found, places, labels, score = set(), [], set(), 0.0
    for t in [*base, *(t for t in templates if t not in base)]:
        want, s = set(t.words), t.stride
        starts = [i for i in range(len(ws)) if ws[i : i + len(t.words)] == t.words]
        if t.phrase:
            if t in base:
                places += starts
            labels |= {t.label} if starts else set()
        for k in range(0, len(ws), s):
            block = ws[k : k + 2 * s]
            share = len(want & set(block)) / len(want)
            if len(want & set(block)) >= t.need and (not t.phrase or any(k <= i < k + s for i in starts)):
                found.add((t.label, k, 2 * s, share))
                labels.add(t.label)
                score = max(score, share)
    named = {t.label for t in base if any(ws[i : i + len(t.words)] == t.words for i in range(len(ws)))}
    return len(ws), len(places), min(places, default=None), max(places, default=None), sorted(named), sorted(labels), score, sorted(found)


def check(spark, texts, templates=TEMPLATES, base=BASE):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, label string")
    rows = licenses.scan(docs, templates, base).collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = r["licenses"]
        got = (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"], x["labels"], x["score"], sorted(tuple(f) for f in x["found"]))
        assert got == plain(texts[r["doc_id"]], templates, base), str(texts[r["doc_id"]])[:80]
        assert (r["text"], r["row"], r["label"]) == (texts[r["doc_id"]], 1, "x")
    return rows


MIT = next(t for t in licenses.NOTICES if t.label == "mit").text


def test_hostile_texts(spark):
    rng = random.Random(2)
    filler = [f"w{i}" for i in range(300)]
    cut = MIT.split()
    changed = [" ".join(w for w in cut if rng.random() > p) for p in (0.05, 0.1, 0.2, 0.3)] * 3
    texts = [
        None, "", " ", "CC BY", "cc-by", "Cc\nBy 4.0", "cc by cc by cc by", "ccby cc bye", "CCÉ BY", "General Public\tLicense general public license", "all rights reserved. " * 400,
        "ALL RIGHTS RESERVED", "İ cc by", "generAl publKic license", "mit liKense MIT LICENSE", "cc by nc", "cc_by", "cc\x00by", "cc\x7fby", "{cc}by",
        MIT, MIT * 3, MIT.replace(" ", "\n# "), *changed, " ".join([*filler, *cut, *filler]), " ".join(sorted(cut)), " ".join(cut[::-1]),
        *(" ".join([*filler[:i], "all", "rights", "reserved", *filler[:5]]) for i in range(20)), " ".join(x for w in cut for x in (w, *filler[:1])),
        " ".join(rng.choice([*filler[:5], "license", "cc", "by", "rights"]) for _ in range(30_000)), "license " * 20_000, "GNU Lesser General Public License", "漢字 cc by 漢字",
        *[t.text for t in licenses.NOTICES],
    ]
    check(spark, texts + texts[3:8])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_templates_of_all_lengths(spark, seed):
    """Few words that all templates share, so that prefixes, lengths and positions matter."""
    rng = random.Random(seed)
    some = "a b c d e f g h i j k l".split()
    templates = tuple(Template(f"t{i}", " ".join(rng.choices(some[: rng.choice([4, 8, 12])], k=rng.choice([1, 2, 5, 9, 20]))), rng.choice([0.3, 0.5, 0.8, 1.0])) for i in range(12))
    base = (phrase("p", "a b"), phrase("q", "b a b"), phrase("r", "c"))
    check(spark, [" ".join(rng.choices([*some, "x", "y", "z"], weights=[1] * 4 + [0.3] * 8 + [6] * 3, k=rng.randrange(120))) for _ in range(150)], (*templates, phrase("s", "d d")), base)


def test_query_on_documents(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = check(spark, texts)
    assert {"reserved", "mit", "apache", "cc-by-nc"} <= {x for r in rows for x in r["licenses"]["labels"]}


def test_empty_table_and_no_text_kept(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(docs).count() == 0
    one = licenses.scan(spark.createDataFrame([(None, "cc by", 3)], "doc_id long, text string, Licenses int"), keep_text=False)
    assert one.columns == ["doc_id", "licenses"] and one.first()["licenses"]["n_base"] == 1


def test_templates_beyond_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="templates"):
        licenses.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))


def test_main_path_has_no_python(spark, sf_dir):
    plan = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn", plan)
