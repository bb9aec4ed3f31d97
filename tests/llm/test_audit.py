"""The filter audit against plain runs of the filters, document by document and order by order."""

import itertools
import re

import pytest

from sluice.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """docs: (id, source, text). Each order applied to the documents themselves."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    judged = []
    for i, source, text in docs:
        t = text or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in docs),
        }
        judged.append((i, source or "", {f for f, bad in fails.items() if bad}))
    out = {}
    for part in {p for _, p, _ in judged}:
        own = [(i, f) for i, p, f in judged if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                stay = [(i, x) for i, x in left if f not in x]
                shapley[f] += len(gone)
                failing = sum(f in x for _, x in own)
                rows["".join(order), step] = (len(stay), len(gone), failing - len(gone), sum(x == {f} for _, x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                left = stay
        out |= {(part, o, s): (*v, shapley[o[s - 1]]) for (o, s), v in rows.items()}
    return out


def got(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_plain_changes_visit_every_order_once_by_neighbours(n):
    order, seen = list(range(n)), set()
    for swap in audit.plain_changes(n):
        if swap is not None:
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n)))


def test_audit_equals_plain_runs(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (0, "a", long), (1, "a", long), (1, "a", long), (2, "b", long + " #"), (3, "b", "w " * 300), (4, None, None), (5, "", ""), (6, None, "ABC def"), (None, "a", long), (None, "c", None),
        (7, "c", "É" * 40 + "A"), (8, "c", "x\x1fy z w\x0bv"), (9, "a", "w " * 200_000 + "END"), (10, "d", "AB" + "x" * 98), (11, "d", "AB" + "é" * 97),
    ]
    labels = [(0, 1, 0), (1, 1, 0), (1, 1, 1), (3, 0, 1), (4, 1, None), (5, None, 1), (99, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, text string, mask string")
    lab = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    assert got(audit.filter_audit(df, lab)) == plain(docs, labels)


def test_words_split_as_the_pattern_does():
    for c in map(chr, [*range(0x100), 0x1680, 0x2003, 0x2028, 0x3000]):
        text = f"a{c}" * 60
        assert len(text.encode().split()) == len(WORD.findall(text)), repr(c)


def test_any_masks_and_many_parts(spark):
    rows = [(f"p{i % 150}", i % 8, 1 + i % 5, i % 3, i % 2) for i in range(2400)]
    counted = spark.createDataFrame(rows, "part string, mask int, n long, good long, toxic long").groupBy("part", "mask").sum("n", "good", "toxic").toDF("part", "mask", "n", "good", "toxic")
    found = got(audit.audit(counted, "xyz"))
    assert len(found) == 150 * 18
    for part in ("p0", "p77", "p149"):
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("xyz"):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << "xyz".index(f)
                gone = [r for r in left if r[1] & bit]
                left = [r for r in left if not r[1] & bit]
                assert found[part, "".join(order), step][:2] == (sum(r[2] for r in left), sum(r[2] for r in gone))
                assert found[part, "".join(order), step][4:6] == (sum(r[3] for r in gone), sum(r[4] for r in gone))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "s", "a b")], "doc_id long, source string, text string")
    assert got(audit.filter_audit(one, labels)) == plain([(1, "s", "a b")], [])
