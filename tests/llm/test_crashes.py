"""Rows that once stopped a job: false records with absurd headers, endless digits, salted joins over columns of any type."""

import hashlib
import random

import pytest

from sluice.llm import pii, quality, warc
from sluice.session import new_path

MAGIC = "WARC/1.0\r\n"
FALSE = [
    f"{MAGIC}Content-Length: 99999999999999999999\r\n\r\n",
    f"{MAGIC}Content-Length: {'9' * 5000}\r\n\r\n",
    f"{MAGIC}Content-Length: {'0' * 5000}3\r\n\r\nabc\r\n\r\n",
    f"{MAGIC}Content-Length: 999999999999999999\r\n\r\n",
    f"{MAGIC}Content-Length: -5\r\n\r\n",
    f"{MAGIC}X-Target-URI-Base64: abcde\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
    f"{MAGIC}X-Target-URI-Base64: é漢\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
    f"{MAGIC}X-Page-Id: 9999999999999999999\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
    f"{MAGIC}X-Page-Id: {'7' * 6000}\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
    f"{MAGIC}WARC-Type: revisit\r\nContent-Type: application/http\r\nContent-Length: 58\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: {'8' * 18}\r\n\r\n\r\n\r\n",
]


def fuzzed(n: int) -> list[str]:
    """Random header lines behind the magic, alone, inside text, and repeated."""
    rng = random.Random(11)
    names = ["Content-Length", "X-Page-Id", "X-Target-URI-Base64", "WARC-Type", "WARC-Refers-To", "WARC-Record-ID", "Content-Type", "WARC-Payload-Digest", "", "Ü", "content-length"]
    values = ["", "0", "3", "12", "-1", "1e3", "٣", "9" * 19, "9" * 30, "1" * 4400, "YWJj", "YW=", "%%%", "revisit", "response", "application/http", "<urn:x>", "\0", " \t", "é" * 9, "sha1:"]
    out = []
    for _ in range(n):
        head = "".join(f"{rng.choice(names)}{rng.choice([': ', ':', ' : ', ''])}{rng.choice(values)}{rng.choice(['\r\n', '\r\n', '\r\n', '\n', '\r'])}" for _ in range(rng.randrange(6)))
        one = f"WARC/1.{rng.choice(['0', '1', '77', '', 'x'])}{rng.choice(['\r\n', '\r\n', '\n', ''])}{head}{rng.choice(['\r\n', '\r\n', ''])}{'abc'[: rng.randrange(4)]}{rng.choice(['\r\n\r\n', ''])}"
        out.append(rng.choice(["", "text ", "<p>" * 30]) + one * rng.choice([1, 1, 3]) + rng.choice(["", " more", "WARC/1."]))
    return out


def read_back(spark, rows, cell=None, split=None):
    path = new_path(spark, "archive")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    try:
        return warc.read_warc(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("cell", "split", "most"), [(1 << 20, None, 8 << 20), (256, "1500b", 8 << 20), (64, "4000b", -1)])
def test_false_records_of_any_kind_are_payload(spark, monkeypatch, cell, split, most):
    monkeypatch.setattr(warc, "CELL", cell)
    monkeypatch.setattr(warc, "BROADCAST_BYTES", most)
    htmls = [*FALSE, *fuzzed(150), *(f"<p>{x}</p>" * 40 for x in FALSE[:8] if len(x) < 1000), "é" * 600, "é" * 600]
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(htmls)]
    got = {r["page_id"]: r for r in read_back(spark, rows, cell, split)}
    assert len(got) == len(rows)
    for i, url, html in rows:
        data = html.encode()
        assert (got[i]["url"], got[i]["payload_bytes"], got[i]["payload_digest"], bytes(got[i]["payload"])) == (url, len(data), hashlib.sha1(data).hexdigest(), data)
    last = len(rows) - 1
    assert (got[last]["record_type"], got[last - 1]["record_type"], got[last - 1]["refers_to"]) == ("response", "revisit", last)


def test_verdicts_by_id_equal_those_by_digest(spark, monkeypatch):
    big = ["a" * 1200, "b" * 1200, "c" * 999]
    rows = [(i % 70 if i % 9 else None, f"http://h/{i % 13}", big[i % 3]) for i in range(200)]
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in (r["page_id"], r["url"], r["payload_digest"], r["record_type"], r["refers_to"]))
    one = sorted(map(key, read_back(spark, rows)))
    monkeypatch.setattr(warc, "BROADCAST_BYTES", -1)
    assert sorted(map(key, read_back(spark, rows))) == one and len(one) == 200


def test_what_the_files_end_cuts_off_is_no_record(spark, tmp_path):
    record = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: {}\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    (tmp_path / "a.warc").write_text(record.format(1, 2, "hi") + record.format(2, 10**17, "WARC/1.0 rest"), newline="")
    (tmp_path / "b.warc").write_text(record.format(3, 16, "x WARC/1.0 y\r\n\r\n") + record.format(4, 50, "12") , newline="")
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert got == {1: b"hi", 3: b"x WARC/1.0 y\r\n\r\n"}


def test_ip_parts_of_thousands_of_digits(spark):
    texts = [f"{'0' * 5000}.1.2.3", f"1.{'0' * 6000}255.0.{'0' * 4400}", f"1.2.3.{'9' * 5000}", f"{'0' * 5000}256.1.1.1", "1" * 9000, "+1" + "2" * 9000, "DE" + "1" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] == "ip"] for r in pii.find_pii(df).collect()}
    assert got == {0: [("ip", 0, len(texts[0]))], 1: [("ip", 0, len(texts[1]))], 2: [], 3: [], 4: [], 5: [], 6: []}


def test_salted_verdicts_over_columns_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_BYTES", -1)
    good = " ".join(f"word{i}" for i in range(80))
    rows = [({"k": i}, 1, 1, 1, i, good, f"good{i % 5}") for i in range(100)] + [({}, 1, 1, 1, 1000 + i, "short", None) for i in range(100)] + [(None, 1, 1, 1, 5000, good, None)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "m map<string,int>, a int, b int, c int, doc_id long, text string, source string")).collect()}
    assert len(got) == len(rows) and all(got[i] for i in range(100)) and got[5000] is False


def test_failures_beyond_three_billion(spark):
    hosts = spark.createDataFrame([("a", 4_000_000_000, 3_900_000_000), ("b", 9_000_000_000, 90_000_000)], "host string, docs long, failures long")
    rates = {r["host"]: (round(r["rate"], 2), r["rejected"]) for r in quality.shrunk(hosts).collect()}
    assert rates == {"a": (0.97, True), "b": (0.01, False)}
