"""Host-level quality rules.

Every document is measured by rules on its words and lines. Rule failures are summed by host (here the
column `source`), each host's failure rate is shrunk towards the rate of all hosts with a beta prior
fitted to the hosts themselves, and hosts whose shrunk rate is beyond a limit are rejected with all
their documents. The limit is relative to the prior: its mean and half its standard deviation, but at
least LIMIT, so that a host goes only if it stands out and most of its documents fail. Only DataFrame
functions are used.

Edge cases: a null text counts as an empty one (0 words, fails); a null host is a host of its own; rows
that repeat are measured and counted each; an empty table gives an empty table; columns of the input
may have any names, also those of the measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.session import fresh, write_out

GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: The least limit of a host's shrunk failure rate, and the standard deviations of the prior above its mean.
LIMIT, SPREAD = 0.5, 0.5
#: Rejected hosts of at most this many bytes of names are broadcast; more of them are joined by salted keys.
BROADCAST_BYTES = 8 << 20
SALTS = 32


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_window_words(words: Column) -> Column:
    """Number of words that lie in a three-word window found twice or more in the array.

    The windows' 64-bit hashes are sorted with their positions, so that equal ones are neighbours: the
    cost is n log n for texts of any length.
    """
    keyed = F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_covered(F.sort_array(F.slice(keyed, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))))))


def _covered(ordered: Column) -> Column:
    def start(s: Column, i: Column) -> Column:
        equal = F.coalesce(F.get(ordered, i - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == s["h"], F.lit(False))
        return F.when(equal, s["i"]).otherwise(F.lit(-1))

    starts = F.array_remove(F.transform(ordered, start), F.lit(-1))
    return F.size(F.array_distinct(F.concat(starts, F.transform(starts, lambda x: x + 1), F.transform(starts, lambda x: x + 2))))


def measure(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """Add a struct column with MEASURES and the verdicts of the document's own rules.

    base_failed: fewer than 50 words, or more than half of the words repeat in windows. failed: base_failed
    or more than one symbol in ten words, over 30 % lines that repeat, or a mean word length out of 2 to 14.
    """
    body, words, lines, windows, ordered, base = (fresh(x, docs) for x in ("q_body", "q_words", "q_lines", "q_windows", "q_ordered", "q_base"))
    b, w = F.col(body), F.col(words)
    df = docs.withColumn(body, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumns({words: F.array_remove(F.split(b, GAP), ""), lines: F.filter(F.split(b, "\n"), lambda x: F.length(_without(x, GAP_CHARS)) > 0)})
    df = df.withColumn(windows, F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))))
    g = F.col(windows)
    # Only where windows repeat are they brought in order.
    df = df.withColumn(ordered, F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    size = F.length(b)
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(_without(b, GAP_CHARS)),
        "n_symbols": size - F.length(_without(b, SYMBOLS)),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.col(ordered).isNull(), F.lit(0)).otherwise(_covered(F.col(ordered))),
    }
    df = df.withColumn(base, F.struct(*[c.cast("long").alias(k) for k, c in counts.items()]))
    m = F.col(base)
    base_failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    other = (10 * m["n_symbols"] > m["n_words"]) | (10 * m["n_dup_lines"] > 3 * m["n_lines"]) | (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 14 * m["n_words"])
    df = df.withColumn(out, F.struct(*[m[k].alias(k) for k in MEASURES], base_failed.alias("base_failed"), (base_failed | other).alias("failed")))
    return df.drop(body, words, lines, windows, ordered, base)


def host_rates(measured: DataFrame, host: str = "source", quality: str = "quality", least: float = LIMIT) -> DataFrame:
    """Per host its documents, failures, shrunk failure rate and whether it goes: (host, docs, failures, rate, rejected)."""
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col(quality)["failed"].cast("long")).alias("failures"))
    return shrunk(write_out(hosts, "hosts"), least)


def shrunk(hosts: DataFrame, least: float = LIMIT) -> DataFrame:
    """hosts (host, docs, failures) with rate and rejected.

    The beta prior has the mean of all documents. Its variance is how far the hosts' rates differ beyond what
    chance alone explains (method of moments), and gives its weight; if they don't, every host gets the mean.
    """
    total = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("docs").alias("n"), F.sum("failures").alias("f"), F.sum(F.col("failures").cast("double") * F.col("failures") / F.col("docs")).alias("s2")).first()
    if not total["n"]:
        return hosts.withColumns({"rate": F.lit(None).cast("double"), "rejected": F.lit(False)})
    mean = total["f"] / total["n"]
    between = total["s2"] / total["n"] - mean * mean - mean * (1 - mean) * total["k"] / total["n"]
    if between <= 1e-12:
        between, rate = 0.0, F.lit(float(mean))
    else:
        weight = max(mean * (1 - mean) / between - 1, 0.0)
        rate = (F.col("failures") + F.lit(mean * weight)) / (F.col("docs") + F.lit(weight))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > max(least, mean + SPREAD * between**0.5))


def judge(measured: DataFrame, rates: DataFrame, host: str = "source", quality: str = "quality", out: str = "kept") -> DataFrame:
    """Add the verdict: false if the document's base rules fail or its host is rejected."""
    own = ~F.col(quality)["base_failed"]
    bad = rates.filter("rejected").select(F.col("host"))
    size = bad.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("host") + 16), F.lit(0)).alias("bytes")).first()
    if not size["n"]:
        return measured.withColumn(out, own)
    name, mark, salt = (fresh(x, measured) for x in ("q_host", "q_bad", "q_salt"))
    bad = bad.select(F.col("host").alias(name), F.lit(True).alias(mark))
    hit = F.col(name).eqNullSafe(F.col(host))
    if size["bytes"] <= BROADCAST_BYTES:
        joined = measured.join(F.broadcast(bad), hit, "left")
    else:
        other = fresh("q_salt_of", measured)
        # By rows, so that columns of any type and of one value are dealt evenly; every salt finds its copy, so any will do.
        salted = measured.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        copies = bad.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, hit & (F.col(salt) == F.col(other)), "left").drop(salt, other)
    return joined.withColumn(out, own & F.col(mark).isNull()).drop(name, mark)


def quality_rules(docs: DataFrame, least: float = LIMIT, text: str = "text", host: str = "source", keep_text: bool = True, quality: str = "quality", out: str = "kept") -> DataFrame:
    """docs with the struct of measures and the verdict. keep_text=False drops the text after measuring.

    The measured rows are written once, as both the hosts' rates and the verdicts read them.
    """
    measured = measure(docs, text, quality)
    if not keep_text:
        measured = measured.drop(text)
    measured = write_out(measured, "measured")
    return judge(measured, host_rates(measured, host, quality, least), host, quality, out)
