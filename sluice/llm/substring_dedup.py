"""Substring dedup over sliding sentence spans.

Every run of several consecutive sentences is hashed that is just long enough to count: two sentences of
LONG words or more, or SPAN sentences and as many more as LEAST words take. Of each sentence these are the
shortest such run that starts with it and the shortest that ends with it; they cover every longer run.
Equal runs are joined over all documents; sentences that a run covers which is not the first of its kind
(by document id, then position) are removed. What is left of a text is as it was, spaces included.

Sentences end behind . ! or ? and a white space, or with a line. Runs are equal if their sentences are,
with white space at their ends off and white space inside as one space. Shorter runs don't count, so that
chance repeats of very short sentences stay; a passage of short sentences counts by its words in sum.

Edge cases: a null text stays null and has no sentences; an empty text stays empty; a repeat inside one
document is removed as one between two; rows that repeat an id and a text are one document and share its
result; a null id comes first in the order; an empty table gives an empty table; extra columns stay, but
for those that have the names of the results, which take their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.parts import text_hash, without
from sluice.session import write_out

#: Sentences and words of a run: two sentences with LONG words, or SPAN or more with LEAST words.
SPAN, LONG, LEAST = 3, 25, 10


def sentences(text: Column) -> Column:
    """The text cut behind each sentence; the pieces make up the text again."""
    return F.split(text, r"(?<=[.!?]\s)|(?<=\n)")


def _spans(n: str, two: str, three: str) -> Column:
    """start * LEAST + number of sentences - 1 of the shortest runs that count; of arrays of words by sentence, pair and triple."""

    def longer(ahead: Column) -> Column:
        """How many sentences are needed of those ahead; null if there are too few."""
        grown = lambda s, x: F.when((s["w"] >= LEAST) & (s["k"] >= SPAN), s).otherwise(F.struct((s["k"] + 1).alias("k"), (s["w"] + x).alias("w")))
        return F.aggregate(ahead, F.struct(F.lit(0).alias("k"), F.lit(0).alias("w")), grown, lambda s: F.when((s["w"] >= LEAST) & (s["k"] >= SPAN), s["k"]))

    def first(pair: Column, i: Column) -> Column:
        """The run that starts at i."""
        of = F.get(three, i)
        more = i * LEAST + longer(F.slice(n, i + 1, F.lit(LEAST))) - 1
        return F.when(pair >= LONG, i * LEAST + 1).when(of >= LEAST, i * LEAST + SPAN - 1).when(of.isNotNull(), more)

    def last(_: Column, i: Column) -> Column:
        """The run that ends at i, if it isn't one that starts somewhere: a pair always is, three are if no pair starts there."""
        of = F.get(three, i - 2)
        back = F.reverse(F.slice(n, F.greatest(i - LEAST + 2, F.lit(1)), F.least(i + 1, F.lit(LEAST))))
        more = i * LEAST - (LEAST - 1) * (longer(back) - 1)
        return F.when(F.get(two, i - 1) >= LONG, F.lit(None)).when(of >= LEAST, F.when(F.get(two, i - 2) >= LONG, (i - 2) * LEAST + SPAN - 1)).when(of.isNotNull(), more)

    return F.array_distinct(F.filter(F.concat(F.transform(two, first), F.transform(two, last)), lambda x: x.isNotNull()))


def _runs(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, hash, at, last, a, b): per document arrays of runs, of sentences from position at to last, and their 128-bit hashes."""
    clean = F.transform(sentences(F.col(text).cast("string")), lambda s, i: F.struct(i.alias("i"), F.trim(F.regexp_replace(s, r"\s+", " ")).alias("s")))
    df = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), text_hash(F.col(text)).alias("hash"), F.filter(clean, lambda x: x["s"] != "").alias("s"))
    each = {
        "i": lambda x: x["i"],
        "n": lambda x: F.length(x["s"]) - F.length(F.replace(x["s"], F.lit(" "), F.lit(""))) + 1,
        # Two seeds: what is equal under one need not be under the other.
        "a": lambda x: F.xxhash64(x["s"]),
        "b": lambda x: F.xxhash64(F.lit(1), x["s"]),
    }
    df = df.select("id", "hash", *[F.transform("s", f).alias(k) for k, f in each.items()])
    df = df.withColumn("two", F.transform("n", lambda x, i: x + F.get("n", i + 1))).withColumn("three", F.transform("two", lambda x, i: x + F.get("n", i + 2)))
    df = df.withColumn("span", _spans("n", "two", "three"))
    start, more = lambda x: F.floor(x / LEAST).cast("int"), lambda x: x % LEAST
    of = lambda c: F.transform("span", lambda x: F.xxhash64(F.slice(c, start(x) + 1, more(x) + 1)))
    place = lambda at: F.transform("span", lambda x: F.get("i", at(x)))
    return df.select("id", "hash", place(start).alias("at"), place(lambda x: start(x) + more(x)).alias("last"), of("a").alias("a"), of("b").alias("b"))


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, hash, at) of all sentences that a run covers which is not the first of its kind."""
    # Texts are cut and hashed once; what is written is read twice.
    runs = write_out(_runs(docs, text, doc_id), "runs")
    # Counted by half of the hash first: most runs are found once and go no further than this sum.
    twice = write_out(runs.select(F.explode("a").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a"), "twice")
    each = runs.select("id", "hash", F.explode(F.arrays_zip("at", "last", "a", "b")).alias("r")).select("id", "hash", "r.*")
    some = write_out(each.join(twice, "a", "left_semi"), "repeats")
    # What is not first is what the firsts leave: this join has the row itself in its key, so no hash is hot.
    first = some.groupBy("a", "b").agg(F.min(F.struct("id", "hash", "at")).alias("f")).select(F.col("a").alias("fa"), F.col("b").alias("fb"), "f.*").toDF("fa", "fb", "fid", "fhash", "fat")
    same = (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")) & (F.col("hash") == F.col("fhash")) & (F.col("at") == F.col("fat")) & F.col("id").eqNullSafe(F.col("fid"))
    later = some.join(first, same, "left_anti")
    spans = later.groupBy("id", "hash", "at").agg(F.max("last").alias("last"))
    return spans.select("id", "hash", F.explode(F.sequence("at", "last")).alias("at"))


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "text", prefix: str = "dedup_") -> DataFrame:
    """docs with the remaining text in out and, behind prefix, parts (sentences) and removed."""
    return without(docs, repeated(docs, text, doc_id), sentences, "", text, doc_id, out, prefix)
