"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

Lines that occur once anywhere end every repeated run, so the sequences are the runs of lines between
them. Round k ranks all suffixes by their first 2^(k+1) lines: the pairs of ranks that stand 2^k lines
apart are sorted over all partitions and numbered. Suffixes of equal rank form an LCP interval of depth
2^k; an interval of any depth m is a pair of overlapping ones. A repeated run counts if it has WORDS words
or more. Every line of such a run lies in the shortest run of WORDS words that starts, or that ends, at
some line inside it, and a run that short has WORDS lines at most; so ranks up to that depth decide all.
Intervals of these runs reveal the repeated ones; all copies but the first (by document id, then line)
are deleted, which together deletes later copies of all maximal repeated runs of WORDS words or more.

Lines are split at line feeds and compared without white space at their ends; blank lines are passed over.
Only DataFrame functions are used.

Edge cases: a null text stays null; an empty text stays empty; rows that repeat an id and a text are one
document and share its result; a null id comes first in the order; an empty table gives an empty table;
extra columns stay, but for those that have the names of the results, which take their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.parts import text_hash, without
from sluice.session import write_out

#: Words of a repeated run that counts. What is shorter are trivial lines, which repeat by chance.
WORDS = 5


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def _numbered(keys: DataFrame, *by: str) -> DataFrame:
    """keys, all different, with their number from 1 in the order of by, as column rank.

    Range partitions are numbered each on its own; only their sizes meet on the driver.
    """
    dealt = write_out(keys.repartitionByRange(*by).withColumn("pid", F.spark_partition_id()), "ranks")
    sizes = sorted((r["pid"], r["n"]) for r in dealt.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for pid, n in sizes:
        starts.append((pid, total))
        total += n
    base = keys.sparkSession.createDataFrame(starts, "pid int, base long")
    own = F.row_number().over(Window.partitionBy("pid").orderBy(*by))
    return dealt.withColumn("own", own).join(F.broadcast(base), "pid").select(*keys.columns, (F.col("base") + F.col("own")).alias("rank"))


def suffix_ranks(seq: DataFrame, depth: int) -> DataFrame:
    """seq (id, hash, part, pos, r0) with columns r1, r2, ... of ranks by 2, 4, ... lines up to depth."""
    k = 0
    order = Window.partitionBy("id", "hash", "part").orderBy("pos")
    while 2 ** (k + 1) <= depth:
        pair = seq.withColumn("next", F.coalesce(F.lead(f"r{k}", 2**k).over(order), F.lit(0)))
        pair = write_out(pair, "suffixes")
        # A suffix that ends before, and one whose first lines stand alone, is in no deeper interval: rank 0.
        # Most are such; they stay out of the join, where they would be one hot key.
        open_ = (F.col(f"r{k}") > 0) & (F.col("next") > 0)
        twice = pair.filter(open_).groupBy(f"r{k}", "next").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        ranks = _numbered(twice, f"r{k}", "next").withColumnRenamed("rank", f"r{k + 1}")
        ranked = pair.filter(open_).join(ranks, [f"r{k}", "next"], "left").withColumn(f"r{k + 1}", F.coalesce(f"r{k + 1}", F.lit(0)).cast("long"))
        seq = ranked.drop("next").unionByName(pair.filter(~open_).drop("next").withColumn(f"r{k + 1}", F.lit(0).cast("long")))
        k += 1
    return write_out(seq, "suffixes")


def _sequences(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, hash, part, pos, at, n, r0): lines that occur twice or more, in parts without gaps, their words and rank."""
    body = F.transform(lines(F.col(text).cast("string")), lambda x, i: F.struct(i.alias("at"), F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")).alias("s")))
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), text_hash(F.col(text)).alias("hash"), F.posexplode(F.filter(body, lambda x: x["s"] != "")).alias("pos", "l"))
    rows = rows.select("id", "hash", "pos", F.col("l.at").alias("at"), F.xxhash64("l.s").alias("a"), F.xxhash64(F.lit(1), F.col("l.s")).alias("b"), (F.length("l.s") - F.length(F.replace("l.s", F.lit(" "), F.lit(""))) + 1).alias("n"))
    rows = write_out(rows, "lines")
    twice = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    ranked = _numbered(twice, "a", "b").withColumnRenamed("rank", "r0")
    some = rows.join(ranked, ["a", "b"]).drop("a", "b").dropDuplicates(["id", "hash", "pos"])
    return some.withColumn("part", F.col("pos") - F.row_number().over(Window.partitionBy("id", "hash").orderBy("pos")))


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(id, hash, at) of all lines in later copies of repeated runs of at least so many words."""
    ranked = suffix_ranks(_sequences(docs, text, doc_id), words)
    levels = sorted((c for c in ranked.columns if c[0] == "r" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    upto = F.sum("n").over(Window.partitionBy("id", "hash", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seqs = ranked.withColumn("upto", upto).groupBy("id", "hash", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "at", "n", "upto", *levels))).alias("s"))
    s = F.col("s")

    def window(code: Column) -> Column:
        """The run of m lines from start: as LCP interval, the ranks of its first and its last 2^k lines."""
        start, m = F.floor(code / words).cast("int"), (code % words + 1).cast("int")
        first = F.get(s, start)
        key = F.lit(None)
        for k, level in reversed(list(enumerate(levels))):
            key = F.when((m >= 2**k) & (m < 2 ** (k + 1)), F.struct(first[level].alias("x"), F.get(s, start + m - 2**k)[level].alias("y"))).otherwise(key)
        return F.struct(first["at"].alias("at"), F.transform(F.slice(s, start + 1, m), lambda y: y["at"]).alias("ats"), m.alias("m"), key["x"].alias("x"), key["y"].alias("y"))

    def both(x: Column, i: Column) -> Column:
        """The shortest runs of enough words that start and that end at a line, as start * words + number of lines - 1."""
        ahead = F.slice(s, i + 1, F.lit(words))
        m = F.size(F.filter(ahead, lambda y: y["upto"] < x["upto"] - x["n"] + words)) + 1
        back = F.slice(s, F.greatest(i - words + 2, F.lit(1)), F.least(i + 1, F.lit(words)))
        w = F.size(F.filter(back, lambda y: y["upto"] - y["n"] > x["upto"] - words)) + 1
        at = i.cast("long") * words
        return F.array(F.when(m <= F.size(ahead), at + m - 1), F.when(w <= F.size(back), at - (w - 1) * words + w - 1))

    # Numbers, as arrays of these are made distinct by hashing; and no row but its own runs, however long a document is.
    codes = F.filter(F.array_distinct(F.flatten(F.transform(s, both))), lambda c: c.isNotNull())
    found = F.filter(F.transform(codes, window), lambda y: (y["x"] > 0) & (y["y"] > 0))
    runs = seqs.select("id", "hash", F.explode(found).alias("w")).select("id", "hash", "w.*")
    runs = write_out(runs, "runs")
    # What is not first is what the firsts leave: this join has the row itself in its key, so no run is hot.
    first = runs.groupBy("m", "x", "y").agg(F.min(F.struct("id", "hash", "at")).alias("f")).select("m", "x", "y", "f.*").toDF("fm", "fx", "fy", "fid", "fhash", "fat")
    same = F.col("id").eqNullSafe(F.col("fid"))
    for c in ("m", "x", "y", "hash", "at"):
        same = same & (F.col(c) == F.col(f"f{c}"))
    later = runs.join(first, same, "left_anti")
    return later.select("id", "hash", F.explode("ats").alias("at"))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "text", prefix: str = "lines_", words: int = WORDS) -> DataFrame:
    """docs with the remaining text in out and, behind prefix, parts (lines) and removed."""
    return without(docs, repeated(docs, text, doc_id, words), lines, "\n", text, doc_id, out, prefix)
