"""License scans by an exact set-similarity join of text blocks with license templates.

A template is a set of words and a threshold: a text block meets it if it has at least that share of the
template's words (containment). Blocks are windows of 2 S words that start at every S-th word, where S is the
least power of two that the template's words fit in, and 8 at least; so every run of S words lies within a
block. Templates that are phrases have the threshold 1 and an exact check behind it: their words must
stand consecutively.

The join: words that a template has are ordered by how many documents hold them, rarest first, the same
for templates and blocks. A block that shares `need` words with a template of n shares one of the
template's n - need + 1 rarest (prefix filter), so only blocks around these are made at all. A block with
fewer words than `need` (length filter), or whose common word stands so late in the template or the block
that too few follow it (positional filter), is dropped; the rest are verified by intersection. A pair is
taken at its rarest common word alone. Blocks are cut out of the document's own row, in time linear in the
document, so nothing but results is shuffled and no word is a hot key.

Words are runs of anything but ASCII separators, after A to Z are put in lower case. Templates are given
by the caller; as they are bounded in bytes (MOST_BYTES, checked) their words stand in the plan. Only
DataFrame functions are used.

Edge cases: a null text is an empty one, without words, places or labels, and a score of 0; texts are
taken whole; rows that repeat an id or a text are scanned each; an empty table gives an empty result;
columns of the input stay, but for one that has the name of the result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.session import fresh, write_out

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The only character beyond A to Z that becomes an ASCII letter alone in lower case.
KELVIN = "\u212A"
LEAST_STRIDE = 8
#: Share of a notice's words that a block must have.
CONTAINMENT = 0.8
#: Words of all templates, in bytes, that may stand in a plan.
MOST_BYTES = 8 << 20


@dataclass(frozen=True)
class Template:
    """A label and its words; a phrase's words must stand consecutively."""

    label: str
    text: str
    threshold: float = CONTAINMENT
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(SEPARATORS, self.text.translate(str.maketrans(CAPITALS, SMALL))) if w]

    @property
    def need(self) -> int:
        """Common words that meet the threshold, at least one."""
        return max(1, math.ceil(self.threshold * len(set(self.words)) - 1e-9))

    @property
    def stride(self) -> int:
        return max(LEAST_STRIDE, 1 << (len(self.words) - 1).bit_length())


def phrase(label: str, text: str) -> Template:
    return Template(label, text, 1.0, True)


# The phrases and labels of the base.
BASE = (phrase("cc-by", "cc by"), phrase("gpl", "general public license"), phrase("reserved", "all rights reserved"))
# Short names of licenses, and the sentences by which the licenses themselves say they are to be applied.
NAMES = (
    phrase("apache", "apache license"),
    phrase("mit", "mit license"),
    phrase("bsd", "bsd license"),
    phrase("mpl", "mozilla public license"),
    phrase("lgpl", "lesser general public license"),
    phrase("agpl", "affero general public license"),
    phrase("cc-by-nc", "cc by nc"),
    phrase("cc-by-sa", "cc by sa"),
    phrase("cc-by-nd", "cc by nd"),
)
NOTICES = (
    Template("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
)
TEMPLATES = (*BASE, *NAMES, *NOTICES)


def words(text: Column) -> Column:
    """The words of a text, A to Z in lower case."""
    lowered = F.when(F.contains(text, F.lit(KELVIN)), F.translate(text, CAPITALS, SMALL)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _index(spark, templates: list[Template], rank: dict[str, int]) -> DataFrame:
    """A row for each word of a template's prefix: where it stands, and all that the filters and the check need."""
    rows = []
    for at, t in enumerate(templates):
        ordered = sorted(set(t.words), key=rank.__getitem__)
        one = {"stride": t.stride, "template": at, "label": t.label, "phrase": t.phrase, "size": len(ordered), "need": t.need, "ordered": ordered, "words": t.words}
        rare = F.struct(*[F.lit(v).alias(k) for k, v in one.items()], _literals(ordered[: len(ordered) - t.need + 1]).alias("rare"))
        rows.append(rare)
    listed = spark.range(1).select(F.inline(F.array(*rows)))
    return listed.select("*", F.posexplode("rare").alias("i", "word")).drop("rare")


def _starts(hits: Column, ahead: list[str], stride: int) -> Column:
    """Of a document's hits, the blocks around those that are prefix words: (stride, k, i), i the index of a hit in the block.

    Hits come in the order of the text: a block is named at the first prefix word that it has.
    """
    rare = F.filter(F.transform(hits, lambda h, i: F.when(h["w"].isin(ahead), F.struct(F.floor(h["at"] / stride).cast("int").alias("cell"), i.alias("i")))), lambda x: x.isNotNull())

    def blocks(array: Column) -> Column:
        def here(x: Column, j: Column) -> Column:
            before = F.coalesce(F.get(array, j - 1)["cell"], F.lit(-2))
            block = lambda k: F.struct(F.lit(stride).alias("stride"), k.alias("k"), x["i"].alias("i"))
            first = x["cell"] > before
            return F.array(F.when(first & (x["cell"] > 0) & (x["cell"] - 1 > before), block(x["cell"] - 1)), F.when(first, block(x["cell"])))

        return F.filter(F.flatten(F.transform(array, here)), lambda x: x.isNotNull())

    return blocks(rare)


def matches(hits: DataFrame, templates: list[Template], row: str, column: str) -> DataFrame:
    """(row, label, phrase, template, start, n_words, score, places): blocks that meet a template.

    hits: a row key and an array of (at, w), the places of words that a template has. start and n_words
    say which words the block spans; places are where a phrase begins in the block's first half, as a
    place in the second half is in the first of the next block.
    """
    spark = hits.sparkSession
    given = {w for t in templates for w in t.words}
    held = hits.select(F.explode(F.array_distinct(F.transform(column, lambda h: h["w"]))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    count = {r["w"]: r["n"] for r in held.collect()}  # a number a word of the templates
    order = sorted(given, key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = _index(spark, templates, rank)
    strides = sorted({t.stride for t in templates})
    ahead = {s: sorted({w for t in templates if t.stride == s for w in sorted(set(t.words), key=rank.__getitem__)[: len(set(t.words)) - t.need + 1]}, key=rank.__getitem__) for s in strides}
    h = F.col(column)
    some = hits.filter(F.arrays_overlap(F.transform(h, lambda x: x["w"]), _literals(sorted(set().union(*ahead.values())))))
    starts = F.concat(*[_starts(h, ahead[s], s) for s in strides])
    blocks = some.select(F.col(row).alias("row"), h.alias("hits"), F.explode(starts).alias("b")).select("row", "hits", "b.*")
    # A block's hits are within 2 S of the one that it is named by: a slice, not the document's whole list.
    width = 2 * F.col("stride")
    low = F.greatest(F.col("i") + 1 - width, F.lit(0))
    inside = F.filter(F.slice("hits", low + 1, 2 * width), lambda x: (x["at"] >= F.col("k") * F.col("stride")) & (x["at"] < F.col("k") * F.col("stride") + width))
    blocks = blocks.withColumn("block", inside)
    own = {s: sorted({w for t in templates if t.stride == s for w in t.words}, key=rank.__getitem__) for s in strides}
    by_stride = lambda lists: F.coalesce(*[F.when(F.col("stride") == s, _literals(x)) for s, x in lists.items()])
    # The intersection keeps the order of its first side, so these are in the global order.
    blocks = blocks.withColumn("tokens", F.array_intersect(by_stride(own), F.transform("block", lambda x: x["w"])))
    blocks = blocks.withColumn("word", F.explode(F.array_intersect(by_stride(ahead), F.col("tokens"))))
    pairs = blocks.drop("hits", "i").join(F.broadcast(index), ["stride", "word"])
    later = F.size("tokens") - F.array_position("tokens", F.col("word")).cast("int") + 1
    pairs = pairs.filter((F.size("tokens") >= F.col("need")) & (F.col("size") - F.col("i") >= F.col("need")) & (later >= F.col("need")))
    rarest = F.size(F.array_intersect(F.slice("ordered", F.lit(1), F.col("i")), F.col("tokens"))) == 0
    pairs = pairs.filter(rarest).withColumn("common", F.size(F.array_intersect("ordered", "tokens"))).filter(F.col("common") >= F.col("need"))

    def begins(x: Column) -> Column:
        follows = F.forall(F.transform("words", lambda w, q: F.struct(w.alias("w"), (x["at"] + q).alias("at"))), lambda y: F.exists("block", lambda z: (z["at"] == y["at"]) & (z["w"] == y["w"])))
        return (x["w"] == F.get("words", F.lit(0))) & (x["at"] < (F.col("k") + 1) * F.col("stride")) & follows

    places = F.when(F.col("phrase"), F.transform(F.filter("block", begins), lambda x: x["at"].cast("long"))).otherwise(F.array().cast("array<bigint>"))
    pairs = pairs.withColumn("places", places).filter(~F.col("phrase") | (F.size("places") > 0))
    start = F.col("k").cast("long") * F.col("stride")
    return pairs.select("row", "label", "phrase", "template", start.alias("start"), (2 * F.col("stride")).alias("n_words"), (F.col("common") / F.col("size")).alias("score"), "places")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: tuple[Template, ...] = BASE, text: str = "text", out: str = "licenses", keep_text: bool = True) -> DataFrame:
    """docs with a struct: n_words; n_base, first_word and last_word (places of the base's phrases); base_labels and labels
    (sorted arrays); score (the highest containment of a template that is met); found (labels with their blocks).
    """
    templates = [*base, *(t for t in templates if t not in base)]
    given = sorted({w for t in templates for w in t.words})
    if sum(len(w.encode()) + 16 for t in templates for w in t.words) > MOST_BYTES:
        raise ValueError("the templates take too many bytes to stand in a plan: scan with some of them at a time")
    row, split, hits, of, n = (fresh(x, docs) for x in ("l_row", "l_words", "l_hits", "l_of", "l_n"))
    kept = [c for c in docs.columns if c.lower() != out.lower() and (keep_text or c != text)]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.withColumn(split, words(body))
    hit = lambda w, i: F.when(w.isin(given), F.struct(i.alias("at"), w.alias("w")))
    found_words = F.filter(F.transform(F.col(split), hit), lambda x: x.isNotNull())
    # The texts are read once; all else reads the hits. Row keys are written with them, so they stay.
    rows = write_out(rows.select(*kept, F.monotonically_increasing_id().alias(row), F.size(split).cast("long").alias(n), found_words.alias(hits)), "words")
    met = matches(rows.select(row, hits), templates, row, hits)
    is_base = F.col("template") < len(base)
    place = lambda f: f(F.when(is_base, f_of[f]("places")))
    f_of = {F.min: F.array_min, F.max: F.array_max}
    block = F.struct("label", "start", "n_words", "score")
    met = met.groupBy(F.col("row").alias(of)).agg(
        F.sum(F.when(is_base, F.size("places")).otherwise(F.lit(0))).alias("n_base"), place(F.min).alias("first_word"), place(F.max).alias("last_word"),
        F.sort_array(F.collect_set(F.when(is_base, F.col("label")))).alias("base_labels"), F.sort_array(F.collect_set("label")).alias("labels"),
        F.max("score").alias("score"), F.sort_array(F.collect_set(block)).alias("found"),
    )
    met = met.select(of, *[F.col(c).alias(fresh(f"l_{c}", docs)) for c in met.columns[1:]])
    names = dict(zip(("n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"), met.columns[1:], strict=True))
    none = F.array().cast("array<string>")
    blank = {"n_base": F.lit(0), "base_labels": none, "labels": none, "score": F.lit(0.0), "found": F.array().cast(met.schema[names["found"]].dataType)}
    fields = [F.coalesce(F.col(c), blank[k]).alias(k) if k in blank else F.col(c).alias(k) for k, c in names.items()]
    return rows.join(met, F.col(row) == F.col(of), "left").select(*kept, F.struct(F.col(n).alias("n_words"), *fields).alias(out))
