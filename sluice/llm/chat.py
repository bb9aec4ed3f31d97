r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is
under the loss mask. A conversation that doesn't end with an assistant turn gives one more example, its
whole text with an empty mask, so that no turn is lost.

A turn is written `[INST]role[/INST]text</s>`. Control strings inside roles and texts are escaped by a
backslash behind their first character (`[\INST]`), and one that has backslashes there already gets one
more, so that taking one away restores every text exactly.

Edge cases: a null text or role is empty; turns are ordered by turn number (null first), then role and
text, so repeated rows and ties give the same order in every run; a null conversation id is a
conversation of its own; an empty table gives no examples; other columns of the input are ignored.
A conversation is a unit as a document is: it must fit in a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
# The control strings of common chat templates, without their first character.
_REST = r"s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|INST\]|/INST\]"
_ESCAPE = rf"([<\[])(\\*)({_REST})"
_UNESCAPE = rf"([<\[])\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _mark(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def prefix_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, is_whole, formatted, loss_start, loss_end): one row per assistant turn.

    loss_start and loss_end are code points into formatted, the end exclusive.
    """
    e = lambda c: escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    raw = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # Turns are ordered by what they say, not by how that is written: the texts come before their escaped forms.
    rows = turns.select("conv_id", F.struct(F.col("turn"), raw("role").alias("name"), raw("text").alias("said"), e("role").alias("role"), e("text").alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    size = F.size("turns")
    targets = F.filter(F.sequence(F.lit(1), size), lambda i: (F.element_at("turns", i)["name"] == "assistant") | (i == size))
    each = whole.select("conv_id", "turns", F.posexplode(targets).alias("example", "n_turns"))
    target = F.element_at("turns", F.col("n_turns"))
    each = each.select(
        "conv_id",
        "example",
        F.col("n_turns").cast("long").alias("n_turns"),
        (F.col("n_turns") == size).alias("is_whole"),
        F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("n_turns")), _mark), "").alias("formatted"),
        F.when(target["name"] == "assistant", F.length(target["text"])).otherwise(F.lit(0)).alias("loss_chars"),
    )
    end = F.length("formatted") - len(END)
    return each.select("conv_id", "example", "n_turns", "is_whole", "formatted", (end - F.col("loss_chars")).alias("loss_start"), end.alias("loss_end"))


def parse_turns(formatted: Column) -> Column:
    """The turns, as array<struct<role, text>>, that a formatted text holds, unescaped."""
    parts = F.filter(F.split(formatted, END), lambda x: x != "")

    def one(x: Column) -> Column:
        fields = F.split(F.substring(x, len(OPEN) + 1, 2147483647), r"\[/INST\]", 2)
        return F.struct(unescape(F.get(fields, F.lit(0))).alias("role"), unescape(F.get(fields, F.lit(1))).alias("text"))

    return F.transform(parts, one)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: turns from the one that is the whole, the masked texts from all."""
    loss = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    told = F.transform(parse_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    each = examples.select(
        "conv_id",
        "n_turns",
        F.length("formatted").cast("long").alias("chars"),
        F.struct("example", loss.alias("loss")).alias("loss"),
        F.when(F.col("is_whole"), F.sha2(F.array_join(told, ""), 256)).alias("sha"),
    )
    by = each.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return by.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
