"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted by turn, runs of turns by one role are merged, and
everything is concatenated to one string:

    <s>[ROLE]user[/ROLE]first text[NEXT]second text</s><s>[ROLE]assistant[/ROLE]answer</s>

``<s>``, ``</s>``, ``[ROLE]``, ``[/ROLE]``, ``[NEXT]`` are the template's control strings; ``[INST]`` and ``[/INST]``
are reserved too, as other templates use them.  Inside texts and roles a control string gets a ``~`` after its first
character (one more if it has some already), so that none is left there and unescaping restores every text exactly.

Places in the output are running sums over a conversation's rows, taken before the rows are collected, so all work but the sorting
grows in proportion to the texts.

Defined results: null text and null role count as empty; a null turn sorts first; equal turns are ordered by role and
text; repeated rows are repeated turns; a null conv_id is a conversation like any other; an empty table gives no conversation.  Other columns,
whatever their names, are ignored.  The rows of one conversation make one output row, so a conversation and its texts, however long,
have to fit in memory, whatever the number of conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, ROLE, ROLE_END, NEXT = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[NEXT]"
_CONTROL = r"(/?(?:s>|INST\]|ROLE\]|NEXT\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(~*){_CONTROL}", "$1$2~$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(~*)~{_CONTROL}", "$1$2$3")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conv_id: ``conv_id, formatted string, loss_spans array<struct<start int, length int>>``.

    A loss span gives the first code point (from 0) and the number of code points of one text of ``loss_role``.
    """
    plain = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select("conv_id", "turn", plain("role"), plain("text"))
    head = lambda role: F.concat(F.lit(OPEN + ROLE), role, F.lit(ROLE_END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")  # as they are said, not as they are escaped
    before, length = F.lag("role").over(order), F.char_length(escape(F.col("text")))
    # what stands between the text before and this one
    gap = F.when(before == F.col("role"), len(NEXT)).otherwise(
        F.char_length(head(escape(F.col("role")))) + F.when(before.isNotNull(), len(CLOSE)).otherwise(0)
    )
    placed = rows.select("*", length.alias("length"), gap.alias("gap"))
    end = F.sum(F.col("gap") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.select("conv_id", "role", "text", "length", (end - F.col("length")).cast("int").alias("start"))
    turn = F.struct("start", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), "length")
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("ts"))
    # first positions (from 1) of the runs of one role, then the runs themselves
    starts = F.filter(
        F.sequence(F.lit(1), F.size("ts")),
        lambda i: (i == 1) | (F.element_at("ts", i)["role"] != F.element_at("ts", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    # as a generator's output the arrays are made once, not for each run that looks at them
    made = F.struct(starts.alias("starts"), F.col("ts")["text"].alias("texts"))
    runs = grouped.select("conv_id", "ts", F.explode(F.array(made)).alias("m")).select("conv_id", "ts", "m.starts", "m.texts")
    run = lambda s, k: F.concat(
        head(F.element_at("ts", s)["role"]),
        F.array_join(F.slice("texts", s, F.coalesce(F.get("starts", k + 1), F.size("ts") + 1) - s), NEXT),
        F.lit(CLOSE),
    )
    spoken = F.filter("ts", lambda t: t["role"] == F.lit(loss_role))
    return runs.select(
        "conv_id",
        F.array_join(F.transform("starts", run), "").alias("formatted"),
        F.transform(spoken, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns read back from a formatted string: array<struct<role, text>>, one for each input row."""
    parts = F.split(formatted, rf"{OPEN}\[ROLE\]")
    body = lambda p: F.substring_index(p, ROLE_END, -1)
    return F.flatten(
        F.transform(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda p: F.transform(
                F.split(F.regexp_replace(body(p), rf"{CLOSE}\z", ""), r"\[NEXT\]"),
                lambda x: F.struct(
                    unescape(F.substring_index(p, ROLE_END, 1)).alias("role"), unescape(x).alias("text")
                ),
            ),
        )
    )


#: Code points of the parts from which spans are read, as finding a place in a string takes as long as all before it.
PART = 4096


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    last = F.floor(F.char_length(formatted) / PART).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(formatted, i * PART + 1, F.lit(PART)))

    def read(parts: Column) -> Column:
        def span(s: Column) -> Column:
            first = F.floor(s["start"] / PART).cast("int")
            many = F.floor((s["start"] + s["length"]) / PART).cast("int") - first + 1
            return F.substring(F.array_join(F.slice(parts, first + 1, many), ""), s["start"] - first * PART + 1, s["length"])

        return F.array_join(F.transform(spans, lambda s: unescape(span(s))), "")

    return F.element_at(F.transform(F.array(parts), read), 1)
