"""Chat formatting, relational: Spark expressions only.

The template: `<|turn|>role<|text|>text<|end|>` for each run of turns with one role, and `<|next|>`
between the texts of such a run. Control strings inside roles and texts - this template's and those of
two common others - get a backslash after their first character, and one more if they have some, so
that no text can open or close a turn and every text can be had back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: First character and rest of the control strings that texts may not hold as they are.
CONTROL = r"(\||/?s>|/?INST\])"

#: Characters in a piece of a formatted text, and runs whose lengths are summed at once, see under_loss().
PIECE = 1024
RUNS = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def _split(text: Column, mark: str) -> Column:
    return F.split(text, rf"\Q{mark}\E", -1)


def formatted(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and segments: the loss mask as run lengths, (n_chars, loss) in order.

    Takes (conv_id, turn, role, text). Turns go by `turn`, nulls first; ties by role, then text; repeated
    rows stay. Null role and null text are empty. Null conv_id: one conversation. Other columns are left
    out, whatever their names. Empty table: empty result. Very long texts stay whole. One conversation's
    turns meet in one task, as they do in its one string.
    """
    own = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("t"))

    def head(x: Column, i: Column) -> Column:
        """What stands before turn i's text: a mark between texts of one role, or the end of a turn and a new one."""
        same = (i > 0) & (x["role"] == F.get(F.col("t"), i - 1)["role"])
        new = F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT))
        return F.when(same, F.lit(NEXT)).otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), new))

    rows = rows.withColumn("p", F.transform("t", lambda x, i: F.struct(head(x, i).alias("head"), escape(x["text"]).alias("text"), (x["role"] == loss_role).alias("loss"))))
    text = F.concat(F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["text"])), ""), F.lit(END))
    run = lambda n, loss: F.struct(n.cast("long").alias("n_chars"), loss.alias("loss"))
    runs = F.flatten(F.transform("p", lambda x: F.array(run(F.length(x["head"]), F.lit(False)), run(F.length(x["text"]), x["loss"]))))
    return rows.select("conv_id", text.alias("formatted"), F.concat(runs, F.array(run(F.lit(len(END)), F.lit(False)))).alias("segments"))


def parsed(text: Column) -> Column:
    """The turns of a formatted conversation, (role, text) in order, as they went in."""

    def block(b: Column) -> Column:
        role = unescape(F.get(_split(b, TEXT), F.lit(0)))
        said = F.get(_split(b, TEXT), F.lit(1))
        return F.transform(_split(F.substring_index(said, END, 1), NEXT), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.filter(_split(text, TURN), lambda b: b != ""), block))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body's own lambdas read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(lengths: Column) -> Column:
    """Where each run begins, from 0. Sums of blocks come first: an array that grows by appending is copied each time, so it is kept short."""
    rise = lambda x, start: F.aggregate(x, F.array(start), lambda held, n: F.array_append(held, F.element_at(held, -1) + n))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / RUNS).cast("int")), lambda i: F.slice(lengths, i * RUNS + 1, RUNS))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda held, n: held + n))
    before = rise(sums, F.lit(0).cast("long"))
    return _once(before, lambda before: F.flatten(F.transform(blocks, lambda x, i: F.slice(rise(x, F.get(before, i)), F.lit(1), F.size(x)))))


def under_loss(formatted_text: Column, segments: Column) -> Column:
    """The texts under the loss mask, in order: formatted_text cut by the mask's run lengths, escapes undone.

    A place in a string is found by counting from its start, so the text is first laid in pieces of PIECE
    characters, and a run is cut from its own pieces: the work grows with the text, not with its turns times it.
    """
    pieces = F.regexp_extract_all(formatted_text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    starts = _once(F.transform(segments, lambda run: run["n_chars"]), _starts)
    runs = _once(starts, lambda starts: F.filter(F.transform(segments, lambda run, i: F.struct(run["loss"].alias("loss"), run["n_chars"].alias("n"), F.get(starts, i).alias("at"))), lambda run: run["loss"]))

    def cut(pieces: Column, run: Column) -> Column:
        first, end = F.floor(run["at"] / PIECE).cast("int"), F.ceil((run["at"] + run["n"]) / PIECE).cast("int")
        own = F.array_join(F.slice(pieces, first + 1, F.greatest(F.lit(0), end - first)), "")
        return unescape(F.substring(own, F.pmod(run["at"], F.lit(PIECE)).cast("int") + 1, run["n"].cast("int")))

    return _once(pieces, lambda pieces: F.transform(runs, lambda run: cut(pieces, run)))


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back of formatted(): turns by parsing the text, the text under the loss by the mask. See op6's contract.

    One row for each conversation, a null conv_id's included. Empty and very long texts are read back
    whole. Empty table: empty result.
    """
    rows = conversations.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parsed(F.col("formatted")).alias("t"), F.array_join(under_loss(F.col("formatted"), F.col("segments")), "").alias("loss"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
