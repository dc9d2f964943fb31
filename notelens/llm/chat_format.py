"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of the same role merge
into one run; runs are concatenated. The template of a run is::

    ### <role>: <text></turn>\\n<text></turn>\\n

Inside roles and texts a backslash is doubled, ``#`` before ``##`` becomes ``\\h``, and ``<`` before
``turn>`` or ``/turn>`` becomes ``\\l``; in roles also ``:`` becomes ``\\c``. So neither ``### `` nor
``</turn>`` can occur in an escaped text, parsing is a plain split, and each turn comes back as it was.

Defined cases: a null role or text is the empty string; a null turn number sorts first; turns with one
number are ordered by role, then text; repeated rows are repeated turns; a null conv_id is a
conversation of its own; other columns are ignored. A conversation becomes one string, so the size of
one conversation is bounded by what a string can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(F.regexp_replace(out, "#(?=##)", "\\\\h"), "<(?=/?turn>)", "\\\\l")
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    def plain(part: Column) -> Column:
        for code, char in (("\\h", "#"), ("\\l", "<"), ("\\c", ":")):
            part = F.replace(part, F.lit(code), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, runs (role, texts), formatted, loss_spans (start from 0 and length, in code points)."""
    named = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(named)).alias("turns"))
    n = F.size("turns")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    chats = chats.withColumn("starts", starts)

    def run(start: Column, k: Column) -> Column:
        after = F.coalesce(F.get("starts", k + 1), n + 1)
        texts = F.transform(F.slice("turns", start, after - start), lambda t: t["text"])
        return F.struct(F.element_at("turns", start)["role"].alias("role"), texts.alias("texts"))

    chats = chats.select("conv_id", F.transform("starts", run).alias("runs"))

    def pieces(r: Column) -> Column:
        piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
        head = F.array(piece(F.concat(F.lit(HEAD), escape(r["role"], role=True), F.lit(": ")), F.lit(False)))
        body = F.flatten(F.transform(r["texts"], lambda t: F.array(piece(escape(t), r["role"] == loss_role), piece(F.lit(END), F.lit(False)))))
        return F.concat(head, body)

    chats = chats.withColumn("pieces", F.flatten(F.transform("runs", pieces)))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,len:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        size = F.length(p["s"]).cast("long")
        span = F.struct(acc["at"].alias("start"), size.alias("len"))
        return F.struct((acc["at"] + size).alias("at"), F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return chats.select(
        "conv_id", "runs", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        F.aggregate("pieces", zero, step)["spans"].alias("loss_spans"),
    )


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Reads formatted back: adds turns (role, text; one per original turn) and loss_text."""

    def turns_of(part: Column) -> Column:
        head = F.substring_index(part, ": ", 1)
        texts = F.split(F.substr(part, F.length(head) + 3), END, -1)
        texts = F.slice(texts, F.lit(1), F.size(texts) - 1)
        return F.transform(texts, lambda t: F.struct(unescape(head).alias("role"), unescape(t).alias("text")))

    parts = F.split("formatted", HEAD, -1)
    turns = F.flatten(F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), turns_of))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["len"].cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(loss, "")})
