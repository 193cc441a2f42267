"""Chat formatting with a checked round trip (DataFrame operations only).

Template: a user turn is "[INST] text [/INST]", an assistant turn "text</s>",
any other turn "<<SYS>>role", a line feed, "text<</SYS>>" (the role URL-coded).
Turns follow each other without anything between. A text that the parser would
not give back is escaped: a backslash doubled, and one put behind the first
character of each control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grammar: one alternative a kind of turn, tried in this order at each place.
TURN = r"(?s)\[INST\] .*? \[/INST\]|<<SYS>>.*?<</SYS>>|.*?</s>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(\[|<)(/?INST\]|/?s>|</?SYS>>)", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, body: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), body, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(body, F.lit("</s>")))
        .otherwise(F.concat(F.lit("<<SYS>>"), F.url_encode(role), F.lit("\n"), body, F.lit("<</SYS>>")))
    )


def parse(formatted: Column) -> Column:
    """array of struct(role, text, body, skip, length): the turns read back.

    body is the text as it stands there, skip the characters of the turn before
    it, length those of the whole turn.
    """

    def one(turn: Column) -> Column:
        user = turn.startswith("[INST] ") & turn.endswith(" [/INST]")
        other = turn.startswith("<<SYS>>") & turn.endswith("<</SYS>>")
        head = F.when(user, F.lit(7)).when(other, F.instr(turn, "\n")).otherwise(F.lit(0))
        tail = F.when(user, F.lit(8)).when(other, F.lit(8)).otherwise(F.lit(4))
        body = F.substring(turn, head + 1, F.length(turn) - head - tail)
        role = F.when(user, F.lit("user")).when(other, F.url_decode(F.substring(turn, F.lit(8), head - 8))).otherwise(F.lit("assistant"))
        return F.struct(role.alias("role"), unescape(body).alias("text"), body.alias("body"), head.alias("skip"), F.length(turn).alias("length"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), one)


def _same(parsed: Column, source: Column) -> Column:
    return F.transform(parsed, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))) == source


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv, formatted, turns (what the parser reads back) and loss_spans.

    First every turn is rendered as it is and read back; one that comes back
    changed is escaped. The whole conversation is then read back, and if it
    isn't its source, rendered again with every turn escaped; if that fails,
    too, the query fails. loss_spans has start (from 0) and length of each
    assistant text in formatted, escapes included. A null text is empty, a null
    role too; rows of one turn number go by role, then text; a null
    conversation is one of its own. Other columns are ignored. A conversation
    is one string in the end, so its rows meet in one row.
    """
    source = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("row"),
    ).withColumn("raw", render(F.col("row.role"), F.col("row.text")))
    body = F.when(_same(parse(F.col("raw")), F.array(F.struct("row.role", "row.text"))), F.col("row.text")).otherwise(escape(F.col("row.text")))
    sheets = (
        source.select("conv", F.struct("row.turn", "row.role", "row.text", body.alias("body")).alias("row"))
        .groupBy("conv")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"))
        .select(
            "conv",
            F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
            F.array_join(F.transform("rows", lambda x: render(x["role"], x["body"])), "").alias("first"),
            F.array_join(F.transform("rows", lambda x: render(x["role"], escape(x["text"]))), "").alias("strict"),
        )
        .withColumn("formatted", F.when(_same(parse(F.col("first")), F.col("source")), F.col("first")).otherwise(F.col("strict")))
        .withColumn("turns", parse(F.col("formatted")))
        .withColumn("turns", F.when(_same(F.col("turns"), F.col("source")), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation did not come back from its format"))))
    )
    starts = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("int").alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["length"]).alias("at"),
            F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["skip"]).alias("start"), F.length(x["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return sheets.select(F.col("conv").alias(conv_col), "formatted", "turns", starts["spans"].alias("loss_spans"))
