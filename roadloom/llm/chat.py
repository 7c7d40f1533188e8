"""Chat formatting by prefix-target expansion, DataFrame functions only.

A conversation becomes one formatted string. explode_examples() makes an example of
every assistant turn: a row of its own with all turns before it as context, and only
its text trained on (the loss span). digest() reads roles, texts and loss spans back from
those rows. A row's text is cut from the conversation's string when the row is made, so
examples stream: they are never gathered, and what is grouped again for a conversation is
its loss texts and lengths alone. In all, examples have the square of a conversation's
length over two; store format_conversations() (a string and three numbers an example) where
that is too much.

A turn is written  [TURN role]\\n text </s>\\n  (without the blanks around text). In roles and texts the
characters \\ < [ ] get a backslash after them, so no marker can occur in them;
unescape() takes it away again.

Edge cases: null text, role: empty. Rows with the same turn number stand in the
order of role, then text; repeated rows stay. A null turn number comes first. A
null conv_id is a conversation like any other. Turns after the last assistant
turn (or all, where there is none) form a last example without a loss span's
text, so that no turn is lost. Texts of any length are whole. An empty table gives an
empty result. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "[TURN ", "]\n", "</s>\n"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[\]])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[\]])\\", "$1")


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, text, examples: array of (example, end_char, loss_start, loss_end), offsets in code points from 0."""
    turns = rows.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MID))
        body = escape(t["text"])
        return F.struct(
            F.concat(head, body, F.lit(CLOSE)).alias("s"),
            F.length(head).cast("long").alias("head"),
            F.length(body).cast("long").alias("body"),
            (t["role"] == TRAINED).alias("trained"),
        )

    convs = convs.select("conv_id", F.transform("turns", piece).alias("pieces"))
    convs = convs.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("text"),
        F.transform("pieces", lambda p: F.struct(p["head"].alias("head"), p["body"].alias("body"), p["trained"].alias("trained"))).alias("spans"),
    )
    empty = "struct<at:bigint,n:int,out:array<struct<example:int,end_char:bigint,loss_start:bigint,loss_end:bigint>>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("n"), F.array().cast("array<struct<example:int,end_char:bigint,loss_start:bigint,loss_end:bigint>>").alias("out")).cast(empty)

    def step(acc: Column, p: Column) -> Column:
        loss = acc["at"] + p["head"]
        end = loss + p["body"] + len(CLOSE)
        example = F.struct(acc["n"].alias("example"), end.alias("end_char"), loss.alias("loss_start"), (loss + p["body"]).alias("loss_end"))
        return F.struct(
            end.alias("at"),
            (acc["n"] + p["trained"].cast("int")).alias("n"),
            F.when(p["trained"], F.concat(acc["out"], F.array(example))).otherwise(acc["out"]).alias("out"),
        ).cast(empty)

    done = F.aggregate("spans", start, step)
    convs = convs.withColumn("_d", done)
    end = F.col("_d")["at"]
    rest = F.struct(F.col("_d")["n"].alias("example"), end.alias("end_char"), end.alias("loss_start"), end.alias("loss_end"))
    last_trained = F.element_at(F.col("spans"), -1)["trained"]
    examples = F.when(last_trained, F.col("_d")["out"]).otherwise(F.concat(F.col("_d")["out"], F.array(rest)))
    return convs.select("conv_id", "text", examples.alias("examples"))


def explode_examples(formatted: DataFrame) -> DataFrame:
    """One row per example with its whole text: conv_id, example, n_examples, text, loss_start, loss_end (code points from 0)."""
    e = formatted.select("conv_id", "text", F.size("examples").alias("n_examples"), F.explode("examples").alias("e"))
    return e.select("conv_id", "e.example", "n_examples", F.substring("text", F.lit(1), F.col("e.end_char").cast("int")).alias("text"), "e.loss_start", "e.loss_end")


def read_turns(text: Column) -> Column:
    """The turns of a formatted string: array of (role, text), unescaped."""
    parts = F.split(text, r"</s>\n")
    whole = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
        cut = F.locate("]\n", body)  # a bracket inside a role is followed by a backslash
        return F.struct(
            unescape(F.substring(body, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(body, cut + len(MID), F.length(body))).alias("text"),
        )

    return F.transform(whole, turn)


def digest(examples: DataFrame) -> DataFrame:
    """What the exploded examples say when read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    All turns are read from the last example's text, a loss text from its own example.
    """
    is_last = F.col("example") == F.col("n_examples") - 1
    turns = read_turns(F.col("text"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = unescape(F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    read = examples.select(
        "conv_id",
        F.struct("example", loss.alias("loss")).alias("l"),
        F.length("text").cast("long").alias("chars"),
        F.when(is_last, F.size(turns)).cast("long").alias("n"),
        F.when(is_last, F.sha2(said, 256)).alias("sha"),
    )
    whole = read.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sort_array(F.collect_list("l")).alias("l"), F.sum("chars").alias("formatted_chars"))
    whole = whole.withColumn("loss", F.array_join(F.transform("l", lambda x: x["loss"]), ""))
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
