"""Chat formatting with a reversible template, by Spark expressions alone.

Template: every run of adjacent turns of one role is one block

    <turn:ROLE>TEXT<and>TEXT ...</turn>\\n

Inside roles and texts ``\\`` is written ``\\s``, ``<`` is written ``\\l`` and ``>`` is written
``\\g``. An escaped text holds no angle bracket, so only the template's own marks have one, and
each backslash starts an escape of two characters: the way back is exact for any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BETWEEN, CLOSE = "<turn:", "<and>", "</turn>\n"
TURN = "struct<turn:bigint,role:string,text:string>"


def escape(text: Column) -> Column:
    for plain, marked in (("\\", "\\s"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column) -> Column:
    for marked, plain in (("\\l", "<"), ("\\g", ">"), ("\\s", "\\")):
        text = F.replace(text, F.lit(marked), F.lit(plain))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and ``formatted``.

    Turns are sorted by (turn, role, text); a null turn sorts first, null roles and texts are
    empty, repeated rows stay repeated, and rows without a conv_id are one conversation. Other
    columns are ignored. A conversation is one output row, so its turns meet in one task by nature.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    grouped = turns.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id")
    grouped = grouped.agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # each turn beside the role before it: a turn of the same role is merged into the block that is open
    roles = F.transform("turns", lambda t: t["role"])
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(roles, F.lit(1), F.size(roles) - 1))
    beside = grouped.select("conv_id", "turns", before.alias("before"))

    def piece(t: Column, last: Column) -> Column:
        opened = F.concat(F.when(last.isNull(), F.lit("")).otherwise(F.lit(CLOSE)), F.lit(OPEN), escape(t["role"]), F.lit(">"))
        return F.concat(F.when(last.eqNullSafe(t["role"]), F.lit(BETWEEN)).otherwise(opened), escape(t["text"]))

    # joined once, so the work is in proportion to the text however many turns there are
    whole = F.concat(F.array_join(F.zip_with("turns", "before", piece), ""), F.lit(CLOSE))
    return beside.select("conv_id", whole.alias("formatted"))


def parse_formatted(formatted: DataFrame) -> DataFrame:
    """The turns back from the text: conv_id, formatted and ``turns``, an array of (role, text)."""
    blocks = F.filter(F.split("formatted", "</turn>\n"), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        head = F.instr(block, ">")
        role = unescape(F.substring(block, F.lit(len(OPEN) + 1), head - F.lit(len(OPEN) + 1)))
        body = F.substring(block, head + F.lit(1), F.length(block))
        return F.transform(
            F.split(body, BETWEEN), lambda x: F.struct(role.alias("role"), unescape(x).alias("text"))
        )

    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"))


def loss_spans(formatted: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, turns, and ``loss``: the texts under the loss mask, read back."""
    back = parse_formatted(formatted)
    trained = F.filter("turns", lambda t: t["role"] == F.lit(trained_role))
    return back.select("*", F.transform(trained, lambda t: t["text"]).alias("loss"))


def digest(formatted: DataFrame) -> DataFrame:
    """Lengths and hashes of what the formatted text gives back."""
    nl = F.lit("\n")
    listed = F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl))
    loss = F.array_join("loss", "")
    return loss_spans(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
