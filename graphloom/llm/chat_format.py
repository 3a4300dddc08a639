"""Chat formatting with prefix-target expansion (DataFrame functions only).

Every turn becomes one marked piece of its conversation's text. Every assistant turn becomes an example, a row of its own:
its context is all text before its reply, and only the reply, its target, is trainable. All contexts of a conversation are
prefixes of the one formatted text, so an example holds the end of its context in that text; the contexts themselves,
whose sum grows with the square of the turns, are cut only where they are asked for (example_texts()).

Control strings inside roles and texts are escaped, reversibly: each backslash is doubled, then "<|" becomes "<\\|".
A single backslash after "<" cannot come from doubling, so the inverse is exact. In roles, which end at a line break, a
line break becomes "<\\e|" the same way.

Defined cases: null roles and texts count as empty; turns are ordered by turn (null first), then role and text, and
repeated turns are all kept; a null conv_id is a conversation; a conversation without assistant turns has no examples;
other columns play no part; an empty table gives an empty result. A conversation is one row: its digest needs its text
in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\e|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\e|"), F.lit("\n")))


def format_turns(turns: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, seq, piece, and in the conversation's text (code points from 0) begin, target_start, target_end; trained."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    t = t.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    t = t.withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumns({"seq": F.row_number().over(order), "begin": F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece")})
    start = F.col("begin") + F.length("head")
    return t.select("conv_id", "seq", "piece", "begin", start.alias("target_start"), (start + F.length("body")).alias("target_end"), (F.col("role") == TRAINED_ROLE).alias("trained"))


def expanded(pieces: DataFrame) -> DataFrame:
    """format_turns() with one row for each assistant turn: conv_id, example (from 1), context_end, target_start, target_end
    (code points of the conversation's text) and target, the trainable text as it stands there."""
    order = Window.partitionBy("conv_id").orderBy("seq")
    target = F.substr("piece", (F.col("target_start") - F.col("begin") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int"))
    return pieces.where("trained").select("conv_id", F.row_number().over(order).alias("example"), F.col("target_start").alias("context_end"), "target_start", "target_end", target.alias("target"))


def format_conversations(pieces: DataFrame) -> DataFrame:
    """format_turns() with one row for each conversation: conv_id, formatted."""
    made = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("pieces"))
    return made.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"))


def example_texts(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """A row for each example: conv_id, example, context and target, both as they stand in the formatted text."""
    both = examples.withColumnRenamed("conv_id", "of").join(formatted, F.col("of").eqNullSafe(F.col("conv_id")))
    cut = lambda a, b: F.substr("formatted", (a + 1).cast("int"), (b - a).cast("int"))
    return both.select("conv_id", "example", cut(F.lit(0), F.col("context_end")).alias("context"), cut(F.col("target_start"), F.col("target_end")).alias("target"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that the formatted text holds."""
    pieces = F.filter(F.split(formatted, r"\Q" + END + r"\E", -1), lambda p: p != "")

    def one(p: Column) -> Column:
        at = F.instr(p, "\n")
        return F.struct(unescape_role(F.substr(p, F.lit(len(START) + 1), at - len(START) - 1)).alias("role"), unescape(F.substr(p, at + 1)).alias("text"))

    return F.transform(pieces, one)


def digests(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """What can be read back for each conversation: its turns from the formatted text, the trainable texts from the examples."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    told = examples.groupBy(F.col("conv_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("example", "target"))).alias("x"))
    told = told.select("of", F.array_join(F.transform("x", lambda e: unescape(e["target"])), "").alias("loss"), F.size("x").cast("long").alias("n"))
    loss = F.coalesce("loss", F.lit(""))
    found = read.join(told, F.col("of").eqNullSafe(F.col("conv_id")), "left")
    return found.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", F.coalesce("n", F.lit(0)).alias("n_examples"))
