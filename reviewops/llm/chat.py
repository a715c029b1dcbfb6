"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A log holds one event per row: conv_id, seq, msg, kind, role, text.  ``msg``
numbers the messages of a conversation.  Kinds:

* ``delta``       appends text to the message (the first one sets the role),
* ``edit``        replaces what the message holds,
* ``regenerate``  discards what the message holds; later deltas build it anew.

``fold_log`` partitions the log by conversation and message, finds each
message's last edit or regeneration, and concatenates what stands from there
on in order of seq.  ``render`` writes the messages as one ChatML-like text
with the spans of the assistant's words as loss mask; ``read_back`` turns a
rendered text into turns again.

Events of equal seq are ordered by kind and text, so repeated rows give a
defined text.  A null text is empty, a null role is the empty role, a null
conv_id is a conversation of its own.  A rendered conversation is one value,
so a conversation is limited by the 2 GB of a Spark string, not by a row cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewops.llm.common import text_of

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates, with any run of backslashes after the opening sign.
CONTROL = r"([<\[])(\\*)((?:\|\w+\||/?s|<?/?SYS>)>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)((?:\|\w+\||/?s|<?/?SYS>)>|/?INST\])"


def escape(text: Column) -> Column:
    """Put one more backslash behind the opening sign of every control string."""
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """Roles end at the line end, so their own line ends and backslashes are escaped too."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def replay_log(turns: DataFrame, chunk: int = 256) -> DataFrame:
    """The event log that a chat server would have written for stored turns (conv_id, turn, role, text).

    Texts stream in deltas of ``chunk`` code points.  An assistant's text is
    streamed after a first attempt that was regenerated; a user's text is
    typed, then edited to the stored one.  Turns are ordered by turn, role and
    text (nulls first), so repeated turns keep a defined place.
    """
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = (turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text_of("text").alias("text"))
            .withColumn("msg", F.row_number().over(in_order).cast("long")))
    n = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    deltas = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                         lambda i: event("delta", F.substring(F.col("text"), i * chunk + 1, F.lit(chunk))))
    draft = F.substring(F.col("text"), F.lit(1), F.lit(chunk // 4))
    events = (F.when(F.col("role") == "assistant",
                     F.concat(F.array(event("delta", draft), event("regenerate", F.lit(""))), deltas))
              .when(F.col("role") == "user", F.array(event("delta", draft), event("edit", F.col("text"))))
              .otherwise(deltas))
    return (rows.select("conv_id", "msg", "role", F.posexplode(events).alias("pos", "e"))
            .select("conv_id", (F.col("msg") * F.lit(1 << 32) + F.col("pos")).alias("seq"), "msg",
                    F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text")))


def fold_log(log: DataFrame) -> DataFrame:
    """Final messages: conv_id, msg, role, text.

    One shuffle by conversation and message serves the window and the
    aggregate, so a conversation with very many events is spread by message.
    """
    rows = log.select("conv_id", "msg", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), text_of("text").alias("text"))
    here = Window.partitionBy("conv_id", "msg")
    event = F.struct("seq", "kind", "text")
    last = F.max(F.when(F.col("kind") != "delta", F.struct("seq", "kind", "text"))).over(here)
    role = F.min(F.struct("seq", "kind", "role")).over(here)["role"]
    live = (rows.withColumn("_last", last).withColumn("_role", role)
            .withColumn("_live", F.col("_last").isNull() | (event >= F.col("_last"))))
    parts = F.array_sort(F.collect_list(F.when(F.col("_live"), event)))
    return (live.groupBy("conv_id", "msg")
            .agg(F.first("_role").alias("role"),
                 F.array_join(F.transform(parts, lambda e: e["text"]), "").alias("text")))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of start, length in code points)."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    pieces = messages.withColumn("_body", escape(F.col("text"))).withColumn("_head", head).select(
        "conv_id", "msg", "role", F.concat("_head", "_body", F.lit(END)).alias("piece"),
        F.length("_head").alias("head"), F.length("_body").alias("body"))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int"))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.col("head")).alias("start"), F.col("body").alias("length")))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg", "piece"))), lambda p: p["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) read from a rendered text."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda t: t != "")

    def turn(t):
        at = F.instr(t, "\n")
        body = F.substring(t, at + 1, F.length(t) - at - len(END))
        return F.struct(unescape_role(F.substring(t, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss_mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digests(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the rendered text."""
    told = F.array_join(F.transform(F.col("_turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (rendered.withColumn("_turns", read_back(F.col("formatted")))
            .withColumn("_loss", loss_text(F.col("formatted"), F.col("loss_mask")))
            .select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                    F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))
