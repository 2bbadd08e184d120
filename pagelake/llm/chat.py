"""Chat formatting from an event log, in DataFrame operations only.

An event belongs to a message of a conversation: ``start`` opens the message and names its role, ``delta`` appends text,
``edit`` replaces the text, ``regenerate`` empties it. An edit or a regeneration also drops the messages that followed
at that time. Events are folded per message, so a conversation with a third of all events is spread over its messages;
which messages live follows from a running maximum over (conversation, block) with the blocks' maxima on top. Only the
rendered conversation is one value, as its text has to be.

Order is given by ``order`` columns (nulls first); rows that are equal in them are taken as one moment. Null text counts
as empty, a null role as an empty one, and a null conversation as a conversation of its own. An empty log gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Messages of a conversation between two entries of the running maximum.
BLOCK = 1024
#: Characters of one streamed delta in logs made from whole messages.
DELTA_CHARS = 400


def escape(text: Column) -> Column:
    """Control strings cannot stand in the result: a backslash more between ``<`` and ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\s"), "\n", r"\\n"))


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unescape(role), r"\\n", "\n"), r"\\s", r"\\")


def fold(events: DataFrame, order: list[str]) -> DataFrame:
    """conv_id, at, role, text of the live messages of ``events`` (conv_id, message, kind, role, text and ``order``)."""
    e = events.select("conv_id", "message", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*order).alias("at"))
    reset = F.max(F.when(F.col("kind").isin("start", "edit", "regenerate"), F.col("at")))
    m = e.groupBy("conv_id", "message").agg(
        F.min(F.when(F.col("kind") == "start", F.struct("at", "role"))).alias("first"), reset.alias("reset"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("at"))).alias("cut"),
        F.collect_list(F.when(F.col("kind") != "start", F.struct("at", "kind", "text"))).alias("parts"),
    ).where("first is not null")
    live = F.filter(F.array_sort("parts"), lambda p: (p["at"] >= F.col("reset")) & (p["kind"] != "regenerate"))
    m = m.select("conv_id", F.col("first.at").alias("at"), F.col("first.role").alias("role"), "cut", F.array_join(F.transform(live, lambda p: p["text"]), "").alias("text"))
    # A message goes when one that began earlier was cut after this one began.
    m = m.withColumn("block", F.floor(F.coalesce(F.col(f"at.{order[0]}"), F.lit(0)) / BLOCK))
    here = W.partitionBy("conv_id", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    m = m.withColumn("cut_here", F.max("cut").over(here))
    blocks = m.groupBy("conv_id", "block").agg(F.max("cut").alias("cut"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), F.max("cut").over(before).alias("cut_before")).where("cut_before is not null")
    m = m.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block")), "left")
    gone = F.coalesce(F.greatest("cut_here", "cut_before") > F.col("at"), F.lit(False))
    return m.where(~gone).select("conv_id", "at", "role", "text")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss: the mask lists the turns to learn from with the characters of the text inside the turn."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    t = messages.select("conv_id", "at", F.concat(head, body, F.lit(END + "\n")).alias("turn"), (F.col("role") == loss_role).alias("learn"), F.length(head).alias("skip"), F.length(body).alias("chars"))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "turn", "learn", "skip", "chars"))).alias("turns"))
    mask = F.filter(F.transform("turns", lambda x, i: F.struct(i.alias("turn"), x["learn"].alias("learn"), x["skip"].alias("start"), x["chars"].alias("chars"))), lambda x: x["learn"])
    return c.select(
        "conv_id", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"),
        F.transform(mask, lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["chars"].alias("chars"))).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """Turns of a rendered conversation as an array of the text between its control strings."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def turn_role(piece: Column) -> Column:
    return unescape_role(F.regexp_extract(piece, r"^<\|im_start\|>([^\n]*)\n", 1))


def turn_text(piece: Column) -> Column:
    return unescape(F.substring(piece, F.instr(piece, "\n") + 1, F.length(piece)))


def masked(piece: Column, span: Column) -> Column:
    return unescape(F.substring(piece, span["start"] + 1, span["chars"]))


def read_back(rendered: DataFrame) -> DataFrame:
    """Digest columns of each conversation, taken from the rendered text and its mask alone."""
    p = rendered.select("conv_id", "formatted", "loss", parse(F.col("formatted")).alias("pieces"))
    whole = F.array_join(F.transform("pieces", lambda x: F.concat(turn_role(x), F.lit("\n"), turn_text(x), F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss", lambda s: masked(F.element_at("pieces", s["turn"] + 1), s)), "")
    p = p.select("conv_id", F.size("pieces").cast("bigint").alias("n_turns"), whole.alias("turns"), learnt.alias("learnt"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    return p.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def events_of(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """A log that leads to the given turns: streamed deltas, drafts of users that are edited, answers that are made anew.

    Rows of one conversation and turn are ordered by role and text; equal rows stay apart.
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumn("dup", F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text")).cast("bigint"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / delta_chars).cast("int")), lambda i: F.substring("text", i * delta_chars + 1, F.lit(delta_chars)))
    none = F.lit(None).cast("string")
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    half = F.substring("text", 1, F.floor(F.length("text") / 2).cast("int"))
    streamed = F.transform(pieces, lambda x: event("delta", x))
    steps = F.when(F.col("role") == "user", F.array(event("start", none), event("delta", F.reverse(half)), event("edit", F.col("text")))).when(
        F.col("role") == "assistant", F.concat(F.array(event("start", none), event("delta", half), event("regenerate", none)), streamed)
    ).otherwise(F.concat(F.array(event("start", none)), streamed))
    return c.select("conv_id", F.struct("turn", "dup").alias("message"), "role", "turn", "dup", F.posexplode(steps).alias("step", "e")).select(
        "conv_id", "message", "role", "turn", "dup", "step", "e.kind", "e.text")
