"""Chat formatting: event-sourced reconstruction of conversations, then rendering.

A log of events (streamed deltas, edits, regenerations) is partitioned by message,
ordered by sequence and folded into final messages; the messages of a conversation are
then rendered in one template. DataFrame functions only.

Events have conv_id, turn, seq, kind, role, text. Kinds:
  message     begins a message of this turn with its text
  delta       appends its text
  edit        replaces all text so far
  regenerate  drops all text so far; deltas that follow build it again
Any other kind, or null, counts as message. A message's role is that of its first event.

Template of a turn: ``<s>`` tag text ``</s>``. Tags: ``[SYS]`` system, ``[INST]`` user,
``[/INST]`` assistant, ``[ROLE]name[/ROLE]`` any other role. Within texts and names a
backslash is doubled and a control string gets a backslash after its first character, so
no control string is left inside a text and reading back is exact.

Edge cases: null text and null role are empty strings; null turn or seq sorts first; rows
that tie on turn and seq sort by kind, role, text and all count; a null conv_id is a
conversation of its own; very long texts are rendered whole, a conversation being one row; an
empty log gives no conversations; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAGS = {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"}
OPEN, CLOSE = "<s>", "</s>"
_CONTROL = r"([<\[])(/?(?:s>|INST\]|SYS\]|ROLE\]))"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_from_rows(rows: DataFrame) -> DataFrame:
    """Each row of finished messages (conv_id, turn, role, text) as one message event."""
    return rows.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def streamed_events(rows: DataFrame) -> DataFrame:
    """The log that writing these messages in pieces leaves. An assistant's text is begun, dropped and
    streamed again in two deltas; any other's is sent in part, gets a delta and is edited to the
    final one. Rows of one turn follow each other in the order of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    at = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    r = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (at * 8).cast("long").alias("at"), F.floor(F.length(text) / 2).cast("int").alias("half"))
    first, rest = F.substr("text", F.lit(1), F.col("half")), F.substr("text", F.col("half") + 1)
    event = lambda i, kind, what: F.struct((F.col("at") + i).alias("seq"), F.lit(kind).alias("kind"), what.alias("text"))
    again = F.array(event(0, "message", rest), event(1, "delta", F.lit("draft")), event(2, "regenerate", F.lit("")), event(3, "delta", first), event(4, "delta", rest))
    edited = F.array(event(0, "message", first), event(1, "delta", F.lit(" and so on")), event(2, "edit", F.col("text")))
    e = r.select("conv_id", "turn", "role", F.explode(F.when(F.col("role") == "assistant", again).otherwise(edited)).alias("e"))
    return e.select("conv_id", "turn", "e.seq", "e.kind", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, message_no, role, text.

    Work is split by (conv_id, turn), so a conversation that holds much of the log spreads
    over many tasks. Only what follows a message's last reset is gathered.
    """
    known = F.col("kind").isin("delta", "edit", "regenerate")
    e = events.select(
        "conv_id", "turn", "seq", F.when(known, F.col("kind")).otherwise("message").alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    e = e.select(
        "*",
        F.count_if(F.col("kind") == "message").over(order).alias("message_no"),
        F.count_if(F.col("kind") != "delta").over(order).alias("reset_no"),
        F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text")).alias("at"),
    )
    last = Window.partitionBy("conv_id", "turn", "message_no")
    e = e.select("*", F.max("reset_no").over(last).alias("last_reset"), F.min_by("role", "at").over(last).alias("first_role"))
    live = (F.col("reset_no") == F.col("last_reset")) & (F.col("kind") != "regenerate")
    parts = F.collect_list(F.when(live, F.struct("at", "text")))
    return e.groupBy("conv_id", "turn", "message_no").agg(
        F.first("first_role").alias("role"),
        F.array_join(F.transform(F.sort_array(parts), lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, loss_turns (one boolean per
    turn: under the loss mask), loss_spans (code points in formatted, end exclusive)."""
    role, tag = F.col("role"), F.lit(None).cast("string")
    for name, mark in TAGS.items():
        tag = F.when(role == name, F.lit(mark)).otherwise(tag)
    tag = F.coalesce(tag, F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]")))
    m = messages.select("conv_id", "turn", "message_no", (role == "assistant").alias("loss"), F.concat(F.lit(OPEN), tag).alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    order = Window.partitionBy("conv_id").orderBy("turn", "message_no")
    m = m.select("*", F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"), F.row_number().over(order).alias("n"))
    end = F.col("stop") - len(CLOSE)
    piece = F.struct("n", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "loss", (end - F.length("body")).alias("start"), end.alias("end"))
    got = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    return got.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.transform("turns", lambda t: t["loss"]).alias("loss_turns"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"),
    )


def format_chats(events: DataFrame) -> DataFrame:
    """Fold an event log and render its conversations."""
    return render(fold(events))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text)."""
    def turn(piece: Column) -> Column:
        role, text = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, mark in TAGS.items():
            head = OPEN + mark
            role = F.when(F.startswith(piece, F.lit(head)), F.lit(name)).otherwise(role)
            text = F.when(F.startswith(piece, F.lit(head)), F.substr(piece, F.lit(len(head) + 1))).otherwise(text)
        other = r"(?s)^<s>\[ROLE\](.*?)\[/ROLE\](.*)$"
        role = F.coalesce(role, unescape(F.regexp_extract(piece, other, 1)))
        text = F.coalesce(text, F.regexp_extract(piece, other, 2))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.filter(F.split(formatted, CLOSE), lambda p: p != ""), turn)
