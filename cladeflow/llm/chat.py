"""Operator 10, chat formatting: event-sourced reconstruction, with DataFrame functions only.

A log has one row an event (conv_id, seq, message, kind, role, text). Events of a message fold in the order of seq:
``message`` and ``edit`` set its text, ``regenerate`` sets it anew (usually to nothing), ``delta`` appends. Folding
groups by (conv_id, message), so a long conversation spreads; only its rendered turns come together at the end, since the
text of a conversation is one value.

A turn renders as ``### role: text</turn>`` and a line end. In roles and texts a backslash becomes ``\\b``, ``<`` ``\\l`` and ``#``
``\\h`` (in roles a colon ``\\c`` too): no control string can occur inside, and each backslash starts exactly one
escape, so unescaping is exact. The loss mask lists the stretches of the assistant's texts, by block (turn) and offset.

Rows: null text counts as empty, a null role as empty; a null kind as ``message``. Events that tie in seq fold in the order of kind, role
and text. A message of which only deltas are known starts empty; its role is the last one given. Events of a null conv_id form one conversation of that id.
Repeated rows of kind message fold to one. Finished turns are a log of one event a message: ``format_turns`` folds it with each row as a message of its own, those that
tie in turn or have none (they come last) included; ``messages_of_turns`` gives the same messages without a fold. In ``events_of_turns`` rows that repeat each other in turn, role and text fold. An empty log gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
EVENTS = ("conv_id", "seq", "message", "kind", "role", "text")


def escape(x: Column, role: bool = False) -> Column:
    for raw, to in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), *([(":", "\\c")] if role else [])):
        x = F.replace(x, F.lit(raw), F.lit(to))
    return x


def unescape(x: Column, role: bool = False) -> Column:
    for raw, to in (*([(":", "\\c")] if role else []), ("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        x = F.replace(x, F.lit(to), F.lit(raw))
    return x


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: one ``message`` event each, a message for each distinct turn, role and text; null turns come last."""
    message = F.struct(F.col("turn").isNull().alias("none"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.select("conv_id", F.col("turn").alias("seq"), message.alias("message"), F.lit("message").alias("kind"), "role", "text")


def format_turns(conversations: DataFrame) -> DataFrame:
    """A table of finished turns to training texts, as a log: each row is an event and a message of its own, so rows that repeat each other all stay. Its number in the
    table only tells it apart: messages are folded by it and rendered in the order of turns."""
    turn = F.struct(F.col("turn").isNull().alias("none"), "turn", F.monotonically_increasing_id().alias("row"))
    log = conversations.select("conv_id", F.col("turn").alias("seq"), turn.alias("message"), F.lit("message").alias("kind"), "role", "text")
    return render(fold_events(log).withColumn("message", F.struct("message.none", "message.turn")))


def messages_of_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): a message for each row of a table of finished turns; null turns come last."""
    message = F.struct(F.col("turn").isNull().alias("none"), "turn")
    return conversations.select("conv_id", message.alias("message"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages."""
    kind = F.coalesce("kind", F.lit("message"))
    event = F.struct("seq", kind.alias("kind"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"] == "delta", 0).otherwise(i + 1)))
    live = F.slice("log", F.greatest("last", F.lit(1)), F.size("log"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return log.withColumn("last", last).select("conv_id", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask), messages that tie in the order of their blocks: loss_mask has, for each assistant text, its block and the offset and length in it, in code points."""
    head = F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit(": "))
    turn = messages.select("conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    block = F.struct("message", F.concat("head", "body", F.lit(END)).alias("block"), (F.col("role") == "assistant").alias("loss"), F.length("head").alias("offset"), F.length("body").alias("length"))
    whole = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    mask = F.transform("blocks", lambda b, i: F.struct(b["loss"].alias("loss"), i.alias("block"), b["offset"].alias("offset"), b["length"].alias("length")))
    mask = F.transform(F.filter(mask, lambda m: m["loss"]), lambda m: F.struct(m["block"].alias("block"), m["offset"].alias("offset"), m["length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "").alias("formatted"), mask.alias("loss_mask"))


def format_chat(events: DataFrame) -> DataFrame:
    """Logs to training texts with their loss masks."""
    return render(fold_events(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted): turns (role, text) and the texts under the mask, from the formatted text alone."""
    blocks = F.split("formatted", END)
    named = formatted.withColumn("blocks", F.slice(blocks, 1, F.size(blocks) - 1))
    head = lambda b: F.substring_index(b, ": ", 1)
    turns = F.transform("blocks", lambda b: F.struct(unescape(F.substr(head(b), F.lit(5)), role=True).alias("role"), unescape(F.substr(b, F.length(head(b)) + 3)).alias("text")))
    loss = F.transform("loss_mask", lambda m: unescape(F.substr(F.element_at("blocks", m["block"] + 1), m["offset"] + 1, m["length"])))
    return named.select("conv_id", turns.alias("turns"), loss.alias("loss_texts"), "formatted")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what read_back finds."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
