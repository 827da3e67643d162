"""Chat formatting from event logs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the template. A turn is OPEN role HEAD text TAIL; texts and roles are
# escaped, so these strings, and those of other common templates, occur unescaped only as marks.
OPEN, HEAD, TAIL = "<|", "|>\n", "<|end|>\n"
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3"))


def escape(x: Column) -> Column:
    for raw, code in ESCAPES:
        x = F.replace(x, F.lit(raw), F.lit(code))
    return x


def unescape(x: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        x = F.replace(x, F.lit(code), F.lit(raw))
    return x


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of logs (conv_id, seq, turn, kind, role, text).

    Events apply by ``seq``: ``delta`` appends text to its turn, ``edit`` replaces
    what the turn holds, ``regenerate`` empties it and starts anew, with its own text if it has one. So a turn's message is the text of all events from its
    last edit or regeneration on. Its role is the last one named. Null texts are empty, a null kind is
    a delta, equal sequence numbers apply in order of kind, then text; a turn
    whose events hold no text is an empty message.
    """
    # All events of a conversation meet once, sorted by sequence; its turns are folded side by side.
    events = events.repartition("conv_id")
    by_turn = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "text")
    e = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    e = e.select("*", F.row_number().over(by_turn).alias("at"), F.sum((F.col("kind") != "delta").cast("int")).over(by_turn).alias("start"))
    last = F.max("start").over(Window.partitionBy("conv_id", "turn"))
    e = e.select("*", last.alias("last"))
    kept = F.array_sort(F.collect_list(F.when(F.col("start") == F.col("last"), F.struct("at", "text"))))
    return e.groupBy("conv_id", "turn").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"),
        F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"),
    )


def format_conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans) from messages (conv_id, turn, role, text).

    ``spans`` is the loss mask: (turn, start, within, length) in code points for each
    assistant text, ``start`` in the whole string and ``within`` in its turn. Turns go by ``turn``; equal ones by role, then text. A null
    role or text is empty; a null conv_id is a conversation of its own; repeated rows are turns of their own.
    """
    m = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumn("body", escape(F.col("text"))).withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD)))
    m = m.withColumn("piece", F.concat("head", "body", F.lit(TAIL)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = m.select("conv_id", F.row_number().over(order).alias("i"), "role", "piece", F.length("head").cast("long").alias("within"), F.length("body").cast("long").alias("length"), before.alias("before"))
    span = F.struct(F.col("i").alias("turn"), (F.col("before") + F.col("within")).alias("start"), "within", "length")
    return m.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("spans"),
    )


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 2147483647), HEAD, 1)).alias("role"),
            unescape(F.substring(p, F.locate(HEAD, p) + len(HEAD), F.lit(2147483647))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped. Cut from its own turn, so the work is linear in the length."""
    pieces = F.split(formatted, r"(?<=<\|end\|>\n)")
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.get(pieces, s["turn"] - 1), (s["within"] + 1).cast("int"), s["length"].cast("int")))), "")
