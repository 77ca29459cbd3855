"""Chat formatting from event logs: fold the events of each conversation, then render its messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aneroid.llm import chat_template as template

KINDS = ("message", "delta", "edit", "regenerate")


def fold_events(events: DataFrame) -> DataFrame:
    """The final messages of a log: ``conv_id, position, role, text`` from ``conv_id, seq, kind, message, role, text``.

    Events count in the order of ``seq``: ``message`` begins a message with a text, ``delta`` appends a
    streamed piece, ``edit`` replaces the text, ``regenerate`` drops it and waits for new pieces. A message is
    what its last message, edit or regenerate event left, with the pieces that follow; its role is the last
    one given; its ``position`` is the ``seq`` of its first event. An unknown kind is an error; NULL kind is a
    delta; NULL text is empty; NULL seq comes first; events with one seq count in the order of kind and text.
    Repeated deltas are separate pieces. NULL ``conv_id`` and NULL ``message`` form groups of their own.

    Everything of a conversation is in one partition, grouped by message, so one task holds one message's
    events at a time and the log is shuffled once.
    """
    known = F.col("kind").isin(*KINDS) | F.col("kind").isNull()
    kind = F.when(known, F.coalesce("kind", F.lit("delta"))).otherwise(
        F.raise_error(F.concat(F.lit("unknown event: "), F.col("kind")))
    )
    event = F.struct(
        F.col("seq"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("role")
    )
    log = F.array_sort(F.collect_list(event))
    messages = events.repartition("conv_id").groupBy("conv_id", "message").agg(log.alias("log"))
    resets = F.filter(
        F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i + 1).otherwise(0)), lambda i: i > 0
    )
    last = F.coalesce(F.array_max(resets), F.lit(1))
    messages = messages.withColumn("_last", last)
    kept = F.filter("log", lambda e, i: (i + 1 >= F.col("_last")) & (e["kind"] != "regenerate"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return messages.select(
        "conv_id",
        F.col("log")[0]["seq"].alias("position"),
        F.try_element_at(roles, F.lit(-1)).alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, loss_spans``.

    ``loss_spans`` has start and end (code points, end excluded) of every text of ``trained_role`` in
    ``formatted``. Messages are in the order of position, then role and text. NULL role or text is empty.
    A conversation is one value and so is built in one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = [F.col("position"), F.col("role"), F.col("text")]
    inside = Window.partitionBy("conv_id").orderBy(*order)
    head, body = template.head(role), template.escape(text)
    parts = messages.withColumns({"_head": head, "_body": body})
    whole = F.concat(F.col("_head"), F.col("_body"), F.lit(template.END))
    end = F.sum(F.length(whole)).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    body_end = end - len(template.END)
    parts = parts.select(
        "conv_id",
        F.row_number().over(inside).alias("_n"),
        whole.alias("_whole"),
        F.when(
            role == trained_role,
            F.struct((body_end - F.length("_body")).alias("start"), body_end.alias("end")),
        ).alias("_span"),
    )
    turns = F.array_sort(F.collect_list(F.struct("_n", "_whole", "_span")))
    joined = parts.groupBy("conv_id").agg(turns.alias("turns"))
    return joined.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["_whole"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["_span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def as_log(conversations: DataFrame) -> DataFrame:
    """A finished table of turns (``conv_id, turn, role, text``) written as the log of an interactive session.

    Assistant turns were streamed in two pieces after a first answer that was generated anew; other turns
    were typed as a draft and then edited. Folding the log gives the turns back, in the order of turn, then
    role and text. NULL text is empty.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    left, right = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))

    def event(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("text"))

    streamed = F.array(
        event("message", F.lit("")), event("delta", right), event("regenerate", F.lit("")),
        event("delta", left), event("delta", right),
    )
    typed = F.array(event("message", left), event("edit", text))
    log = conversations.withColumn("message", nth).withColumn(
        "_event", F.when(F.col("role") == "assistant", streamed).otherwise(typed)
    )
    return log.select("conv_id", "message", "role", F.posexplode("_event").alias("_i", "_e")).select(
        "conv_id", (F.col("message") * 8 + F.col("_i")).cast("long").alias("seq"), F.col("_e.kind").alias("kind"),
        "message", "role", F.col("_e.text").alias("text"),
    )
