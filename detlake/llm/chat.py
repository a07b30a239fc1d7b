"""Chat formatting: conversations are folded from event logs and rendered with a loss mask, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings. All begin with the two characters that texts may not show unescaped.
START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"


def escape(text: Column) -> Column:
    r"""Backslashes are doubled, then ``<|`` becomes ``<\|``: no control string survives, and no two texts become equal."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    r"""A single backslash between ``<`` and ``|`` was put there; all others stand in pairs."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, position, role, text, redone)`` of a log ``(conv_id, seq, kind, message_id, role, text)``.

    Events of one message are put in order of ``seq``. ``message``, ``edit`` and ``regenerate`` set its text, ``delta``
    appends to it; what stood before the last setting event is lost. A message stands where its first event was and has the
    first role given. ``redone`` is the ``seq`` of its last ``regenerate``. An event without ``message_id`` is a message of its own; a
    missing kind means ``message``. Null texts and roles are empty. Equal ``seq`` are ordered by kind, role and text.
    """
    e = events.select(
        _column(events, "conv_id", "long").alias("conv_id"), F.col("seq").cast("long").alias("seq"),
        F.coalesce(_column(events, "kind", "string"), F.lit("message")).alias("kind"),
        _column(events, "message_id", "string").alias("message_id"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    alone = e.where("message_id IS NULL").select(
        "conv_id", F.col("seq").alias("position"), "role", "text", F.lit(None).cast("long").alias("redone")
    )
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    grouped = e.where("message_id IS NOT NULL").groupBy("conv_id", "message_id").agg(log.alias("log"))
    sets = F.filter("log", lambda x: x["kind"] != "delta")
    grouped = grouped.withColumn("since", F.coalesce(F.array_max(F.transform(sets, lambda x: x["seq"])), F.lit(-(1 << 63))))
    text = F.filter("log", lambda x: (x["seq"] >= F.col("since")))
    # of several setting events with one seq the last in order counts
    last = F.coalesce(F.array_max(F.transform(text, lambda x, i: F.when(x["kind"] != "delta", i))), F.lit(0))
    text = F.array_join(F.transform(F.filter(text, lambda x, i: i >= last), lambda x: x["text"]), "")
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r != "")
    told = grouped.select(
        "conv_id", F.col("log")[0]["seq"].alias("position"), F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"), text.alias("text"),
        F.array_max(F.transform(F.filter("log", lambda x: x["kind"] == "regenerate"), lambda x: x["seq"])).alias("redone"),
    )
    return alone.unionByName(told)


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)`` per conversation of folded messages.

    A message that was there when an earlier one was regenerated is dropped: the conversation went on from there. Turns
    follow by position, role and text. Each becomes ``<|start|>role<|sep|>text<|end|>`` with role and text escaped. ``loss``
    has one struct (start, length) per turn, in code points from the turn's own ``<|start|>``: the escaped text of an assistant
    turn, and length 0 for all others. A conversation is one output row, so its size is bounded by what a string can hold.
    Null conversation ids form one conversation.
    """
    turns = F.array_sort(F.collect_list(F.struct("position", "role", "text", "redone")))
    c = messages.groupBy("conv_id").agg(turns.alias("turns"))
    redone = F.filter("turns", lambda t: t["redone"].isNotNull())
    c = c.withColumn("redone", redone).withColumn(
        "turns",
        F.when(F.size("redone") == 0, F.col("turns")).otherwise(
            F.filter(
                "turns",
                lambda t: ~F.exists("redone", lambda r: (r["position"] < t["position"]) & (t["position"] < r["redone"])),
            )
        ),
    )
    parts = F.transform("turns", lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(END)))

    def mask(t: Column) -> Column:
        start = F.length(escape(t["role"])) + len(START + SEP)
        own = t["role"] == "assistant"
        return F.struct(F.when(own, start).otherwise(0).alias("start"), F.when(own, F.length(escape(t["text"]))).otherwise(0).alias("length"))

    return c.select("conv_id", F.array_join(parts, "").alias("formatted"), F.transform("turns", mask).alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """``rendered`` with ``turns`` (role, text) parsed from ``formatted``, and ``learned``: the unescaped texts under the loss mask."""
    pieces = F.split("formatted", r"(?<=<\|end\|>)")
    pieces = F.filter(pieces, lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, SEP, 1)
        body = p.substr(F.length(head) + len(SEP) + 1, F.length(p) - F.length(head) - len(SEP + END))
        return F.struct(unescape(F.replace(head, F.lit(START), F.lit(""))).alias("role"), unescape(body).alias("text"))

    learned = F.transform(
        F.filter(F.arrays_zip(F.col("pieces").alias("piece"), F.col("loss").alias("span")), lambda x: x["span"]["length"] > 0),
        lambda x: unescape(x["piece"].substr(x["span"]["start"] + 1, x["span"]["length"])),
    )
    return rendered.withColumn("pieces", pieces).withColumn("turns", F.transform("pieces", turn)).withColumn("learned", learned).drop("pieces")
