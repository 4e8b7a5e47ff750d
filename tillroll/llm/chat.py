"""Chat formatting from an event log, with DataFrame functions only.

The log holds one event per row: ``conv_id``, ``seq`` (order inside the conversation),
``message_id``, ``kind``, ``role``, ``text``.  Kinds: ``message`` opens a message with its first
text, ``delta`` appends streamed text, ``edit`` replaces the message's text, ``regenerate``
discards what was streamed so that the deltas after it build the message anew.  A message's
text is that of its last reset (message, edit or regenerate) and the deltas after it; its place
is its first event's; its role the last one named.  An event delivered twice counts once.

Template of one turn (``ROLE`` and ``TEXT`` escaped)::

    ### ROLE: TEXT</turn>\\n

Escapes are reversible: backslash -> ``\\\\``, ``#`` -> ``\\#``, ``</`` -> ``<\\/`` and, in roles,
``:`` -> ``\\c``.  So neither ``###`` nor ``</turn>`` nor the role's end mark can stand inside.

Defined results: null text or role is empty, null ``conv_id`` is one conversation, a null kind is a
delta, null ``seq`` sorts first; ties fall by message, kind and text; an empty log gives no
rows; other columns of the log, clashing names included, are left behind.  Messages are folded before conversations, each in its own shuffle with partial
aggregation; a whole conversation is one output cell, as its format asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
RESETS = ("message", "edit", "regenerate")
PIECE = 1024


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: double backslashes split the text into parts with only single escapes."""
    def plain(part: Column) -> Column:
        out = F.replace(F.replace(part, F.lit("\\c"), F.lit(":")), F.lit("\\#"), F.lit("#"))
        return F.replace(out, F.lit("<\\/"), F.lit("</"))

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def cut(text: Column, piece: int = PIECE) -> Column:
    """A text's pieces of ``piece`` code points, cut in one pass; an empty text is one empty piece."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)))


def log_of_rows(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Event log of finished turns (conv_id, turn, role, text): each row opens a message and
    streams its text in pieces of ``piece`` code points; rows order by turn, then role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).select(
        "*", F.row_number().over(order).cast("long").alias("message_id"))
    return (numbered.select("conv_id", "message_id", "role", F.posexplode(cut(F.col("text"), piece)).alias("k", "piece"))
            .select("conv_id", F.struct("message_id", "k").alias("seq"), "message_id",
                    F.when(F.col("k") == 0, "message").otherwise("delta").alias("kind"), "role",
                    F.col("piece").alias("text")))


def fold_messages(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message_id, place, role, text."""
    event = F.struct(F.col("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"),
                     F.coalesce("text", F.lit("")).alias("text"), F.col("role"))
    groups = (events.select("conv_id", "message_id", event.alias("event"))
              .groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_set("event")).alias("log")))
    last = F.array_max(F.transform(F.col("log"), lambda e, i: F.when(e.kind.isin(*RESETS), i).otherwise(0)))
    live = F.slice("log", F.col("last") + 1, F.size("log"))
    roles = F.filter(F.transform("log", lambda e: e.role), lambda r: r.isNotNull())
    return groups.withColumn("last", last).select(
        "conv_id", "message_id", F.col("log")[0]["seq"].alias("place"),
        F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e.text), "").alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    ``loss_spans`` lists (start, length) in code points of ``formatted``: the escaped text of each
    ``trained`` turn, in order.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(MIDDLE))
    turns = messages.select("conv_id", "place", "message_id", (F.col("role") == trained).alias("trained"),
                            head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("size", F.length("head") + F.length("body") + len(CLOSE))
    before = (Window.partitionBy("conv_id").orderBy("place", "message_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    turn = F.struct("start", F.length("body").alias("length"), "trained",
                    F.concat("head", "body", F.lit(CLOSE)).alias("turn"))
    return (turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.array_join(F.transform("turns", lambda t: t.turn), "").alias("formatted"),
                    F.transform(F.filter("turns", lambda t: t.trained),
                                lambda t: F.struct(t.start.alias("start"), t.length.alias("length"))).alias("loss_spans")))


def format_chat(events: DataFrame, trained: str = "assistant") -> DataFrame:
    return render(fold_messages(events), trained)


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted conversation."""
    pieces = F.split(formatted, CLOSE, -1)
    def turn(piece: Column) -> Column:
        colon = F.locate(MIDDLE, piece)
        return F.struct(unescape(F.substring(piece, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1)).alias("role"),
                        unescape(F.substring(piece, colon + len(MIDDLE), F.length(piece))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped.

    The conversation is cut into pieces once; a span is read from the pieces that it touches, so the
    work follows the length of the conversation and not its square."""
    def under(pieces: Column, s: Column) -> Column:
        first = F.floor(s.start / PIECE).cast("int")
        count = F.floor((s.start + s.length) / PIECE).cast("int") - first + 1
        return F.substring(F.array_join(F.slice(pieces, first + 1, count), ""), (s.start % PIECE + 1).cast("int"), s.length)

    def text(pieces: Column) -> Column:  # the pieces are bound, or each span would cut anew
        return F.array_join(F.transform(spans, lambda s: unescape(under(pieces, s))), "")

    return F.transform(F.array(cut(formatted)), text)[0]
