"""Chat formatting: fold logged events into final messages, then render conversations with a reversible template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mlwatch.llm.native import let

TURN = "<|turn|>"
END = "<|end|>\n"
PIECE = 32
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    """Double every backslash, then part every ``<|`` by a single one: no control string is left, and none is lost."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As ``escape``, and without line feeds: a role ends with its line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, place, role, text) of a log with conv_id, turn, seq, kind, role and text.

    Events of a turn are taken by seq; equal ones by kind and text. ``message`` opens a new message, so that two of one
    turn, also equal ones, are two messages, told apart by ``place``. ``delta`` adds text to the turn's latest message,
    ``edit`` replaces its text, ``regenerate`` empties it for the deltas that follow. Events before the first message
    of their turn make a message of their own. A null text is empty; the role is the first known one, or empty. Null
    ids and turns count as values of their own. An unknown kind is an error.
    """
    order = ["seq", "_kind", "text"]
    known = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0))
    own = events.select(
        "conv_id", "turn", "seq", "role", F.coalesce("text", F.lit("")).alias("text"),
        F.when(known > 0, known).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null"))))).alias("_kind"),
    )
    turn = W.partitionBy("conv_id", "turn").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = own.withColumn("place", F.sum((F.col("_kind") == 1).cast("long")).over(turn))
    message = W.partitionBy("conv_id", "turn", "place").orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    reset = F.when(F.col("_kind") != 2, F.struct(*order))
    live = placed.withColumn("_reset", F.max(reset).over(message)).withColumn("role", F.first("role", ignorenulls=True).over(message))
    live = live.where(F.col("_reset").isNull() | (F.struct(*order) >= F.col("_reset")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda e: e["text"]), "")
    return live.groupBy("conv_id", "turn", "place").agg(F.coalesce(F.first("role"), F.lit("")).alias("role"), text.alias("text"))


def render(final: DataFrame, learn: str = "assistant", by: int = PIECE) -> DataFrame:
    """(conv_id, formatted, loss): one text per conversation, and its mask as spans (start, size) of UTF-8 bytes.

    Turns are rendered in order as TURN, role, line feed, text, END. The mask covers the escaped texts of the role
    ``learn``. Turns are first joined in pieces of ``by`` turns, so that a conversation that holds many rows reaches its
    last task in few; the conversation itself is one value, as the result must be.
    """
    body = escape(F.col("text"))
    head = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))
    one = final.select(
        "conv_id", "turn", "place", F.floor(F.col("turn") / by).alias("_piece"), F.concat(head, body, F.lit(END)).alias("_text"),
        F.octet_length(head).alias("_skip"), F.octet_length(body).alias("_size"), (F.col("role") == learn).alias("_learn"),
    )
    piece = W.partitionBy("conv_id", "_piece").orderBy("turn", "place").rowsBetween(W.unboundedPreceding, -1)
    one = one.withColumn("_at", F.coalesce(F.sum(F.octet_length("_text")).over(piece), F.lit(0)).cast("long"))
    span = F.when(F.col("_learn"), F.struct((F.col("_at") + F.col("_skip")).alias("start"), F.col("_size").cast("long").alias("size")))
    rows = F.sort_array(F.collect_list(F.struct("turn", "place", "_text", span.alias("_span"))))
    pieces = one.groupBy("conv_id", "_piece").agg(rows.alias("_rows")).select(
        "conv_id", "_piece",
        F.array_join(F.transform("_rows", lambda r: r["_text"]), "").alias("_text"),
        F.filter(F.transform("_rows", lambda r: r["_span"]), lambda s: s.isNotNull()).alias("_spans"),
    )
    before = W.partitionBy("conv_id").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("_at", F.coalesce(F.sum(F.octet_length("_text")).over(before), F.lit(0)).cast("long"))
    moved = F.transform("_spans", lambda s: F.struct((s["start"] + F.col("_at")).alias("start"), s["size"].alias("size")))
    whole = pieces.withColumn("_spans", moved).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_piece", "_text", "_spans"))).alias("_all"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("_all", lambda p: p["_text"]), "").alias("formatted"),
        F.flatten(F.transform("_all", lambda p: p["_spans"])).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, as an array of (role, text)."""
    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        text = F.substring(F.encode(x, "utf-8"), F.octet_length(role) + 2, F.octet_length(x) - F.octet_length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(F.decode(text, "utf-8")).alias("text"))

    parts = F.split(formatted, r"<\|turn\|>")
    return F.transform(F.filter(parts, lambda x: x != ""), turn)


def under_mask(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the mask, joined."""
    return let(
        F.encode(formatted, "utf-8"),
        lambda raw: F.array_join(
            F.transform(loss, lambda s: unescape(F.decode(F.substring(raw, (s["start"] + 1).cast("int"), s["size"].cast("int")), "utf-8"))), ""
        ),
    )
