"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has rows (conv_id, seq, turn, kind, role, text):
- `message` sets a turn's whole text; `delta` appends to it in the order of seq;
- `edit` replaces what the turn says so far; deltas after it append to the edit;
- `regenerate` throws away what the turn says so far; what follows is the new answer.
Each turn's last role counts. Logs are partitioned by conversation, sorted by seq and folded turn by turn; events
that a later one replaces go before texts are gathered. A conversation comes out as one text, so its live
turns meet in one row and one task: conversations are the unit that is spread out, and one alone can't be.

The template marks a turn as `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts a backslash is
doubled and `<|` becomes `<\\|`, so that control strings never appear there; in roles a line feed becomes
`<\\.`. Both are undone exactly by `unescape`.

Defined results: null roles and texts are empty; null conversation ids are one conversation; a null turn comes
first; a null kind is a delta; ties in seq are ordered by kind, role, then text; rows that repeat a turn are
turns of their own when they come through `messages` or `streamed`, which number them by turn, role and text;
very long texts are rendered whole; an empty table has no conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\."))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\."), F.lit("\n")))


def messages(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as a log of `message` events, numbered by turn, role and text."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv_id", at.alias("seq"), at.alias("turn"), F.lit("message").alias("kind"), "role", "text")


def streamed(rows: DataFrame, piece: int = 400) -> DataFrame:
    """Rows as the log of a service that streams: what was said in the end is in it, among what was replaced.

    An assistant's turn is a first draft in deltas, a regenerate, and the answer in deltas of `piece` characters.
    Any other turn is a message that an edit replaces, with a delta for the rest of the text.
    """
    rows = messages(rows)
    n, text = F.length("text"), F.col("text")
    event = lambda kind, said: F.struct(F.lit(kind).alias("kind"), said.alias("text"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"), F.lit(piece)), lambda i: event("delta", F.substring(text, i + 1, F.lit(piece))))
    draft = F.array(event("delta", F.substring(text, F.lit(1), F.least(n, F.lit(piece)))), event("delta", F.lit(" no")), event("regenerate", F.lit("")))
    half = F.floor(n / 2).cast("int")
    edited = F.array(event("message", F.concat(F.lit("draft "), F.substring(text, F.lit(1), F.least(half, F.lit(piece))))), event("edit", F.substring(text, F.lit(1), half)), event("delta", F.substring(text, half + 1, n)))
    events = F.when(F.col("role") == "assistant", F.concat(draft, pieces)).otherwise(edited)
    log = rows.select("conv_id", "turn", "role", F.posexplode(events).alias("at", "event"))
    # A turn's events follow each other; turns have room for all that a text can hold.
    seq = F.col("turn") * F.lit(1 << 31) + F.col("at")
    return log.select("conv_id", seq.alias("seq"), "turn", "event.kind", "role", "event.text")


def fold(log: DataFrame) -> DataFrame:
    """The final message of each turn: conv_id, turn, role, text."""
    log = log.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Nothing before the last event that isn't a delta matters, so it goes before texts are gathered.
    by = W.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text")
    fresh = F.sum(F.when(F.col("kind") == "delta", 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0))
    last = F.max("_age").over(W.partitionBy("conv_id", "turn"))
    live = log.withColumn("_age", fresh).withColumn("_last", last).filter("_age = _last")
    said = F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", said.alias("text"))))
    turns = live.groupBy("conv_id", "turn").agg(parts.alias("parts"))
    return turns.select("conv_id", "turn", F.element_at("parts", -1)["role"].alias("role"), F.array_join(F.col("parts.text"), "").alias("text"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans of assistant texts in formatted: start and length in code points)."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.withColumn("_head", head).withColumn("_body", escape(F.col("text")))
    turns = turns.withColumn("_n", F.length("_head") + F.length("_body") + F.lit(len(END)))
    before = F.sum("_n").over(W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    spans = F.when(F.col("role") == "assistant", F.struct((before + F.length("_head")).alias("start"), F.length("_body").alias("length")))
    turns = turns.select("conv_id", F.struct(before.alias("at"), F.concat("_head", "_body", F.lit(END)).alias("said"), spans.alias("loss")).alias("part"))
    by = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return by.select("conv_id", F.array_join(F.col("parts.said"), "").alias("formatted"), F.array_compact(F.col("parts.loss")).alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> out of a formatted conversation."""
    said = F.filter(F.split(formatted, "<\\|im_start\\|>"), lambda x, i: i > 0)
    return F.transform(
        said,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substring(x, F.instr(x, "\n") + 1, F.length(x) - F.instr(x, "\n") - len(END))).alias("text"),
        ),
    )


def digest(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of rendered conversations."""
    masked = F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"].cast("int") + 1, x["length"]))), "")
    rows = rows.withColumn("_turns", read_back(F.col("formatted"))).withColumn("_masked", masked)
    text = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("_masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("_masked"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
