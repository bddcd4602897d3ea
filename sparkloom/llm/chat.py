"""Chat formatting of typed content parts, with DataFrame functions only.

A message's parts (text, image, audio, document) are visited in order and flattened: a text is escaped, every other part
becomes one placeholder, and is recorded as an attachment with its reference and the number of tokens that the placeholder
stands for. The template is ``<|im_start|>role\\ncontent<|im_end|>\\n`` per turn; what a role or a text says can never be taken
for one of its control strings, and can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<kind: string, text: string, ref: string, amount: bigint>"
#: Tokens that a placeholder stands for: per unit of a part's amount (image tiles, seconds of audio, pages), and at least.
EXPANSION = {"image": (256, 85), "audio": (25, 25), "document": (600, 600)}


def escaped(text: Column) -> Column:
    """A backslash is doubled, ``<|`` gets one in between, and a ``<`` at the end becomes ``<\\.``, so that neither a piece nor pieces side by side hold ``<|``; see unescaped."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.when(F.endswith(out, F.lit("<")), F.concat(out, F.lit("\\."))).otherwise(out)


def unescaped(text: Column) -> Column:
    """Undoes escaped. ``<\\|`` and ``<\\.`` with a single backslash can only come from ``<|`` and a last ``<``: all others stand in pairs."""
    return F.replace(F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("<\\."), F.lit("<")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    """As escaped; a new line becomes ``<\\n`` in three characters, so that a role stays on its line."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def visited(part: Column) -> Column:
    """A part's piece of the output. Texts (also of no or an unknown kind that carry one) are escaped; null texts are empty."""
    other = F.coalesce(part["kind"].isin(*EXPANSION), F.lit(False))
    return F.when(other, F.concat(F.lit("<|"), part["kind"], F.lit("|>"))).otherwise(F.coalesce(escaped(part["text"]), F.lit("")))


def expanded(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; 0 for a text."""
    out = F.lit(0).cast("long")
    for kind, (unit, least) in EXPANSION.items():
        out = F.when(part["kind"] == kind, F.greatest(F.lit(least), F.coalesce(part["amount"], F.lit(0)) * unit).cast("long")).otherwise(out)
    return out


def format_parts(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss (array of start, length in formatted), attachments and expanded_tokens.

    messages: conv_id, turn, role and parts (array of PART); other columns are ignored. Turns are ordered by turn (null
    first), then role and parts; repeated rows are turns of their own. Null roles, parts and texts are empty; a message
    without parts is an empty turn. The loss mask covers the content of each message of loss_role, code point by code point.
    attachments are (turn, part, kind, ref, tokens), turn and part counted from 0, in the order of their placeholders; they
    bear no loss. Messages with a null conv_id form one conversation. An empty table gives an empty result.

    One shuffle by conversation; a conversation is one row of the result and so has to meet in one task.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"))
    # the window's sort comes before parts are flattened, so rows are sorted as they came
    rows = rows.withColumn("at", F.row_number().over(order) - 1)
    rows = rows.withColumn("head", F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))).withColumn("pieces", F.transform("parts", visited))
    rows = rows.withColumn("content", F.array_join("pieces", "")).withColumn("all", F.concat("head", "content", F.lit(END + "\n")))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.char_length("all")).over(before), F.lit(0)))
    # the loss covers runs of text; a placeholder among them is left out
    spans = F.transform("pieces", lambda x, i: F.struct(
        (F.col("start") + F.char_length("head") + F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + F.char_length(y))).alias("start"),
        F.char_length(x).cast("long").alias("length"), i.alias("part")))
    other = F.transform("parts", lambda p: F.coalesce(p["kind"].isin(*EXPANSION), F.lit(False)))
    spans = F.transform(F.filter(spans, lambda s: (s["length"] > 0) & ~F.get(other, s["part"])), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    rows = rows.withColumn("loss", F.when(F.col("role") == loss_role, spans).otherwise(F.array().cast("array<struct<start: bigint, length: bigint>>")))
    attached = F.filter(F.transform("parts", lambda p, i: F.struct(F.col("at").alias("turn"), i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded(p).alias("tokens"))), lambda a: a["tokens"] > 0)
    rows = rows.select("conv_id", "at", "all", "loss", attached.alias("attached"))
    got = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("at", "all", "loss", "attached"))).alias("x"))
    attachments = F.flatten(F.transform("x", lambda t: t["attached"]))
    return got.select("conv_id", "n_turns", F.array_join(F.transform("x", lambda t: t["all"]), "").alias("formatted"), F.flatten(F.transform("x", lambda t: t["loss"])).alias("loss"), attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("expanded_tokens"))


def turns(formatted: Column) -> Column:
    """The turns (role, text) of formatted text, as they were; placeholders stay as they are written."""
    cut = F.filter(F.split(formatted, "<\\|im_end\\|>\n"), lambda x: F.startswith(x, F.lit(START)))
    body = F.transform(cut, lambda x: F.substring(x, F.lit(len(START) + 1), F.char_length(x)))
    return F.transform(body, lambda x: F.struct(unescaped_role(F.substring_index(x, "\n", 1)).alias("role"), unescaped(F.substring(x, F.char_length(F.substring_index(x, "\n", 1)) + 2, F.char_length(x))).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, in order, with nothing in between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
