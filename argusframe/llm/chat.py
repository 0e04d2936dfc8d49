"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn renders as ``### role:`` newline, text, ``</turn>`` newline. The grammar is deterministic: a turn ends at the
first ``</turn>`` newline, its role at the first colon and newline; then the escapes ``\\b`` ``\\l`` ``\\h`` ``\\c``
``\\n`` stand for backslash, ``<``, ``#``, colon and newline. Each turn is rendered as it is, parsed back, and compared
with its source; if they differ, or if the text holds a control string, its control strings are escaped, and if that
still differs every special character is. The last level always reads back: it leaves no control character.

Turns are rendered and parsed where they lie; a conversation's turns meet first in chunks of CHUNK_TURNS turn numbers,
then by conversation, because its digests run over all of it. Null text or role is empty. Equal turn numbers are
ordered by role, then text; repeated rows are repeated turns; a null conv_id is a conversation of its own; a null turn comes first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, HEAD, SEP = "</turn>\n", "### ", ":\n"
#: Turn numbers that meet in one chunk before conversations do.
CHUNK_TURNS = 64
#: (character, its escape); the backslash first, and last when reading back (fixed values).
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"), ("\n", "\\n")]
CONTROL = [("\\", "\\b"), ("</turn>", "\\l/turn>"), ("### ", "\\h## ")]


def _replace(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def unescape(c: Column) -> Column:
    return _replace(c, [(b, a) for a, b in [*ESCAPES[1:], ESCAPES[0]]])


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), _replace(role, ESCAPES), F.lit(SEP), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation or chunk."""
    pieces = F.split(formatted, r"\Q" + END + r"\E", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, SEP)
        return F.struct(unescape(F.substr(piece, F.lit(len(HEAD) + 1), cut - len(HEAD) - 1)).alias("role"), unescape(F.substr(piece, cut + len(SEP))).alias("text"))

    return F.transform(pieces, turn)


def levels(text: Column) -> list[Column]:
    """The text as it is, with its control strings escaped, with every special character escaped."""
    return [text, _replace(text, CONTROL), _replace(text, ESCAPES[:3])]


def format_turns(rows: DataFrame) -> DataFrame:
    """Adds rendered and level to rows with (role, text): the first level that reads back as the one source turn."""
    plain, *others = levels(F.col("text"))
    conflict = reduce(lambda a, b: a | b, [F.contains(F.col("text"), F.lit(c)) for c, _ in CONTROL])
    rows = rows.withColumn("__r0", render(F.col("role"), plain))
    same = lambda name: parse(F.col(name)) == F.array(F.struct(F.col("role"), F.col("text")))
    rows = rows.withColumn("__ok0", ~conflict & same("__r0"))
    rows = rows.withColumn("__r1", F.when(~F.col("__ok0"), render(F.col("role"), others[0])))
    rows = rows.withColumn("__ok1", F.coalesce(same("__r1"), F.lit(False)))
    rendered = F.when(F.col("__ok0"), F.col("__r0")).when(F.col("__ok1"), F.col("__r1")).otherwise(render(F.col("role"), others[1]))
    level = F.when(F.col("__ok0"), 0).when(F.col("__ok1"), 1).otherwise(2)
    return rows.withColumns({"rendered": rendered, "level": level}).drop("__r0", "__r1", "__ok0", "__ok1")


def format_chunks(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation and chunk: formatted text, the code-point spans under the loss mask, and the turns read back."""
    clean = conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    turns = format_turns(clean.repartition("conv_id", "turn"))
    chunk = F.floor(F.coalesce("turn", F.lit(-(2**62))) / CHUNK_TURNS).alias("chunk")
    order = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered")))
    chunks = turns.groupBy("conv_id", chunk).agg(order.alias("t"))
    formatted = F.array_join(F.transform("t", lambda x: x["rendered"]), "")
    chunks = chunks.select("conv_id", "chunk", formatted.alias("formatted"))
    chunks = chunks.withColumn("read", parse(F.col("formatted")))
    return chunks.withColumn("loss_spans", loss_spans(F.col("formatted"), loss_role))


def loss_spans(formatted: Column, loss_role: str) -> Column:
    """(start, length) in code points of the escaped texts of loss_role."""
    pieces = F.split(formatted, r"\Q" + END + r"\E", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    head = HEAD + loss_role + SEP
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        n = F.char_length(piece)
        span = F.struct((acc["at"] + len(head)).alias("start"), (n - len(head)).alias("length"))
        spans = F.when(F.startswith(piece, F.lit(head)), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + n + len(END)).alias("at"), spans.alias("spans"))

    return F.aggregate(pieces, start, step)["spans"]


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation, read back from its formatted text: n_turns, turns (role, newline, text, newline for each),
    loss_text (what the mask covers, unescaped), formatted, loss_spans (in code points of formatted)."""
    chunks = format_chunks(conversations, loss_role)
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    parts = chunks.select(
        "conv_id", "chunk", "formatted", "loss_spans", F.size("read").cast("long").alias("n"), F.char_length("formatted").alias("chars"),
        F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join(masked, "").alias("loss"),
    )
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("chunk", "formatted", "turns", "loss", "loss_spans", "chars"))).alias("c"))
    joined = lambda name: F.array_join(F.transform("c", lambda x: x[name]), "").alias(name)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    moved = lambda acc, c: F.struct((acc["at"] + c["chars"]).alias("at"), F.concat(acc["spans"], F.transform(c["loss_spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["length"].alias("length")))).alias("spans"))
    return whole.select("conv_id", "n_turns", joined("formatted"), joined("turns"), joined("loss").alias("loss_text"), F.aggregate("c", start, moved)["spans"].alias("loss_spans"))
