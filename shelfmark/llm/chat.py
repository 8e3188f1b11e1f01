r"""Chat formatting that can always be read back.

A turn is ``### role: text</turn>`` and a line end. The rendered text is parsed again by a
deterministic parser: it cuts at ``</turn>`` and line end, takes the role up to the first ``: ``,
refuses texts that still hold a control string, and undoes escapes. Turns that do not come back as
they were are escaped (``\`` as ``\b``, the ``<`` of ``</turn>`` as ``\l``, the first ``#`` of
``### `` as ``\h``, ``:`` in a role as ``\c``); in escaped content every ``\`` begins an escape, so
the second parse is identical. ``round_trip`` says so for each conversation.

Column expressions only. A conversation is one row by nature (its text is one string); turns are
gathered with partial lists per task before the shuffle.

Defined results: NULL text and NULL role are empty; turns sort by turn, ties by role and text; NULL
turns come first; repeated rows are turns of their own; rows with a NULL conv_id form one
conversation; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import running

OPEN, SEP, CLOSE, END = "### ", ": ", "</turn>", "</turn>\n"
LOSS_ROLE = "assistant"


def _swap(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _swap(text, [("\\", "\\b"), (CLOSE, "\\l/turn>"), (OPEN, "\\h## ")])


def unescape(text: Column) -> Column:
    return _swap(text, [("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\b", "\\")])


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(SEP), text, F.lit(END))


def _pieces(formatted: Column) -> Column:
    """The turns of a formatted text, without their closing mark."""
    every = F.split(formatted, r"\Q" + END + r"\E", -1)
    return F.slice(every, F.lit(1), F.size(every) - 1)


def _role(piece: Column) -> Column:
    return F.substring_index(F.substr(piece, F.lit(len(OPEN) + 1)), SEP, 1)


def _text(piece: Column) -> Column:
    return F.substr(piece, F.lit(len(OPEN) + len(SEP) + 1) + F.length(_role(piece)))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>; the text is NULL where a control string is left in a turn."""
    def turn(piece: Column) -> Column:
        role, text = _role(piece), _text(piece)
        clean = ~(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
                  | F.contains(role, F.lit(CLOSE)) | F.contains(role, F.lit(OPEN)))
        return F.struct(unescape(role).alias("role"),
                        F.when(clean, unescape(text)).alias("text"))
    return F.transform(_pieces(formatted), turn)


def render(turns: Column) -> Column:
    """Formatted text; a turn that would not be read back as it is gets escaped."""
    def one(t: Column) -> Column:
        plain = _turn(t["role"], t["text"])
        back = parse(plain)
        same = (F.size(back) == 1) & (back[0]["role"] == t["role"]) & \
            F.coalesce(back[0]["text"] == t["text"], F.lit(False))
        safe_role = F.replace(escape(t["role"]), F.lit(":"), F.lit("\\c"))
        return F.when(same, plain).otherwise(_turn(safe_role, escape(t["text"])))
    return F.array_join(F.transform(turns, one), "")


def _starts(pieces: Column) -> Column:
    """Position (from 0, in characters) of each piece in the formatted text."""
    sizes = F.transform(pieces, lambda p: (F.length(p) + len(END)).cast("bigint"))
    return running(sizes, F.lit(0).cast("bigint"), "bigint", lambda at, n: at + n)


def loss_spans(formatted: Column, role: str = LOSS_ROLE) -> Column:
    """Per turn the start and length, in characters, of what is under the loss mask (length 0
    where the turn is not of ``role``)."""
    pieces = _pieces(formatted)
    placed = F.arrays_zip(pieces.alias("piece"), _starts(pieces).alias("start"))
    return F.transform(placed, lambda p: F.struct(
        (p["start"] + len(OPEN) + len(SEP) + F.length(_role(p["piece"]))).cast("bigint")
        .alias("start"),
        F.when(unescape(_role(p["piece"])) == role, F.length(_text(p["piece"])))
        .otherwise(0).cast("bigint").alias("length")))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the mask, read from the formatted text by their positions.

    Each is cut from its own turn, so that a long conversation is not scanned once per turn.
    """
    pieces = _pieces(formatted)
    both = F.arrays_zip(pieces.alias("piece"), _starts(pieces).alias("at"), spans.alias("span"))
    return F.transform(both, lambda b: unescape(F.substr(
        b["piece"], (b["span"]["start"] - b["at"] + 1).cast("int"),
        b["span"]["length"].cast("int"))))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns, formatted, loss_spans, recovered, round_trip per conversation.

    ``rows``: conv_id, turn, role, text.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    source = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    source = source.select("conv_id", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    out = source.withColumn("formatted", render(F.col("turns")))
    out = out.withColumns({"loss_spans": loss_spans(F.col("formatted")),
                           "recovered": parse(F.col("formatted"))})
    return out.withColumn("round_trip", F.col("recovered") == F.col("turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of the formatted text, the recovered turns and the masked texts."""
    turns = F.array_join(F.transform("recovered", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(masked_texts(F.col("formatted"), F.col("loss_spans")), "")
    return formatted.withColumn("loss", loss).select(
        "conv_id", F.size("recovered").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
