"""Chat conversations as one training text each, with a loss mask, by relational operations alone.

Template: ``<turn>role NEWLINE text</turn> NEWLINE`` per run of turns of one role; the texts of a run stand
in one turn, with ``<+turn>`` between them, so adjacent turns of a role merge and can still be told apart.
Control strings inside texts get a backslash after ``<`` (one more if they have some), which is undone
exactly; in roles newlines and backslashes are escaped too.

Turns are collected and sorted in blocks of ``BLOCK`` turn numbers, then blocks are joined, so a very long
conversation is sorted in pieces by many tasks and only finished pieces of text meet.

Defined cases: null text or role counts as empty; turns are ordered by turn (null first), then role, then
text; repeated rows are turns of their own; a null ``conv_id`` is a conversation; an empty table gives an
empty table; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, JOIN, CLOSE = "<turn>", "<+turn>", "</turn>\n"
#: Turn numbers sorted together.
BLOCK = 256
#: Masked stretches cut from one piece of a text when it is read back.
STRETCHES = 64
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*[/+]?turn>)", r"<\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*[/+]?turn>)", "<$1")


def _role_escaped(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_unescaped(role: Column) -> Column:
    parts = F.split(role, r"\\\\")
    return unescaped(F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\"))


def _header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def _between(before: Column, role: Column) -> Column:
    """What stands before a text: the mark between texts of a run, or the end of a turn and a new header."""
    return F.when(before == role, F.lit(JOIN)).otherwise(F.concat(F.lit(CLOSE), _header(role)))


def _running(lengths: Column) -> Column:
    """Sums of the lengths before each position."""
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(lengths, start, lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))


def _stretches(pieces: Column, starts: Column) -> Column:
    """Start and length of each learned text, from pieces with ``lead``, ``text`` and ``role``."""
    spans = F.transform(
        pieces,
        lambda p, i: F.struct(
            (F.get(starts, i) + F.length(p["lead"])).alias("start"),
            F.length(p["text"]).cast("long").alias("n_chars"),
            p["role"].alias("role"),
        ),
    )
    return F.transform(
        F.filter(spans, lambda s: s["role"] == LEARNED), lambda s: F.struct(s["start"], s["n_chars"])
    )


def _block_texts(turns: DataFrame) -> DataFrame:
    """Per conversation and block: its text from the first to the last turn's text, and its mask."""
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / BLOCK).alias("block"),
        F.struct(
            F.col("turn"),
            _role_escaped(F.coalesce(F.col("role"), F.lit(""))).alias("role"),
            escaped(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
        ).alias("turn"),
    )
    sorted_turns = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    pieces = F.transform(
        "turns",
        lambda t, i: F.struct(
            F.when(i == 0, F.lit("")).otherwise(_between(F.get("turns", i - 1)["role"], t["role"])).alias("lead"),
            t["role"].alias("role"),
            t["text"].alias("text"),
        ),
    )
    texts = F.transform("pieces", lambda p: F.concat(p["lead"], p["text"]))
    lengths = F.transform("pieces", lambda p: F.length(p["lead"]) + F.length(p["text"]))
    return (
        sorted_turns.withColumn("pieces", pieces)
        .withColumn("starts", _running(lengths))
        .select(
            "conv_id",
            F.struct(
                "block",
                F.element_at("pieces", 1)["role"].alias("first_role"),
                F.element_at("pieces", -1)["role"].alias("last_role"),
                F.size("pieces").cast("long").alias("n_turns"),
                F.array_join(texts, "").alias("text"),
                _stretches(F.col("pieces"), F.col("starts")).alias("mask"),
            ).alias("part"),
        )
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns``, ``formatted``, and ``loss_mask``: ordered ``(start, n_chars)`` by characters."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    parts = _block_texts(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    leads = F.transform(
        "parts",
        lambda p, i: F.when(i == 0, _header(p["first_role"])).otherwise(
            _between(F.get("parts", i - 1)["last_role"], p["first_role"])
        ),
    )
    texts = F.transform("parts", lambda p, i: F.concat(F.get("leads", i), p["text"]))
    lengths = F.transform("parts", lambda p, i: F.length(F.get("leads", i)) + F.length(p["text"]))
    mask = F.flatten(
        F.transform(
            "parts",
            lambda p, i: F.transform(
                p["mask"],
                lambda s: F.struct(
                    (s["start"] + F.get("starts", i) + F.length(F.get("leads", i))).alias("start"),
                    s["n_chars"].alias("n_chars"),
                ),
            ),
        )
    )
    return (
        parts.withColumn("leads", leads)
        .withColumn("starts", _running(lengths))
        .select(
            "conv_id",
            F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n_turns"]).alias("n_turns"),
            F.concat(F.array_join(texts, ""), F.lit(CLOSE)).alias("formatted"),
            mask.alias("loss_mask"),
        )
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text, in order, as an array of ``(role, text)``."""
    blocks = F.filter(F.split(formatted, F.lit("</turn>\n")), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = _role_unescaped(F.substr(head, F.lit(len(OPEN) + 1)))
        body = F.substr(block, F.length(head) + 2)
        return F.transform(
            F.split(body, r"<\+turn>"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns_of))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between.

    Stretches are cut in groups, each from its own piece of the text, since cutting far from the start of a
    long text is slow.
    """
    groups = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(mask) - 1, F.lit(0)), F.lit(STRETCHES)),
        lambda i: F.slice(mask, i + 1, F.lit(STRETCHES)),
    )

    def group_text(group: Column) -> Column:
        first, last = F.element_at(group, 1), F.element_at(group, -1)
        start = first["start"]
        piece = F.substr(formatted, (start + 1).cast("int"), (last["start"] + last["n_chars"] - start).cast("int"))
        return F.aggregate(
            F.array(piece),
            F.lit(""),
            lambda _, whole: F.array_join(
                F.transform(
                    group,
                    lambda s: unescaped(
                        F.substr(whole, (s["start"] - start + 1).cast("int"), s["n_chars"].cast("int"))
                    ),
                ),
                "",
            ),
        )

    filled = F.filter(groups, lambda g: F.size(g) > 0)
    return F.array_join(F.transform(filled, group_text), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and learned text as they stand in formatted conversations."""
    turns = parse_turns(F.col("formatted"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        formatted.withColumn("turns", turns)
        .withColumn("loss", masked_text(F.col("formatted"), F.col("loss_mask")))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
