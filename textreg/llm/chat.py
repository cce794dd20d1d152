"""Training windows from conversations: rendered turns, a token budget, and a loss mask. DataFrame functions only.

A turn is rendered as ``<|turn|>role``, a line break, its text, ``<|end|>``. Inside roles and texts the characters that control strings
need (``<``, ``>``, ``[``) are escaped with backslashes, so the rendered text can be read back exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Every control string has one of these characters, and what stands for them has none. A backslash itself is doubled first.
ESCAPES = {"<": r"\l", ">": r"\g", "[": r"\b"}
BUDGET = 2048
HISTORY = 512


def escape(text: Column) -> Column:
    start = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES.items(), start)


def unescape(text: Column) -> Column:
    """Parts between doubled backslashes hold single escapes only."""
    plain = lambda part: reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), ESCAPES.items(), part)
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def token_count(text: Column) -> Column:
    """Words and single marks of a text: an estimate of its tokens. Pass another expression for a real tokenizer's count."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"))


def format_chats(
    chats: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    tokens=token_count,
) -> DataFrame:
    """Cut conversations into windows of whole turns.

    Returns one row per window: ``conv_col``, ``window`` (rising within a conversation), ``text``, ``context_turns`` (leading
    turns that only repeat what another window holds), ``loss`` (``[start, end)`` code points of the assistant texts to learn,
    as they stand escaped in ``text``) and ``n_tokens``.

    Turns are in order of ``turn_col``, then role, then text. Running sums of their tokens are cut every
    ``budget - history - (tokens of the system turn)`` tokens, at least every half budget: a window's own turns are those
    whose sum ends in one stretch, so only a turn that reaches back over a cut makes a window longer.
    A system turn at the start of a conversation begins every window. A window repeats the turns before
    it that begin within ``history`` tokens of its start, of whatever windows they are. Each turn is the own turn of exactly one window; repeated turns are
    never part of the loss.

    Null texts and roles count as empty; a null conversation id is one conversation; null turn numbers come first. Repeated
    rows are turns of their own. Other columns are ignored. A conversation is one group of rows: its windows are
    found by sorting, and only one window's turns are ever in one row.
    """
    rows = chats.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"),
    )
    conv = Window.partitionBy("conv").orderBy("turn", "role", "body")
    numbered = rows.select(
        "*", F.row_number().over(conv).alias("pos"), tokens(F.concat("role", F.lit(" "), "body")).cast("bigint").alias("n"),
    )
    up = Window.partitionBy("conv").orderBy("pos")
    opening = (F.col("pos") == 1) & (F.col("role") == "system")
    system = F.first(F.when(opening, F.struct("role", "body", "n"))).over(up).alias("system")
    own = F.when(opening, F.lit(0).cast("bigint")).otherwise(F.col("n"))
    summed = numbered.select("*", system, F.sum(own).over(up).alias("upto")).withColumn(
        "stretch", F.greatest(F.lit(budget // 2), F.lit(budget - history) - F.coalesce("system.n", F.lit(0)))
    )
    # The opening system turn is an own turn of the first window and comes first there anyway.
    cut = summed.withColumn("window", F.expr("greatest(upto - 1, 0) div stretch"))
    before = F.lag("window").over(up)
    starts = cut.withColumn("begins", F.when(before.isNull() | (before != F.col("window")), F.col("upto") - F.col("n")))
    down = Window.partitionBy("conv").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.struct("window", "begins")
    # Starts lie a stretch apart but for the first two of any ``history`` tokens, so this many can have a turn as history.
    following = starts.withColumn("ahead", F.array().cast(f"array<{starts.select(start).schema[0].dataType.simpleString()}>"))
    for _ in range(-(-history // max(1, budget // 2)) + 1):
        this = F.when(F.col("begins").isNotNull(), F.concat(F.array(start), "ahead"))
        following = following.withColumn("ahead", F.coalesce(F.last(this, True).over(down), F.array()))
    # The opening system turn is in every window already.
    near = F.filter("ahead", lambda s: s["begins"] - F.col("upto") + F.col("n") <= history)
    opens = (F.col("pos") == 1) & F.col("system").isNotNull()
    place = lambda window, kind: F.struct(window.alias("window"), F.lit(kind).alias("kind"))
    places = F.concat(
        F.array(place(F.col("window"), 2)),
        F.when(opens, F.array()).otherwise(F.transform(near, lambda s: place(s["window"], 1))),
    )
    turns = following.select("conv", "pos", "role", "body", "n", F.explode(places).alias("at")).select(
        "conv", "at.window", "at.kind", "pos", "role", "body", "n"
    )
    # The system turn once for each window but its own.
    kept = following.filter(
        "begins IS NOT NULL AND system IS NOT NULL AND pos > 1"
    ).select(
        "conv", "window", F.lit(0).alias("kind"), F.lit(1).alias("pos"), "system.role", "system.body", "system.n"
    )
    every = turns.unionByName(kept)
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(r"\n")), F.lit("\n"))
    drawn = every.select(
        "conv", "window", "kind", "pos", "n", F.char_length(head).alias("skip"), escape(F.col("body")).alias("inner"),
        (F.col("kind") == 2).alias("own"), ((F.col("kind") == 2) & (F.col("role") == "assistant")).alias("learn"), head.alias("head"),
    ).select("*", F.concat("head", "inner", F.lit(END)).alias("drawn"))
    inside = Window.partitionBy("conv", "window").orderBy("pos")
    placed = drawn.withColumn("ends", F.sum(F.char_length("drawn")).over(inside)).withColumn(
        "start", F.col("ends") - F.char_length("drawn") + F.col("skip")
    )
    span = F.struct(F.col("start").cast("int").alias("start"), (F.col("start") + F.char_length("inner")).cast("int").alias("end"))
    whole = placed.groupBy("conv", "window").agg(
        F.array_sort(F.collect_list(F.struct("pos", "drawn"))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("learn"), span))).alias("loss"),
        F.sum(F.when(F.col("own"), 0).otherwise(1)).alias("context_turns"), F.sum("n").alias("n_tokens"),
    )
    return whole.select(
        F.col("conv").alias(conv_col), "window", F.array_join("turns.drawn", "").alias("text"),
        F.col("context_turns").cast("int").alias("context_turns"), "loss", "n_tokens",
    )


def read_turns(text: Column) -> Column:
    """The turns of a rendered window: array of (role, text)."""
    blocks = F.filter(F.split(text, r"<\|turn\|>"), lambda b: b != "")

    def turn(block: Column) -> Column:
        line = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.char_length(line) + 2, F.char_length(block) - F.char_length(line) - 1 - len(END))
        return F.struct(unescape(_role(line)).alias("role"), unescape(body).alias("text"))

    return F.transform(blocks, turn)


def _role(line: Column) -> Column:
    """Line breaks of a role back; its other escapes stay for ``unescape``."""
    return F.array_join(F.transform(F.split(line, r"\\\\"), lambda p: F.replace(p, F.lit(r"\n"), F.lit("\n"))), r"\\")


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Conversations again from their windows: ``conv_col``, ``n_turns``, ``turns`` (role, line break, text, line break
    each, joined), ``learned`` (the texts under the loss mask, unescaped and joined) and ``formatted_chars``.

    One row holds a whole conversation here, which is what a digest of it needs.
    """
    own = F.slice(read_turns(F.col("text")), F.col("context_turns") + 1, F.greatest(F.size(F.split("text", r"<\|turn\|>")), F.lit(1)))
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    parts = windows.select(
        F.col(conv_col).alias("conv"), "window", own.alias("own"), F.array_join(learned, "").alias("learned"),
        F.char_length("text").cast("bigint").alias("chars"),
    ).select(
        "*", F.array_join(F.transform("own", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
    )
    whole = parts.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("window", "turns", "learned"))).alias("p"),
        F.sum(F.size("own")).cast("bigint").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
    )
    return whole.select(
        F.col("conv").alias(conv_col), "n_turns", F.array_join("p.turns", "").alias("turns"),
        F.array_join("p.learned", "").alias("learned"), "formatted_chars",
    )
