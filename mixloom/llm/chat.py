"""Chat formatting in budgeted windows, with DataFrame functions only.

Template of a turn: ``### Role: text</turn>`` and a newline. Inside roles and texts
``\\``, ``#``, ``<``, ``:`` (roles) and newlines (roles) are written as a backslash
and a letter, so control strings cannot occur there and can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 2
HISTORY_TOKENS = 256
END = "</turn>\n"
START = "### "

# fixed values: what stands for a character inside a text, and inside a role
_TEXT_MARKS = [("#", "\\h"), ("<", "\\l")]
_ROLE_MARKS = [*_TEXT_MARKS, (":", "\\c"), ("\n", "\\n")]


def escape(value: Column, role: bool = False) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\b"))
    for raw, mark in _ROLE_MARKS if role else _TEXT_MARKS:
        out = F.replace(out, F.lit(raw), F.lit(mark))
    return out


def unescape(value: Column, role: bool = False) -> Column:
    out = value
    for raw, mark in _ROLE_MARKS if role else _TEXT_MARKS:
        out = F.replace(out, F.lit(mark), F.lit(raw))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def token_count(text: Column) -> Column:
    """Words and single other signs, a cheap stand-in for a tokenizer's count."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]{1,6}|[^\s\p{L}\p{N}]")).cast("long")


def with_spans(turns: DataFrame) -> DataFrame:
    """``span`` and ``first`` (the position where it starts) of each turn.

    The prefix sum of tokens says in which stretch of ``room`` tokens a turn ends.
    Turns that end in the same stretch are a span if they fit the room together;
    otherwise the one that began in an earlier stretch stands alone. System turns
    add no tokens to the sum. Only a turn that is longer than the room exceeds it.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("pos")
    upto = by_turn.rowsBetween(Window.unboundedPreceding, 0)
    stretch = Window.partitionBy("conv_id", "_stretch")
    placed = (
        turns.withColumn("_sum", F.sum("tokens").over(upto))
        .withColumn("_stretch", F.floor(F.greatest(F.col("_sum") - 1, F.lit(0)) / F.col("room")))
        .withColumn("_across", F.col("_sum") - F.col("tokens") < F.col("_stretch") * F.col("room"))
        .withColumn("_alone", F.col("_across") & (F.sum("tokens").over(stretch) > F.col("room")))
    )
    key = F.struct("_stretch", ~F.col("_alone"))
    starts = F.when(F.lag(key).over(by_turn) == key, 0).otherwise(1)
    return (
        placed.withColumn("_start", starts)
        .withColumn("span", F.sum("_start").over(upto))
        .withColumn("first", F.max(F.when(F.col("_start") == 1, F.col("pos"))).over(upto))
        .drop("_sum", "_stretch", "_across", "_alone", "_start")
    )


def format_windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    history_tokens: int = HISTORY_TOKENS,
) -> DataFrame:
    """One row per window: conv_id, window (from 1), n_turns, repeated, tokens, text, loss.

    Each window holds the system turns before it, up to ``history`` turns repeated
    from just before it, and new turns; together they fit the budget unless one turn
    alone is longer or system turns take over half of it. ``repeated`` is how many leading
    turns were given before. ``loss`` lists (start, length) in code points of the
    text of new assistant turns; repeated ones are masked out.

    ``history_tokens`` bounds the repeated turns: a turn is repeated only if it and
    all between it and the window have no more tokens. Null texts and roles count
    as empty, rows with equal turn numbers follow role and text, null numbers come
    first and a null id is a conversation of its own.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("body"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    by_turn = Window.partitionBy("conv_id").orderBy("pos")
    whole = Window.partitionBy("conv_id")
    system = F.col("role") == "system"
    size = token_count(F.col("body")) + token_count(F.lit(START.strip() + END.strip()))
    retained = F.least(F.coalesce(F.sum(F.when(system, F.col("n"))).over(whole), F.lit(0)), F.lit(budget // 2))
    turns = (
        rows.withColumn("pos", F.row_number().over(order))
        .withColumn("n", size)
        .withColumn("tokens", F.when(system, 0).otherwise(F.col("n")))
        # the system turns' share and the history's come off the budget
        .withColumn("room", F.greatest(budget - history_tokens - retained, F.lit(1)))
    )
    spans = with_spans(turns).withColumn("last", F.max("span").over(whole))
    copy = lambda span, fresh: F.struct(span.alias("span"), F.lit(fresh).alias("fresh"))
    none = F.array().cast("array<struct<span:bigint,fresh:boolean>>")
    # where turn + k starts a later span, this turn is the k-th last before it
    followed = F.array(
        *[
            F.struct(
                F.lead("span", k).over(by_turn).alias("span"),
                ((F.lead("first", k).over(by_turn) == F.col("pos") + k)
                 & (F.sum("n").over(by_turn.rowsBetween(0, k - 1)) <= history_tokens)).alias("meets"),
            )
            for k in range(1, history + 1)
        ]
    ) if history else F.array().cast("array<struct<span:bigint,meets:boolean>>")
    spread = spans.withColumn("_followed", followed).withColumn(
        "copy",
        F.explode(
            F.concat(
                F.array(copy(F.col("span"), True)),
                F.when(
                    ~system,
                    F.transform(F.filter("_followed", lambda x: x["meets"]), lambda x: copy(x["span"], False)),
                )
                .when(
                    F.col("last") > F.col("span"),
                    F.transform(F.sequence(F.col("span") + 1, F.col("last")), lambda x: copy(x, False)),
                )
                .otherwise(none),
            )
        ),
    )
    fresh = F.col("copy.fresh")
    piece = F.struct(
        "pos",
        fresh.alias("fresh"),
        F.concat(F.lit(START), escape(F.col("role"), True), F.lit(": ")).alias("head"),
        escape(F.col("body")).alias("said"),
        (fresh & (F.col("role") == "assistant")).alias("target"),
    )
    windows = spread.groupBy("conv_id", F.col("copy.span").alias("window")).agg(
        F.sort_array(F.collect_list(piece)).alias("turns"), F.sum("n").alias("tokens")
    )
    # a turn's text starts after all turns before it and its own head
    sized = F.transform(
        "turns",
        lambda t: F.struct(
            t["target"].alias("target"),
            F.length(t["head"]).alias("head"),
            F.length(t["said"]).alias("said"),
        ),
    )
    no_loss = F.array().cast("array<struct<start:bigint,length:bigint>>")
    loss = F.aggregate(
        sized,
        F.struct(F.lit(0).alias("at"), no_loss.alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["head"] + t["said"] + len(END)).alias("at"),
            F.when(
                t["target"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + t["head"]).cast("long").alias("start"),
                            t["said"].cast("long").alias("length"),
                        )
                    ),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return windows.select(
        "conv_id",
        "window",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: ~t["fresh"])).cast("long").alias("repeated"),
        "tokens",
        F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["said"], F.lit(END)))).alias("text"),
        loss.alias("loss"),
    )


def read_turns(text: Column) -> Column:
    """Array of (role, text) of a formatted window."""
    parts = F.split(text, END)
    turns = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substr(t, F.lit(len(START) + 1), F.instr(t, ": ") - len(START) - 1), True).alias("role"),
            unescape(F.substr(t, F.instr(t, ": ") + 2)).alias("text"),
        ),
    )


def digest_conversations(windows: DataFrame) -> DataFrame:
    """Turns and loss texts of each conversation as read back from its windows."""
    read = windows.select(
        "conv_id",
        F.struct(
            "window",
            # turns that were given before come first
            F.slice(read_turns(F.col("text")), F.col("repeated").cast("int") + 1, F.col("n_turns").cast("int")).alias("turns"),
            F.transform(
                "loss", lambda s: unescape(F.substr(F.col("text"), s["start"].cast("int") + 1, s["length"].cast("int")))
            ).alias("loss"),
        ).alias("w"),
        F.length("text").cast("long").alias("n"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("w")).alias("w"), F.sum("n").alias("formatted_chars")
    )
    turns = F.flatten(F.transform("w", lambda w: w["turns"]))
    loss = F.concat_ws("", F.flatten(F.transform("w", lambda w: w["loss"])))
    return whole.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(
            F.concat_ws("", F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256
        ).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
