"""Chat formatting in budgeted windows.

Turns become marked, escaped pieces. A running sum of turn tokens cuts a conversation into turn-aligned
spans; each window holds the system turn, a limited history of turns before its span, then the span.
The loss covers assistant texts of the span alone, so each is learned once. DataFrame expressions
throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: What counts as a token: a run of ASCII letters and digits, or one other visible character.
TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"
TURN_TOKENS = 4


def escaped(c: Column) -> Column:
    r"""Text without control strings: \ becomes \\, <| becomes <\|."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(c: Column) -> Column:
    r"""As escaped(); a line feed becomes \-, for the role ends at the first."""
    return F.replace(escaped(c), F.lit("\n"), F.lit("\\-"))


def unescaped(c: Column) -> Column:
    """The inverse of escaped() and escaped_role()."""
    parts = F.transform(
        F.split(c, r"\\\\", -1),
        lambda p: F.replace(F.replace(p, F.lit("\\-"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")),
    )
    return F.array_join(parts, "\\")


def format_windows(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = 512,
    history: int = 128,
    least: int = 64,
) -> DataFrame:
    """conv_id, window, n_context, n_tokens, formatted, loss_spans: a row per window.

    n_context: leading turns repeated from before the window's span. loss_spans: array of
    (start, length) in code points of `formatted`. A span takes turns while their tokens stay within
    budget - system - history (`least` at least, if the system turn leaves it); history is what the
    span leaves of the budget, `history` at most. So n_tokens is within the budget, unless one turn
    with the system turn is larger; that turn stands whole in a window of its own. Turns go by turn
    number, ties by role, then text, nulls first; equal rows are turns of their own. Null roles and
    texts count as empty; a null conversation id is a conversation. Columns of df besides the four
    are ignored; an empty table gives no window.
    """
    if min(budget, least) < 1 or history < 0:
        raise ValueError("budget and least must be positive, history not negative")
    turns = df.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    body = F.when(~F.col("is_system"), F.col("tokens")).otherwise(0)
    turns = (
        turns.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)) + TURN_TOKENS)
        .withColumn("seq", F.row_number().over(order))
        .withColumn("is_system", (F.col("seq") == 1) & (F.col("role") == "system"))
        .withColumn("before", F.sum(body).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - body)
        .withColumn("system_tokens", F.sum(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    free = F.lit(budget) - F.col("system_tokens")
    turns = _starts(turns.withColumn("room", F.greatest(free - history, F.least(free, F.lit(least)))))
    steps = F.when(F.col("room") < 1, 0).otherwise(F.least(2 * F.floor(F.lit(history) / F.col("room")) + 2, F.lit(history // TURN_TOKENS + 1)))
    turns = (
        turns.withColumn("own", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("last", F.max("own").over(Window.partitionBy("conv_id")))
    )
    reach = F.when(F.col("is_system"), F.col("last")).otherwise(F.least("last", F.col("own") + steps))
    piece = F.concat(F.lit(START), F.col("head"), F.lit("\n"), F.col("body"), F.lit(END))
    window = Window.partitionBy("conv_id", "window")
    spent = F.sum(F.when(F.col("target") | F.col("is_system"), F.col("tokens")).otherwise(0)).over(window)
    placed = (
        turns.withColumn("window", F.explode(F.sequence(F.col("own"), reach.cast("bigint"))))
        .withColumn("target", F.col("window") == F.col("own"))
        .withColumn("begin", F.min(F.when(F.col("target") & ~F.col("is_system"), F.col("before"))).over(window))
        .withColumn("allowed", F.least(F.lit(history), F.lit(budget) - spent))
        .where(F.col("target") | F.col("is_system") | (F.col("begin") - F.col("before") <= F.col("allowed")))
        .withColumn("head", escaped_role(F.col("role")))
        .withColumn("body", escaped(F.col("text")))
        .withColumn("piece", piece)
        .withColumn("offset", F.sum(F.length("piece")).over(window.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("piece"))
    )
    learned = F.col("target") & (F.col("role") == "assistant")
    start = F.col("offset") + len(START) + F.length("head") + 1
    rows = placed.groupBy("conv_id", "window").agg(
        F.count(F.when(~F.col("target"), 1)).alias("n_context"),
        F.sum("tokens").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(learned, F.struct(start.cast("bigint").alias("start"), F.length("body").cast("bigint").alias("length"))))).alias("loss_spans"),
    )
    return rows.select("conv_id", "window", "n_context", "n_tokens", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss_spans")


def _starts(turns: DataFrame) -> DataFrame:
    """turns with new: 1 where a span starts (but the first), for the next turn would pass the room."""

    def step(s: Column, t: Column) -> Column:
        fits = s["n"] + t["tokens"] <= t["room"]
        return F.struct(
            F.when(t["is_system"], s["n"]).when(fits | (s["n"] == 0), s["n"] + t["tokens"]).otherwise(t["tokens"]).alias("n"),
            F.when(t["is_system"] | fits | (s["n"] == 0), s["at"]).otherwise(F.concat(s["at"], F.array(t["seq"]))).alias("at"),
        )

    told = F.array_sort(F.collect_list(F.struct("seq", F.col("tokens").cast("bigint").alias("tokens"), "is_system", F.col("room").cast("bigint").alias("room"))))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.expr("cast(array() as array<int>)").alias("at"))
    cuts = turns.groupBy("conv_id").agg(F.aggregate(told, none, step)["at"].alias("at")).select(F.col("conv_id").alias("_conv"), F.explode("at").alias("_at"))
    marked = turns.join(cuts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("seq") == F.col("_at")), "left")
    return marked.withColumn("new", F.when(F.col("_at").isNotNull(), 1).otherwise(0)).drop("_conv", "_at")


def read_back(windows: DataFrame) -> DataFrame:
    """Windows as conversations: conv_id, n_turns, dialogue, loss_text, formatted_chars.

    dialogue has role, line feed, text, line feed of each turn, parsed from `formatted` with the
    repeated context left out; loss_text is all text under the loss mask, unescaped.
    """

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substr(p, F.length(role) + 2)
        return F.concat(unescaped(F.substr(role, F.lit(len(START) + 1))), F.lit("\n"), unescaped(text), F.lit("\n"))

    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    parsed = (
        windows.withColumn("all", pieces)
        .withColumn("own", F.slice("all", F.col("n_context").cast("int") + 1, F.greatest(F.size("all") - 1 - F.col("n_context").cast("int"), F.lit(0))))
        .select(
            "conv_id",
            "window",
            F.size("own").alias("turns"),
            F.array_join(F.transform("own", turn), "").alias("said"),
            F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "").alias("learned"),
            F.length("formatted").alias("chars"),
        )
    )
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", c))), lambda x: x[c]), "")
    return parsed.groupBy("conv_id").agg(
        F.sum("turns").cast("long").alias("n_turns"),
        joined("said").alias("dialogue"),
        joined("learned").alias("loss_text"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
