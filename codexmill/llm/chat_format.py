"""Chat formatting in budgeted windows: DataFrame functions only.

Turns of a conversation are laid on a token axis by prefix sums. Spans of new turns
start where the axis enters a new half budget, or next to a turn longer than that, so
they end at turns and stay within the budget unless one turn alone exceeds it. A window
is the retained system turn, up to ``history`` turns before the span (as far as
``history_tokens`` go), then the span. Only assistant texts of the span are under the
loss mask; repeated ones are masked out, so each is a target exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a turn's markup beside its words.
MARKUP_TOKENS = 4


def escape(text: Column) -> Column:
    r"""Put one more backslash between < and |, so that no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _role(role: Column) -> Column:
    """Roles share a line with the start mark: line ends in them are written as \\n."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    # pairs of backslashes are read from the left; what lies between them holds none but those of \\n
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + F.lit(MARKUP_TOKENS)


def format_windows(conv: DataFrame, budget: int = 1024, history: int = 4, history_tokens: int = 256) -> DataFrame:
    """One row per window: conv_id, window, formatted, new_start, loss_spans, n_new, tokens.

    ``new_start`` is the code point where turns that are not repeated begin; for the first
    window that includes the system turn. ``loss_spans`` are [start, end) code points of
    target texts. Rows are taken by (turn, role, text); ties and repeated rows all stay.
    Null text or role: empty. Null turn: before all others. A null conv_id is a
    conversation of its own. Empty table: no windows. Other columns are not used.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conv.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("tok", tokens(F.col("text")).cast("long"))
    half = F.lit(max(1, (budget - history_tokens) // 2))
    turns = (
        rows.withColumn("at", F.row_number().over(order) - 1)
        .withColumn("to", F.sum("tok").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("cell", F.floor((F.col("to") - F.col("tok")) / half))
        .withColumn("big", F.col("tok") > half)
        .withColumn("opens", ((F.col("at") == 0) | F.col("big") | F.lag("big", 1, False).over(order) | (F.col("cell") != F.lag("cell", 1, -1).over(order))).cast("int"))
        .withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    )
    # what each turn says as a repeat of a later window is read off the same prefix sums
    whole = (
        turns.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "tok", "to", "span"))).alias("turns"))
        .withColumn("sys", F.when(F.get("turns", F.lit(0))["role"] == "system", F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0)))
    )
    heads = turns.groupBy("conv_id", "span").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    spans = heads.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("span", "first", "last"))).alias("spans"))
    both = whole.join(spans, whole["conv_id"].eqNullSafe(spans["conv_id"])).drop(spans["conv_id"])
    per = both.select("conv_id", "sys", "turns", F.explode("spans").alias("s")).select(
        "conv_id",
        F.col("s.span").alias("window"),
        F.expr("slice(turns, s.first + 1, s.last - s.first + 1)").alias("new"),
        F.when(F.col("s.first") > 0, F.col("sys")).otherwise(F.slice("sys", 1, 0)).alias("kept"),
        F.expr(f"slice(turns, greatest(1 + size(sys), s.first + 1 - {int(history)}), least({int(history)}, greatest(0, s.first - size(sys))))").alias("old"),
    )
    base = F.expr("new[0].to - new[0].tok")
    per = per.withColumn("old", F.filter("old", lambda t: base - (t["to"] - t["tok"]) <= F.lit(history_tokens)))
    written = lambda t: F.concat(F.lit(START), _role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END), F.lit("\n"))
    lead = lambda t: F.char_length(F.concat(F.lit(START), _role(t["role"]), F.lit("\n")))
    per = (
        per.withColumn("repeated", F.concat("kept", "old"))
        .withColumn("head", F.array_join(F.transform("repeated", written), ""))
        .withColumn("new_start", F.char_length("head"))
        .withColumn("parts", F.transform("new", lambda t: F.struct(written(t).alias("w"), (t["role"] == "assistant").alias("target"), lead(t).alias("lead"), F.char_length(escape(t["text"])).alias("len"))))
        .withColumn("formatted", F.concat("head", F.array_join(F.transform("parts", lambda p: p["w"]), "")))
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")
    step = lambda acc, p: F.struct(
        (acc["at"] + F.char_length(p["w"])).alias("at"),
        F.when(p["target"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["lead"]).alias("start"), (acc["at"] + p["lead"] + p["len"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    return per.select(
        "conv_id",
        "window",
        "formatted",
        "new_start",
        F.aggregate("parts", F.struct(F.col("new_start").alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"]).alias("loss_spans"),
        F.size("new").alias("n_new"),
        F.expr("aggregate(concat(repeated, new), 0L, (a, t) -> a + t.tok)").alias("tokens"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Per conversation what the formatted windows say: turns, target text, sizes.

    conv_id, n_turns, turns (array of role, text), loss_text, formatted_chars. Only the
    windows' own columns are read, so this inverts ``format_windows``.
    """
    fresh = F.split(F.expr("substring(formatted, new_start + 1)"), r"\Q" + START + r"\E", -1)
    parsed = windows.withColumn("_p", F.slice(fresh, 2, F.greatest(F.size(fresh) - 1, F.lit(0)))).withColumn(
        "_turns",
        F.transform(
            "_p",
            lambda p: F.struct(
                _unrole(F.substring_index(p, "\n", 1)).alias("role"),
                unescape(F.substring(p, F.char_length(F.substring_index(p, "\n", 1)) + 2, F.char_length(p) - F.char_length(F.substring_index(p, "\n", 1)) - F.lit(2 + len(END)))).alias("text"),
            ),
        ),
    )
    parsed = parsed.withColumn("_loss", F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), ""))
    return (
        parsed.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("window", "_turns", "_loss", F.char_length("formatted").cast("long").alias("_len")))).alias("_w"))
        .select(
            "conv_id",
            F.flatten(F.transform("_w", lambda w: w["_turns"])).alias("turns"),
            F.array_join(F.transform("_w", lambda w: w["_loss"]), "").alias("loss_text"),
            F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + w["_len"]).alias("formatted_chars"),
        )
        .withColumn("n_turns", F.size("turns").cast("long"))
    )
