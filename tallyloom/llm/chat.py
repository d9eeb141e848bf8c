"""Relational chat formatting: turns are collected, sorted, merged and joined by Spark expressions only.

Template, for each run of neighbouring turns of one role::

    <|turn|>ROLE<|body|>TEXT<|join|>TEXT...<|end|>

Inside roles and texts a backslash is written ``\\e`` and ``<`` is written ``\\l``. An escaped text holds no ``<``, hence no
control string, and every backslash in it starts a two-letter code, so that the way back is unambiguous. ``<|join|>`` keeps
the borders of merged turns, which makes the formatted text hold all that the rows held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, JOIN, END = "<|turn|>", "<|body|>", "<|join|>", "<|end|>"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def _pattern(mark: str) -> str:
    return mark.replace("|", "\\|")


def _segments(run: Column) -> Column:
    """One merged turn as pieces (s, loss) in order; only the texts of the learnt role are under the loss mask."""
    learnt = run[0]["role"] == LEARNT
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    off = F.lit(False)
    texts = F.transform(run, lambda t, i: F.array(piece(F.when(i == 0, F.lit("")).otherwise(F.lit(JOIN)), off), piece(escape(t["text"]), learnt)))
    head = F.array(piece(F.concat(F.lit(TURN), escape(run[0]["role"]), F.lit(BODY)), off))
    return F.concat(head, F.flatten(texts), F.array(piece(F.lit(END), off)))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) to one row per conversation: conv_id, formatted, loss (array of start, end: code points).

    Turns are sorted by number, then role and text (a null number first); rows that are alike all stay. A null role or text
    is the empty one. Rows without a conv_id are one conversation of that id. An empty table gives no rows.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t")
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.col("t")[i]["role"] != F.col("t")[i - 1]["role"]))
    bounds = sorted_turns.withColumn("b", F.concat(starts, F.array(F.size("t"))))
    runs = bounds.withColumn("runs", F.transform(F.slice("b", F.lit(1), F.size("b") - 1), lambda s, k: F.slice("t", s + 1, F.col("b")[k + 1] - s)))
    cut = runs.select("conv_id", F.flatten(F.transform("runs", _segments)).alias("segments"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans"))

    def step(acc, x):
        to = acc["at"] + F.length(x["s"])
        span = F.array(F.struct(acc["at"].alias("start"), to.alias("end")))
        return F.struct(to.alias("at"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return cut.select("conv_id", F.array_join(F.transform("segments", lambda x: x["s"]), "").alias("formatted"), F.aggregate("segments", zero, step)["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Undo the template: conv_id, turns (array of role, text) and loss_text (all text under the mask, nothing between)."""
    runs = F.slice(F.split("formatted", _pattern(TURN), -1), 2, 1 << 30)

    def parts(run):
        role, body = F.split(run, _pattern(BODY), -1)[0], F.split(run, _pattern(BODY), -1)[1]
        texts = F.split(F.replace(body, F.lit(END), F.lit("")), _pattern(JOIN), -1)
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    under = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(runs, parts)).alias("turns"), F.array_join(under, "").alias("loss_text"))


def digests(back: DataFrame) -> DataFrame:
    """The counts and digests of what was read back."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
