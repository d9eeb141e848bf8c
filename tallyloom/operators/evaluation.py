"""Reports over scored replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.answers import after_hashes, extract_answer, safe_float, same_known_number, same_number
from tallyloom.functions.rewards import SOFT, strip
from tallyloom.operators.ordered import running
from tallyloom.session import cut_lineage


def share(condition: Column) -> Column:
    """Percentage of rows that hold, to two decimals, from two whole counts."""
    return F.round(F.count_if(condition) * 100.0 / F.count(F.lit(1)), 2)


def mark_correct(df: DataFrame, reply: str, truth: str, out: str, *, truthy: bool = False) -> DataFrame:
    """Evaluation rule: both answers must exist and be equal. ``truthy`` also rules out empty text."""
    df = extract_answer(df, reply, "_found")
    right = same_known_number(F.col("_found"), F.col(truth))
    if truthy:
        right = right & (F.col("_found") != "") & (F.col(truth) != "")
    return df.withColumn(out, F.coalesce(right, F.lit(False))).drop("_found")


def completion_only(reply: Column, prompt: Column) -> Column:
    """A model's output without the prompt in front of it; an output that does not begin with the prompt stays as it is."""
    return F.when(F.startswith(reply, prompt), F.substring(reply, F.length(prompt) + 1, F.length(reply))).otherwise(reply)


def eval_accuracy(df: DataFrame, by: list[str], reply: str = "completion", truth: str = "answer", strip_prompt: str | None = None) -> DataFrame:
    """Correct answers and well-formed replies per group: one scan, partial aggregation.

    ``strip_prompt`` names a column with the prompt, for outputs that repeat it: its own tags must not be read as an answer.
    """
    if strip_prompt:
        df = df.withColumn(reply, completion_only(F.col(reply), F.col(strip_prompt)))
    marked = mark_correct(df, reply, truth, "_right").withColumn("_formed", F.col(reply).rlike(SOFT))
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("_right").alias("n_correct"),
        F.count_if("_formed").alias("n_formatted"),
        share(F.col("_right")).alias("accuracy_pct"),
        share(F.col("_formed")).alias("format_pct"),
    )


def group_advantage(df: DataFrame, group: str, reward: str, eps: float = 1e-4) -> DataFrame:
    """(reward - mean) / (std + eps) inside each prompt's generations.

    Group statistics are aggregated with map-side combine and joined back, so that a prompt with very
    many generations is not gathered in one task. The rewards are computed once and written.
    """
    df = cut_lineage(df)
    stats = df.groupBy(group).agg(
        F.avg(reward).alias("_mean"),
        F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_std"),
        F.min(reward).alias("_low"),
        F.max(reward).alias("_high"),
    )
    joined = df.join(stats, group)
    return joined.withColumn("advantage", (F.col(reward) - F.col("_mean")) / (F.col("_std") + eps)).withColumn(
        "informative", F.col("_low") != F.col("_high")
    ).drop("_mean", "_std", "_low", "_high")


def informative_groups(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Rows of the groups whose rewards differ; the rewards are computed once and written."""
    df = cut_lineage(df)
    kept = df.groupBy(group).agg(F.min(reward).alias("_low"), F.max(reward).alias("_high"))
    return df.join(kept.filter("_low <> _high").select(group), group, "left_semi")


def running_accuracy(df: DataFrame, order: str, right: str, by: list[str] | None = None) -> DataFrame:
    """Correct and total after each row. The rows are scored once and written: ranges, windows and summaries read them there."""
    out = running(cut_lineage(df), by or [], [order], {
        "n_total": ("count", F.lit(1)),
        "n_correct": ("sum", F.col(right).cast("long")),
    })
    return out.withColumn("accuracy_pct", F.round(F.col("n_correct") * 100.0 / F.col("n_total"), 2))


def extraction_audit(df: DataFrame) -> DataFrame:
    """Compare the extractor with the plain ``####`` rule per row of (split, idx, answer)."""
    both = extract_answer(df, "answer", "found").withColumn("plain", after_hashes(F.col("answer")))
    return both.select(
        "split", "idx", "found", "plain",
        safe_float(F.col("found")).isNull().alias("unparseable"),
        (~same_number(safe_float(F.col("found")), safe_float(F.col("plain")))).alias("mismatch"),
        F.coalesce(F.col("found").contains(","), F.lit(False)).alias("comma_kept"),
    )


def audit_totals(audit: DataFrame) -> DataFrame:
    return audit.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("mismatch").alias("n_mismatch"),
        F.count_if("unparseable").alias("n_unparseable"),
        F.count_if("comma_kept").alias("n_comma"),
    )


def fallback_recovery(df: DataFrame) -> DataFrame:
    """How often the last number of the reasoning equals the answer behind ``####``."""
    cut = df.withColumn("_reasoning", F.split_part("answer", F.lit("####"), F.lit(1)))
    cut = extract_answer(cut, "_reasoning", "_guess").withColumn("_plain", after_hashes(F.col("answer")))
    hit = F.col("_guess").isNotNull() & same_number(safe_float(F.col("_guess")), safe_float(F.col("_plain")))
    return cut.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_good"), share(hit).alias("good_pct"))


def compare_models(df: DataFrame, base: str, trained: str, by: list[str]) -> DataFrame:
    """Base against trained: shares and their differences."""
    def pct(model: str, flag: str) -> Column:
        mine = F.col("model") == model
        return F.round(F.count_if(mine & F.col(flag)) * 100.0 / F.nullif(F.count_if(mine), F.lit(0)), 2)

    shares = df.groupBy(*by).agg(
        *[F.count_if(F.col("model") == m).alias(f"n_{m}") for m in (base, trained)],
        *[pct(m, f).alias(f"{f}_{m}") for f in ("right", "formed") for m in (base, trained)],
    )
    return shares.select("*", *[
        F.round(F.col(f"{f}_{trained}") - F.col(f"{f}_{base}"), 2).alias(f"{f}_delta") for f in ("right", "formed")
    ])
