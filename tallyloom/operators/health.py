"""Checks on training runs: parsed logs, tensors, token batches and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators.ordered import neighbour
from tallyloom.session import cut_lineage

INF = float("inf")


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def step_sample(df: DataFrame) -> DataFrame:
    """The first ten steps and every 25th."""
    return df.filter((F.col("step") <= 10) | (F.col("step") % 25 == 0))


def kl_verdict(df: DataFrame, resumed_after: int, guard: float = 1.0) -> DataFrame:
    """First logged KL per run; a resumed run starts late and says nothing."""
    first = df.filter("kl IS NOT NULL").groupBy("run").agg(F.min("step").alias("first_step"), F.min_by("kl", "step").alias("first_kl"))
    verdict = (
        F.when(F.col("first_step") > resumed_after, "inconclusive").when(F.col("first_kl") < guard, "healthy").otherwise("sick")
    )
    return first.withColumn("verdict", verdict)


def nonfinite_rate(df: DataFrame) -> DataFrame:
    g = F.col("grad_norm")
    return df.filter(g.isNotNull()).groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.isnan(g)).alias("n_nan"),
        F.count_if(F.abs(g) == INF).alias("n_inf"), F.count_if(is_finite(g)).alias("n_finite"),
    )


def tripwire(df: DataFrame, limit: float = 1.0) -> DataFrame:
    """First step where the adapter magnitude exceeds the limit."""
    return df.filter(F.col("b_max") > limit).groupBy("run").agg(
        F.min("step").alias("first_step"), F.min_by("b_max", "step").alias("b_max"), F.count(F.lit(1)).alias("n_over")
    )


def growth_factor(df: DataFrame, splits: list[float] | None = None) -> DataFrame:
    """Magnitude over the previous logged magnitude of the run. ``splits``: known ranges of steps, if any. Logs are parsed once."""
    seen = cut_lineage(df.filter("b_max IS NOT NULL").select("run", "step", "b_max"))
    out = neighbour(seen, ["run"], ["step"], {"b_before": "b_max"}, splits=splits)
    return out.withColumn("factor", F.try_divide("b_max", "b_before"))


def constant_growth(growth: DataFrame, factor: float = 256.0, tolerance: float = 0.05) -> DataFrame:
    """Runs whose magnitude grows by the same factor at every step."""
    near = F.abs(F.col("factor") / factor - 1) <= tolerance
    return growth.filter("factor IS NOT NULL").groupBy("run").agg(
        F.bool_and(near).alias("constant"), F.min("factor").alias("low"), F.max("factor").alias("high")
    )


def no_op_runs(df: DataFrame) -> DataFrame:
    """Runs whose adapter stays at 0, or whose optimizer sees no usable gradient."""
    return df.filter("b_max IS NOT NULL OR seen_grads IS NOT NULL").groupBy("run").agg(
        F.coalesce(F.max("b_max") == 0, F.lit(False)).alias("never_moves"),
        F.coalesce(F.bool_and((F.col("nonzero_grads") == 0) | (F.col("nonzero_grads") <= F.col("nonfinite"))), F.lit(False)).alias("no_gradients"),
    )


def has_nonfinite(values: Column) -> Column:
    return F.exists(values, lambda x: F.isnan(x) | (F.abs(x) == INF))


def nonfinite_tensors(df: DataFrame, by: str, show: int = 5) -> DataFrame:
    """Count of tensors with NaN or infinity per group, and the first few names."""
    bad = df.filter(has_nonfinite(F.col("vals"))).select(by, "name")
    first = (
        bad.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy("name"))).filter(F.col("_nth") <= show)
        .groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("first_names"))
    )
    return bad.groupBy(by).agg(F.count(F.lit(1)).alias("n_bad")).join(first, by)


def token_id_range(df: DataFrame, vocab: int) -> DataFrame:
    low, high = F.array_min("ids"), F.array_max("ids")
    return df.select("*", low.alias("low"), high.alias("high"), ((low < 0) | (high >= vocab)).alias("violates"))


def abs_sum(values: Column) -> Column:
    return F.aggregate(values.cast("array<double>"), F.lit(0.0), lambda acc, x: acc + F.abs(x))


def abs_max(values: Column) -> Column:
    """Largest magnitude; two native passes instead of a lambda."""
    return F.greatest(F.abs(F.array_max(values)), F.abs(F.array_min(values)))


def checksum_drift(df: DataFrame) -> DataFrame:
    """Per (name, snap): sum of magnitudes against the tensor's first snapshot."""
    sums = df.select("name", "snap", abs_sum(F.col("vals")).alias("total"))
    first = sums.groupBy("name").agg(F.min_by("total", "snap").alias("start"))
    return sums.join(first, "name").withColumn("moved", F.col("total") != F.col("start"))


def absmax_by_kind(df: DataFrame) -> DataFrame:
    kind = F.nullif(F.regexp_extract("name", r"(lora_[AB])", 1), F.lit(""))
    return df.select(kind.alias("part"), abs_max(F.col("vals")).cast("double").alias("m")).filter("part IS NOT NULL").groupBy("part").agg(
        F.max("m").alias("abs_max"), F.count(F.lit(1)).alias("n"))


def hook_counts(df: DataFrame, by: str = "step") -> DataFrame:
    """Per step: gradients seen, missing, non-zero, not finite."""
    size = abs_max(F.col("vals")).cast("double")
    bad = has_nonfinite(F.col("vals"))
    return df.groupBy(by).agg(
        F.count("vals").alias("present"), F.count_if(F.col("vals").isNull()).alias("absent"),
        F.count_if(F.col("vals").isNotNull() & (bad | (size > 0))).alias("nonzero"),
        F.count_if(bad).alias("nonfinite"), F.max(F.when(~bad, size)).alias("abs_max"),
    )


def diff_tensors(a: DataFrame, b: DataFrame, max_diff: float = 0.05, max_abs: float = 1e4) -> DataFrame:
    """Compare tensors by name: one row per name on either side."""
    left = a.select("name", F.col("vals").alias("va"))
    right = b.select("name", F.col("vals").alias("vb"))
    gap = F.array_max(F.zip_with(F.col("va").cast("array<double>"), F.col("vb").cast("array<double>"), lambda x, y: F.abs(x - y)))
    both = left.join(right, "name", "full_outer")
    out = both.select("name", F.col("va").isNotNull().alias("in_a"), F.col("vb").isNotNull().alias("in_b"),
                      gap.alias("max_diff"), F.when(F.col("vb").isNotNull(), abs_max(F.col("va")).cast("double")).alias("abs_max"))
    return out.withColumn("bad", F.coalesce((F.col("max_diff") > max_diff) | (F.col("abs_max") > max_abs), F.lit(False)))


def diff_verdict(diff: DataFrame) -> DataFrame:
    totals = diff.agg(
        F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("n_common"),
        F.count_if("bad").alias("n_bad"), F.max("max_diff").alias("worst"),
    )
    ok = (F.col("n_bad") == 0) & (F.col("n_common") > 0) & (F.col("n_a") == F.col("n_b"))
    return totals.withColumn("verdict", F.when(ok, "PASS").otherwise("FAIL"))


def reward_windows(df: DataFrame, width: int = 50) -> DataFrame:
    return df.filter("reward IS NOT NULL").groupBy("run", F.floor(F.col("step") / width).alias("win")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward"))


def flat_rewards(windows: DataFrame, band: float) -> DataFrame:
    """Runs whose window means all lie within a narrow band."""
    return windows.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_windows"), F.min("mean_reward").alias("low"), F.max("mean_reward").alias("high"),
        (F.max("mean_reward") - F.min("mean_reward") <= band).alias("flat"))


def epoch_times(df: DataFrame) -> DataFrame:
    """Seconds between the checkpoints of a run, and since its first. One row per epoch, so a plain window."""
    w = Window.partitionBy("run").orderBy("epoch")
    return df.select("run", "epoch", (F.col("ts1") - F.lag("ts1").over(w)).alias("secs"),
                     (F.col("ts1") - F.first("ts1").over(w)).alias("total_secs"))


def relative_change(df: DataFrame, key: str, variant: str, base: str, new: str, measures: list[str]) -> DataFrame:
    """Percentage change of mean measures, new against base; one pass instead of a self-join."""
    def mean(m: str, v: str) -> Column:
        return F.avg(F.when(F.col(variant) == v, F.col(m)))

    means = df.groupBy(key).agg(*[mean(m, v).alias(f"{m}_{v}") for m in measures for v in (base, new)])
    return means.select(key, *[
        F.round((F.try_divide(F.col(f"{m}_{new}"), F.col(f"{m}_{base}")) - 1) * 100, 1).alias(f"{m}_pct") for m in measures])


def throughput(df: DataFrame, samples: str, secs: Column, batch: int, accumulate: int) -> DataFrame:
    return df.select("*", F.lit(batch * accumulate).alias("effective_batch"), F.try_divide(F.col(samples), secs).alias("samples_per_s"))


def progress(df: DataFrame) -> DataFrame:
    """Where each run is: batches done, steps left."""
    lines = df.filter("batch IS NOT NULL")
    return lines.groupBy("run").agg(
        F.max("batch").alias("batch"), F.max("batches").alias("batches"), F.max("step").alias("step"),
        F.min(F.col("step_max") - F.col("step")).alias("steps_left"), F.max_by("epoch", "step").alias("epoch"))
