"""Classification metrics and the choice of an epoch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators.ordered import number_rows, running


def argmax(values: Column) -> Column:
    """Index of the first maximum, from 0."""
    return F.array_position(values, F.array_max(values)) - 1


def sigmoid_label(logit: Column) -> Column:
    return F.when(1.0 / (1.0 + F.exp(-logit)) > 0.5, 1).otherwise(0)


def bce_with_logits(logit: Column, label: Column) -> Column:
    """Binary cross-entropy that does not overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def cross_entropy(logits: Column, target: Column, smoothing: float = 0.0) -> Column:
    """Cross-entropy of one row of logits; ``target`` counts from 0."""
    wide = logits.cast("array<double>")
    top = F.array_max(wide)
    log_sum = top + F.log(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))
    hit = log_sum - F.get(wide, target)
    if not smoothing:
        return hit
    mean = log_sum - F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x) / F.size(wide)
    return (1 - smoothing) * hit + smoothing * mean


def with_batches(df: DataFrame, order: str, size: int, by: list[str] | None = None) -> DataFrame:
    """Number of the fixed-size batch each row falls into, from 0, in stored order."""
    rows = number_rows(df, by or [], [order], "_nth")
    return rows.withColumn("batch", F.floor((F.col("_nth") - 1) / size)).drop("_nth")


def batch_mean_loss(df: DataFrame, order: str, loss: str, size: int, by: list[str]) -> DataFrame:
    """Mean of per-batch means: a short last batch weighs as much as a full one."""
    means = with_batches(df, order, size, by).groupBy(*by, "batch").agg(F.avg(loss).alias("_mean"))
    return means.groupBy(*by).agg(F.count(F.lit(1)).alias("n_batches"), F.avg("_mean").alias("loss"))


def accuracy(df: DataFrame, label: str, prediction: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy")
    )


def ratio(top: Column, bottom: Column) -> Column:
    """Undefined ratios are 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def binary_prf(df: DataFrame, label: str, prediction: str, by: list[str]) -> DataFrame:
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col(label) == 1) & (F.col(prediction) == 1)).alias("tp"),
        F.count_if((F.col(label) == 0) & (F.col(prediction) == 1)).alias("fp"),
        F.count_if((F.col(label) == 1) & (F.col(prediction) == 0)).alias("fn"),
        F.count_if(F.col(label) == F.col(prediction)).alias("n_right"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *by, ratio(F.col("n_right"), F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per-class rows plus accuracy, macro and weighted averages, from the table of class pairs."""
    pairs = confusion_counts(df, label, prediction)
    # every pair counts once for its true class and once for the class it was given
    sides = pairs.select(
        F.explode(F.array(
            F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given"),
                     F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given"),
                     F.lit(0).cast("long").alias("hit")),
        )).alias("s")
    ).select("s.*")
    per_class = sides.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "given", "hit")]).select(
        "cls", "support", "hit",
        ratio(F.col("hit"), F.col("given")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("given") + F.col("support")).alias("f1"),
    )
    scores = ["precision", "recall", "f1"]
    rows = F.sum("support").alias("support")
    macro = per_class.agg(*[F.avg(c).alias(c) for c in scores], rows)
    weighted = per_class.agg(*[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in scores], rows)
    overall = per_class.agg(ratio(F.sum("hit"), F.sum("support")).alias("f1"), rows)
    parts = [
        per_class.select(F.col("cls").cast("string").alias("name"), *scores, "support"),
        macro.select(F.lit("macro avg").alias("name"), *scores, "support"),
        weighted.select(F.lit("weighted avg").alias("name"), *scores, "support"),
        overall.select(F.lit("accuracy").alias("name"), F.lit(None).cast("double").alias("precision"),
                       F.lit(None).cast("double").alias("recall"), "f1", "support"),
    ]
    return reduce(DataFrame.unionByName, parts)


def batch_progress(df: DataFrame, order: str, right: str, size: int, every: int) -> DataFrame:
    """Accuracy so far after batches 0, every, 2 * every, ..."""
    so_far = running(df, [], [order], {"n_total": ("count", F.lit(1)), "n_right": ("sum", F.col(right).cast("long"))})
    batch = F.floor((F.col("n_total") - 1) / size)
    ends = so_far.withColumn("batch", batch).filter(F.col("batch") % every == 0)
    return ends.groupBy("batch").agg(F.max("n_total").alias("n_total"), F.max("n_right").alias("n_right")).withColumn(
        "accuracy", F.col("n_right") / F.col("n_total")
    )


def best_epoch_strict(df: DataFrame) -> DataFrame:
    """First epoch that reaches the highest accuracy."""
    return df.groupBy("run").agg(
        F.max_by("epoch", F.struct("eval_acc", -F.col("epoch"))).alias("best_epoch"), F.max("eval_acc").alias("best_acc")
    )


def best_epoch_by_loss(df: DataFrame) -> DataFrame:
    return df.groupBy("run").agg(
        F.min_by("epoch", F.struct("eval_loss", "epoch")).alias("best_epoch"), F.min("eval_loss").alias("best_loss")
    )


def early_stop(df: DataFrame, metric: str, patience: int) -> DataFrame:
    """Where training halts when ``metric`` has not risen for ``patience`` evaluations in a row.

    A run has as many rows as it has epochs, so its history fits a plain window.
    """
    w = Window.partitionBy("run").orderBy("epoch")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = df.select(
        "run", "epoch", metric, F.row_number().over(w).alias("nth"), F.max(metric).over(past).alias("_before")
    ).withColumn("_rose", F.col("_before").isNull() | (F.col(metric) > F.col("_before")))
    since = F.max(F.when(F.col("_rose"), F.col("nth"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("_last", since).withColumn("_halt", F.col("nth") - F.col("_last") >= patience)
    stops = marked.groupBy("run").agg(
        F.min(F.when(F.col("_halt"), F.col("nth"))).alias("_stop_nth"),
        F.max("nth").alias("_all"),
        F.min_by("_last", F.when(F.col("_halt"), F.col("nth"))).alias("_stop_best"),
        F.max("_last").alias("_end_best"),
    )
    return stops.select(
        "run", F.col("_stop_nth").isNotNull().alias("stopped_early"),
        F.coalesce("_stop_nth", "_all").cast("long").alias("epochs_run"),
        F.coalesce("_stop_best", "_end_best").cast("long").alias("best_nth"),
    )


def plateau_lr(df: DataFrame, metric: str, lr: float, factor: float = 0.1, patience: int = 2,
               threshold: float = 1e-4) -> DataFrame:
    """Learning rate after each epoch when it drops after more than ``patience`` epochs without a rise.

    Each value depends on the one before, so a run's short history is folded as one sorted array.
    """
    start = F.struct(
        F.lit(lr).alias("lr"), F.lit(float("-inf")).alias("best"), F.lit(0).alias("bad"),
        F.array().cast("array<struct<epoch:bigint,lr:double>>").alias("seen"),
    )

    def step(acc, row):
        better = (acc["best"] == float("-inf")) | (row["m"] > acc["best"] * (1 + threshold))
        bad = F.when(better, 0).otherwise(acc["bad"] + 1)
        cut = bad > patience
        rate = F.when(cut, acc["lr"] * factor).otherwise(acc["lr"])
        return F.struct(
            rate.alias("lr"), F.when(better, row["m"]).otherwise(acc["best"]).alias("best"),
            F.when(cut, 0).otherwise(bad).alias("bad"),
            F.array_append(acc["seen"], F.struct(row["epoch"].alias("epoch"), rate.alias("lr"))).alias("seen"),
        )

    history = df.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", F.col(metric).alias("m")))).alias("h"))
    return history.select("run", F.explode(F.aggregate("h", start, step, lambda a: a["seen"])).alias("e")).select("run", "e.*")


def chance_level_runs(df: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Runs that never left coin-flip accuracy and a loss of ln 2."""
    flat = (F.col("eval_acc") == 0.5) & (F.abs(F.col("eval_loss") - F.log(F.lit(2.0))) < tolerance)
    return df.groupBy("run").agg(F.bool_and(flat).alias("at_chance"), F.count(F.lit(1)).alias("n_epochs"))
