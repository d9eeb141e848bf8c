"""Scoring with plugged-in models, a text classifier, and parameter search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.classification import classification_report


def score_batches(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], size: int, out: str = "score") -> DataFrame:
    """Run a scorer over batches of at most ``size`` rows; ``load`` builds it once per task."""
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*df.schema.fields]).add(out, DoubleType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for frame in frames:
            for at in range(0, len(frame), size):
                batch = frame.iloc[at : at + size]
                yield batch.assign(**{out: score(batch)})

    return df.mapInPandas(run, schema)


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Row or batch mapper of your own, one Arrow batch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(run, schema)


def metric_from_pairs(pairs: DataFrame, compute: Callable[[pd.Series, pd.Series, pd.Series], float]) -> DataFrame:
    """A metric of your own over the table of (label, prediction, n): its size is classes squared."""
    metric = F.pandas_udf(compute, "double")
    return pairs.agg(metric("label", "prediction", "n").alias("metric"))


def _features(features: int, text: str) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\W+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_x"),
    ])


def _share_right(df: DataFrame, label: str) -> float:
    row = df.agg(F.avg((F.col("pred") == F.col(label)).cast("double")).alias("a")).first()
    return row["a"] or 0.0


def train_text_classifier(train: DataFrame, valid: DataFrame, *, text: str = "text", label: str = "label",
                          features: int = 1 << 12, rounds: tuple[int, ...] = (1, 4, 16), penalty: float = 0.01):
    """Fit with a growing number of passes, check each on the validation rows, keep the first best.

    Words are counted and weighed once; the fits read the stored features only.
    """
    prepare = _features(features, text).fit(train)
    known, held = (prepare.transform(rows).select(label, "_x").persist(StorageLevel.MEMORY_AND_DISK) for rows in (train, valid))
    best, best_score, history = None, -1.0, []
    try:
        for passes in rounds:
            model = LogisticRegression(featuresCol="_x", labelCol=label, predictionCol="pred", maxIter=passes, regParam=penalty).fit(known)
            score = _share_right(model.transform(held), label)
            history.append((passes, score))
            if score > best_score:
                best, best_score = model, score
    finally:
        known.unpersist(), held.unpersist()
    return PipelineModel([*prepare.stages, best]), history


def report_on(model, test: DataFrame, label: str = "label") -> DataFrame:
    return classification_report(model.transform(test).select(label, F.col("pred").cast("int").alias("pred")), label, "pred")


def _pick(key: Column, seed: int, low: Column, high: Column, step: Column) -> Column:
    """A value low, low + step, ... <= high chosen by hash."""
    count = F.floor((high - low) / step + 1e-9) + 1
    return low + step * F.pmod(F.xxhash64(key, F.lit(seed)), count)


def sample_trials(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Trials over the search space: rank 4..64 by 4, alpha rank..4 rank by 4, dropout 0.1..0.5 by 0.05."""
    ids = spark.range(1, n + 1).withColumnRenamed("id", "trial")
    t = F.col("trial")
    ranked = ids.withColumn("rank", _pick(t, seed, F.lit(4), F.lit(64), F.lit(4)).cast("int"))
    return ranked.select(
        "trial", "rank", _pick(t, seed + 1, F.col("rank"), F.col("rank") * 4, F.lit(4)).cast("int").alias("alpha"),
        F.round(_pick(t, seed + 2, F.lit(0.1), F.lit(0.5), F.lit(0.05)), 2).alias("dropout"))


def param_search(trials: DataFrame, objective: Callable[[dict], tuple[float, dict]], parallel: int = 2) -> list[dict]:
    """Run the objective on each trial (their number is chosen by the caller). A failed one costs infinity."""
    rows = [r.asDict() for r in trials.orderBy("trial").collect()]

    def attempt(params: dict) -> dict:
        try:
            loss, extra = objective(params)
        except Exception as error:  # noqa: BLE001 - a failing trial must not end the search
            loss, extra = math.inf, {"error": str(error)[:200]}
        return {**params, "loss": float(loss), **extra}

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(attempt, rows))


def best_trial(results: DataFrame) -> DataFrame:
    """Lowest loss; the earlier trial wins ties."""
    return results.orderBy("loss", "trial").limit(1)


def param_ranges(results: DataFrame, names: list[str]) -> DataFrame:
    """Smallest and largest value per parameter, and its value in the best trial."""
    best = F.struct("loss", "trial")
    row = results.agg(*[
        F.struct(F.lit(n).alias("param"), F.min(n).cast("double").alias("low"), F.max(n).cast("double").alias("high"),
                 F.min_by(n, best).cast("double").alias("best")).alias(n) for n in names])
    return row.select(F.inline(F.array(*names)))
