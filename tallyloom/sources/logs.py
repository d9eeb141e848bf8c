"""Training logs: lines of text to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the shapes of log lines
_NUM = r"([-+]?(?:\d[\d.]*(?:e[-+]?\d+)?|nan|inf))"
FIELDS: dict[str, tuple[str, str]] = {
    "step": (r"(?:step |'step': )(\d+)", "long"),
    "step_max": (r"step \d+/(\d+)", "long"),
    "batch": (r"batch (\d+)/\d+", "long"),
    "batches": (r"batch \d+/(\d+)", "long"),
    "epoch": (r"epoch " + _NUM, "double"),
    "loss": (r"'loss': " + _NUM, "double"),
    "grad_norm": (r"'grad_norm': " + _NUM, "double"),
    "reward": (r"'reward': " + _NUM, "double"),
    "kl": (r"'kl': " + _NUM, "double"),
    "b_max": (r"\|B\|max=" + _NUM, "double"),
    "a_max": (r"\|A\|max=" + _NUM, "double"),
    "grad_max": (r"(?:grad\|max|absmax)=" + _NUM, "double"),
    "nonfinite": (r"non-finite(?:\(B grads\))?=(\d+)", "long"),
    "total": (r"non-finite\(B grads\)=\d+/(\d+)", "long"),
    "seen_grads": (r"optimizer sees: (\d+) grads", "long"),
    "none_grads": (r"\((\d+) None\)", "long"),
    "nonzero_grads": (r"None\), nonzero=(\d+)", "long"),
    "hook_calls": (r"calls=(\d+)", "long"),
    "hook_nonzero": (r"calls=\d+, nonzero=(\d+)", "long"),
    "hook_nonfinite": (r"calls=\d+, nonzero=\d+, non-finite=(\d+)", "long"),
    "base_drift": (r"base-drift: (.+?) \|", "string"),
}


# plain text that each match contains: a quick look that spares most lines the regex
MARKS = {
    "step_max": "step ", "batch": "batch ", "batches": "batch ", "epoch": "epoch ", "loss": "'loss': ", "grad_norm": "'grad_norm': ",
    "reward": "'reward': ", "kl": "'kl': ", "b_max": "|B|max=", "a_max": "|A|max=", "grad_max": "max=", "nonfinite": "non-finite",
    "total": "non-finite(B grads)=", "seen_grads": "optimizer sees: ", "none_grads": " None)", "nonzero_grads": "None), nonzero=",
    "hook_calls": "calls=", "hook_nonzero": "calls=", "hook_nonfinite": "calls=", "base_drift": "base-drift: ",
}


def _field(line: Column, name: str) -> Column:
    pattern, kind = FIELDS[name]
    hit = F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    if name in MARKS:
        hit = F.when(line.contains(MARKS[name]), hit)
    return hit.alias(name) if kind == "string" else hit.try_cast(kind).alias(name)


def parse_training_log(lines: DataFrame, line: str = "line", fields: tuple[str, ...] | None = None) -> DataFrame:
    """Add typed columns for the fields a line mentions; ask only for those you need."""
    return lines.select("*", *[_field(F.col(line), name) for name in fields or FIELDS])


def read_training_log(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """Lines of log files with the run named by the file, parsed. Batch or stream."""
    reader = spark.readStream if stream else spark.read
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return parse_training_log(reader.text(path).select(run.alias("run"), F.col("value").alias("line")))
