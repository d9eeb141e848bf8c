"""Printed benchmark results, server replies and checkpoints as typed columns.

Each ``parse_*`` works on a column of text, each ``read_*`` on files; both keep bad rows and flag them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the two shapes of a result line
RESULT_FIELDS = ["model", "task", "run", "verdict", "score", "secs", "fails"]
RESULT_FIELDS_NO_RUN = ["model", "task", "verdict", "score", "secs", "fails"]


def parse_result_lines(df: DataFrame, line: str = "line", *, with_run: bool = True) -> DataFrame:
    """``model|task|run|verdict|score|secs|fails`` to columns; the older form has no run."""
    names = RESULT_FIELDS if with_run else RESULT_FIELDS_NO_RUN
    cells = F.split(F.col(line), r"\|", len(names))
    kept = [c for c in df.columns if c != line]
    cut = df.select(*kept, *[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])
    out = cut.withColumn("secs", F.regexp_replace("secs", "s$", "").try_cast("long"))
    out = out.withColumn("score", F.nullif("score", F.lit("-")))
    if with_run:
        out = out.withColumn("run", F.col("run").try_cast("long"))
    none = F.array().cast("array<string>")
    return out.withColumn("fails", F.when(F.coalesce("fails", F.lit("")) == "", none).otherwise(F.split("fails", ",")))


def read_result_lines(spark: SparkSession, path: str, *, with_run: bool = True) -> DataFrame:
    return parse_result_lines(spark.read.text(path).withColumnRenamed("value", "line"), with_run=with_run)


def parse_items(df: DataFrame, line: str = "line") -> DataFrame:
    """``name|PASS or FAIL|note`` to columns."""
    cells = F.split(F.col(line), r"\|", 3)
    kept = [c for c in df.columns if c != line]
    return df.select(*kept, cells[0].alias("item"), (cells[1] == "PASS").alias("ok"), F.get(cells, F.lit(2)).alias("note"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item files of many runs; the folder of a file names its run."""
    lines = spark.read.text(path)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1)
    return parse_items(lines.select(run.alias("run"), F.col("value").alias("line")))


def _number(json: Column, path: str, kind: str) -> Column:
    return F.get_json_object(json, path).try_cast(kind)


def parse_server_timings(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Counts and speeds of a server reply. One without timings is flagged, not fatal."""
    schema = "timings struct<prompt_n:bigint,prompt_per_second:double,predicted_n:bigint,predicted_per_second:double>"
    kept = [c for c in df.columns if c != reply]
    parsed = df.select(*kept, F.from_json(reply, schema)["timings"].alias("t"))
    return parsed.select(
        *kept, F.col("t").isNull().alias("failed"), F.col("t.prompt_n").alias("prompt_n"),
        F.when(F.col("t").isNotNull(), F.coalesce("t.prompt_per_second", F.lit(0.0))).alias("pp"),
        F.col("t.predicted_n").alias("gen_n"),
        F.when(F.col("t").isNotNull(), F.coalesce("t.predicted_per_second", F.lit(0.0))).alias("tg"))


def parse_timed_reply(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Nanosecond counters to tokens per second; an error field wins. A missing duration counts as 1 ns."""
    schema = ("error string, prompt_eval_count bigint, prompt_eval_duration bigint, eval_count bigint, "
              "eval_duration bigint, load_duration bigint")
    kept = [c for c in df.columns if c != reply]
    r = df.select(*kept, F.from_json(reply, schema).alias("r"))

    def default(name: str, value: int) -> Column:
        return F.coalesce(f"r.{name}", F.lit(value))

    fine = F.col("r.error").isNull()
    pp = F.try_divide(default("prompt_eval_count", 0), default("prompt_eval_duration", 1) / 1e9)
    tg = F.try_divide(default("eval_count", 0), default("eval_duration", 1) / 1e9)
    return r.select(
        *kept, F.col("r.error").alias("error"), F.when(fine, default("prompt_eval_count", 0)).alias("prompt_n"), F.when(fine, pp).alias("pp"),
        F.when(fine, default("eval_count", 0)).alias("gen_n"), F.when(fine, tg).alias("tg"),
        F.when(fine, default("load_duration", 0) / 1e9).alias("load_secs"))


def parse_pipe_table(df: DataFrame, out: str) -> DataFrame:
    """Rows of a printed pipe table: array of trimmed cells per line that starts with a pipe."""
    kept = [c for c in df.columns if c != out]
    lines = df.select(*kept, F.posexplode(F.split(out, "\n")).alias("line_no", "_line")).filter(F.col("_line").startswith("|"))
    inner = F.regexp_replace("_line", r"^\||\|\s*$", "")
    return lines.select(*kept, "line_no", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))


def read_pipe_table(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("out"))
    return parse_pipe_table(lines, "out")


def latest_checkpoint(paths: DataFrame, by: list[str]) -> DataFrame:
    """Path with the highest checkpoint number, compared as a number; NULL where there is none."""
    n = F.nullif(F.regexp_extract("path", r"checkpoint-(\d+)/?$", 1), F.lit("")).try_cast("long")
    return paths.withColumn("_n", n).groupBy(*by).agg(F.max_by("path", "_n").alias("path"), F.max("_n").alias("n"))
