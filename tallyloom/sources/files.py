"""Document folders, JSON profiles and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """All files below a folder with digest, size and modification time."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        "path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("content"),
        F.col("length").alias("n_bytes"), F.unix_seconds("modificationTime").alias("mtime"))


def read_split(spark: SparkSession, path: str, split: str, column: str = "split") -> DataFrame:
    """One split of a dataset; with the split as a partition column other splits are not even listed."""
    return spark.read.parquet(path).filter(F.col(column) == split)


def read_json_or_default(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a fixed schema; no rows when the path does not exist."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; quotes doubled, so texts with line breaks survive."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, letters beyond ASCII kept."""
    df.write.mode("overwrite").json(path)


def write_result_lines(df: DataFrame, path: str) -> None:
    """``|``-joined result lines from typed columns."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns])
    df.select(text.alias("value")).write.mode("overwrite").text(path)
