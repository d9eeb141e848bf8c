"""What the operators of this subpackage share: readers of a table's needed columns, and run settings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import bounded_batches


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only these two columns, a null text as the empty one. Other columns of the input, whatever their names, play no part."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def per_text(docs: DataFrame, function: Callable[[list[bytes]], dict[str, list]], schema: pa.Schema, sql_schema: str) -> DataFrame:
    """One row for each of ``id_and_text(docs)``: ``doc_id`` and the columns that ``function`` makes of the UTF-8 texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[f.name], f.type) for f in schema)], names=["doc_id", *schema.names])

    return docs.mapInArrow(run, f"doc_id long, {sql_schema}")


def words(raw: bytes) -> list[bytes]:
    """Runs of bytes other than the six ASCII blanks, with A-Z in lower case."""
    return raw.lower().split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def crc_of_id(mod: int, key: str = "doc_id"):
    """crc32 of the id written as text, modulo ``mod``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % mod


def free_name(name: str, taken: list[str]) -> str:
    """A column name that is not among those taken, whatever their case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name
