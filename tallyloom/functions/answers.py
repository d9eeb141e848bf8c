"""Reading a final answer out of a model reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import strip

# fixed values: tag, number and separator shapes the answer format prescribes
ANSWER_TAG = r"(?s)<answer>(.*?)</answer>"
MIXED_FRACTION = r"(?U)\A(-?\d+)\s+(\d+)\s*/\s*(\d+)\z"
CURRENCY_AND_SPACE = "(?U)[$€£\\s]"
PLAIN_NUMBER = r"(?U)\A-?\d+(\.\d+)?\z"
ANY_NUMBER = r"(?U)-?(?:\d{1,3}(?:[ ,]\d{3})+|\d+)(?:\.\d+)?"
HASHES = "####"
INTEGER_SHAPE = r"(?U)\A[+-]?\d+(?:_\d+)*\z"
FLOAT_SHAPE = (
    r"(?iU)\A[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?\z"
)


def after_hashes(text: Column) -> Column:
    """The piece behind the first ``####``, stripped, without commas; NULL when there is none."""
    piece = F.split_part(text, F.lit(HASHES), F.lit(2))
    return F.when(text.contains(HASHES), F.replace(strip(piece), F.lit(","), F.lit("")))


def last_number(text: Column) -> Column:
    hit = F.try_element_at(F.regexp_extract_all(text, F.lit(ANY_NUMBER), F.lit(0)), F.lit(-1))
    return F.translate(hit, ", ", "")


def _mixed_value(body: Column) -> Column:
    whole = F.regexp_extract(body, MIXED_FRACTION, 1)
    top = F.regexp_extract(body, MIXED_FRACTION, 2).try_cast("double")
    bottom = F.regexp_extract(body, MIXED_FRACTION, 3).try_cast("double")
    size = F.abs(whole.try_cast("double")) + F.try_divide(top, bottom)
    signed = F.when(whole.startswith("-"), -size).otherwise(size)
    return F.when(body.rlike(MIXED_FRACTION) & (bottom != 0), signed.cast("string"))


def extract_answer(df: DataFrame, text: str, out: str, *, mixed: bool = True) -> DataFrame:
    """Add the final answer as text: tagged answer, else behind ``####``, else the last number.

    The tag body gets a projection of its own, since each later step looks at it again.
    """
    body = F.when(F.col(text).rlike(ANSWER_TAG), strip(F.regexp_extract(text, ANSWER_TAG, 1)))
    df = df.withColumn("_body", body)
    df = df.withColumn("_bare", F.replace(F.regexp_replace("_body", CURRENCY_AND_SPACE, ""), F.lit(","), F.lit("")))
    steps = [
        F.when(F.col("_bare").rlike(PLAIN_NUMBER), F.col("_bare")),
        after_hashes(F.col(text)),
        last_number(F.col(text)),
    ]
    if mixed:
        steps.insert(0, _mixed_value(F.col("_body")))
    return df.withColumn(out, F.coalesce(*steps)).drop("_body", "_bare")


def safe_float(text: Column) -> Column:
    """Number of a text after dropping commas, by Python's rules; NULL when it is none."""
    bare = strip(F.replace(text, F.lit(","), F.lit("")))
    word = F.lower(F.regexp_replace(bare, r"\A[+-]", ""))
    special = F.when(word == "nan", F.lit(float("nan"))).when(
        word.isin("inf", "infinity"),
        F.when(bare.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))),
    )
    number = F.when(bare.rlike(FLOAT_SHAPE), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))
    return F.coalesce(number, special)


def is_integer_like(text: Column) -> Column:
    return F.coalesce(strip(text).rlike(INTEGER_SHAPE), F.lit(False))


def same_number(a: Column, b: Column) -> Column:
    """Equality of two optional numbers where NULL equals NULL and NaN equals nothing."""
    return F.coalesce(a.eqNullSafe(b) & ~F.isnan(F.coalesce(a, F.lit(0.0))), F.lit(False))


def same_known_number(a: Column, b: Column) -> Column:
    """Equality for evaluation: both texts must exist; two non-numbers still count as equal."""
    return a.isNotNull() & b.isNotNull() & same_number(safe_float(a), safe_float(b))
