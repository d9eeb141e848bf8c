"""Rows that every operator has to take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, score string, fingerprint string, length int, sequence_id string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [None, "", "   \n\t", "one", "The same text twice, word for word, with a few more words behind.", "The same text twice, word for word, with a few more words behind.", "Ünïcode Straße — naïve “quotes” 東京 😀", "x" * 3000, LONG, "don't we're I'll it's!! <|endoftext|> ok"]


def rows():
    made = [(i, t, "clash", "clash", 1, "clash") for i, t in enumerate(TEXTS)]
    return [*made, made[4], made[4], (None, "no id", None, None, None, None), (None, None, None, None, None, None)]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is None, str(x)) for x in r)
