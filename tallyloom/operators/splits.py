"""Deterministic shuffles, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.session import spread

ROWS_PER_CELL = 1_000_000


def keyed_hash(seed: int, *keys: Column) -> Column:
    """60 bits of the md5 of seed and keys, written with slashes between: other engines can state it too."""
    text = F.concat_ws("/", F.lit(seed).cast("string"), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def hash_order(key: str, seed: int) -> Column:
    return keyed_hash(seed, F.col(key))


def seeded_shuffle(df: DataFrame, key: str, seed: int, name: str = "position") -> DataFrame:
    """Each row's place in a reproducible permutation, from 1.

    Hashes are uniform, so their leading bits cut the table into ranges of equal height without a
    sample: rows are ranked inside a range and shifted by the size of the ranges before it.
    """
    cells = max(spread(df.sparkSession), -(-df.count() // ROWS_PER_CELL))
    marked = df.withColumn("_hash", hash_order(key, seed)).withColumn("_cell", F.shiftright("_hash", 60 - (cells - 1).bit_length()))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy("_hash", key))
    # one row per range
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).select(
        "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = marked.withColumn("_inside", inside).join(sizes, "_cell")
    return placed.withColumn(name, F.col("_inside") + F.col("_before")).drop("_hash", "_cell", "_inside", "_before")


def shuffled_head(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """First n rows of the permutation, as a top-n instead of a full sort."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def train_val_test(train: DataFrame, test: DataFrame, key: str, n_train: int, n_val: int, n_test: int, seed: int) -> DataFrame:
    """Exact split sizes: the first rows of one permutation for training and validation, others for testing."""
    pool = seeded_shuffle(train, key, seed).filter(F.col("position") <= n_train + n_val)
    part = F.when(F.col("position") <= n_train, "train").otherwise("validation")
    held = seeded_shuffle(test, key, seed).filter(F.col("position") <= n_test)
    return pool.withColumn("part", part).unionByName(held.withColumn("part", F.lit("test")))


def head_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """First n rows in stored order."""
    return df.orderBy(order).limit(n)


def scope_filter(df: DataFrame, scope: str | None) -> DataFrame:
    """No scope: all rows. A scope: its own rows and the common ones."""
    if scope is None:
        return df
    return df.filter(F.coalesce("scope", F.lit("")).isin("", scope))


def exclude_recent(prefs: Column, seen: Column, last: int = 3) -> Column:
    """Preferences not among the last few seen; all of them when none is left, or nothing was seen. Null preferences are none."""
    none = F.array().cast("array<string>")
    prefs, seen = F.coalesce(prefs, none), F.coalesce(seen, none)
    recent = F.slice(seen, F.greatest(F.lit(1), F.size(seen) - (last - 1)), F.lit(last))
    fresh = F.filter(prefs, lambda p: ~F.array_contains(recent, p))
    return F.when(F.size(fresh) == 0, prefs).otherwise(fresh)


def truncation_filter(df: DataFrame, reply: str, n_tokens: Column, cap: int) -> DataFrame:
    """Replies that ran into the length limit before closing their answer."""
    return df.filter((n_tokens >= cap) & ~F.col(reply).contains("</answer>"))


def hash_choice(options: Column, key: Column, seed: int) -> Column:
    """One option per key, the same on every run; NULL for an empty list."""
    size = F.size(options)
    return F.when(size > 0, F.try_element_at(options, (F.pmod(keyed_hash(seed, key), F.greatest(size, F.lit(1))) + 1).cast("int")))


def hash_shuffle(options: Column, key: Column, seed: int) -> Column:
    """Options in an order that depends on the key only."""
    tagged = F.transform(options, lambda x, i: F.struct(keyed_hash(seed, key, i).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda s: s["x"])
