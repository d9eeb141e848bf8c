"""Ordered analytics that do not depend on how rows are spread over keys.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, and a window without a
key sends the whole table there. The functions here cut the order column into ranges of about
equal row count first. Windows then run inside (key, range); one summary row per (key, range) is
carried over the earlier ranges and joined back. A key that holds a third of all rows is worked on
by as many tasks as there are ranges, and the results equal those of the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.session import cut_lineage, spread

RANGE = "_range"


#: Rows that a range may have before more ranges are cut
ROWS_PER_RANGE = 1_000_000
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _marks(df: DataFrame, column: str, pieces: int | None) -> list[float]:
    """Values at which ranges of about equal height end; a value that fills several ranges is there several times."""
    pieces = pieces or max(spread(df.sparkSession), -(-df.count() // ROWS_PER_RANGE))
    probs = [i / pieces for i in range(1, pieces)]
    # a tenth of a range is close enough: the ranges only balance work
    return sorted(df.approxQuantile(column, probs, min(0.1 / pieces, 0.01))) if probs else []


def range_splits(df: DataFrame, column: str, pieces: int | None = None) -> list[float]:
    """Boundaries of about equal-height ranges of a numeric column; a list of ``pieces`` numbers."""
    return [float("-inf"), *sorted(set(_marks(df, column, pieces))), float("inf")]


def add_range(df: DataFrame, column: str, splits: Sequence[float]) -> DataFrame:
    """Attach the number of the range that ``column`` falls into."""
    widened = df.withColumn("_rangekey", F.col(column).cast("double"))
    cut = Bucketizer(splits=list(splits), inputCol="_rangekey", outputCol=RANGE, handleInvalid="keep")
    # nulls sort before all values
    return cut.transform(widened).drop("_rangekey").withColumn(RANGE, F.when(F.col(column).isNull(), -1).otherwise(F.col(RANGE).cast("int")))


def cut_ranges(df: DataFrame, order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """Attach the range of each row in the order of the whole key.

    A value of ``order[0]`` that fills two ranges or more gets a range of its own, which is cut again by ``order[1]``, so that
    one value in most rows does not put them all into one range. Text, times and the like are dealt by Spark's own range
    partitioning on the whole key, and written, so that the ranges stay what they are.
    """
    if dict(df.dtypes)[order[0]] not in NUMERIC:
        held = cut_lineage(df)
        pieces = pieces or max(spread(df.sparkSession), -(-held.count() // ROWS_PER_RANGE))
        dealt = held.repartitionByRange(pieces, *[F.col(c).asc_nulls_first() for c in order])
        return cut_lineage(dealt.withColumn(RANGE, F.spark_partition_id()))
    marks = _marks(df, order[0], pieces)
    heavy = {v: marks.count(v) for v in set(marks) if marks.count(v) > 1}
    if not heavy or len(order) < 2 or dict(df.dtypes)[order[1]] not in NUMERIC:
        return add_range(df, order[0], [float("-inf"), *sorted(set(marks)), float("inf")])
    values = sorted({*marks, *(math.nextafter(v, math.inf) for v in heavy)})
    splits = [float("-inf"), *values, float("inf")]
    cut = add_range(df, order[0], splits)
    bucket = {1 + values.index(v): n for v, n in heavy.items()}
    # one row per heavy value, as many numbers in all as there are ranges
    most = max(bucket.values()) + 1
    tied = cut.where(F.col(RANGE).isin(list(bucket))).groupBy(RANGE).agg(
        F.percentile_approx(F.col(order[1]).cast("double"), [i / most for i in range(1, most)], max(10_000, 20 * most)).alias("q"))
    inner = {r[RANGE]: sorted(set(r["q"])) for r in tied.collect()}
    places = F.create_map(*[x for k, q in inner.items() for x in (F.lit(k), F.array(*map(F.lit, q)))])
    within = F.size(F.filter(F.try_element_at(places, F.col(RANGE)), lambda m: m <= F.col(order[1]).cast("double")))
    return cut.withColumn(RANGE, F.col(RANGE).cast("long") * (1 << 20) + F.greatest(F.lit(0), F.coalesce(within, F.lit(0))))


_LOCAL = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Add running values per key. ``measures``: name -> (sum | count | max | min | last, column).

    ``order`` must be unique per key; its first column may be of any type that sorts, nulls come first. ``last`` is the latest non-null value.
    ``inclusive=False`` leaves the current row out.
    """
    cut = cut_ranges(df, order) if splits is None else add_range(df, order[0], splits)
    for name, (_, column) in measures.items():
        cut = cut.withColumn(f"_in_{name}", column)
    group = [*keys, RANGE]
    upto = 0 if inclusive else -1
    frame = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)

    local, totals, carried = [], [], []
    for name, (kind, _) in measures.items():
        source = F.col(f"_in_{name}")
        if kind == "last":
            local.append(F.last(source, ignorenulls=True).over(frame).alias(f"_loc_{name}"))
            latest = F.max(F.when(source.isNotNull(), F.struct(*order, source.alias("v"))))
            totals.append(latest["v"].alias(f"_tot_{name}"))
            carried.append(F.last(f"_tot_{name}", ignorenulls=True).over(before).alias(f"_car_{name}"))
        else:
            fold = _LOCAL[kind]
            local.append(fold(source).over(frame).alias(f"_loc_{name}"))
            totals.append(fold(source).alias(f"_tot_{name}"))
            outer = F.sum if kind == "count" else fold
            carried.append(outer(f"_tot_{name}").over(before).alias(f"_car_{name}"))
    summary = cut.groupBy(*group).agg(*totals).select(*group, *carried)
    joined = cut.select("*", *local).join(summary, group, "left")
    out = [
        _merge(kind, F.col(f"_car_{name}"), F.col(f"_loc_{name}")).alias(name)
        for name, (kind, _) in measures.items()
    ]
    kept = [c for c in df.columns if c not in measures]
    return joined.select(*kept, *out)


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, str],
    *,
    ahead: bool = False,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Add columns of the previous (or next) row per key. ``columns``: new name -> source column."""
    cut = cut_ranges(df, order) if splits is None else add_range(df, order[0], splits)
    group = [*keys, RANGE]
    inside = Window.partitionBy(*group).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(RANGE)
    packed = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    edge = F.struct(*order, packed.alias("v"))
    shift, pick = (F.lead, F.min) if ahead else (F.lag, F.max)
    summary = (
        cut.groupBy(*group)
        .agg(pick(edge)["v"].alias("_edge"))
        .select(*group, shift("_edge").over(across).alias("_far"))
    )
    joined = cut.select("*", shift(packed).over(inside).alias("_near")).join(summary, group, "left")
    found = joined.withColumn("_hit", F.coalesce("_near", "_far"))
    return found.select(*df.columns, *[F.col(f"_hit.{new}").alias(new) for new in columns])


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, **kw
) -> DataFrame:
    """Row numbers 1, 2, ... per key (or over the table) without one task sorting it all."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, **kw)


def count_below(points: DataFrame, probes: DataFrame, keys: Sequence[str], at: str, name: str) -> DataFrame:
    """For each probe row: how many points of the same keys have a value < its own. No pairs are built."""
    weights = points.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("_weight"))
    extra = [c for c in probes.columns if c not in (*keys, at)]
    seen = weights.select(*keys, at, F.lit(1).alias("_side"), "_weight",
                          *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra])
    asked = probes.select(*keys, at, F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_weight"), *extra)
    # at equal values a probe sorts before the point, so the bound is strict
    both = seen.unionByName(asked)
    counted = running(both, keys, [at, "_side"], {name: ("sum", F.col("_weight"))},
                      splits=range_splits(points, at))
    return counted.filter(F.col("_side") == 0).select(*keys, at, *extra, name)
