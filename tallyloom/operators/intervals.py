"""Bookings, free slots, range counts and other ordered reports. No pairs of rows are built."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators.ordered import RANGE, add_range, count_below, number_rows, range_splits, running
from tallyloom.session import cut_lineage


def overlap_counts(bookings: DataFrame) -> DataFrame:
    """For each valid half-open [s, e): how many others of its resource overlap it. Adjacent ones do not.

    Those that start before my end, less those that end no later than my start, less myself.
    """
    valid = bookings.filter("s < e").select("resource", "seq", "s", "e")

    def mark(at: str, side: int, starts: int, ends: int, sign: int):
        # at equal times a question (side 0) sorts before the bounds (side 1), so it counts those strictly below
        return F.struct(F.expr(at).alias("at"), F.lit(side).alias("side"), F.lit(starts).alias("starts"), F.lit(ends).alias("ends"), F.lit(sign).alias("sign"))

    marks = F.array(mark("s", 1, 1, 0, 0), mark("e", 1, 0, 1, 0), mark("e", 0, 0, 0, 1), mark("s + 1", 0, 0, 0, -1))
    line = valid.select("resource", "seq", F.explode(marks).alias("m")).select("resource", "seq", "m.*")
    swept = running(line, ["resource"], ["at", "side", "seq", "starts"], {
        "began": ("sum", F.col("starts")), "ended": ("sum", F.col("ends"))}, splits=range_splits(valid, "s"))
    asked = swept.filter("side = 0")
    gain = F.when(F.col("sign") == 1, F.col("began")).otherwise(-F.col("ended"))
    return asked.groupBy("resource", "seq").agg((F.sum(gain) - 1).alias("n_overlaps"))


def with_span(bookings: DataFrame) -> DataFrame:
    """Number the connected stretch of time each booking belongs to, per resource."""
    splits = range_splits(bookings, "s")
    reach = running(bookings, ["resource"], ["s", "e", "seq"], {"_reach": ("max", F.col("e"))}, inclusive=False, splits=splits)
    opens = F.when(F.col("_reach").isNull() | (F.col("s") > F.col("_reach")), 1).otherwise(0)
    return running(reach.withColumn("_opens", opens).drop("_reach"), ["resource"], ["s", "e", "seq"], {"span": ("sum", F.col("_opens"))}, splits=splits).drop("_opens")


def merge_intervals(bookings: DataFrame) -> DataFrame:
    """Merged busy spans per resource."""
    return with_span(bookings.filter("s < e")).groupBy("resource", "span").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))


#: Before the first span and behind the last one all time is free
NEVER = 1 << 60
PARTS = 4


def next_free(spans: DataFrame, asked: DataFrame) -> DataFrame:
    """Earliest start >= t of a free slot of length d, for queries (resource, q_id, t, d) over merged spans.

    Time is cut into ranges of about equal height, so a busy resource is many cells (resource, range) of bounded size. A cell knows
    its gaps, the gap that runs into it and its longest gap. A query looks into the cell of its t, where a tree of longest gaps leads it
    to the first one that is long enough; if there is none, the longest gaps of the later cells name the one cell to look into.
    """
    splits = range_splits(asked, "t")
    keys = ["resource", RANGE]
    # spans are apart, so their starts and their ends are in the same order
    cells = add_range(spans.select("resource", "s", "e"), "s", splits).groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("s"), F.array_sort(F.collect_list("e")).alias("e"))
    probes = add_range(asked.select("resource", "q_id", "t", "d"), "t", splits)
    # one row per cell that has spans or queries
    grid = cut_lineage(cells.join(probes.select(*keys).distinct(), keys, "full_outer"))
    over = Window.partitionBy("resource").orderBy(RANGE)
    # the summary of a cell without its spans: a row per resource and range
    edges = grid.select(*keys, F.get("s", F.lit(0)).alias("_first"), F.get("e", F.size("e") - 1).alias("_last")).select(
        *keys, F.coalesce(F.last("_last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-NEVER)).alias("before"),
        F.coalesce(F.first("_first", True).over(over.rowsBetween(1, Window.unboundedFollowing)), F.lit(NEVER)).alias("after"))
    inner = F.transform("e", lambda e, i: F.coalesce(F.get("s", i + 1), F.col("after")) - e)
    whole = cut_lineage(grid.join(edges, keys).withColumn("longest", F.array_max(inner)))
    # cells of one range meet their queries in a few groups, so that many small cells cost little
    part = F.pmod(F.xxhash64("resource"), F.lit(PARTS)).cast("int").alias("part")

    def look(questions: DataFrame) -> DataFrame:
        held = whole.select(part, *keys, "s", "e", "before", "after").groupBy(RANGE, "part")
        return questions.select("*", part).groupBy(RANGE, "part").cogroup(held).applyInPandas(_first_gaps, f"resource long, {RANGE} int, q_id long, t long, d long, free_at long")

    found = cut_lineage(look(probes))
    done = found.where("free_at IS NOT NULL")
    # per resource the longest gap of each range: as many entries as there are ranges
    reach = whole.where("longest IS NOT NULL").groupBy("resource").agg(F.array_sort(F.collect_list(F.struct(F.col(RANGE).alias("r"), F.col("longest").alias("n")))).alias("reach"))
    target = F.filter("reach", lambda x: (x["r"] > F.col(RANGE)) & (x["n"] >= F.col("d")))[0]["r"]
    later = found.where("free_at IS NULL").join(reach, "resource").select("resource", "q_id", F.lit(-NEVER).alias("t"), "d", target.alias(RANGE))
    return done.unionByName(look(later)).select("resource", "q_id", "free_at")


def _first_gaps(asked: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    """For the queries of some cells the first free time there, null if there is none; t of -NEVER asks for gaps that begin in the cell.

    The gaps of all cells are one list, ordered by cell and time, so that many small cells cost no more than a large one.
    """
    made = asked[["resource", RANGE, "q_id", "t", "d"]].assign(free_at=pd.array([pd.NA] * len(asked), dtype="Int64"))
    if not len(asked):
        return made
    wanted, mine = np.unique(asked["resource"].to_numpy(), return_inverse=True)
    cells = cells[cells["resource"].isin(wanted)].sort_values("resource")
    starts, ends = ([np.asarray([] if v is None else v, np.int64) for v in cells[c]] for c in ("s", "e"))
    sizes = np.fromiter(map(len, starts), np.int64, len(cells)) + 1
    last = np.cumsum(sizes)
    first = last - sizes
    begin, until = np.empty(last[-1], np.int64), np.empty(last[-1], np.int64)
    inside, ending = np.ones(last[-1], bool), np.ones(last[-1], bool)
    inside[first] = ending[last - 1] = False
    begin[first], until[last - 1] = cells["before"].to_numpy(np.int64), cells["after"].to_numpy(np.int64)
    begin[inside], until[ending] = np.concatenate(ends), np.concatenate(starts)
    t, d = asked["t"].to_numpy(np.int64), asked["d"].to_numpy(np.int64)
    # gaps and queries in one order: a query comes behind the gaps of its cell that begin at its t or earlier
    order = np.lexsort((np.r_[np.zeros(len(begin), np.int8), np.ones(len(t), np.int8)], np.r_[begin, t], np.r_[np.repeat(np.arange(len(cells)), sizes), mine]))
    seen = np.cumsum(order < len(begin))
    is_query = order >= len(begin)
    behind = np.empty(len(t), np.int64)
    behind[order[is_query] - len(begin)] = seen[is_query]
    # the gap that runs at t, or the one behind the span that does
    at = np.maximum(behind - 1, first[mine])
    fits = (t > -NEVER) & (until[at] - np.maximum(t, begin[at]) >= d)
    place = at
    if not fits.all():
        place = np.where(fits, at, first_at_least(until - begin, at + 1, d))
    answer = np.where(place < last[mine], np.maximum(t, begin[np.minimum(place, len(begin) - 1)]), NEVER)
    made["free_at"] = pd.array(answer, dtype="Int64")
    made.loc[answer == NEVER, "free_at"] = pd.NA
    return made


def first_at_least(values: np.ndarray, start: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each query the first index from ``start`` on whose value is ``least`` or more, by a tree of greatest values; their number if there is none."""
    n = len(values)
    size = 1 << max(0, int(n - 1).bit_length())
    tree = np.full(2 * size, -(1 << 62), np.int64)
    tree[size : size + n] = values
    for level in range(size.bit_length() - 2, -1, -1):
        nodes = np.arange(1 << level, 2 << level)
        tree[nodes] = np.maximum(tree[2 * nodes], tree[2 * nodes + 1])
    node, open_ones = np.minimum(start, size - 1) + size, start < n
    # up to the first node to the right that holds enough
    up = open_ones.copy()
    while up.any():
        good = tree[node] >= least
        up &= ~good
        right_edge = (node & (node + 1)) == 0
        open_ones &= ~(up & right_edge)
        up &= ~right_edge
        node = np.where(up, np.where(node % 2 == 1, (node + 1) // 2, node + 1), node)
    down = open_ones & (node < size)
    while down.any():
        left = 2 * node
        node = np.where(down, np.where(tree[np.minimum(left, 2 * size - 1)] >= least, left, left + 1), node)
        down = open_ones & (node < size)
    return np.where(open_ones, node - size, n)


def range_counts(events: DataFrame, asked: DataFrame) -> DataFrame:
    """Events with lo <= t < hi per query (q_id, lo, hi): two positions in one ordered pass."""
    ends = asked.select("q_id", F.explode(F.array(
        F.struct(F.col("lo").alias("at"), F.lit(-1).alias("sign")), F.struct(F.greatest("lo", "hi").alias("at"), F.lit(1).alias("sign")))).alias("b")).select("q_id", "b.*")
    counted = count_below(events.select(F.col("t").alias("at")), ends, [], "at", "below")
    return counted.groupBy("q_id").agg(F.sum(F.col("sign") * F.coalesce("below", F.lit(0))).alias("n"))


def cart_totals(actions: DataFrame) -> DataFrame:
    """Total of each cart in whole cents; a checkout closes the cart of its customer."""
    cut = running(actions, ["customer"], ["seq"], {"cart": ("sum", F.col("is_checkout").cast("long"))}, inclusive=False)
    cut = cut.withColumn("cart", F.coalesce("cart", F.lit(0)))
    return cut.groupBy("customer", "cart").agg(
        F.coalesce(F.sum(F.when(~F.col("is_checkout"), F.col("qty") * F.col("unit_cents"))), F.lit(0)).alias("total_cents"),
        F.count_if(~F.col("is_checkout")).alias("n_items"), F.bool_or("is_checkout").alias("checked_out"))


def median_mode(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Exact median (mean of the middle two) and mode (first seen wins ties) per key.

    The middle ranks come from range-wise numbering, so a key's values are never held together.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    ranked = number_rows(df.select(key, value, order), [key], [value, order], "_rank").join(sizes, key)
    middle = ranked.filter((F.col("_rank") == F.floor((F.col("n") + 1) / 2)) | (F.col("_rank") == F.floor((F.col("n") + 2) / 2)))
    medians = middle.groupBy(key).agg(((F.min(value) + F.max(value)) / 2).alias("median"), F.max("n").alias("n"))
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"), F.min(order).alias("_first"))
    modes = counts.groupBy(key).agg(F.max_by(value, F.struct("_c", -F.col("_first"))).alias("mode"))
    return medians.join(modes, key)


def live_entries(events: DataFrame, capacity: int, ttl: int, now: int) -> DataFrame:
    """Cache content at ``now``: last value per key put within ttl, the most recently used up to capacity.

    Right when no get asks for a key that was evicted before; the keyed fold covers that case.
    """
    is_put = F.col("op") == "put"
    keys = events.filter(F.col("t") <= now).groupBy("tenant", "key").agg(
        F.max_by("val", F.when(is_put, F.col("seq"))).alias("val"), F.max(F.when(is_put, F.col("t"))).alias("put_at"), F.max("seq").alias("used"))
    live = keys.filter((F.col("put_at").isNotNull()) & (F.lit(now) - F.col("put_at") <= ttl))
    w = Window.partitionBy("tenant").orderBy(F.desc("used"))
    return live.withColumn("recency", F.row_number().over(w).cast("long")).filter(F.col("recency") <= capacity)
