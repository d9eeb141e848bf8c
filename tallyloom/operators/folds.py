"""Order-dependent decisions: each row depends on what was accepted before it.

Rows are partitioned by key, sorted, and streamed through one pass that keeps only the running state
of the current key. No group is gathered in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.intervals import with_span


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """``step(state, row) -> (state, rows)`` over each key in order; at a key's end ``step(state, None)``."""
    width = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in schema.split(",")]
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = tuple(row[:width])
                if key != current:
                    if current is not None:
                        out += step(current, state, None)[1]
                    current, state = key, None
                state, rows = step(current, state, row)
                out += rows
            if out:
                yield pd.DataFrame(out, columns=names)
        if current is not None:
            rows = step(current, state, None)[1]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    first = [*keys, *[c for c in df.columns if c not in keys]]
    return df.select(*first).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def accept_bookings(requests: DataFrame) -> DataFrame:
    """Keep each booking iff it overlaps none kept before; exact cancels free their slot.

    Requests in separate stretches of time cannot meet, so a busy resource splits into its stretches.
    """
    valid = with_span(requests.filter("s < e"))
    invalid = requests.filter("s >= e").select("resource", "seq", F.lit("invalid").alias("outcome"))

    def step(key, state, row):
        from bisect import bisect_left, insort

        if row is None:
            return state, []
        kept = [] if state is None else state
        slot = (row.s, row.e)
        at = bisect_left(kept, slot)
        there = at < len(kept) and kept[at] == slot
        if row.is_cancel:
            if there:
                kept.pop(at)
            outcome = "cancelled" if there else "not found"
        elif (at < len(kept) and kept[at][0] < row.e) or (at > 0 and kept[at - 1][1] > row.s):
            outcome = "rejected"
        else:
            insort(kept, slot)
            outcome = "booked"
        return kept, [(key[0], row.seq, outcome)]

    rows = valid.select("resource", "span", "seq", "s", "e", "is_cancel")
    return sorted_fold(rows, ["resource", "span"], ["seq"], step, "resource long, seq long, outcome string").unionByName(invalid)


def order_step(state: dict | None, event: str, amount: int, total: int) -> tuple[dict, bool]:
    """One event of an order's life; returns the new state and whether the event was accepted."""
    s = dict(state) if state else {"state": "new", "paid": 0, "refund": 0, "history": "new", "rejected": 0}
    here, then = s["state"], None
    if event == "pay" and here == "new" and s["paid"] + amount <= total:
        s["paid"] += amount
        then = "paid" if s["paid"] == total else "new"
    elif event == "ship" and here == "paid":
        then = "shipped"
    elif event == "deliver" and here == "shipped":
        then = "delivered"
    elif event == "cancel" and here in ("new", "paid"):
        s["refund"], then = s["paid"], "cancelled"
    if then is None:
        s["rejected"] += 1
        return s, False
    if then != here:
        s["state"], s["history"] = then, s["history"] + ">" + then
    return s, True


ORDER_SCHEMA = "order_id long, state string, paid long, refund long, history string, rejected long"


def order_states(events: DataFrame) -> DataFrame:
    """Where each order ends: state, payments, refund, visited states, rejected events."""

    def step(key, state, row):
        if row is None:
            return state, [(key[0], state["state"], state["paid"], state["refund"], state["history"], state["rejected"])]
        return order_step(state, row.event, row.amount, row.total)[0], []

    rows = events.select("order_id", "seq", "event", "amount", "total")
    return sorted_fold(rows, ["order_id"], ["seq"], step, ORDER_SCHEMA)


def cache_step(cache: dict, op: str, key: str, val: int, t: int, capacity: int, ttl: int) -> tuple[str, str | None]:
    """One cache access; ``cache`` maps key -> (val, put time) from least to most recently used."""
    if key in cache and t - cache[key][1] > ttl:
        del cache[key]
    if op == "get":
        if key not in cache:
            return "miss", None
        cache[key] = cache.pop(key)
        return "hit", None
    known = cache.pop(key, None) is not None
    cache[key] = (val, t)
    evicted = None
    if len(cache) > capacity:
        stale = [k for k, (_, put) in cache.items() if t - put > ttl]
        evicted = stale[0] if stale else next(iter(cache))
        del cache[evicted]
    return "update" if known else "insert", evicted


def cache_trace(events: DataFrame, capacity: int, ttl: int) -> DataFrame:
    """Outcome of every access to a per-tenant cache with least-recently-used eviction and expiry."""

    def step(key, state, row):
        if row is None:
            return state, []
        cache = {} if state is None else state
        outcome, evicted = cache_step(cache, row.op, row.key, row.val, row.t, capacity, ttl)
        return cache, [(key[0], row.seq, outcome, evicted)]

    rows = events.select("tenant", "seq", "t", "op", "key", "val")
    return sorted_fold(rows, ["tenant"], ["seq"], step, "tenant long, seq long, outcome string, evicted string")
