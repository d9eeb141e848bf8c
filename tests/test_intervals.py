import random

import numpy as np
import pandas as pd

from tallyloom.operators import folds as D
from tallyloom.operators import intervals as I


def bookings(spark, rows):
    return spark.createDataFrame(rows, "resource long, s long, e long, seq long, is_cancel boolean")


def random_rows(n=250, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randint(0, 400)
        out.append((0 if rng.random() < 0.6 else rng.randint(1, 3), s, s + rng.randint(-1, 12), i, rng.random() < 0.2))
    # cancels that hit something
    for i in range(n, n + 60):
        r = rng.choice(out[:n])
        out.append((r[0], r[1], r[2], i, rng.random() < 0.7))
    return out


def test_overlap_counts(spark):
    rows = random_rows()
    got = {r["seq"]: r["n_overlaps"] for r in I.overlap_counts(bookings(spark, rows)).collect()}
    valid = [r for r in rows if r[1] < r[2]]
    assert got == {a[3]: sum(1 for b in valid if b[0] == a[0] and b[3] != a[3] and a[1] < b[2] and b[1] < a[2]) for a in valid}


def accept_plainly(rows):
    kept, out = {}, {}
    for resource, s, e, seq, cancel in sorted(rows, key=lambda r: r[3]):
        mine = kept.setdefault(resource, [])
        if s >= e:
            out[seq] = "invalid"
        elif cancel:
            out[seq] = "cancelled" if (s, e) in mine else "not found"
            if (s, e) in mine:
                mine.remove((s, e))
        elif any(s < b and a < e for a, b in mine):
            out[seq] = "rejected"
        else:
            mine.append((s, e))
            out[seq] = "booked"
    return out


def test_accept_bookings_equals_plain_order(spark):
    rows = random_rows(seed=4)
    got = {r["seq"]: r["outcome"] for r in D.accept_bookings(bookings(spark, rows)).collect()}
    assert got == accept_plainly(rows) and {"booked", "rejected", "cancelled", "not found", "invalid"} <= set(got.values())


def test_adjacent_bookings_are_free(spark):
    rows = [(1, 10, 20, 0, False), (1, 20, 30, 1, False), (1, 0, 10, 2, False), (1, 15, 25, 3, False), (1, 12, 18, 4, True), (1, 10, 20, 5, True), (1, 15, 20, 6, False)]
    got = {r["seq"]: r["outcome"] for r in D.accept_bookings(bookings(spark, rows)).collect()}
    assert [got[i] for i in range(7)] == ["booked", "booked", "booked", "rejected", "not found", "cancelled", "booked"]


def next_plainly(spans, t, d):
    for s, e in sorted(spans):
        if t + d <= s:
            return t
        t = max(t, e)
    return t


def test_next_free(spark):
    rows = [r for r in random_rows(80, seed=7) if r[1] < r[2]] + [(5, 10, 20, 900, False), (5, 30, 40, 901, False)]
    spans = I.merge_intervals(bookings(spark, rows))
    rng = random.Random(2)
    asked = [(k, i, rng.randint(-5, 450), rng.randint(1, 40)) for i, k in enumerate([0, 1, 2, 3, 5, 8] * 30)]
    asked += [(5, 1000, 12, 5), (5, 1001, 12, 15), (5, 1002, 15, 10), (5, 1003, 25, 5), (5, 1004, 0, 10)]
    got = {r["q_id"]: r["free_at"] for r in I.next_free(spans, spark.createDataFrame(asked, "resource long, q_id long, t long, d long")).collect()}
    busy = {}
    for r in rows:
        busy.setdefault(r[0], []).append((r[1], r[2]))
    for k, i, t, d in asked:
        assert got[i] == next_plainly(busy.get(k, []), t, d), (k, t, d)
    assert [got[i] for i in range(1000, 1005)] == [20, 40, 20, 25, 0]


def test_many_small_cells_are_one_search(monkeypatch):
    rng, trees = random.Random(11), []
    search = I.first_at_least
    monkeypatch.setattr(I, "first_at_least", lambda *a: trees.append(1) or search(*a))
    spans = {k: sorted({rng.randint(0, 30) * 10 for _ in range(rng.randint(0, 4))}) for k in range(400)}
    cells = pd.DataFrame([(k, [s for s in v] or None, [s + 9 for s in v] or None, -I.NEVER, I.NEVER if k % 2 else 305) for k, v in spans.items()], columns=["resource", "s", "e", "before", "after"])
    asked = pd.DataFrame([(k, 0, 4 * k + i, rng.randint(-5, 320) if i else -I.NEVER, rng.randint(1, 40)) for k in range(0, 400, 3) for i in range(4)], columns=["resource", I.RANGE, "q_id", "t", "d"])
    got = I._first_gaps(asked.sample(frac=1, random_state=1), cells.sample(frac=1, random_state=2))
    assert len(got) == len(asked) and len(trees) == 1
    for r in got.itertuples():
        after = I.NEVER if r.resource % 2 else 305
        gaps = list(zip([-I.NEVER] + [s + 9 for s in spans[r.resource]], spans[r.resource] + [after]))
        free = next((max(r.t, b) for b, u in (gaps[1:] if r.t == -I.NEVER else gaps) if u - max(r.t, b) >= r.d), None)
        # a query behind all gaps of its cell finds none there
        assert (None if pd.isna(r.free_at) else r.free_at) == free, (r, gaps)


def test_tree_of_longest_gaps():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 8, 9, 100):
        values, start, least = rng.integers(0, 50, n), rng.integers(0, n + 1, 300), rng.integers(0, 60, 300)
        plain = [next((i for i in range(a, n) if values[i] >= x), n) for a, x in zip(start, least)]
        assert I.first_at_least(values, start, least).tolist() == plain


def test_range_counts_half_open(spark):
    rng = random.Random(7)
    events = [rng.randint(0, 100) for _ in range(500)] + [50] * 300
    asked = [(i, rng.randint(-3, 100), rng.randint(0, 103)) for i in range(120)] + [(500, 50, 50), (501, 50, 51), (502, 60, 10)]
    got = {r["q_id"]: r["n"] for r in I.range_counts(
        spark.createDataFrame([(t,) for t in events], "t long"), spark.createDataFrame(asked, "q_id long, lo long, hi long")).collect()}
    assert got == {i: sum(1 for t in events if lo <= t < hi) for i, lo, hi in asked}


def test_median_mode(spark):
    rows = [("a", v, i) for i, v in enumerate([4.0, 1.0, 3.0, 2.0])] + [("b", v, 10 + i) for i, v in enumerate([2.0, 1.0, 1.0, 2.0, 9.0])] + [("c", 7.0, 99)]
    got = {r["k"]: (r["median"], r["mode"]) for r in I.median_mode(spark.createDataFrame(rows, "k string, v double, i long"), "k", "v", "i").collect()}
    assert got == {"a": (2.5, 4.0), "b": (2.0, 2.0), "c": (7.0, 7.0)}


def test_cart_totals(spark):
    rows = [("c", 1, False, 2, 500), ("c", 2, False, 1, 250), ("c", 3, True, 1, 9), ("c", 4, False, 2, 250), ("d", 1, True, 1, 1)]
    out = I.cart_totals(spark.createDataFrame(rows, "customer string, seq long, is_checkout boolean, qty long, unit_cents long"))
    assert {(r["customer"], r["cart"]): (r["total_cents"], r["checked_out"]) for r in out.collect()} == {("c", 0): (1250, True), ("c", 1): (500, False), ("d", 0): (0, True)}


def orders(spark, events):
    rows = [(o, i, e, a, total) for o, total, steps in events for i, (e, a) in enumerate(steps)]
    return spark.createDataFrame(rows, "order_id long, seq long, event string, amount long, total long")


def test_order_states(spark):
    events = [
        (1, 1000, [("pay", 300), ("pay", 800), ("pay", 700), ("ship", 0), ("deliver", 0)]),
        (2, 1000, [("ship", 0), ("pay", 1000), ("pay", 1), ("deliver", 0), ("cancel", 0), ("pay", 5)]),
        (3, 1000, [("cancel", 0), ("pay", 100), ("ship", 0)]),
        (4, 1000, [("pay", 400), ("cancel", 0)]),
        (5, 1000, [("pay", 1000), ("ship", 0), ("cancel", 0)])]
    got = {r["order_id"]: (r["state"], r["paid"], r["refund"], r["history"], r["rejected"]) for r in D.order_states(orders(spark, events)).collect()}
    assert got == {
        1: ("delivered", 1000, 0, "new>paid>shipped>delivered", 1), 2: ("cancelled", 1000, 1000, "new>paid>cancelled", 4),
        3: ("cancelled", 0, 0, "new>cancelled", 2), 4: ("cancelled", 400, 400, "new>cancelled", 0), 5: ("shipped", 1000, 0, "new>paid>shipped", 1)}


def test_cache_trace(spark):
    def run(steps, capacity, ttl=10**9):
        rows = [(1, i, t, op, k, v) for i, (op, k, v, t) in enumerate(steps)]
        out = D.cache_trace(spark.createDataFrame(rows, "tenant long, seq long, t long, op string, key string, val long"), capacity, ttl)
        return [(r["outcome"], r["evicted"]) for r in out.orderBy("seq").collect()]

    assert run([("put", "a", 1, 0), ("put", "b", 2, 0), ("get", "a", 0, 0), ("put", "c", 3, 0), ("get", "b", 0, 0), ("get", "a", 0, 0)], 2) == [
        ("insert", None), ("insert", None), ("hit", None), ("insert", "b"), ("miss", None), ("hit", None)]
    assert run([("put", "a", 1, 100), ("get", "a", 0, 104), ("get", "a", 0, 106)], 4, ttl=5) == [("insert", None), ("hit", None), ("miss", None)]
    assert run([("put", "a", 1, 0), ("put", "b", 2, 0), ("put", "a", 10, 0), ("put", "c", 3, 0)], 2) == [("insert", None), ("insert", None), ("update", None), ("insert", "b")]


def test_live_entries_agree_with_the_trace(spark):
    rows = [(1, 0, 0, "put", "a", 1), (1, 1, 1, "put", "b", 2), (1, 2, 2, "get", "a", 0), (1, 3, 3, "put", "c", 3), (1, 4, 4, "put", "d", 4)]
    df = spark.createDataFrame(rows, "tenant long, seq long, t long, op string, key string, val long")
    assert [r["key"] for r in I.live_entries(df, 3, 100, 10).orderBy("recency").collect()] == ["d", "c", "a"]
    assert [r["key"] for r in I.live_entries(df, 3, 6, 10).orderBy("recency").collect()] == ["d"]
