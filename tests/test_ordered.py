import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators import ordered as O
from tallyloom.operators import splits as S


@pytest.fixture(scope="module")
def rows():
    """One key holds two thirds of the rows."""
    rng = random.Random(3)
    return [(0 if rng.random() < 0.66 else rng.randint(1, 9), i, rng.choice([None, rng.randint(-50, 50)])) for i in rng.sample(range(2000), 600)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, t long, v long")


def by_key(rows):
    out = {}
    for k, t, v in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(k, []).append((t, v))
    return out


def test_running_values(spark, rows):
    measures = {"total": ("sum", F.col("v")), "n": ("count", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.col("v")), "recent": ("last", F.col("v"))}
    got = {(r["k"], r["t"]): (r["total"], r["n"], r["top"], r["low"], r["recent"]) for r in O.running(frame(spark, rows), ["k"], ["t"], measures).collect()}
    for k, series in by_key(rows).items():
        seen = []
        for t, v in series:
            seen += [] if v is None else [v]
            want = (sum(seen), len(seen), max(seen), min(seen), seen[-1]) if seen else (None, 0, None, None, None)
            assert got[k, t] == want


def test_running_without_current_row_and_without_keys(spark, rows):
    got = {r["t"]: r["before"] for r in O.running(frame(spark, rows), [], ["t"], {"before": ("count", F.lit(1))}, inclusive=False).collect()}
    for i, (_, t, _) in enumerate(sorted(rows, key=lambda r: r[1])):
        assert (got[t] or 0) == i


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbour(spark, rows, ahead):
    got = {(r["k"], r["t"]): (r["nt"], r["nv"]) for r in O.neighbour(frame(spark, rows), ["k"], ["t"], {"nt": "t", "nv": "v"}, ahead=ahead).collect()}
    for k, series in by_key(rows).items():
        for i, (t, _) in enumerate(series):
            j = i + 1 if ahead else i - 1
            assert got[k, t] == (series[j] if 0 <= j < len(series) else (None, None))


def test_count_below_with_ties(spark):
    rng = random.Random(9)
    points = [(rng.randint(0, 2), rng.randint(0, 20)) for _ in range(300)] + [(0, 7)] * 500
    probes = [(k, i, rng.randint(-2, 23)) for i, k in enumerate([0, 1, 2] * 40)]
    p = spark.createDataFrame(points, "k long, at long")
    q = spark.createDataFrame(probes, "k long, q long, at long")
    got = {r["q"]: r["n"] for r in O.count_below(p, q, ["k"], "at", "n").collect()}
    for k, i, at in probes:
        assert (got[i] or 0) == sum(1 for kk, t in points if kk == k and t < at)


def test_seeded_shuffle_is_a_permutation_and_repeats(spark):
    df = spark.range(500).withColumnRenamed("id", "key")
    one = {r["key"]: r["position"] for r in S.seeded_shuffle(df, "key", 1).collect()}
    again = {r["key"]: r["position"] for r in S.seeded_shuffle(df.repartition(7), "key", 1).collect()}
    other = {r["key"]: r["position"] for r in S.seeded_shuffle(df, "key", 2).collect()}
    assert sorted(one.values()) == list(range(1, 501)) and one == again and one != other
    first = [r["key"] for r in S.shuffled_head(df, "key", 1, 10).collect()]
    assert sorted(one[k] for k in first) == list(range(1, 11))


def test_split_sizes_are_exact_and_disjoint(spark):
    train = spark.range(200).select(F.col("id"), F.lit("train").alias("split"))
    test = spark.range(1000, 1100).select(F.col("id"), F.lit("test").alias("split"))
    rows = S.train_val_test(train, test, "id", 120, 30, 40, 42).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r["part"], set()).add(r["id"])
    assert {p: len(ids) for p, ids in parts.items()} == {"train": 120, "validation": 30, "test": 40}
    assert not parts["train"] & parts["validation"] and min(parts["test"]) >= 1000


def test_exclude_recent(spark):
    cases = [(["a", "b", "a"], ["b"], ["a", "a"]), (["a"], ["a"], ["a"]), (["a", "b"], [], ["a", "b"]), (["a", "b"], ["a", "x", "y", "z"], ["a", "b"])]
    df = spark.createDataFrame([(p, s) for p, s, _ in cases], "p array<string>, s array<string>")
    assert [r[0] for r in df.select(S.exclude_recent(F.col("p"), F.col("s"))).collect()] == [w for _, _, w in cases]


def test_a_value_in_most_rows_is_cut_by_the_next_column(spark):
    rng = random.Random(4)
    rows = [(5 if rng.random() < 0.9 else rng.randint(0, 100), i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "v long, i long")
    sizes = [r["count"] for r in O.cut_ranges(df, ["v", "i"], 20).groupBy(O.RANGE).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 2 * len(rows) / len(sizes)
    got = {(r["v"], r["i"]): r["n"] for r in O.number_rows(df, [], ["v", "i"], "n").collect()}
    assert all(got[r] == n for n, r in enumerate(sorted(rows), 1))


def test_text_times_and_nulls_as_order(spark):
    rng = random.Random(11)
    rows = [(i % 3, None if i == 7 else f"k{rng.randrange(40)}", i, float(i % 5)) for i in range(300)]
    frame = spark.createDataFrame(rows, "g long, k string, i long, x double").withColumn("ts", F.timestamp_seconds(F.col("i") % 17)).withColumn("n", F.when(F.col("i") % 4 > 0, F.col("i") % 11))
    for first in ("k", "ts", "n"):
        plain = Window.partitionBy("g").orderBy(first, "i").rowsBetween(Window.unboundedPreceding, 0)
        want = {r["i"]: r["s"] for r in frame.withColumn("s", F.sum("x").over(plain)).collect()}
        assert {r["i"]: r["s"] for r in O.running(frame, ["g"], [first, "i"], {"s": ("sum", F.col("x"))}).collect()} == want


def test_sources_are_scanned_once(spark, tmp_path):
    from tallyloom.operators import evaluation, health

    spark.range(50).selectExpr("id AS doc_id", "id % 3 = 0 AS right", "id % 4 AS g", "CAST(id % 7 AS double) AS reward").write.parquet(f"{tmp_path}/rows")
    spark.range(50).selectExpr("id % 2 AS run", "id AS step", "CAST(id AS double) AS b_max").write.parquet(f"{tmp_path}/log")
    rows, log = spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/log")
    for out in (evaluation.running_accuracy(rows, "doc_id", "right"), evaluation.group_advantage(rows, "g", "reward"), evaluation.informative_groups(rows, "g", "reward"), health.growth_factor(log)):
        assert out.count() > 0 and "parquet" not in out._jdf.queryExecution().executedPlan().toString().lower()
