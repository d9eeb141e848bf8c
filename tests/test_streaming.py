import pytest
from pyspark.sql import functions as F

from tallyloom.operators import folds as D
from tallyloom.operators import retrieval as R
from tallyloom.streaming import runs as S


def drop_files(spark, folder, parts, schema):
    """Each part arrives as a file of its own, in order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")


def stream(spark, folder, schema, parts, **options):
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return reader.parquet(folder)


def test_sessions_over_several_batches(spark, tmp_path):
    schema = "id long, ts long, source string, session_id string"
    parts = [[(1, 10, "a", "u1"), (2, 11, "a", "u2"), (3, 12, "b", "u9")], [(4, 20, "a", "u1"), (5, 21, "a", "u3"), (6, 22, "c", None)], [(7, 30, "b", "u8")]]
    drop_files(spark, f"{tmp_path}/in", parts, schema)
    out = S.run_to_end(stream(spark, f"{tmp_path}/in", schema, parts), f"{tmp_path}/out", handle=S.number_new_sessions(f"{tmp_path}/out/rows"))
    got = {(r["source"], r["session_id"]): r["seq"] for r in out.collect()}
    whole = spark.createDataFrame([r for p in parts for r in p], schema)
    assert got == {(r["source"], r["session_id"]): r["seq"] for r in R.number_sessions(whole).collect()}
    assert got[("a", "u3")] == 3 and len(got) == 5


def test_dedup_over_batches_and_a_repeated_batch(spark, tmp_path):
    folder = f"{tmp_path}/rows"
    handle = S.index_unseen(folder)
    one = spark.createDataFrame([("/a", "s1"), ("/b", "s1"), ("/c", "s2")], "path string, sha256 string")
    two = spark.createDataFrame([("/d", "s2"), ("/e", "s3")], "path string, sha256 string")
    for df, batch in ((one, 0), (two, 1), (two, 1), (one, 0)):
        handle(df, batch)
    assert sorted((r["sha256"], r["path"]) for r in spark.read.parquet(folder).collect()) == [("s1", "/a"), ("s2", "/c"), ("s3", "/e")]


def test_keyed_state_numbers_sessions_without_reading_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "_earlier", None)
    schema = "id long, ts long, source string, session_id string"
    parts = [[(1, 10, "a", "u1"), (2, 11, "a", "u2"), (3, 12, "b", "u9")], [(4, 20, "a", "u1"), (5, 21, "a", "u3"), (6, 22, "c", None)], [(7, 30, "b", "u8"), (8, 31, "a", "u2"), (9, 32, "a", "u0")]]
    folder = f"{tmp_path}/out"

    def run():
        found = S.stream_first_sessions(stream(spark, f"{tmp_path}/in", schema, parts))
        return S.run_to_end(found, folder, "update", handle=S.number_newcomers(f"{folder}/rows", f"{folder}/counters"))

    drop_files(spark, f"{tmp_path}/in", parts[:2], schema)
    assert {(r["source"], r["session_id"]): r["seq"] for r in run().collect()} == {("a", "u1"): 1, ("a", "u2"): 2, ("a", "u3"): 3, ("b", "u9"): 1}
    # a restart goes on where the state was left
    drop_files(spark, f"{tmp_path}/in/more", parts[2:], schema)
    got = {(r["source"], r["session_id"]): r["seq"] for r in run().collect()}
    whole = spark.createDataFrame([r for p in parts for r in p], schema)
    assert got == {(r["source"], r["session_id"]): r["seq"] for r in R.number_sessions(whole).collect()} and len(got) == 6
    assert {r["source"]: r["last"] for r in spark.read.parquet(f"{folder}/counters/batch=00000002").collect()} == {"a": 4, "b": 2}
    assert run().count() == 6


def test_keyed_state_keeps_each_content_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "_earlier", None)
    schema = "path string, content string"
    drop_files(spark, f"{tmp_path}/in", [[("/b", "x"), ("/a", "x"), ("/c", "y")], [("/0", "x"), ("/d", "z")], [("/e", "z"), ("/f", None)]], schema)
    folder = f"{tmp_path}/out"
    out = S.run_to_end(S.stream_first_contents(stream(spark, f"{tmp_path}/in", schema, None)), folder, "update", handle=S.write_newcomers(f"{folder}/rows"))
    assert sorted(r["path"] for r in out.collect()) == ["/a", "/c", "/d", "/f"]


def test_tripwire_stops_the_query(spark, tmp_path):
    schema = "run string, line_no long, step long, b_max double, kl double, nonfinite long"
    drop_files(spark, f"{tmp_path}/in", [[("r", 1, 1, 0.1, 0.0, 0)], [("r", 2, 2, 1.5, None, 3)]], schema)
    alerts = S.stream_tripwire(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
    query = S.start_batches(alerts, S.stop_on_alert(f"{tmp_path}/rows"), f"{tmp_path}/ck")
    with pytest.raises(Exception, match="adapter above limit in r at step 2"):
        query.awaitTermination()
    assert {r["alert"] for r in spark.read.parquet(f"{tmp_path}/rows").collect()} == {"adapter above limit", "gradient not finite"}


def test_orders_advance_over_triggers(spark, tmp_path):
    schema = "order_id long, seq long, event string, amount long, total long"
    parts = [[(1, 1, "pay", 300, 1000), (2, 1, "ship", 0, 50)], [(1, 2, "pay", 800, 1000), (1, 3, "pay", 700, 1000), (2, 2, "pay", 50, 50)], [(1, 4, "ship", 0, 1000), (2, 3, "cancel", 0, 50)]]
    drop_files(spark, f"{tmp_path}/in", parts, schema)
    out = S.run_to_end(S.stream_order_states(stream(spark, f"{tmp_path}/in", schema, parts)), f"{tmp_path}/out", "update")
    last = {}
    for r in spark.read.parquet(f"{tmp_path}/out/rows").orderBy("batch").collect():
        last[r["order_id"]] = tuple(r[c] for c in ("state", "paid", "refund", "history", "rejected"))
    whole = spark.createDataFrame([r for p in parts for r in p], schema)
    assert last == {r["order_id"]: (r["state"], r["paid"], r["refund"], r["history"], r["rejected"]) for r in D.order_states(whole).collect()}
    assert out.count() == 6


def test_neighbouring_orders_share_a_row_of_state(spark, tmp_path):
    schema = "order_id long, seq long, event string, amount long, total long"
    ids = [None, *range(-40, 900)]
    parts = [[(i, 1, "pay", 5, 5 + (i or 0) % 3) for i in ids], [(i, 2, "ship", 0, 5 + (i or 0) % 3) for i in ids[::2]] + [(5_000_000_000, 1, "cancel", 0, 9)]]
    drop_files(spark, f"{tmp_path}/in", parts, schema)
    query = S.start_batches(S.stream_order_states(stream(spark, f"{tmp_path}/in", schema, parts)), S.append_batches(f"{tmp_path}/rows"), f"{tmp_path}/ck", "update")
    query.awaitTermination()
    last = {}
    for r in spark.read.parquet(f"{tmp_path}/rows").orderBy("batch").collect():
        last[r["order_id"]] = tuple(r)[:6]
    assert last == {r["order_id"]: tuple(r) for r in D.order_states(spark.createDataFrame([r for p in parts for r in p], schema)).collect()}
    # one for null, one below zero, one from zero, one far away
    assert sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]) == 4


def test_cache_over_triggers_equals_the_batch_fold(spark, tmp_path):
    schema = "tenant long, seq long, t long, op string, key string, val long"
    rows = [(i % 2, i, i, "put" if i % 3 else "get", f"k{i * 7 % 5}", i) for i in range(60)]
    parts = [rows[:20], rows[20:41], rows[41:]]
    drop_files(spark, f"{tmp_path}/in", parts, schema)
    got = S.run_to_end(S.stream_cache(stream(spark, f"{tmp_path}/in", schema, parts), 3, 25), f"{tmp_path}/out")
    key = lambda r: (r["tenant"], r["seq"], r["outcome"], r["evicted"])
    assert sorted(map(key, got.collect()), key=str) == sorted(map(key, D.cache_trace(spark.createDataFrame(rows, schema), 3, 25).collect()), key=str)


def test_reward_hours_close_with_the_watermark(spark, tmp_path):
    schema = "run string, ts timestamp, reward double"
    def at(hour, minute):
        import datetime
        return datetime.datetime(2024, 1, 1, hour, minute, tzinfo=datetime.timezone.utc)
    parts = [[("r", at(0, 5), 1.0), ("r", at(0, 50), 3.0)], [("r", at(4, 0), 5.0)], [("r", at(9, 0), 7.0)]]
    drop_files(spark, f"{tmp_path}/in", parts, schema)
    out = S.run_to_end(S.stream_reward_hours(stream(spark, f"{tmp_path}/in", schema, parts)), f"{tmp_path}/out")
    got = {r["h"]: r["mean_reward"] for r in out.select(F.hour("hour").alias("h"), "mean_reward").collect()}
    assert got[0] == 2.0 and got[4] == 5.0 and 9 not in got
