"""Online forms of the batch reports, over files that keep arriving.

Every sink is a folder that a restarted query may write again: one subfolder per micro-batch,
overwritten when the batch is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.functions.rewards import SOFT, total_reward
from tallyloom.operators.agentbench import item_axis, item_order
from tallyloom.operators.evaluation import mark_correct
from tallyloom.operators.folds import ORDER_SCHEMA, cache_step, order_step
from tallyloom.operators.health import token_id_range
from tallyloom.operators.ordered import number_rows

BatchFn = Callable[[DataFrame, int], None]


def start_batches(stream: DataFrame, handle: BatchFn, checkpoint: str, mode: str = "append", *, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def batch_folder(folder: str, batch: int) -> str:
    return f"{folder}/batch={batch:08d}"


def append_batches(folder: str) -> BatchFn:
    """Each micro-batch to its own subfolder."""
    def handle(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(batch_folder(folder, batch))

    return handle


def run_to_end(stream: DataFrame, folder: str, mode: str = "append", handle: BatchFn | None = None, key: list[str] | None = None) -> DataFrame:
    """Process what is there now and give back the sink. For complete mode: the last state; for update mode: the last row of each key, if one is given."""
    seen: list[int] = []
    inner = handle or append_batches(f"{folder}/rows")

    def noted(df: DataFrame, batch: int) -> None:
        inner(df, batch)
        seen.append(batch)

    query = start_batches(stream, noted, f"{folder}/checkpoint", mode)
    query.awaitTermination()
    spark = stream.sparkSession
    if mode == "complete":
        if not seen:
            raise ValueError("no batch ran: the source is empty, or was read to its end before")
        return spark.read.parquet(batch_folder(f"{folder}/rows", max(seen)))
    rows = spark.read.parquet(f"{folder}/rows")
    if mode == "update" and key:
        last = F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), "batch").alias("last")
        return rows.groupBy(*key).agg(last).select("last.*")
    return rows.drop("batch")


def stream_accuracy(completions: DataFrame) -> DataFrame:
    """Running correct and total, format rate and mean reward per run (complete or update mode)."""
    scored = mark_correct(total_reward(completions, "full"), "completion", "answer", "right")
    return scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("right").alias("n_correct"),
        F.count_if(F.col("completion").rlike(SOFT)).alias("n_formatted"), F.sum("reward").alias("reward_sum"))


def stream_reward_windows(log: DataFrame, width: int = 50) -> DataFrame:
    """Mean reward per window of steps while logs grow."""
    return log.filter("reward IS NOT NULL").groupBy("run", F.floor(F.col("step") / width).alias("win")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward"))


def stream_reward_hours(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Mean reward per hour of event time; closed windows only (append mode)."""
    return log.filter("reward IS NOT NULL").withWatermark("ts", late).groupBy("run", F.window("ts", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward")).select("run", F.col("w.start").alias("hour"), "n", "mean_reward")


def stream_tripwire(log: DataFrame, limit: float = 1.0, guard: float = 1.0) -> DataFrame:
    """Alert rows, without state."""
    def alert(kind: str, condition: str, value: str):
        return F.when(F.expr(condition), F.struct(F.lit(kind).alias("alert"), F.expr(value).cast("double").alias("value")))

    kinds = F.array(
        alert("adapter above limit", f"b_max > {limit}", "b_max"),
        alert("KL at first step", f"step <= 1 AND kl >= {guard}", "kl"),
        alert("gradient not finite", "nonfinite > 0", "nonfinite"))
    found = F.explode(F.filter(kinds, lambda k: k.isNotNull()))
    return log.select("run", "line_no", "step", found.alias("_a")).select("run", "line_no", "step", "_a.alert", "_a.value")


def stream_token_alerts(batches: DataFrame, vocab: int) -> DataFrame:
    """Token batches with an id outside the vocabulary, without state."""
    return token_id_range(batches, vocab).filter("violates").drop("ids")


def stop_on_alert(folder: str) -> BatchFn:
    """Write the alerts, then stop the query: a run that trips must not go on."""
    def handle(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(batch_folder(folder, batch))
        first = df.sparkSession.read.parquet(batch_folder(folder, batch)).orderBy("step").first()
        if first is not None:
            raise RuntimeError(f"{first['alert']} in {first['run']} at step {first['step']}")

    return handle


def _earlier(spark: SparkSession, folder: str, batch: int, schema: str) -> DataFrame:
    """Rows that batches before this one wrote; none on the first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema + ", batch int").option("basePath", folder).parquet(f"{folder}/batch=*").filter(F.col("batch") < batch).drop("batch")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def index_unseen(folder: str) -> BatchFn:
    """Index only content no earlier batch has: repeats within the batch collapse first."""
    def handle(df: DataFrame, batch: int) -> None:
        fresh = df.groupBy("sha256").agg(F.min("path").alias("path"))
        known = _earlier(df.sparkSession, folder, batch, "sha256 string, path string")
        fresh.join(known, "sha256", "left_anti").write.mode("overwrite").parquet(batch_folder(folder, batch))

    return handle


def stream_dedup(docs: DataFrame, late: str = "30 days") -> DataFrame:
    """Drop copies that arrive within the watermark; ``index_unseen`` catches the others."""
    sized = docs.select("path", "seen_at", F.sha2("content", 256).alias("sha256"))
    return sized.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["sha256"])


def number_new_sessions(folder: str) -> BatchFn:
    """Give each session its source's next number when it is first seen.

    State is one row per session in a written table, so a busy source is spread like any other.
    """
    schema = "source string, session_id string, seq long"

    def handle(df: DataFrame, batch: int) -> None:
        known = _earlier(df.sparkSession, folder, batch, schema)
        first = df.filter("session_id IS NOT NULL").groupBy("source", "session_id").agg(F.min("ts").alias("first_ts"), F.min("id").alias("first_id"))
        new = first.join(known.select("source", "session_id"), ["source", "session_id"], "left_anti")
        last = known.groupBy("source").agg(F.max("seq").alias("_last"))
        numbered = number_rows(new, ["source"], ["first_ts", "first_id"], "_nth").join(last, "source", "left")
        out = numbered.select("source", "session_id", (F.col("_nth") + F.coalesce("_last", F.lit(0))).alias("seq"))
        out.write.mode("overwrite").parquet(batch_folder(folder, batch))

    return handle


# ---- keyed state: what is known of a key lies in the state store, and a batch looks up its own keys only


def first_seen(stream: DataFrame, keys: list[str], *about: Column) -> DataFrame:
    """A row per key that a batch meets (update mode), with ``about`` it, and when its first and its last batch began.

    The two times are equal in the batch that meets a key first, and a repeated batch has the times it had before.
    """
    # the time at which the batch began, the same for all its rows
    timed = stream.withColumn("batch_time", F.current_timestamp())
    return timed.groupBy(*keys).agg(*about, F.min("batch_time").alias("born"), F.max("batch_time").alias("met"))


def newcomers(df: DataFrame) -> DataFrame:
    return df.where("born = met").drop("born", "met")


def stream_first_contents(docs: DataFrame) -> DataFrame:
    """Contents with the least path of the batch in which they are first seen; state for all contents, without a watermark."""
    return first_seen(docs.select("path", F.sha2("content", 256).alias("sha256")), ["sha256"], F.min("path").alias("path"))


def write_newcomers(folder: str) -> BatchFn:
    """The keys that no earlier batch has met, of a stream of ``first_seen``; nothing written before is read."""
    def handle(df: DataFrame, batch: int) -> None:
        newcomers(df).write.mode("overwrite").parquet(batch_folder(folder, batch))

    return handle


def stream_first_sessions(log: DataFrame) -> DataFrame:
    """Sessions with their first query in the batch that meets them first."""
    return first_seen(log.filter("session_id IS NOT NULL"), ["source", "session_id"], F.min("ts").alias("first_ts"), F.min("id").alias("first_id"))


COUNTERS = "source string, last long"


def number_newcomers(folder: str, counters: str) -> BatchFn:
    """Give each session its source's next number when it is first seen, of a stream of ``stream_first_sessions``.

    One row per source says how far it has come; each batch reads the rows of the batch before and writes its own. Sessions of a
    busy source are spread like any others.
    """
    def handle(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        known = spark.read.schema(COUNTERS).parquet(batch_folder(counters, batch - 1)) if batch else spark.createDataFrame([], COUNTERS)
        numbered = number_rows(newcomers(df), ["source"], ["first_ts", "first_id"], "_nth").join(known, "source", "left")
        numbered.select("source", "session_id", (F.col("_nth") + F.coalesce("last", F.lit(0))).alias("seq")).write.mode("overwrite").parquet(batch_folder(folder, batch))
        written = spark.read.schema("source string, session_id string, seq long").parquet(batch_folder(folder, batch))
        both = known.unionByName(written.select("source", F.col("seq").alias("last"))).groupBy("source").agg(F.max("last").alias("last"))
        both.coalesce(1).write.mode("overwrite").parquet(batch_folder(counters, batch))

    return handle


#: Orders of neighbouring numbers share a row of state, 2 to the power of this at most: a call for a key costs far more than the events of an order
ORDER_BITS = 10


def stream_order_states(events: DataFrame) -> DataFrame:
    """State of every order after the events so far (update mode): the batch fold, one trigger at a time."""
    state_schema = "order_id array<long>, state array<string>, paid array<long>, refund array<long>, history array<string>, rejected array<long>"
    names = ("state", "paid", "refund", "history", "rejected")

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {i: dict(zip(names, now)) for i, *now in zip(*state.get)} if state.exists else {}
        rows, met = pd.concat(list(frames)).sort_values("seq"), {}
        # events without an order's number share the row of state without one
        ids = rows["order_id"].tolist() if key[0] is not None else [None] * len(rows)
        for i, event, amount, total in zip(ids, *(rows[c].tolist() for c in ("event", "amount", "total"))):
            met[i] = known[i] = order_step(known.get(i), event, int(amount), int(total))[0]
        state.update((list(known), *([now[n] for now in known.values()] for n in names)))
        yield pd.DataFrame([(i, *[now[n] for n in names]) for i, now in met.items()], columns=["order_id", *names])

    near = F.shiftright(F.col("order_id").cast("long"), ORDER_BITS).alias("_near")
    return events.select("order_id", "seq", "event", "amount", "total", near).groupBy("_near").applyInPandasWithState(
        advance, ORDER_SCHEMA, state_schema, "update", GroupStateTimeout.NoTimeout)


def stream_cache(events: DataFrame, capacity: int, ttl: int) -> DataFrame:
    """Outcome of each cache access per tenant. The state holds at most ``capacity`` entries."""
    state_schema = "keys array<string>, vals array<long>, puts array<long>"

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = {k: (v, p) for k, v, p in zip(*state.get)} if state.exists else {}
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            outcome, evicted = cache_step(cache, row.op, row.key, int(row.val), int(row.t), capacity, ttl)
            out.append((key[0], row.seq, outcome, evicted))
        state.update((list(cache), [int(v) for v, _ in cache.values()], [int(p) for _, p in cache.values()]))
        yield pd.DataFrame(out, columns=["tenant", "seq", "outcome", "evicted"])

    return events.groupBy("tenant").applyInPandasWithState(
        advance, "tenant long, seq long, outcome string, evicted string", state_schema, "append", GroupStateTimeout.NoTimeout)


def stream_verdicts(items: DataFrame) -> DataFrame:
    """The compliance matrix while runs finish (complete or update mode)."""
    held = items.groupBy("layout", "model", "item").agg(F.count_if("ok").alias("held"), F.count(F.lit(1)).alias("runs"))
    return item_axis(held).withColumn("ord", item_order(F.col("item")))
