"""Streaming twins of batch reports. Each reads the given files as a stream and processes all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.bench import MATRIX
from tallyloom.plans.health import LOG, WINDOWS
from tallyloom.plans.ordered import ORDER_WALK
from tallyloom.plans.registry import query
from tallyloom.plans.retrieval import SESSIONS
from tallyloom.plans.scoring import RIGHT, SCORED, SOFT, set_sql
from tallyloom.plans.tables import BASE, Tables
from tallyloom.session import scratch_dir
from tallyloom.sources.logs import parse_training_log
from tallyloom.streaming import runs as S


class StreamTables(Tables):
    """The same tables and derived views, read as streams of files."""

    #: None: all files that are there make one trigger
    files_per_trigger: int | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BASE:
            raise AttributeError(name)
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        # as a pattern the path may be one file or a folder of part files
        reader = self.spark.readStream.schema(schema)
        if self.files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.files_per_trigger)
        return reader.parquet(f"{self.folder}/{name}.parque[t]")

    @property
    def prefix(self) -> str:
        return "s" + Tables(self.spark, self.folder).prefix


def _live(t: Tables, view: str) -> DataFrame:
    return StreamTables(t.spark, t.folder).view(view)


@query("stream_accuracy", SCORED + f"""
SELECT model, count(*) AS n, count(*) FILTER ({RIGHT}) AS n_correct, count(*) FILTER ({SOFT}) AS n_formatted, CAST(sum({set_sql('full')}) AS DOUBLE) AS reward_sum FROM ext GROUP BY model""")
def _(t: Tables):
    return S.run_to_end(S.stream_accuracy(_live(t, "completions")), scratch_dir(t.spark, "accuracy"), "complete")


@query("stream_reward_windows", WINDOWS + "SELECT run, win, n, round(mean_reward, 7) AS mean_reward FROM w")
def _(t: Tables):
    log = parse_training_log(_live(t, "log_lines"), fields=("step", "reward"))
    out = S.run_to_end(S.stream_reward_windows(log), scratch_dir(t.spark, "windows"), "complete")
    return out.withColumn("mean_reward", F.round("mean_reward", 7))


@query("stream_tripwire", LOG + """
, a AS (SELECT run, line_no, step, 'adapter above limit' AS alert, b_max AS value FROM log WHERE b_max > 1.0
 UNION ALL SELECT run, line_no, step, 'KL at first step', kl FROM log WHERE step <= 1 AND kl >= 1.0
 UNION ALL SELECT run, line_no, step, 'gradient not finite', CAST(nonfinite AS DOUBLE) FROM log WHERE nonfinite > 0) SELECT * FROM a""")
def _(t: Tables):
    log = parse_training_log(_live(t, "log_lines"), fields=("step", "b_max", "kl", "nonfinite"))
    return S.run_to_end(S.stream_tripwire(log), scratch_dir(t.spark, "alerts"))


@query("stream_token_alerts", """
SELECT batch_key, step, list_min(ids) AS low, list_max(ids) AS high, true AS violates FROM @token_batches WHERE list_min(ids) < 0 OR list_max(ids) >= 30000""")
def _(t: Tables):
    return S.run_to_end(S.stream_token_alerts(_live(t, "token_batches"), 30000), scratch_dir(t.spark, "tokens"))


@query("stream_dedup", "SELECT sha256(text) AS sha256 FROM @documents GROUP BY 1")
def _(t: Tables):
    docs = StreamTables(t.spark, t.folder).documents
    arriving = docs.select(F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    folder = scratch_dir(t.spark, "dedup")
    return S.run_to_end(S.stream_first_contents(arriving), folder, "update", handle=S.write_newcomers(f"{folder}/rows")).select("sha256")


# copies that arrive within the watermark are dropped by the state, all others by the written table
@query("stream_dedup_watermark", "SELECT sha256(text) AS sha256 FROM @documents GROUP BY 1")
def _(t: Tables):
    docs = StreamTables(t.spark, t.folder).documents
    arriving = docs.select(F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
                           F.timestamp_seconds(F.col("doc_id") + 1704067200).alias("seen_at"), F.col("text").alias("content"))
    folder = scratch_dir(t.spark, "dedup")
    return S.run_to_end(S.stream_dedup(arriving), folder, handle=S.index_unseen(f"{folder}/rows")).select("sha256")


@query("stream_sessions", f"WITH {SESSIONS} SELECT source, session_id, seq FROM seqs")
def _(t: Tables):
    folder = scratch_dir(t.spark, "sessions")
    log = _live(t, "rag_queries").select("id", "ts", "source", "session_id")
    return S.run_to_end(S.stream_first_sessions(log), folder, "update", handle=S.number_newcomers(f"{folder}/rows", f"{folder}/counters"))


# event time: hours that the watermark has closed
@query("stream_reward_hours", LOG + """
, h AS (SELECT run, CAST(floor(line_no / 60) AS BIGINT) AS hour, reward FROM log WHERE reward IS NOT NULL),
m AS (SELECT max(line_no) * 60 - 3600 AS mark FROM log WHERE reward IS NOT NULL)
SELECT run, hour, count(*) AS n, round(avg(reward), 7) AS mean_reward FROM h, m WHERE (hour + 1) * 3600 <= mark GROUP BY run, hour""")
def _(t: Tables):
    # a line a minute
    log = parse_training_log(_live(t, "log_lines"), fields=("reward",)).withColumn("ts", F.timestamp_seconds(F.col("line_no") * 60))
    out = S.run_to_end(S.stream_reward_hours(log), scratch_dir(t.spark, "hours"))
    return out.select("run", F.floor(F.unix_timestamp("hour") / 3600).alias("hour"), "n", F.round("mean_reward", 7).alias("mean_reward"))


@query("stream_order_states", ORDER_WALK.replace("@order_events", "@shipments"))
def _(t: Tables):
    events = _live(t, "shipments")
    return S.run_to_end(S.stream_order_states(events), scratch_dir(t.spark, "orders"), "update", key=["order_id"])


@query("stream_cache")
def _(t: Tables):
    return S.run_to_end(S.stream_cache(_live(t, "cache_events"), 3, 400_000), scratch_dir(t.spark, "cache"))


@query("stream_verdicts", MATRIX + " SELECT * FROM matrix")
def _(t: Tables):
    return S.run_to_end(S.stream_verdicts(_live(t, "rubric_items")), scratch_dir(t.spark, "verdicts"), "complete")
