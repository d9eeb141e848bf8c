"""Readers and writers over printed, JSON and file forms of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.rewards import total_reward
from tallyloom.plans.registry import query
from tallyloom.plans.scoring import SCORED, set_sql
from tallyloom.plans.tables import Tables
from tallyloom.session import scratch_dir
from tallyloom.sources import files as S
from tallyloom.sources import results as P


@query("read_result_lines", """
SELECT run_id, model, task, run, CASE WHEN rc = 124 THEN 'TIMEOUT' WHEN passed = total THEN 'PASS' ELSE 'FAIL' END AS verdict,
       passed || '/' || total AS score, ended - started AS secs, CASE WHEN passed = total THEN 0 WHEN total = 13 THEN 2 ELSE 1 END AS n_fails FROM @agent_runs""")
def _(t: Tables):
    return P.parse_result_lines(t.view("result_lines")).withColumn("n_fails", F.size("fails")).drop("fails")


@query("read_items", "SELECT run_id, item, ok, CASE WHEN ok THEN '' ELSE item || ' not held' END AS note FROM @rubric_items")
def _(t: Tables):
    return P.parse_items(t.view("item_lines"))


@query("read_server_timings", """
WITH j AS (SELECT l_orderkey, l_linenumber, CAST(reply AS JSON) AS j FROM @server_replies)
SELECT l_orderkey, l_linenumber, (j->'$.timings') IS NULL AS failed, CAST(j->>'$.timings.prompt_n' AS BIGINT) AS prompt_n,
       CASE WHEN (j->'$.timings') IS NOT NULL THEN coalesce(CAST(j->>'$.timings.prompt_per_second' AS DOUBLE), 0) END AS pp,
       CAST(j->>'$.timings.predicted_n' AS BIGINT) AS gen_n,
       CASE WHEN (j->'$.timings') IS NOT NULL THEN coalesce(CAST(j->>'$.timings.predicted_per_second' AS DOUBLE), 0) END AS tg FROM j""")
def _(t: Tables):
    return P.parse_server_timings(t.view("server_replies"))


@query("read_timed_reply", """
WITH j AS (SELECT l_orderkey, l_linenumber, CAST(reply AS JSON) AS j, reply LIKE '%"error"%' AS bad FROM @timed_replies),
v AS (SELECT l_orderkey, l_linenumber, bad, j->>'$.error' AS error, coalesce(CAST(j->>'$.prompt_eval_count' AS BIGINT), 0) AS pc, coalesce(CAST(j->>'$.prompt_eval_duration' AS BIGINT), 1) AS pd,
  coalesce(CAST(j->>'$.eval_count' AS BIGINT), 0) AS ec, coalesce(CAST(j->>'$.eval_duration' AS BIGINT), 1) AS ed, coalesce(CAST(j->>'$.load_duration' AS BIGINT), 0) AS ld FROM j)
SELECT l_orderkey, l_linenumber, error, CASE WHEN NOT bad THEN pc END AS prompt_n, CASE WHEN NOT bad THEN round(pc / (pd / 1e9::DOUBLE), 4) END AS pp,
       CASE WHEN NOT bad THEN ec END AS gen_n, CASE WHEN NOT bad THEN round(ec / (ed / 1e9::DOUBLE), 4) END AS tg, CASE WHEN NOT bad THEN round(ld / 1e9::DOUBLE, 6) END AS load_secs FROM v""")
def _(t: Tables):
    out = P.parse_timed_reply(t.view("timed_replies"))
    return out.withColumn("pp", F.round("pp", 4)).withColumn("tg", F.round("tg", 4)).withColumn("load_secs", F.round("load_secs", 6))


@query("read_pipe_table", """
SELECT l_orderkey, l_linenumber, 's' || l_suppkey AS model, CAST(l_linenumber AS BIGINT) AS knob, 'pp512' AS test, CAST(round(l_extendedprice) AS BIGINT) + 0.5::DOUBLE AS speed FROM @lineitem""")
def _(t: Tables):
    rows = P.parse_pipe_table(t.view("sweep_output"), "out")
    c = F.col("cells")
    data = rows.filter(F.get(c, F.lit(3)).try_cast("double").isNotNull())
    return data.select("l_orderkey", "l_linenumber", c[0].alias("model"), c[1].cast("long").alias("knob"), c[2].alias("test"), c[3].cast("double").alias("speed"))


@query("latest_checkpoint", """
SELECT source AS run, arg_max('/out/' || source || '/checkpoint-' || doc_id, doc_id) AS path, max(doc_id) AS n FROM @documents WHERE lang <> 'es' GROUP BY source""")
def _(t: Tables):
    return P.latest_checkpoint(t.view("checkpoint_paths"), ["run"])


@query("spot_check", SCORED + f"""
SELECT doc_id, model, completion, answer, CAST({set_sql('full')} AS DOUBLE) AS reward FROM ext ORDER BY doc_id LIMIT 3""")
def _(t: Tables):
    scored = total_reward(t.view("completions"), "full")
    return scored.orderBy("doc_id").limit(3).select("doc_id", "model", "completion", "answer", F.col("reward").cast("double").alias("reward"))


@query("read_documents", "SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes FROM @documents GROUP BY source")
def _(t: Tables):
    folder = scratch_dir(t.spark, "documents")
    t.documents.select("source", F.col("text").alias("value")).write.partitionBy("source").text(folder)
    found = S.read_documents(t.spark, folder, "*.txt")
    return found.groupBy(F.regexp_extract("path", "source=([^/]+)", 1).alias("source")).agg(F.sum("n_bytes").alias("n_bytes"))


@query("read_json_or_default", """
SELECT user_id, coalesce(level, 'B1') AS level, coalesce(len(prefs), 0) AS n_prefs, coalesce(len(scores), 0) AS n_scores FROM @learners""")
def _(t: Tables):
    folder = scratch_dir(t.spark, "profiles")
    learners = t.view("learners")
    S.write_json(learners, folder)
    schema = "user_id long, level string, prefs array<string>, seen array<string>, scores array<double>"
    known = S.read_json_or_default(t.spark, folder, schema)
    nobody = S.read_json_or_default(t.spark, folder + "-missing", schema)
    both = known.unionByName(nobody)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return both.select("user_id", F.coalesce("level", F.lit("B1")).alias("level"), size("prefs").alias("n_prefs"), size("scores").alias("n_scores"))


@query("write_csv", "SELECT id, text, label FROM @sentiment")
def _(t: Tables):
    folder = scratch_dir(t.spark, "csv")
    S.write_csv(t.view("sentiment").select("id", "text", "label"), folder)
    return S.read_csv(t.spark, folder, "id long, text string, label int")


@query("write_json", "SELECT conv_id, turn, role, text FROM @conversations")
def _(t: Tables):
    folder = scratch_dir(t.spark, "json")
    S.write_json(t.conversations, folder)
    return S.read_json_or_default(t.spark, folder, "conv_id long, turn long, role string, text string")


@query("write_result_lines", """
SELECT model, task, run, CASE WHEN rc = 124 THEN 'TIMEOUT' WHEN passed > 0 AND passed = total THEN 'PASS' ELSE 'FAIL' END AS verdict FROM @agent_runs""")
def _(t: Tables):
    from tallyloom.operators.agentbench import summary_table

    folder = scratch_dir(t.spark, "lines")
    S.write_result_lines(summary_table(t.view("agent_runs")), folder)
    return P.read_result_lines(t.spark, folder).select("model", "task", "run", "verdict")
