"""Benchmark runs, rubric checks and throughput tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import agentbench as B
from tallyloom.plans.registry import query
from tallyloom.plans.tables import Tables

VERDICT = "CASE WHEN rc = 124 THEN 'TIMEOUT' WHEN passed > 0 AND passed = total THEN 'PASS' ELSE 'FAIL' END"
RUNS = f"WITH v AS (SELECT *, {VERDICT} AS verdict FROM @agent_runs) "
SALT = "pack-salt-1"


@query("parse_test_summary", r"""
WITH p AS (SELECT run_id, expected, CAST(coalesce(regexp_extract_all(out, '(\d+) passed', 1)[-1], '0') AS BIGINT) AS passed,
  coalesce(list_sum([CAST(x AS BIGINT) for x in regexp_extract_all(out, '(\d+) (?:failed|error)', 1)]), 0) AS failed FROM @test_output),
q AS (SELECT run_id, passed, CAST(greatest(passed + failed, expected) AS BIGINT) AS total FROM p)
SELECT *, CASE WHEN total > 0 THEN passed || '/' || total || ' (' || (100 * passed // total) || '%)' END AS score, passed > 0 AND passed = total AS ok FROM q""")
def _(t: Tables):
    return B.parse_test_summary(t.view("test_output")).select("run_id", "passed", "total", "score", "ok")


@query("score_text", "SELECT run_id, passed || '/' || total || ' (' || (100 * passed // total) || '%)' AS score FROM @agent_runs")
def _(t: Tables):
    return t.view("agent_runs").select("run_id", B.score_text(F.col("passed"), F.col("total")).alias("score"))


@query("verdict", RUNS + "SELECT verdict, rc, count(*) AS n FROM v GROUP BY ALL")
def _(t: Tables):
    return B.with_verdict(t.view("agent_runs")).groupBy("verdict", "rc").agg(F.count(F.lit(1)).alias("n"))


@query("summary_table", RUNS + """
SELECT model, task, run, verdict, passed || '/' || total || ' (' || (100 * passed // total) || '%)' AS score, (ended - started) || 's' AS time,
       CASE WHEN verdict = 'FAIL' THEN note ELSE '' END AS note, row_number() OVER (PARTITION BY v.session ORDER BY started, v.run_id) AS nth, coalesce(f.fails, '') AS fails
FROM v LEFT JOIN (SELECT run_id, string_agg(item, ',' ORDER BY list_position(['deliverable', 'name', 'version', 'license', 'summary', 'order', 'lastline', 'protected', 'no-strays', 'evidence'], item))
  FILTER (NOT ok) AS fails FROM @rubric_items GROUP BY run_id) f ON v.run_id = f.run_id""")
def _(t: Tables):
    return B.summary_table(t.view("agent_runs"), t.view("rubric_items"))


META = """meta AS (SELECT run_id, max(content) FILTER (path = 'dist/package.meta') AS meta, max(content) FILTER (path = 'REPORT.md') AS report FROM @artifacts GROUP BY run_id),
f AS (SELECT *, regexp_extract(meta, '(?m)^Name: *(.*)$', 1) AS name, regexp_extract(meta, '(?m)^Version: *(.*)$', 1) AS version,
  regexp_extract(meta, '(?m)^License: *(.*)$', 1) AS license, regexp_extract(meta, '(?m)^Summary: *(.*)$', 1) AS summary,
  string_split(regexp_replace(meta, '\\n$', ''), chr(10)) AS lines FROM meta)"""
SUMMARY_OK = f"summary <> '' AND length(summary) <= 80 AND regexp_matches(summary, '(?i){B.SUMMARY_ALLOW}') AND NOT regexp_matches(summary, '(?i){B.SUMMARY_DENY}')"
ORDER_OK = "array_to_string([split_part(x, ':', 1) for x in lines], ' ') = 'Name Version License Summary Checked'"
EVIDENCE_OK = f"coalesce(regexp_matches(report, '(?m)^## Evidence') AND contains(report, 'VALIDATE-OK ' || substr(sha256(meta || '{SALT}'), 1, 12)) AND contains(report, sha256(meta)), false)"
PROTECTED = "prot AS (SELECT m.run_id, bool_and(coalesce(sha256(a.content) = m.sha256, false)) AS protected FROM @manifest m LEFT JOIN @artifacts a ON a.run_id = m.run_id AND a.path = m.path GROUP BY m.run_id)"
STRAYS = "stray AS (SELECT a.run_id, a.path FROM @artifacts a ANTI JOIN @manifest m ON a.run_id = m.run_id AND a.path = m.path WHERE a.path NOT IN ('dist/package.meta', 'REPORT.md'))"
RUBRIC = f"""WITH {META}, {PROTECTED}, {STRAYS},
n AS (SELECT run_id, count(*) AS n_strays FROM stray GROUP BY run_id),
r AS (SELECT f.*, coalesce(protected, true) AS protected, coalesce(n_strays, 0) AS n_strays FROM f LEFT JOIN prot USING (run_id) LEFT JOIN n USING (run_id)),
items AS (SELECT run_id, unnest([
  {{'ord': 1, 'item': 'deliverable', 'ok': meta IS NOT NULL, 'bad': 'no package file'}},
  {{'ord': 2, 'item': 'name', 'ok': name = 'samplepack', 'bad': 'Name=' || name}},
  {{'ord': 3, 'item': 'version', 'ok': version = '2.4.1', 'bad': 'Version=' || version}},
  {{'ord': 4, 'item': 'license', 'ok': license = 'BSD-2-Clause', 'bad': 'License=' || license}},
  {{'ord': 5, 'item': 'summary', 'ok': {SUMMARY_OK}, 'bad': 'Summary=' || summary}},
  {{'ord': 6, 'item': 'order', 'ok': {ORDER_OK}, 'bad': 'fields out of order, or lines too many'}},
  {{'ord': 7, 'item': 'lastline', 'ok': lines[-1] = 'Checked: manual', 'bad': 'last line differs'}},
  {{'ord': 8, 'item': 'protected', 'ok': protected, 'bad': 'an input file was changed or is gone'}},
  {{'ord': 9, 'item': 'no-strays', 'ok': n_strays = 0, 'bad': 'stray files: ' || n_strays}},
  {{'ord': 10, 'item': 'evidence', 'ok': {EVIDENCE_OK}, 'bad': 'no valid evidence'}}], recursive := true) FROM r)"""


@query("rubric", RUBRIC + " SELECT run_id, ord, item, ok, CASE WHEN ok THEN '' ELSE bad END AS note FROM items")
def _(t: Tables):
    return B.rubric(t.view("artifacts"), t.view("manifest"), SALT)


@query("rubric_scores", RUBRIC + """ SELECT run_id, count(*) FILTER (ok) || '/10 (' || (10 * count(*) FILTER (ok)) || '%)' AS score,
 coalesce(string_agg(item, ',' ORDER BY ord) FILTER (NOT ok), '') AS fails, count(*) FILTER (ok) = 10 AS passed FROM items GROUP BY run_id""")
def _(t: Tables):
    return B.rubric_scores(B.rubric(t.view("artifacts"), t.view("manifest"), SALT))


@query("kv_fields", f"WITH {META} SELECT run_id, name, version, license, summary FROM f")
def _(t: Tables):
    meta = t.view("artifacts").filter(F.col("path") == B.META)
    return meta.select("run_id", *[B.kv_field(F.col("content"), k).alias(k.lower()) for k in ("Name", "Version", "License", "Summary")])


@query("field_order", f"WITH {META} SELECT run_id, {ORDER_OK} AS in_order, lines[-1] = 'Checked: manual' AS terminated FROM f")
def _(t: Tables):
    meta = t.view("artifacts").filter(F.col("path") == B.META)
    return meta.select("run_id", B.field_order_holds(F.col("content"), B.FIELD_ORDER).alias("in_order"),
                       (B.last_line(F.col("content")) == B.LAST_LINE).alias("terminated"))


@query("allow_deny", f"WITH {META} SELECT run_id, {SUMMARY_OK} AS grounded FROM f")
def _(t: Tables):
    meta = t.view("artifacts").filter(F.col("path") == B.META)
    return meta.select("run_id", B.allow_deny(B.kv_field(F.col("content"), "Summary"), B.SUMMARY_ALLOW, B.SUMMARY_DENY).alias("grounded"))


@query("manifest_check", f"WITH {PROTECTED} SELECT * FROM prot")
def _(t: Tables):
    return B.manifest_check(t.view("manifest"), t.view("artifacts"))


@query("stray_files", f"WITH {STRAYS} SELECT * FROM stray")
def _(t: Tables):
    return B.stray_files(t.view("manifest"), t.view("artifacts"), [B.META, B.REPORT])


@query("evidence_check", f"WITH {META} SELECT run_id, {EVIDENCE_OK} AS proven FROM f")
def _(t: Tables):
    docs = t.view("artifacts").groupBy("run_id").agg(
        F.max(F.when(F.col("path") == B.META, F.col("content"))).alias("meta"),
        F.max(F.when(F.col("path") == B.REPORT, F.col("content"))).alias("report"))
    return docs.select("run_id", B.evidence_holds(F.col("meta"), F.col("report"), SALT).alias("proven"))


AXIS = "CASE " + " ".join(f"WHEN layout = 'permuted' AND item = '{k}' THEN '{v}'" for k, v in B.PERMUTED_AXIS.items()) + " " + " ".join(
    f"WHEN item = '{k}' THEN '{v}'" for k, v in B.AXIS.items()) + " END"
ORD = "CAST(list_position([" + ", ".join(f"'{i}'" for i in B.ITEMS) + "], item) AS BIGINT)"
MATRIX = f"""WITH matrix AS (SELECT layout, model, item, count(*) FILTER (ok) AS held, count(*) AS runs, {AXIS} AS axis, {ORD} AS ord FROM @rubric_items GROUP BY layout, model, item)"""


@query("compliance_matrix", MATRIX + " SELECT * FROM matrix")
def _(t: Tables):
    return B.compliance_matrix(t.view("rubric_items"))


@query("item_axis", f"SELECT layout, {AXIS} AS axis, count(*) AS n, count(*) FILTER (NOT ok) AS failed FROM @rubric_items GROUP BY ALL")
def _(t: Tables):
    return B.item_axis(t.view("rubric_items")).groupBy("layout", "axis").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("failed"))


@query("stochastic_or_hard", MATRIX + """
 SELECT layout, model, item, CASE WHEN held = 0 THEN 'hard gap' WHEN held = runs THEN 'solid' ELSE 'stochastic' END AS kind FROM matrix""")
def _(t: Tables):
    return B.stochastic_or_hard(B.compliance_matrix(t.view("rubric_items"))).select("layout", "model", "item", "kind")


@query("pool_sessions", RUNS + """
SELECT layout, model, count(*) FILTER (verdict = 'PASS') AS passes, count(*) AS runs, count(DISTINCT session) AS sessions,
       CAST(100 * count(*) FILTER (verdict = 'PASS') // count(*) AS BIGINT) AS pct FROM v GROUP BY ALL""")
def _(t: Tables):
    return B.pool_sessions(t.view("agent_runs"))


@query("pass_rate", RUNS + """
SELECT model, task, count(*) FILTER (verdict = 'PASS') AS passes, count(*) AS runs,
       round(count(*) FILTER (verdict = 'PASS') * 100.0::DOUBLE / count(*), 2) AS pct FROM v GROUP BY ALL""")
def _(t: Tables):
    return B.pass_rate(t.view("agent_runs"), ["model", "task"])


@query("verdict_totals", RUNS + """
SELECT model, task, CAST(grouping_id(model, task) AS BIGINT) AS level, count(*) FILTER (verdict = 'PASS') AS passes, count(*) AS runs FROM v GROUP BY ROLLUP (model, task)""")
def _(t: Tables):
    return B.verdict_totals(t.view("agent_runs"))


@query("task_model_matrix", RUNS + "SELECT task, " + ", ".join(
    f"count(*) FILTER (verdict = 'PASS' AND model = 'm{i}') AS m{i}" for i in range(4)) + " FROM v GROUP BY task")
def _(t: Tables):
    return B.task_model_matrix(t.view("agent_runs"), ["m0", "m1", "m2", "m3"])


@query("verdict_flips", RUNS + """
, l AS (SELECT *, lag(verdict) OVER (PARTITION BY model, task ORDER BY run) AS before FROM v)
SELECT model, task, count(*) FILTER (before <> verdict) AS flips, count(DISTINCT verdict) AS verdicts FROM l GROUP BY ALL""")
def _(t: Tables):
    return B.verdict_flips(t.view("agent_runs"))


@query("failure_signatures", """
WITH s AS (SELECT model, layout, run_id, coalesce(string_agg(item, ',' ORDER BY item) FILTER (NOT ok), '') AS signature FROM @rubric_items GROUP BY ALL)
SELECT model, layout, signature, count(*) AS runs FROM s GROUP BY ALL""")
def _(t: Tables):
    return B.failure_signatures(t.view("rubric_items"))


@query("failure_kind", """
SELECT model, CASE WHEN rc = 124 THEN 'timeout' WHEN passed = total THEN 'none' WHEN regexp_matches(note, '(?i)used (eval|re)|modified') THEN 'disqualified'
  WHEN regexp_matches(note, '(?i)invalid syntax') THEN 'syntax error' WHEN regexp_matches(note, '(?i)not created|missing') THEN 'no output'
  WHEN passed >= total - 1 THEN 'near miss' ELSE 'failing tests' END AS kind, count(*) AS runs FROM @agent_runs GROUP BY ALL""")
def _(t: Tables):
    kind = B.failure_kind(*[F.col(c) for c in ("note", "passed", "total", "rc")])
    return t.view("agent_runs").groupBy("model", kind.alias("kind")).agg(F.count(F.lit(1)).alias("runs"))


@query("min_runs_gate", RUNS + """
SELECT session, model, task, count(*) FILTER (verdict = 'PASS') AS passes, count(*) AS runs,
       round(count(*) FILTER (verdict = 'PASS') * 100.0::DOUBLE / count(*), 2) AS pct, count(*) >= 100 AS rankable FROM v GROUP BY ALL""")
def _(t: Tables):
    return B.min_runs_gate(t.view("agent_runs"), ["session", "model", "task"], 100)


@query("layout_effect", """
WITH r AS (SELECT item, count(*) FILTER (layout = 'standard' AND ok) * 100.0::DOUBLE / nullif(count(*) FILTER (layout = 'standard'), 0) AS standard,
 count(*) FILTER (layout = 'permuted' AND ok) * 100.0::DOUBLE / nullif(count(*) FILTER (layout = 'permuted'), 0) AS permuted FROM @rubric_items GROUP BY item)
SELECT item, round(standard, 6) AS standard, round(permuted, 6) AS permuted, round(permuted - standard, 6) AS points FROM r""")
def _(t: Tables):
    out = B.layout_effect(t.view("rubric_items"))
    return out.select("item", *[F.round(c, 6).alias(c) for c in ("standard", "permuted", "points")])


TIERS = {"click": "easy", "signup": "easy", "view": "mid", "purchase": "mid", "error": "parser"}


@query("tier_summary", RUNS + ", x AS (SELECT *, CASE task " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TIERS.items()) + """ END AS tier FROM v)
SELECT model, tier, CAST(grouping_id(model, tier) AS BIGINT) AS level, count(*) FILTER (verdict = 'PASS') AS passes, count(*) AS runs
FROM x GROUP BY GROUPING SETS ((model, tier), (tier), (model))""")
def _(t: Tables):
    return B.tier_summary(t.view("agent_runs"), TIERS)


@query("mean_std", """
SELECT model, depth, count(*) AS n, round(avg(pp), 4) AS pp_mean, round(avg(tg), 4) AS tg_mean, round(stddev_samp(pp), 4) AS pp_std, round(stddev_samp(tg), 4) AS tg_std
FROM @sweep WHERE status = 'ok' GROUP BY ALL""")
def _(t: Tables):
    out = B.mean_std(t.view("sweep").filter("status = 'ok'"), ["model", "depth"], ["pp", "tg"])
    return out.select("model", "depth", "n", *[F.round(c, 4).alias(c) for c in ("pp_mean", "tg_mean", "pp_std", "tg_std")])


@query("sweep_floor", """
SELECT model, min(knob) FILTER (status = 'ok') AS floor, max(tg) FILTER (status = 'ok') AS best_tg,
       arg_max(knob, tg * 100 - knob) FILTER (status = 'ok') AS best_knob, count(*) FILTER (status <> 'ok') AS n_failed, NOT bool_or(status = 'ok') AS failed_all
FROM @sweep GROUP BY model""")
def _(t: Tables):
    return B.sweep_floor(t.view("sweep"))


@query("config_delta", """
WITH m AS (SELECT model, knob, avg(pp) AS pp, avg(tg) AS tg FROM @sweep WHERE status = 'ok' GROUP BY ALL)
SELECT a.model, a.knob, round(a.pp, 4) AS pp, round(a.tg, 4) AS tg, round((a.pp / b.pp - 1) * 100, 4) AS pp_pct, round((a.tg / b.tg - 1) * 100, 4) AS tg_pct
FROM m a LEFT JOIN m b ON a.model = b.model AND b.knob = 7""")
def _(t: Tables):
    out = B.config_delta(t.view("sweep").filter("status = 'ok'"), ["model"], "knob", 7)
    return out.select("model", "knob", *[F.round(c, 4).alias(c) for c in ("pp", "tg", "pp_pct", "tg_pct")])


@query("depth_decay", """
WITH m AS (SELECT model, depth, avg(tg) AS tg FROM @sweep GROUP BY ALL)
SELECT model, depth, round(tg, 6) AS tg, round(tg / first_value(tg) OVER (PARTITION BY model ORDER BY depth), 6) AS kept FROM m""")
def _(t: Tables):
    return B.depth_decay(t.view("sweep")).select("model", "depth", F.round("tg", 6).alias("tg"), F.round("kept", 6).alias("kept"))


@query("fleet_ranking", """
WITH m AS (SELECT model, round(avg(tg), 6) AS tg FROM @sweep GROUP BY model)
SELECT model, tg, rank() OVER (ORDER BY tg DESC) AS rank, dense_rank() OVER (ORDER BY tg DESC) AS dense FROM m""")
def _(t: Tables):
    return B.fleet_ranking(t.view("sweep"), "model", "tg")


@query("duration", """
SELECT session, CAST(sum(ended - started) AS BIGINT) AS total_secs, max(ended - started) AS longest, max(ended) - min(started) AS wall_secs FROM @agent_runs GROUP BY session""")
def _(t: Tables):
    secs = B.duration("started", "ended")
    return t.view("agent_runs").groupBy("session").agg(
        F.sum(secs).alias("total_secs"), F.max(secs).alias("longest"), (F.max("ended") - F.min("started")).alias("wall_secs"))


@query("best_known", """
SELECT model, rep, knob, pp, tg FROM @sweep QUALIFY row_number() OVER (PARTITION BY model ORDER BY l_shipdate DESC, tg DESC, pp DESC, rep DESC, knob DESC) = 1""")
def _(t: Tables):
    return B.best_known(t.view("sweep"), "model", [F.col(c) for c in ("l_shipdate", "tg", "pp", "rep", "knob")], ["rep", "knob", "pp", "tg"])
