"""Training-health checks over logs, tensors and timings derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import health as H
from tallyloom.operators.ordered import range_splits
from tallyloom.plans.registry import query
from tallyloom.plans.tables import Tables
from tallyloom.sources.logs import FIELDS, parse_training_log


def parsed(t: Tables, *fields: str):
    return parse_training_log(t.view("log_lines"), fields=fields or None)


def _sql_field(name: str) -> str:
    pattern, kind = FIELDS[name]
    hit = "nullif(regexp_extract(line, '" + pattern.replace("'", "''") + "', 1), '')"
    return f"{hit} AS {name}" if kind == "string" else f"TRY_CAST({hit} AS {'BIGINT' if kind == 'long' else 'DOUBLE'}) AS {name}"


LOG = "WITH log AS (SELECT run, line_no, " + ", ".join(_sql_field(f) for f in FIELDS) + " FROM @log_lines) "


@query("read_training_log", LOG + """
SELECT line_no, step, step_max, batch, batches, epoch, loss, CAST(grad_norm AS VARCHAR) IN ('nan', 'inf') AS odd_norm, reward, kl, b_max, a_max, grad_max,
       nonfinite, total, seen_grads, none_grads, nonzero_grads, hook_calls, hook_nonzero, hook_nonfinite, base_drift FROM log""")
def _(t: Tables):
    g = F.col("grad_norm")
    return parsed(t).withColumn("odd_norm", F.when(g.isNotNull(), ~H.is_finite(g))).select(
        "line_no", "odd_norm", *[f for f in FIELDS if f != "grad_norm"])


@query("step_sample", LOG + "SELECT run, step, b_max FROM log WHERE step <= 10 OR step % 25 = 0")
def _(t: Tables):
    return H.step_sample(parsed(t, "step", "b_max")).select("run", "step", "b_max")


@query("kl_verdict", LOG + """
, f AS (SELECT run, min(step) AS first_step, arg_min(kl, step) AS first_kl FROM log WHERE kl IS NOT NULL GROUP BY run)
SELECT *, CASE WHEN first_step > 500 THEN 'inconclusive' WHEN first_kl < 1.0 THEN 'healthy' ELSE 'sick' END AS verdict FROM f""")
def _(t: Tables):
    return H.kl_verdict(parsed(t, "step", "kl"), resumed_after=500)


@query("nonfinite_rate", LOG + """
SELECT run, count(*) AS n, count(*) FILTER (isnan(grad_norm)) AS n_nan, count(*) FILTER (isinf(grad_norm)) AS n_inf,
       count(*) FILTER (isfinite(grad_norm)) AS n_finite FROM log WHERE grad_norm IS NOT NULL GROUP BY run""")
def _(t: Tables):
    return H.nonfinite_rate(parsed(t, "grad_norm"))


@query("tripwire", LOG + """
SELECT run, min(step) AS first_step, arg_min(b_max, step) AS b_max, count(*) AS n_over FROM log WHERE b_max > 1.0 GROUP BY run""")
def _(t: Tables):
    return H.tripwire(parsed(t, "step", "b_max"))


GROWTH = LOG + """, g AS (SELECT run, step, b_max, lag(b_max) OVER (PARTITION BY run ORDER BY step) AS b_before FROM log WHERE b_max IS NOT NULL),
growth AS (SELECT *, b_max / nullif(b_before, 0) AS factor FROM g) """


def _growth(t: Tables):
    # steps are event numbers here, so their ranges need no look at the parsed log
    return H.growth_factor(parsed(t, "step", "b_max"), splits=range_splits(t.events, "event_id"))


@query("growth_factor", GROWTH + "SELECT run, step, b_max, b_before, factor FROM growth")
def _(t: Tables):
    return _growth(t)


@query("constant_growth", GROWTH + """
SELECT run, bool_and(abs(factor / 256.0 - 1) <= 0.05) AS "constant", min(factor) AS low, max(factor) AS high
FROM growth WHERE factor IS NOT NULL GROUP BY run""")
def _(t: Tables):
    return H.constant_growth(_growth(t))


@query("no_op_runs", LOG + """
SELECT run, coalesce(max(b_max) = 0, false) AS never_moves,
       coalesce(bool_and(nonzero_grads = 0 OR nonzero_grads <= nonfinite), false) AS no_gradients
FROM log WHERE b_max IS NOT NULL OR seen_grads IS NOT NULL GROUP BY run""")
def _(t: Tables):
    return H.no_op_runs(parsed(t, "b_max", "seen_grads", "nonzero_grads", "nonfinite"))


@query("nonfinite_tensors", """
WITH bad AS (SELECT kind, name FROM @tensors_bad WHERE len([x for x in vals if NOT isfinite(x)]) > 0),
top AS (SELECT kind, string_agg(name, ',' ORDER BY name) AS first_names FROM (SELECT * FROM bad QUALIFY row_number() OVER (PARTITION BY kind ORDER BY name) <= 5) q GROUP BY kind)
SELECT kind, count(*) AS n_bad, any_value(first_names) AS first_names FROM bad JOIN top USING (kind) GROUP BY kind""")
def _(t: Tables):
    return H.nonfinite_tensors(t.view("tensors_bad"), "kind")


@query("token_id_range", """
SELECT batch_key, step, list_min(ids) AS low, list_max(ids) AS high, list_min(ids) < 0 OR list_max(ids) >= 30000 AS violates FROM @token_batches""")
def _(t: Tables):
    return H.token_id_range(t.view("token_batches"), 30000).drop("ids")


SNAPS = """snaps AS (SELECT name, 0 AS snap, vals FROM @tensors_a UNION ALL
 SELECT name, 1, CASE WHEN kind = 4 THEN array_append(vals, CAST(0.5 AS FLOAT)) ELSE vals END FROM @tensors_a)"""


@query("checksum_drift", f"""
WITH {SNAPS}, s AS (SELECT name, snap, list_sum([abs(CAST(x AS DOUBLE)) for x in vals]) AS total FROM snaps)
SELECT name, snap, round(total, 6) AS total, round(start, 6) AS start, total <> start AS moved
FROM (SELECT *, first_value(total) OVER (PARTITION BY name ORDER BY snap) AS start FROM s) q""")
def _(t: Tables):
    a = t.view("tensors_a")
    later = F.when(F.col("kind") == 4, F.array_append("vals", F.lit(0.5).cast("float"))).otherwise(F.col("vals"))
    # both snapshots of a tensor come from one scan of its row
    snaps = a.select("name", F.posexplode(F.array("vals", later)).alias("snap", "vals"))
    out = H.checksum_drift(snaps)
    return out.select("name", "snap", F.round("total", 6).alias("total"), F.round("start", 6).alias("start"), "moved")


@query("absmax_by_kind", """
SELECT regexp_extract(name, 'lora_[AB]') AS part, max(CAST(list_max([abs(x) for x in vals]) AS DOUBLE)) AS abs_max, count(*) AS n FROM @tensors_a GROUP BY 1""")
def _(t: Tables):
    return H.absmax_by_kind(t.view("tensors_a"))


@query("hook_counts", """
WITH g AS (SELECT step, vals, len([x for x in vals if NOT isfinite(x)]) > 0 AS bad, CAST(list_max([abs(x) for x in vals]) AS DOUBLE) AS size FROM @tensors_bad)
SELECT step, count(vals) AS present, count(*) FILTER (vals IS NULL) AS absent, count(*) FILTER (vals IS NOT NULL AND (bad OR size > 0)) AS nonzero,
       count(*) FILTER (bad) AS nonfinite, max(size) FILTER (NOT bad) AS abs_max FROM g GROUP BY step""")
def _(t: Tables):
    return H.hook_counts(t.view("tensors_bad"))


DIFF = """WITH j AS (SELECT coalesce(a.name, b.name) AS name, a.vals AS va, b.vals AS vb FROM @tensors_a4 a FULL JOIN @tensors_b b ON a.name = b.name),
d AS (SELECT name, va IS NOT NULL AS in_a, vb IS NOT NULL AS in_b,
 CASE WHEN va IS NOT NULL AND vb IS NOT NULL THEN list_max([abs(CAST(va[i] AS DOUBLE) - CAST(vb[i] AS DOUBLE)) for i in range(1, len(va) + 1)]) END AS max_diff,
 CASE WHEN vb IS NOT NULL THEN CAST(list_max([abs(x) for x in va]) AS DOUBLE) END AS abs_max FROM j),
diff AS (SELECT *, coalesce(max_diff > 0.05 OR abs_max > 1e4, false) AS bad FROM d) """


@query("diff_tensors", DIFF + "SELECT name, in_a, in_b, round(max_diff, 8) AS max_diff, round(abs_max, 8) AS abs_max, bad FROM diff")
def _(t: Tables):
    out = H.diff_tensors(t.view("tensors_a4"), t.view("tensors_b"))
    return out.select("name", "in_a", "in_b", F.round("max_diff", 8).alias("max_diff"), F.round("abs_max", 8).alias("abs_max"), "bad")


@query("diff_verdict", DIFF + """
SELECT count(*) FILTER (in_a) AS n_a, count(*) FILTER (in_b) AS n_b, count(*) FILTER (in_a AND in_b) AS n_common, count(*) FILTER (bad) AS n_bad,
       round(max(max_diff), 8) AS worst,
       CASE WHEN count(*) FILTER (bad) = 0 AND count(*) FILTER (in_a AND in_b) > 0 AND count(*) FILTER (in_a) = count(*) FILTER (in_b) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM diff""")
def _(t: Tables):
    return H.diff_verdict(H.diff_tensors(t.view("tensors_a4"), t.view("tensors_b"))).withColumn("worst", F.round("worst", 8))


WINDOWS = LOG + ", w AS (SELECT run, CAST(floor(step / 50) AS BIGINT) AS win, count(*) AS n, avg(reward) AS mean_reward FROM log WHERE reward IS NOT NULL GROUP BY ALL) "


@query("reward_windows", WINDOWS + "SELECT run, win, n, round(mean_reward, 7) AS mean_reward FROM w")
def _(t: Tables):
    return H.reward_windows(parsed(t, "step", "reward")).withColumn("mean_reward", F.round("mean_reward", 7))


@query("flat_rewards", WINDOWS + """
SELECT run, count(*) AS n_windows, round(min(mean_reward), 7) AS low, round(max(mean_reward), 7) AS high, max(mean_reward) - min(mean_reward) <= 5 AS flat FROM w GROUP BY run""")
def _(t: Tables):
    out = H.flat_rewards(H.reward_windows(parsed(t, "step", "reward")), 5.0)
    return out.select("run", "n_windows", F.round("low", 7).alias("low"), F.round("high", 7).alias("high"), "flat")


@query("epoch_times", """
SELECT run, epoch, ts1 - lag(ts1) OVER w AS secs, ts1 - first_value(ts1) OVER w AS total_secs FROM @epochs WINDOW w AS (PARTITION BY run ORDER BY epoch)""")
def _(t: Tables):
    return H.epoch_times(t.view("epochs"))


@query("relative_change", """
SELECT model, round((avg(ended - started) FILTER (layout = 'permuted') / nullif(avg(ended - started) FILTER (layout = 'standard'), 0) - 1) * 100, 1) AS secs_pct,
       round((avg(passed) FILTER (layout = 'permuted') / nullif(avg(passed) FILTER (layout = 'standard'), 0) - 1) * 100, 1) AS passed_pct
FROM @agent_runs GROUP BY model""")
def _(t: Tables):
    runs = t.view("agent_runs").withColumn("secs", F.col("ended") - F.col("started"))
    return H.relative_change(runs, "model", "layout", "standard", "permuted", ["secs", "passed"])


@query("throughput", """
SELECT run, epoch, 32 AS effective_batch, round(n / nullif(ts1 - ts0, 0), 8) AS samples_per_s FROM @epochs""")
def _(t: Tables):
    out = H.throughput(t.view("epochs"), "n", F.col("ts1") - F.col("ts0"), 8, 4)
    return out.select("run", "epoch", "effective_batch", F.round("samples_per_s", 8).alias("samples_per_s"))


@query("progress", LOG + """
SELECT run, max(batch) AS batch, max(batches) AS batches, max(step) AS step, min(step_max - step) AS steps_left, arg_max(epoch, step) AS epoch
FROM log WHERE batch IS NOT NULL GROUP BY run""")
def _(t: Tables):
    return H.progress(parsed(t, "step", "step_max", "batch", "batches", "epoch"))
