"""Classification metrics over classifier outputs and epoch histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import classification as C
from tallyloom.plans.registry import query
from tallyloom.plans.tables import Tables


@query("argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS predicted FROM @embeddings")
def _(t: Tables):
    return t.embeddings.select("vec_id", C.argmax(F.col("embedding")).alias("predicted"))


@query("sigmoid_label", "SELECT row_idx, CASE WHEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-z2)) > 0.5 THEN 1 ELSE 0 END AS predicted FROM @predictions")
def _(t: Tables):
    return t.view("predictions").select("row_idx", C.sigmoid_label(F.col("z2")).alias("predicted"))


BCE = "greatest(z2, 0) - z2 * label + ln(1 + exp(-abs(z2)))"


@query("bce_with_logits", f"SELECT row_idx, round({BCE}, 8) AS loss FROM @predictions")
def _(t: Tables):
    return t.view("predictions").select("row_idx", F.round(C.bce_with_logits(F.col("z2"), F.col("label")), 8).alias("loss"))


@query("batch_mean_loss", f"""
WITH b AS (SELECT run, {BCE} AS loss, floor((row_number() OVER (PARTITION BY run ORDER BY row_idx) - 1) / 32) AS batch FROM @predictions),
m AS (SELECT run, batch, avg(loss) AS loss FROM b GROUP BY ALL)
SELECT run, count(*) AS n_batches, round(avg(loss), 8) AS loss FROM m GROUP BY run""")
def _(t: Tables):
    rows = t.view("predictions").select("run", "row_idx", C.bce_with_logits(F.col("z2"), F.col("label")).alias("l"))
    out = C.batch_mean_loss(rows, "row_idx", "l", 32, ["run"])
    return out.select("run", "n_batches", F.round("loss", 8).alias("loss"))


LSE = "(list_max(e) + ln(list_sum([exp(x - list_max(e)) for x in e])))"


@query("token_cross_entropy", f"""
WITH w AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM @embeddings)
SELECT label, count(*) AS n, round(avg({LSE} - e[label + 1]), 6) AS loss,
       round(avg(0.9::DOUBLE * ({LSE} - e[label + 1]) + 0.1::DOUBLE * ({LSE} - list_sum(e) / len(e))), 6) AS smoothed
FROM w GROUP BY label""")
def _(t: Tables):
    logits, target = F.col("embedding"), F.col("label")
    return t.embeddings.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(C.cross_entropy(logits, target)), 6).alias("loss"),
        F.round(F.avg(C.cross_entropy(logits, target, 0.1)), 6).alias("smoothed"))


def _two_class(t: Tables):
    return t.view("predictions").select("run", "row_idx", "label", F.when(F.col("z1") > F.col("z0"), 1).otherwise(0).alias("pred"))


TWO = "two AS (SELECT run, row_idx, label, CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS pred FROM @predictions)"


@query("accuracy", f"WITH {TWO} SELECT run, count(*) AS n, round(avg(CAST(label = pred AS INT)), 8) AS accuracy FROM two GROUP BY run")
def _(t: Tables):
    return C.accuracy(_two_class(t), "label", "pred", ["run"]).withColumn("accuracy", F.round("accuracy", 8))


@query("binary_prf", f"""
WITH {TWO}, c AS (SELECT run, count(*) AS n, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = pred) AS ok FROM two GROUP BY run)
SELECT run, round(ok / n, 8) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS "precision",
       round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1 FROM c""")
def _(t: Tables):
    out = C.binary_prf(_two_class(t), "label", "pred", ["run"])
    return out.select("run", *[F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def _ten_class(t: Tables):
    return t.embeddings.select("label", (C.argmax(F.col("embedding")) % 10).cast("int").alias("pred"))


TEN = "ten AS (SELECT label, CAST((list_position(embedding, list_max(embedding)) - 1) % 10 AS INT) AS pred FROM @embeddings)"


@query("confusion_counts", f"WITH {TEN} SELECT label, pred AS prediction, count(*) AS n FROM ten GROUP BY ALL")
def _(t: Tables):
    return C.confusion_counts(_ten_class(t), "label", "pred")


@query("classification_report", f"""
WITH {TEN}, classes AS (SELECT label AS cls FROM ten UNION SELECT pred FROM ten),
s AS (SELECT cls, (SELECT count(*) FROM ten WHERE label = cls) AS support, (SELECT count(*) FROM ten WHERE pred = cls) AS given,
             (SELECT count(*) FROM ten WHERE pred = cls AND label = cls) AS hit FROM classes),
p AS (SELECT *, coalesce(hit / nullif(given, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS rc, coalesce(2 * hit / nullif(given + support, 0), 0) AS f FROM s)
SELECT CAST(cls AS VARCHAR) AS name, round(pr, 8) AS "precision", round(rc, 8) AS recall, round(f, 8) AS f1, support FROM p
UNION ALL SELECT 'macro avg', round(avg(pr), 8), round(avg(rc), 8), round(avg(f), 8), CAST(sum(support) AS BIGINT) FROM p
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 8), round(sum(rc * support) / sum(support), 8), round(sum(f * support) / sum(support), 8), CAST(sum(support) AS BIGINT) FROM p
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 8), CAST(sum(support) AS BIGINT) FROM p""")
def _(t: Tables):
    out = C.classification_report(_ten_class(t), "label", "pred")
    return out.select("name", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("batch_progress", f"""
WITH {TWO}, r AS (SELECT *, row_number() OVER (ORDER BY row_idx) AS n_total, sum(CAST(label = pred AS INT)) OVER (ORDER BY row_idx) AS n_right FROM two),
b AS (SELECT CAST(floor((n_total - 1) / 8) AS BIGINT) AS batch, * EXCLUDE (run) FROM r)
SELECT batch, max(n_total) AS n_total, CAST(max(n_right) AS BIGINT) AS n_right, round(max(n_right) / max(n_total), 8) AS accuracy
FROM b WHERE batch % 20 = 0 GROUP BY batch""")
def _(t: Tables):
    marked = _two_class(t).select("row_idx", (F.col("label") == F.col("pred")).alias("right"))
    out = C.batch_progress(marked, "row_idx", "right", 8, 20)
    return out.select("batch", "n_total", "n_right", F.round("accuracy", 8).alias("accuracy"))


@query("best_epoch_strict", """
SELECT run, epoch AS best_epoch, eval_acc AS best_acc FROM @epochs QUALIFY row_number() OVER (PARTITION BY run ORDER BY eval_acc DESC, epoch) = 1""")
def _(t: Tables):
    return C.best_epoch_strict(t.view("epochs"))


@query("best_epoch_by_loss", """
SELECT run, epoch AS best_epoch, eval_loss AS best_loss FROM @epochs QUALIFY row_number() OVER (PARTITION BY run ORDER BY eval_loss, epoch) = 1""")
def _(t: Tables):
    return C.best_epoch_by_loss(t.view("epochs"))


@query("early_stop", """
WITH RECURSIVE h AS (SELECT run, epoch, eval_acc, row_number() OVER (PARTITION BY run ORDER BY epoch) AS nth FROM @epochs),
walk AS (
  SELECT run, nth, eval_acc AS best, CAST(1 AS BIGINT) AS best_nth, 0 AS bad FROM h WHERE nth = 1
  UNION ALL
  SELECT h.run, h.nth, greatest(w.best, h.eval_acc), CASE WHEN h.eval_acc > w.best THEN h.nth ELSE w.best_nth END,
         CASE WHEN h.eval_acc > w.best THEN 0 ELSE w.bad + 1 END
  FROM walk w JOIN h ON h.run = w.run AND h.nth = w.nth + 1 WHERE w.bad < 5)
SELECT run, max(bad) >= 5 AS stopped_early, max(nth) AS epochs_run, max(best_nth) AS best_nth FROM walk GROUP BY run""")
def _(t: Tables):
    return C.early_stop(t.view("epochs"), "eval_acc", 5)


@query("plateau_lr", """
WITH RECURSIVE h AS (SELECT run, epoch, eval_acc, row_number() OVER (PARTITION BY run ORDER BY epoch) AS nth FROM @epochs),
walk AS (
  SELECT run, epoch, nth, eval_acc AS best, 0 AS bad, 0.001::DOUBLE AS lr FROM h WHERE nth = 1
  UNION ALL
  SELECT h.run, h.epoch, h.nth, CASE WHEN h.eval_acc > w.best * 1.0001::DOUBLE THEN h.eval_acc ELSE w.best END,
         CASE WHEN h.eval_acc > w.best * 1.0001::DOUBLE OR w.bad + 1 > 2 THEN 0 ELSE w.bad + 1 END,
         CASE WHEN NOT (h.eval_acc > w.best * 1.0001::DOUBLE) AND w.bad + 1 > 2 THEN w.lr * 0.1::DOUBLE ELSE w.lr END
  FROM walk w JOIN h ON h.run = w.run AND h.nth = w.nth + 1)
SELECT run, epoch, round(lr * 1e9, 3) AS lr_nano FROM walk""")
def _(t: Tables):
    out = C.plateau_lr(t.view("epochs"), "eval_acc", 0.001)
    return out.select("run", "epoch", F.round(F.col("lr") * 1e9, 3).alias("lr_nano"))


@query("chance_level_runs", """
SELECT run, bool_and(eval_acc = 0.5 AND abs(eval_loss - ln(2)) < 0.001) AS at_chance, count(*) AS n_epochs FROM @epochs GROUP BY run""")
def _(t: Tables):
    return C.chance_level_runs(t.view("epochs"))
