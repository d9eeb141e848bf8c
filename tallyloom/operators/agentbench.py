"""Scoring and summarising repeated benchmark runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators.ordered import neighbour, number_rows

# fixed values: rubric items in report order, the axis each one tests, and where four of them move
ITEMS = ("deliverable", "name", "version", "license", "summary", "order", "lastline", "protected", "no-strays", "evidence")
AXIS = {
    "deliverable": "compliance", "name": "compliance",
    "version": "hallucination", "license": "hallucination", "summary": "hallucination",
    "order": "tail-read", "lastline": "tail-read",
    "protected": "thrashing", "no-strays": "thrashing",
    "evidence": "evidence-gate",
}
PERMUTED_AXIS = {"lastline": "moved-to-head", "evidence": "moved-to-head", "name": "moved-to-tail", "version": "moved-to-tail"}
TIMEOUT_RC = 124


def _lookup(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def parse_test_summary(df: DataFrame, out: str = "out", expected: str = "expected") -> DataFrame:
    """Counts out of a test runner's closing lines. ``expected`` raises the total of a protected suite."""
    text = F.col(out)
    passed = F.coalesce(
        F.try_element_at(F.regexp_extract_all(text, F.lit(r"(\d+) passed"), F.lit(1)), F.lit(-1)).try_cast("long"), F.lit(0))
    failed = F.aggregate(
        F.regexp_extract_all(text, F.lit(r"(\d+) (?:failed|error)"), F.lit(1)), F.lit(0).cast("long"),
        lambda acc, x: acc + x.cast("long"))
    df = df.withColumn("passed", passed).withColumn("total", F.greatest(F.col("passed") + failed, F.col(expected).cast("long")))
    return df.select(
        "*", F.when(F.col("total") > 0, score_text(F.col("passed"), F.col("total"))).alias("score"),
        ((F.col("passed") > 0) & (F.col("passed") == F.col("total"))).alias("ok"))


def floor_pct(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down; NULL for an empty whole."""
    return F.floor(F.try_divide(100 * part, whole)).cast("long")


def score_text(passed: Column, total: Column) -> Column:
    return F.concat(passed.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), floor_pct(passed, total).cast("string"), F.lit("%)"))


def verdict(rc: Column, ok: Column) -> Column:
    """A run that was cut off stays a TIMEOUT even when everything passed."""
    return F.when(rc == TIMEOUT_RC, "TIMEOUT").when(ok, "PASS").otherwise("FAIL")


def with_verdict(df: DataFrame) -> DataFrame:
    return df.withColumn("verdict", verdict(F.col("rc"), (F.col("passed") > 0) & (F.col("passed") == F.col("total"))))


def duration(start: str, end: str) -> Column:
    return F.col(end) - F.col(start)


def failed_items(items: DataFrame) -> DataFrame:
    """Names of the items that did not hold, per run and in the fixed item order."""
    failed = F.when(~F.col("ok"), F.struct(item_order(F.col("item")).alias("ord"), "item"))
    return items.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(failed)), lambda s: s["item"]), ",").alias("fails"))


def summary_table(df: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One printable row per run; with rubric items (run_id, item, ok) also the failed ones and the order of execution per session."""
    if items is not None:
        nth = number_rows(with_verdict(df), ["session"], ["started", "run_id"], "nth").join(failed_items(items), "run_id", "left")
        return _summary(nth, "nth", F.coalesce("fails", F.lit("")).alias("fails"))
    return _summary(with_verdict(df))


def _summary(df: DataFrame, *more: str | Column) -> DataFrame:
    return df.select(
        "model", "task", "run", "verdict", F.coalesce(score_text(F.col("passed"), F.col("total")), F.lit("-")).alias("score"),
        F.concat(duration("started", "ended").cast("string"), F.lit("s")).alias("time"),
        F.when(F.col("verdict") == "FAIL", F.col("note")).otherwise("").alias("note"), *more)


def item_axis(df: DataFrame) -> DataFrame:
    """Failure axis of an item; four items change theirs in the permuted layout."""
    moved = F.when(F.col("layout") == "permuted", _lookup(F.col("item"), PERMUTED_AXIS))
    return df.withColumn("axis", F.coalesce(moved, _lookup(F.col("item"), AXIS)))


def item_order(item: Column) -> Column:
    return F.array_position(F.array(*[F.lit(i) for i in ITEMS]), item).cast("long")


def compliance_matrix(items: DataFrame) -> DataFrame:
    """Held and total runs per layout, model and item, in the fixed item order."""
    held = items.groupBy("layout", "model", "item").agg(F.count_if("ok").alias("held"), F.count(F.lit(1)).alias("runs"))
    return item_axis(held).withColumn("ord", item_order(F.col("item")))


def stochastic_or_hard(matrix: DataFrame) -> DataFrame:
    kind = F.when(F.col("held") == 0, "hard gap").when(F.col("held") == F.col("runs"), "solid").otherwise("stochastic")
    return matrix.withColumn("kind", kind)


def pool_sessions(df: DataFrame) -> DataFrame:
    """Passes and runs over all sessions; layouts are separate populations and never mixed."""
    return with_verdict(df).groupBy("layout", "model").agg(
        F.count_if(F.col("verdict") == "PASS").alias("passes"), F.count(F.lit(1)).alias("runs"),
        F.count_distinct("session").alias("sessions")
    ).withColumn("pct", floor_pct(F.col("passes"), F.col("runs")))


def pass_rate(df: DataFrame, by: list[str]) -> DataFrame:
    return with_verdict(df).groupBy(*by).agg(
        F.count_if(F.col("verdict") == "PASS").alias("passes"), F.count(F.lit(1)).alias("runs")
    ).withColumn("pct", F.round(F.col("passes") * 100.0 / F.col("runs"), 2))


def verdict_totals(df: DataFrame) -> DataFrame:
    """PASS counts per model and task, per model, and overall, from one rollup."""
    return with_verdict(df).rollup("model", "task").agg(
        F.grouping_id().alias("level"), F.count_if(F.col("verdict") == "PASS").alias("passes"), F.count(F.lit(1)).alias("runs"))


def task_model_matrix(df: DataFrame, models: list[str]) -> DataFrame:
    """Tasks as rows, models as columns. The models are named, so no extra pass looks for them."""
    return with_verdict(df).groupBy("task").pivot("model", models).agg(F.count_if(F.col("verdict") == "PASS"))


def verdict_flips(df: DataFrame) -> DataFrame:
    """How often the verdict changes from one run to the next per model and task."""
    runs = with_verdict(df).select("model", "task", "run", "verdict")
    seen = neighbour(runs, ["model", "task"], ["run"], {"before": "verdict"})
    return seen.groupBy("model", "task").agg(
        F.count_if(F.col("before") != F.col("verdict")).alias("flips"), F.count_distinct("verdict").alias("verdicts"))


def failure_signatures(items: DataFrame) -> DataFrame:
    """How often each combination of failed items occurs. A run has ten items at most."""
    runs = items.groupBy("model", "layout", "run_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("item")))), ",").alias("signature"))
    return runs.groupBy("model", "layout", "signature").agg(F.count(F.lit(1)).alias("runs"))


def failure_kind(note: Column, passed: Column, total: Column, rc: Column) -> Column:
    return (
        F.when(rc == TIMEOUT_RC, "timeout")
        .when(passed == total, "none")
        .when(note.rlike("(?i)used (eval|re)|modified"), "disqualified")
        .when(note.rlike("(?i)invalid syntax"), "syntax error")
        .when(note.rlike("(?i)not created|missing"), "no output")
        .when(passed >= total - 1, "near miss")
        .otherwise("failing tests")
    )


def min_runs_gate(df: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    """Rates from fewer than ``least`` runs are not fit to rank."""
    return pass_rate(df, by).withColumn("rankable", F.col("runs") >= least)


def layout_effect(items: DataFrame) -> DataFrame:
    """Rate at which an item holds, per layout, and the difference in points."""
    def rate(layout: str) -> Column:
        mine = F.col("layout") == layout
        return F.try_divide(F.count_if(mine & F.col("ok")) * 100.0, F.count_if(mine))

    rates = items.groupBy("item").agg(rate("standard").alias("standard"), rate("permuted").alias("permuted"))
    return rates.withColumn("points", F.col("permuted") - F.col("standard"))


def tier_summary(df: DataFrame, tiers: dict[str, str]) -> DataFrame:
    """Pass rate per model and tier, per tier, and per model."""
    tiered = with_verdict(df).withColumn("tier", _lookup(F.col("task"), tiers))
    return tiered.groupingSets([["model", "tier"], ["tier"], ["model"]], "model", "tier").agg(
        F.grouping_id().alias("level"), F.count_if(F.col("verdict") == "PASS").alias("passes"), F.count(F.lit(1)).alias("runs"))


def mean_std(df: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(m).alias(f"{m}_mean") for m in measures], *[F.stddev_samp(m).alias(f"{m}_std") for m in measures])


def sweep_floor(df: DataFrame) -> DataFrame:
    """Smallest knob value that works, and the best speed; ``failed_all`` instead of an error."""
    ok = F.col("status") == "ok"
    return df.groupBy("model").agg(
        F.min(F.when(ok, F.col("knob"))).alias("floor"), F.max(F.when(ok, F.col("tg"))).alias("best_tg"),
        F.max_by("knob", F.when(ok, F.struct("tg", -F.col("knob")))).alias("best_knob"),
        F.count_if(~ok).alias("n_failed"), (~F.bool_or(ok)).alias("failed_all"))


def config_delta(df: DataFrame, by: list[str], config: str, base: int) -> DataFrame:
    """Mean speeds per configuration and their percentage change against the base one."""
    means = df.groupBy(*by, config).agg(F.avg("pp").alias("pp"), F.avg("tg").alias("tg"))
    bases = means.filter(F.col(config) == base).select(*by, F.col("pp").alias("_pp"), F.col("tg").alias("_tg"))
    return means.join(bases, by, "left").select(
        *by, config, "pp", "tg",
        *[((F.try_divide(F.col(m), F.col(f"_{m}")) - 1) * 100).alias(f"{m}_pct") for m in ("pp", "tg")])


def depth_decay(df: DataFrame) -> DataFrame:
    """Generation speed at each depth relative to the shallowest. One row per depth, so a plain window."""
    means = df.groupBy("model", "depth").agg(F.avg("tg").alias("tg"))
    first = F.first("tg").over(Window.partitionBy("model").orderBy("depth"))
    return means.withColumn("kept", F.col("tg") / first)


def fleet_ranking(df: DataFrame, by: str, measure: str) -> DataFrame:
    """Models by their mean; one row per model reaches the ranking window."""
    means = df.groupBy(by).agg(F.round(F.avg(measure), 6).alias(measure))
    w = Window.orderBy(F.desc(measure))
    return means.select(by, measure, F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"))


def best_known(df: DataFrame, by: str, order: list[Column], keep: list[str]) -> DataFrame:
    """Latest record per key. A maximum over packed rows combines before the shuffle, unlike a sort."""
    return df.groupBy(by).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_best")).select(by, "_best.*")


# ---- rubric over artifact files -----------------------------------------------------------------


def kv_field(text: Column, key: str) -> Column:
    """First value of a ``Key: value`` line; empty when there is none."""
    return F.regexp_extract(text, rf"(?m)^{key}: *(.*)$", 1)


def lines_of(text: Column) -> Column:
    """Lines without the empty piece behind a closing newline."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def field_order_holds(text: Column, keys: list[str]) -> Column:
    """The keys of all lines, blank ones included, are exactly the wanted sequence."""
    found = F.transform(lines_of(text), lambda line: F.substring_index(line, ":", 1))
    return F.array_join(found, " ") == " ".join(keys)


def last_line(text: Column) -> Column:
    return F.element_at(lines_of(text), -1)


def allow_deny(text: Column, allow: str, deny: str, max_len: int = 80) -> Column:
    return (F.length(text) > 0) & (F.length(text) <= max_len) & text.rlike(f"(?i){allow}") & ~text.rlike(f"(?i){deny}")


def evidence_holds(meta: Column, report: Column, salt: str) -> Column:
    """The report quotes the salted token and the digest of the final file."""
    token = F.substring(F.sha2(F.concat(meta, F.lit(salt)), 256), 1, 12)
    held = (
        report.rlike(r"(?m)^## Evidence") & report.contains(F.concat(F.lit("VALIDATE-OK "), token))
        & report.contains(F.sha2(meta, 256))
    )
    return F.coalesce(held, F.lit(False))


def manifest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Per run: does every protected file exist with its recorded digest."""
    now = files.select("run_id", "path", F.sha2("content", 256).alias("_now"))
    both = manifest.join(now, ["run_id", "path"], "left")
    return both.groupBy("run_id").agg(F.bool_and(F.coalesce(F.col("_now") == F.col("sha256"), F.lit(False))).alias("protected"))


def stray_files(baseline: DataFrame, now: DataFrame, allowed: list[str]) -> DataFrame:
    """Files that are new and neither allowed nor ignored."""
    seen = now.filter(~F.col("path").rlike(r"(^|/)\.[^/]*$|(^|/)__pycache__/|(^|/)agent\.log$") & ~F.col("path").isin(allowed))
    return seen.select("run_id", "path").join(baseline.select("run_id", "path"), ["run_id", "path"], "left_anti")


# fixed values: what a correct packaging job looks like
META, REPORT = "dist/package.meta", "REPORT.md"
EXPECTED = {"Name": "samplepack", "Version": "2.4.1", "License": "BSD-2-Clause"}
FIELD_ORDER = ["Name", "Version", "License", "Summary", "Checked"]
LAST_LINE = "Checked: manual"
SUMMARY_ALLOW = "language model|character-level|transformer|next[- ]token"
SUMMARY_DENY = "differential|numerical|integrat|approximat|equation|solver|mathematic"


def rubric(files: DataFrame, manifest: DataFrame, salt: str, baseline: DataFrame | None = None) -> DataFrame:
    """Ten checks per run -> (run_id, ord, item, ok, note). A run of the manifest that left no file fails its checks; it is not left out."""
    baseline = manifest if baseline is None else baseline
    docs = files.groupBy("run_id").agg(
        F.max(F.when(F.col("path") == META, F.col("content"))).alias("meta"),
        F.max(F.when(F.col("path") == REPORT, F.col("content"))).alias("report"))
    strays = stray_files(baseline, files, [META, REPORT]).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_strays"))
    runs = docs.join(manifest_check(manifest, files), "run_id", "full_outer").join(strays, "run_id", "left")
    meta = F.coalesce("meta", F.lit(""))
    there = F.col("meta").isNotNull()
    summary = kv_field(meta, "Summary")
    checks = {"deliverable": (there, F.lit("no package file"))}
    for item, key in (("name", "Name"), ("version", "Version"), ("license", "License")):
        checks[item] = (kv_field(meta, key) == EXPECTED[key], F.concat(F.lit(f"{key}="), kv_field(meta, key)))
    checks["summary"] = (allow_deny(summary, SUMMARY_ALLOW, SUMMARY_DENY), F.concat(F.lit("Summary="), summary))
    checks["order"] = (there & field_order_holds(meta, FIELD_ORDER), F.lit("fields out of order, or lines too many"))
    checks["lastline"] = (there & (last_line(meta) == LAST_LINE), F.lit("last line differs"))
    checks["protected"] = (F.coalesce("protected", F.lit(True)), F.lit("an input file was changed or is gone"))
    checks["no-strays"] = (F.coalesce("n_strays", F.lit(0)) == 0, F.concat(F.lit("stray files: "), F.coalesce("n_strays", F.lit(0)).cast("string")))
    checks["evidence"] = (evidence_holds(F.col("meta"), F.col("report"), salt), F.lit("no valid evidence"))
    packed = F.array(*[
        F.struct(F.lit(i + 1).alias("ord"), F.lit(item).alias("item"), checks[item][0].alias("ok"),
                 F.when(checks[item][0], "").otherwise(checks[item][1]).alias("note"))
        for i, item in enumerate(ITEMS)])
    return runs.select("run_id", F.inline(packed))


def rubric_scores(items: DataFrame) -> DataFrame:
    """Score line and failed items per run; PASS only when all ten hold."""
    out = items.groupBy("run_id").agg(
        F.count_if("ok").alias("held"), F.count(F.lit(1)).alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("ord", "item")))), lambda s: s["item"]), ",").alias("fails"))
    return out.select("run_id", score_text(F.col("held"), F.col("total")).alias("score"), "fails", (F.col("held") == F.col("total")).alias("passed"))


VERIFIERS: dict[str, Callable[..., DataFrame]] = {"packaging": rubric}


def verify(task: str, *args, **options) -> DataFrame:
    """Check the runs of a task by the verifier that is registered for it."""
    if task not in VERIFIERS:
        raise KeyError(f"no verifier for {task!r}; there are: {', '.join(sorted(VERIFIERS))}")
    return VERIFIERS[task](*args, **options)


def register_verifier(task: str, build: Callable[..., DataFrame]) -> None:
    """Plug in the rubric of another task: a function to rows of (run_id, ord, item, ok, note)."""
    VERIFIERS[task] = build
