import hashlib

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import agentbench as B
from tallyloom.operators import classification as C
from tallyloom.operators import health as H
from tallyloom.sources.logs import parse_training_log

SALT = "s1"
NOTE = "protected text"


def meta_text(**changes):
    fields = {"Name": "samplepack", "Version": "2.4.1", "License": "BSD-2-Clause", "Summary": "A small language model"} | changes
    return "".join(f"{k}: {v}\n" for k, v in fields.items()) + "Checked: manual\n"


def report_text(meta):
    token = hashlib.sha256((meta + SALT).encode()).hexdigest()[:12]
    return f"## Evidence\nVALIDATE-OK {token}\n{hashlib.sha256(meta.encode()).hexdigest()}\n"


def run_rubric(spark, files):
    rows = [("r", path, text) for path, text in files.items()]
    manifest = spark.createDataFrame([("r", "src/NOTES", hashlib.sha256(NOTE.encode()).hexdigest())], "run_id string, path string, sha256 string")
    items = B.rubric(spark.createDataFrame(rows, "run_id string, path string, content string"), manifest, SALT)
    return {r["item"]: r["ok"] for r in items.collect()}, B.rubric_scores(items).first()


def good_files():
    meta = meta_text()
    return {B.META: meta, B.REPORT: report_text(meta), "src/NOTES": NOTE}


def test_rubric_perfect_run(spark):
    items, score = run_rubric(spark, good_files())
    assert all(items.values()) and list(items) == list(B.ITEMS)
    assert (score["score"], score["fails"], score["passed"]) == ("10/10 (100%)", "", True)


@pytest.mark.parametrize("change,item", [
    ({"Name": "other"}, "name"), ({"Version": "2.5-dev"}, "version"), ({"License": "MIT"}, "license"),
    ({"Summary": "A numerical solver and language model"}, "summary"), ({"Summary": "x" * 81 + " transformer"}, "summary")])
def test_rubric_one_wrong_field(spark, change, item):
    meta = meta_text(**change)
    items, _ = run_rubric(spark, good_files() | {B.META: meta, B.REPORT: report_text(meta)})
    assert [i for i, ok in items.items() if not ok] == [item]


@pytest.mark.parametrize("files,item", [
    ({"src/NOTES": NOTE + "x"}, "protected"), ({"stray.txt": "x"}, "no-strays"), ({B.REPORT: "## Evidence\n"}, "evidence")])
def test_rubric_one_wrong_file(spark, files, item):
    items, _ = run_rubric(spark, good_files() | files)
    assert [i for i, ok in items.items() if not ok] == [item]


def test_rubric_blank_line_breaks_order_and_hidden_files_are_ignored(spark):
    meta = meta_text().replace("License", "\nLicense")
    files = good_files() | {B.META: meta, B.REPORT: report_text(meta), "agent.log": "x", "a/__pycache__/b.pyc": "x", ".hidden": "x"}
    items, _ = run_rubric(spark, files)
    assert [i for i, ok in items.items() if not ok] == ["order"]


def test_rubric_seven_defects(spark):
    meta = meta_text(Name="x", Version="1", License="MIT", Summary="equation solver").replace("Checked: manual\n", "")
    items, score = run_rubric(spark, {B.META: meta, B.REPORT: report_text(meta), "src/NOTES": NOTE + "x"})
    assert score["score"] == "3/10 (30%)" and [i for i, ok in items.items() if ok] == ["deliverable", "no-strays", "evidence"]


@pytest.mark.parametrize("out,expected,want", [
    ("5 passed in 1s", 5, (5, 5, "5/5 (100%)", True)), ("1 failed, 12 passed", 13, (12, 13, "12/13 (92%)", False)),
    ("1 error", 0, (0, 1, "0/1 (0%)", False)), ("nothing", 4, (0, 4, "0/4 (0%)", False)), ("nothing", 0, (0, 0, None, False)),
    ("2 passed\n3 passed, 1 failed, 2 errors", 0, (3, 6, "3/6 (50%)", False))])
def test_parse_test_summary(spark, out, expected, want):
    row = B.parse_test_summary(spark.createDataFrame([(out, expected)], "out string, expected int")).first()
    assert (row["passed"], row["total"], row["score"], row["ok"]) == want


def test_timeout_never_passes(spark):
    df = spark.createDataFrame([(124, 5, 5), (0, 5, 5), (0, 4, 5), (0, 0, 0)], "rc int, passed long, total long")
    assert [r["verdict"] for r in B.with_verdict(df).collect()] == ["TIMEOUT", "PASS", "FAIL", "FAIL"]


def test_matrix_and_kinds(spark):
    rows = [("standard", "m", "lastline", i < 4, i) for i in range(5)] + [("permuted", "m", "lastline", True, 9), ("standard", "m", "name", False, 1)]
    matrix = B.stochastic_or_hard(B.compliance_matrix(spark.createDataFrame(rows, "layout string, model string, item string, ok boolean, run int")))
    got = {(r["layout"], r["item"]): (r["held"], r["runs"], r["axis"], r["kind"]) for r in matrix.collect()}
    assert got == {("standard", "lastline"): (4, 5, "tail-read", "stochastic"), ("permuted", "lastline"): (1, 1, "moved-to-head", "solid"),
                   ("standard", "name"): (0, 1, "compliance", "hard gap")}


def test_pass_rates_as_published(spark):
    rows = [(t, 0, 1 if i < n else 0, 1, "m") for t, n in (("regex", 8), ("interp", 10), ("codec", 13), ("perf", 14)) for i in range(14)]
    out = B.pass_rate(spark.createDataFrame(rows, "task string, rc int, passed long, total long, model string"), ["task"])
    assert {r["task"]: round(r["pct"]) for r in out.collect()} == {"regex": 57, "interp": 71, "codec": 93, "perf": 100}


def test_speculative_delta_and_sweep_floor(spark):
    df = spark.createDataFrame([("s", 0, 4580.0, 85.3), ("s", 1, 3450.0, 149.2)], "model string, cfg int, pp double, tg double")
    row = B.config_delta(df, ["model"], "cfg", 0).filter("cfg = 1").first()
    assert (round(row["pp_pct"]), round(row["tg_pct"])) == (-25, 75)
    sweep = spark.createDataFrame([("q", 8, 0, "oom"), ("q", 10, 96, "ok"), ("q", 12, 90, "ok"), ("z", 8, 0, "oom")], "model string, knob int, tg long, status string")
    got = {r["model"]: (r["floor"], r["best_tg"], r["best_knob"], r["failed_all"]) for r in B.sweep_floor(sweep).collect()}
    assert got == {"q": (10, 96, 10, False), "z": (None, None, None, True)}


def test_early_stop_as_published(spark):
    def history(run, accs):
        return [(run, i + 1, a) for i, a in enumerate(accs)]

    rows = history("five", [0.1, 0.2, 0.9, 0.8, 0.8, 0.8, 0.9, 0.7, 0.95]) + history("long", [0.1, 0.2, 0.3])
    two = history("two", [0.9, 0.95, 0.9, 0.9]) + history("first", [0.96, 0.95, 0.96])
    schema = "run string, epoch int, eval_acc double"
    got = {r["run"]: (r["epochs_run"], r["best_nth"], r["stopped_early"]) for r in C.early_stop(spark.createDataFrame(rows, schema), "eval_acc", 5).collect()}
    assert got == {"five": (8, 3, True), "long": (3, 3, False)}
    got = {r["run"]: (r["epochs_run"], r["best_nth"]) for r in C.early_stop(spark.createDataFrame(two, schema), "eval_acc", 2).collect()}
    assert got == {"two": (4, 2), "first": (3, 1)}


def test_plateau(spark):
    rows = [("r", i + 1, a) for i, a in enumerate([0.5, 0.4, 0.4, 0.4, 0.6, 0.6, 0.6, 0.6])]
    out = C.plateau_lr(spark.createDataFrame(rows, "run string, epoch long, m double"), "m", 0.01).orderBy("epoch").collect()
    assert [round(r["lr"], 6) for r in out] == [0.01, 0.01, 0.01, 0.001, 0.001, 0.001, 0.001, 0.0001]


def test_chance_level(spark):
    rows = [("flat", 0.693, 0.5)] * 6 + [("fine", 0.3, 0.9), ("fine", 0.693, 0.5)]
    out = C.chance_level_runs(spark.createDataFrame(rows, "run string, eval_loss double, eval_acc double"))
    assert {r["run"]: r["at_chance"] for r in out.collect()} == {"flat": True, "fine": False}


def test_constant_growth_by_256(spark):
    rows = [("bad", i, 8.5e-4 * 256.0**i) for i in range(4)] + [("good", i, 0.01 * (i + 1)) for i in range(4)]
    out = H.constant_growth(H.growth_factor(spark.createDataFrame(rows, "run string, step long, b_max double")))
    assert {r["run"]: r["constant"] for r in out.collect()} == {"bad": True, "good": False}


def test_kl_verdicts(spark):
    rows = [("a", 1, 0.0), ("b", 1, 0.0008), ("c", 1, 5807.0), ("d", 1, 45.0), ("e", 936, 0.1), ("a", 2, 9.0)]
    out = H.kl_verdict(spark.createDataFrame(rows, "run string, step long, kl double"), resumed_after=1)
    assert {r["run"]: r["verdict"] for r in out.collect()} == {"a": "healthy", "b": "healthy", "c": "sick", "d": "sick", "e": "inconclusive"}


def test_log_lines(spark):
    lines = ["[TRIPWIRE step 25] |B|max=1.250e-02 grad|max=3.100e+00 non-finite(B grads)=2/224",
             "batch 7/7473 | step 3/935 | left 932 steps | epoch 0.003", "{'loss': 0.1, 'grad_norm': nan, 'kl': 0.0008, 'step': 1}", "noise"]
    got = [r.asDict() for r in parse_training_log(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert (got[0]["step"], got[0]["b_max"], got[0]["grad_max"], got[0]["nonfinite"], got[0]["total"]) == (25, 0.0125, 3.1, 2, 224)
    assert (got[1]["batch"], got[1]["batches"], got[1]["step"], got[1]["step_max"], got[1]["epoch"]) == (7, 7473, 3, 935, 0.003)
    assert got[2]["grad_norm"] != got[2]["grad_norm"] and got[2]["kl"] == 0.0008 and got[2]["step"] == 1
    assert all(v is None for k, v in got[3].items() if k != "line")


def test_diff_tensors_verdicts(spark):
    schema = "name string, vals array<float>"
    a = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [0.5])], schema)
    assert H.diff_verdict(H.diff_tensors(a, a)).first()["verdict"] == "PASS"
    off = spark.createDataFrame([("x", [1.0, 2.2]), ("y", [0.5])], schema)
    assert H.diff_verdict(H.diff_tensors(a, off)).first()["n_bad"] == 1
    fewer = spark.createDataFrame([("x", [1.0, 2.0])], schema)
    assert H.diff_verdict(H.diff_tensors(a, fewer)).first()["verdict"] == "FAIL"
    empty = spark.createDataFrame([], schema)
    assert H.diff_verdict(H.diff_tensors(empty, empty)).first()["verdict"] == "FAIL"


def test_flat_reward_and_relative_time(spark):
    rows = [("flat", i, 1.47 + (i % 4) * 0.03) for i in range(200)] + [("up", i, i / 100) for i in range(200)]
    out = H.flat_rewards(H.reward_windows(spark.createDataFrame(rows, "run string, step long, reward double")), 0.09)
    assert {r["run"]: r["flat"] for r in out.collect()} == {"flat": True, "up": False}
    times = spark.createDataFrame([("m2", "plain", 13.8), ("m2", "fused", 11.9), ("m9", "plain", 65.5), ("m9", "fused", 55.7), ("m12", "plain", 82.0), ("m12", "fused", 74.4)], "m string, v string, t double")
    got = {r["m"]: r["t_pct"] for r in H.relative_change(times, "m", "v", "plain", "fused", ["t"]).collect()}
    assert got == {"m2": -13.8, "m9": -15.0, "m12": -9.3}


def test_report_handles_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, p int")
    got = {r["name"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in C.classification_report(df, "y", "p").collect()}
    assert got["1"] == (0.0, 0.0, 0.0, 1) and got["0"][1] == 1.0 and got["accuracy"][2] == pytest.approx(2 / 3)
    assert got["macro avg"][0] == pytest.approx(1 / 3)


def test_sigmoid_boundary_and_argmax_ties(spark):
    df = spark.createDataFrame([(0.0, [1.0, 3.0, 3.0])], "z double, v array<double>")
    row = df.select(C.sigmoid_label(F.col("z")).alias("s"), C.argmax(F.col("v")).alias("a"), C.bce_with_logits(F.lit(800.0), F.lit(0)).alias("b")).first()
    assert (row["s"], row["a"], row["b"]) == (0, 1, 800.0)
