import pandas as pd
from pyspark.sql import functions as F

from tallyloom.operators import models as M
from tallyloom.sources import files as S
from tallyloom.sources import results as P
from tallyloom.sources.logs import read_training_log


def test_result_and_item_files(spark, tmp_path):
    (tmp_path / "r.txt").write_text("m|packaging|3|FAIL|8/10 (80%)|41s|lastline,evidence\nm|packaging|4|TIMEOUT|-|900s|\n")
    rows = P.read_result_lines(spark, str(tmp_path / "r.txt")).orderBy("run").collect()
    assert (rows[0]["run"], rows[0]["secs"], rows[0]["fails"]) == (3, 41, ["lastline", "evidence"])
    assert (rows[1]["verdict"], rows[1]["score"], rows[1]["fails"]) == ("TIMEOUT", None, [])
    old = spark.createDataFrame([("m|bugfix|FAIL|3/4 (75%)|9s|pytest still failing",)], "line string")
    assert P.parse_result_lines(old, with_run=False).first()["task"] == "bugfix"
    (tmp_path / "run7").mkdir()
    (tmp_path / "run7" / ".x").write_text("")
    (tmp_path / "run7" / "items").write_text("name|PASS|\nversion|FAIL|Version='a|b'\n")
    items = {r["item"]: (r["run"], r["ok"], r["note"]) for r in P.read_items(spark, str(tmp_path / "run7")).collect()}
    assert items == {"name": ("run7", True, ""), "version": ("run7", False, "Version='a|b'")}


def test_pipe_table_and_replies(spark):
    out = "load\n| model | tg |\n| --- | --- |\n| q4 | 96.6 |\nend"
    cells = [r["cells"] for r in P.parse_pipe_table(spark.createDataFrame([(out,)], "out string"), "out").orderBy("line_no").collect()]
    assert cells == [["model", "tg"], ["---", "---"], ["q4", "96.6"]]
    df = spark.createDataFrame([('{"timings": {"prompt_n": 5, "prompt_per_second": 2.5}}',), ('{"x": 1}',), ("broken",)], "reply string")
    assert [(r["failed"], r["prompt_n"], r["pp"], r["tg"]) for r in P.parse_server_timings(df).collect()] == [(False, 5, 2.5, 0.0), (True, None, None, None), (True, None, None, None)]
    df = spark.createDataFrame([('{"prompt_eval_count": 10, "prompt_eval_duration": 2000000000, "eval_count": 3}',), ('{"error": "gone", "eval_count": 3}',)], "reply string")
    rows = P.parse_timed_reply(df).collect()
    assert (rows[0]["pp"], rows[0]["tg"], rows[0]["load_secs"]) == (5.0, 3e9, 0.0) and (rows[1]["error"], rows[1]["gen_n"]) == ("gone", None)


def test_checkpoints_compare_as_numbers(spark):
    df = spark.createDataFrame([("r", "/o/checkpoint-935"), ("r", "/o/checkpoint-1000"), ("r", "/o/final"), ("s", "/o/x")], "run string, path string")
    assert {r["run"]: r["path"] for r in P.latest_checkpoint(df, ["run"]).collect()} == {"r": "/o/checkpoint-1000", "s": None}


def test_files(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_text("é")
    (tmp_path / "d" / "sub" / "b.txt").write_text("é")
    rows = S.read_documents(spark, str(tmp_path / "d")).collect()
    assert len(rows) == 2 and len({r["sha256"] for r in rows}) == 1 and rows[0]["content"] == "é" and rows[0]["n_bytes"] == 2
    df = spark.createDataFrame([(1, 'a "quoted", text\nnew line'), (2, "é")], "id long, text string")
    S.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, S.read_csv(spark, str(tmp_path / "csv"), "id long, text string").collect())) == sorted(map(tuple, df.collect()))
    S.write_json(df, str(tmp_path / "json"))
    assert S.read_json_or_default(spark, str(tmp_path / "json"), "id long, text string").count() == 2
    assert S.read_json_or_default(spark, str(tmp_path / "nothing"), "id long, text string").count() == 0
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "run_01.log").write_text("[TRIPWIRE step 2] |B|max=1.0e-02 grad|max=1.0e+00 non-finite(B grads)=0/4\n")
    row = read_training_log(spark, str(tmp_path / "logs")).first()
    assert (row["run"], row["step"], row["b_max"]) == ("run_01", 2, 0.01)


def test_score_batches_loads_once_and_respects_the_size(spark):
    def load():
        sizes = []

        def score(batch):
            sizes.append(len(batch))
            return pd.Series([float(max(sizes))] * len(batch), index=batch.index)

        return score

    out = M.score_batches(spark.range(50).coalesce(1), load, 16).agg(F.max("score"), F.count("score")).first()
    assert tuple(out) == (16.0, 50)


def test_mappers_and_metrics(spark):
    doubled = M.map_rows(spark.range(5), lambda pdf: pdf.assign(id=pdf["id"] * 2), "id long")
    assert sorted(r["id"] for r in doubled.collect()) == [0, 2, 4, 6, 8]


def test_param_search_survives_failures(spark):
    trials = M.sample_trials(spark, 30, 5)
    rows = trials.collect()
    assert all(4 <= r["rank"] <= 64 and r["rank"] % 4 == 0 and r["rank"] <= r["alpha"] <= 4 * r["rank"] and 0.1 <= r["dropout"] <= 0.5 for r in rows)

    def objective(params):
        if params["trial"] == 1:
            raise ValueError("no memory")
        return abs(params["rank"] - 20), {"seen": True}

    results = M.param_search(trials, objective)
    assert results[0]["loss"] == float("inf") and "no memory" in results[0]["error"]
    table = spark.createDataFrame([(r["trial"], r["rank"], r["loss"]) for r in results], "trial long, rank int, loss double")
    assert M.best_trial(table).first()["loss"] == min(r["loss"] for r in results)
    low_high = M.param_ranges(table, ["rank"]).first()
    assert (low_high["low"], low_high["high"]) == (min(r["rank"] for r in rows), max(r["rank"] for r in rows))


def test_classifier_learns(spark):
    rows = [(f"good great fine {i}", 1) for i in range(40)] + [(f"bad awful poor {i}", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "text string, label int")
    model, history = M.train_text_classifier(df, df, features=256, rounds=(1, 5))
    assert history[-1][1] == 1.0
    report = {r["name"]: r["f1"] for r in M.report_on(model, df).collect()}
    assert report["accuracy"] == 1.0
