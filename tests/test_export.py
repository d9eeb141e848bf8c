"""Exported records come back as they were written, whole batches at a time."""

from tallyloom.operators import retrieval as R
from tallyloom.operators import tutoring as U


def test_records_come_back(spark, tmp_path):
    log = spark.createDataFrame([(1, 10, "a \"q\"\n", "agent1", "u1"), (2, 11, "b", "agent1", "u2"), (3, 12, None, "cli", None)], "id long, ts long, text string, source string, session_id string")
    found = spark.createDataFrame([(1, 2, 70, "second"), (1, 1, 71, "first \u6771"), (2, 1, 72, None)], "q_id long, place long, chunk_id long, chunk_text string")
    feedback = spark.createDataFrame([(1, "bad", "x", 1), (1, "good", "y", 2)], "query_id long, verdict string, note string, ts long")
    records = R.export_records(log, R.number_sessions(log), found, feedback)
    R.write_records(records, str(tmp_path))
    R.write_records(records, str(tmp_path))  # a repeated batch replaces itself
    R.write_records(records.limit(0), str(tmp_path), 1)
    got = {r["id"]: r for r in R.read_records(spark, str(tmp_path)).collect()}
    assert sorted(map(str, got.values())) == sorted(map(str, records.collect())) and len(got) == 3
    assert (got[1]["session_seq"], got[1]["label"], got[1]["verdict"]) == (1, "agent1#1", "good") and got[2]["session_seq"] == 2 and got[3]["session_seq"] is None
    assert [tuple(c) for c in got[1]["chunks"]] == [(1, 71, "first \u6771"), (2, 70, "second")] and got[3]["chunks"] == []


def test_table_function_gives_what_the_columns_give(spark):
    raws = ['{"text": "t", "questions": [{"question": "Who?", "answer": "me"}, {"question": "Why?", "answer": null}]}', "no json", None, '```json\n{"questions": [{"question": "a", "answer": "b"}]}\n```', '{"questions": []}', "[1]"]
    df = spark.createDataFrame(list(enumerate(raws)), "k long, raw string")
    plain = U.explode_questions(U.parse_tutor_reply(df, "raw"))
    assert sorted(map(str, U.reply_questions(df, "raw").collect())) == sorted(map(str, plain.collect()))
