import re

import __spark_entry__ as entry
import pytest


def plan_of(spark, folder, name, capsys):
    df = entry.queries()[name](spark, folder)
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", [
    "accuracy_by_language", "running_accuracy", "overlap_counts", "range_counts", "length_ablation", "bm25", "vector_topk", "root_scopes",
    "classification_report", "config_delta", "cart_totals", "index_status"])
def test_no_pairwise_join(spark, folder, name, capsys):
    plan = plan_of(spark, folder, name, capsys)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name,columns", [
    ("word_counts", {"text"}), ("format_compliance", {"doc_id", "text", "lang", "n_chars"}), ("argmax", {"vec_id", "embedding"}),
    ("duration", {"event_id", "ts", "value"}), ("sweep_floor", {"l_suppkey", "l_linenumber", "l_quantity"})])
def test_scans_read_only_what_is_used(spark, folder, name, columns, capsys):
    plan = plan_of(spark, folder, name, capsys)
    for schema in re.findall(r"ReadSchema: struct<(.*)>", plan):
        assert set(re.findall(r"(\w+):", re.sub(r"<[^<>]*>", "", schema))) <= columns, schema


def test_filters_reach_the_scan(spark, folder, capsys):
    from pyspark.sql import functions as F

    from tallyloom.plans.tables import Tables

    capsys.readouterr()
    Tables(spark, folder).view("order_events").filter(F.col("order_id") == 7).explain("formatted")
    assert "EqualTo(l_orderkey,7)" in capsys.readouterr().out


@pytest.mark.parametrize("name", ["extraction_audit_samples", "vector_topk", "bm25"])
def test_rank_limits_apply_before_the_shuffle(spark, folder, name, capsys):
    plan = plan_of(spark, folder, name, capsys)
    assert plan.count("WindowGroupLimit") >= 2
