"""Streams give the same rows whether a table is one file or a folder of parts that arrive one by one."""

import __spark_entry__ as entry
import pytest

from tallyloom.plans.streams import StreamTables
from tallyloom.plans.tables import BASE


@pytest.fixture(scope="module")
def parts(spark, folder, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("parts"))
    for name in BASE:
        key = spark.read.parquet(f"{folder}/{name}.parquet")
        order = {"events": "event_id", "lineitem": "l_orderkey", "documents": "doc_id", "conversations": "conv_id"}.get(name, key.columns[0])
        key.repartitionByRange(3, order).sortWithinPartitions(order).write.parquet(f"{to}/{name}.parquet")
    return to


def rows(frame):
    return sorted((tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("name", ["stream_accuracy", "stream_verdicts", "stream_token_alerts", "stream_tripwire", "stream_dedup"])
def test_same_rows(spark, folder, parts, name, monkeypatch):
    one = rows(entry.queries()[name](spark, folder))
    monkeypatch.setattr(StreamTables, "files_per_trigger", 1)
    assert rows(entry.queries()[name](spark, parts)) == one


def test_last_state_of_each_order(spark, parts, monkeypatch):
    monkeypatch.setattr(StreamTables, "files_per_trigger", 1)
    got = entry.queries()["stream_order_states"](spark, parts)
    assert got.count() == got.select("order_id").distinct().count() > 0
