import re

import __spark_entry__ as entry
import pytest

from tallyloom.plans.tables import BASE


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oracles_use_known_tables_only():
    for name, sql in entry.oracle_sql().items():
        assert not re.search(r"[@~]\w", re.sub(r"'[^']*'", "", sql)), name


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "n", "n_correct", "n_formatted", "accuracy_pct", "format_pct"] and df.count() > 0


@pytest.mark.parametrize("name", ["running_accuracy", "rubric", "bm25", "vector_topk", "range_counts", "group_advantage", "stream_accuracy"])
def test_against_duckdb(spark, folder, name):
    import duckdb
    from tools.compare import rows_of

    duck = duckdb.connect()
    for table in BASE:
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    frame = entry.queries()[name](spark, folder)
    want = duck.sql(entry.oracle_sql()[name])
    assert rows_of(frame.columns, frame.collect()) == rows_of(want.columns, want.fetchall())
