"""The driver contract."""

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert {r["verdict"] for r in entry.entry(spark).collect()} <= {"OK", "NG"}
