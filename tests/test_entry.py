"""The driver's contract: names, schemas, and SQL for what SQL can express."""

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.queries()["property_frequency"](spark, "/root/testdata/sf0.001")
    assert rows.columns == ["property", "frequency"] and rows.count() > 5
