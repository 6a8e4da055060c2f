"""Renames between fields of equal values."""

import datetime as dt
import json

from scantable.operators import drift


def test_equal_fields_are_all_renamed(spark, rows):
    """Two constants, and a third old field whose best fit goes to another: best first, each field once."""
    files = [(1, "x", dt.datetime(2025, 1, 1)), (2, "x", dt.datetime(2025, 1, 2))]
    old = [(1, i, {"candidate_id": i, "a": True, "b": True, "c": i < 9}) for i in range(10)]
    new = [(2, i, {"candidate_id": i, "p": True, "q": True, "r": True}) for i in range(10)]
    f = spark.createDataFrame(files, "file_id long, series_name string, exported_at timestamp")
    r = spark.createDataFrame([(a, b, json.dumps(c)) for a, b, c in old + new], "file_id long, line_no long, raw_record string")
    got = rows(drift.schema_changes(f, r), "change_kind", "old_field", "new_field")
    assert got == [("renamed", "a", "p"), ("renamed", "b", "q"), ("renamed", "c", "r")]
