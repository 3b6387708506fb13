"""The SQL table function, one row at a time."""

from __future__ import annotations

import __spark_entry__ as entry_points


def test_the_table_function_builds_no_arrow_batch_per_row(spark, sf_dir):
    df = entry_points.queries()["flatten_json"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
