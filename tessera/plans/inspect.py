"""Read facts out of Catalyst plans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    try:
        return str(df._jdf.queryExecution().executedPlan().toString())
    except Exception:  # noqa: BLE001
        return ""


def formatted_plan(df: DataFrame) -> str:
    try:
        return str(df._jdf.queryExecution().explainString(
            df.sparkSession._jvm.org.apache.spark.sql.execution.FormattedMode))
    except Exception:  # noqa: BLE001
        return physical_plan(df)


def check_plan(df: DataFrame) -> dict:
    """Facts the tests assert on."""
    plan = physical_plan(df)
    return {
        "python_udf": any(k in plan for k in ("BatchEvalPython", "ArrowEvalPython",
                                             "FlatMapGroupsInPandas", "MapInPandas", "MapInArrow", "PythonMapInArrow")),
        "cartesian": "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan,
        "pushed_filters": [ln.strip() for ln in plan.splitlines() if "PushedFilters: [" in ln
                           and "PushedFilters: []" not in ln],
        "exchanges": plan.count("Exchange "),
    }
