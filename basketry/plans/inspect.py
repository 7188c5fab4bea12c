"""Executed-plan inspection for tests and tuning.

Run the query first (``collect``/``write``) so the adaptive plan is final,
then read it here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def executed_plan(df: DataFrame) -> str:
    """Text of the final physical plan (the adaptive plan's current one)."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    return plan.toString()


def formatted_plan(df: DataFrame) -> str:
    """``explain("formatted")`` text, with runtime row counts once executed."""
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted")


def single_partition_rows(df: DataFrame) -> list[int]:
    """Runtime row counts of the shuffles that gather into one partition.

    Used to check that only bounded tables (a row per range, one-row
    aggregates) ever meet in a single task. -1 marks a stage whose count
    is unknown.
    """
    text = formatted_plan(df)
    single = set(re.findall(r"\((\d+)\) Exchange\s*\nInput[^\n]*\nArguments: SinglePartition", text))
    lines = text.splitlines()
    out = []
    for i, line in enumerate(lines[:-1]):
        m = re.search(r"ShuffleQueryStage \(\d+\)(?:, Statistics\(.*rowCount=([0-9.E+]+)\))?", line)
        if not m:
            continue
        e = re.search(r"Exchange \((\d+)\)", lines[i + 1])
        if e and e.group(1) in single:
            out.append(int(float(m.group(1))) if m.group(1) else -1)
    return out


def plan_counts(df: DataFrame) -> dict[str, int]:
    """How many scans, shuffles, reused shuffles, broadcasts, windows and
    Python UDF nodes the executed plan has."""
    text = executed_plan(df)
    return {
        "scans": len(re.findall(r"FileScan parquet|Scan parquet|Scan ExistingRDD", text)),
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", text)),
        "single_partition": len(re.findall(r"Exchange SinglePartition", text)),
        "reused": len(re.findall(r"ReusedExchange", text)),
        "broadcasts": len(re.findall(r"BroadcastExchange", text)),
        "windows": len(re.findall(r"\bWindow\b", text)),
        "python_udfs": len(re.findall(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas", text)),
    }


def pushed_filters(df: DataFrame) -> list[str]:
    """PushedFilters lists of the Parquet scans."""
    return re.findall(r"PushedFilters: \[([^\]]*)\]", formatted_plan(df))
