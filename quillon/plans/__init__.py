"""Checks on physical plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

PYTHON_NODE = re.compile(r"\b(\w*(?:EvalPython|InPandas|InArrow|MapInBatch)\w*)\b")


class FallbackError(RuntimeError):
    """A plan that was to stay in the engine evaluates Python."""


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def python_nodes(df: DataFrame) -> list[str]:
    return sorted(set(PYTHON_NODE.findall(plan_text(df))))


def require_native(df: DataFrame) -> DataFrame:
    """The frame itself, or FallbackError if its plan has a Python node."""
    if found := python_nodes(df):
        raise FallbackError(", ".join(found))
    return df
