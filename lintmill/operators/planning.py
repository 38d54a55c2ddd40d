"""Migration plans from analysis rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill import fixed_values as V
from lintmill.functions import scoring
from lintmill.functions.text import strings


def plan(analysis: DataFrame, key: str = "path") -> DataFrame:
    """One plan per analysis row; a pure projection."""
    complexity, findings = F.col("complexity"), F.col("findings")
    steps = {name: strings(texts) for name, texts in V.PLAN_STEPS.items()}
    by_category = {c: F.col(f"cat_{c}") for c, _ in V.CATEGORY_DEPENDENCIES}
    days = scoring.duration_days(complexity, findings)
    return analysis.select(
        key,
        scoring.priority(complexity, F.col("errors")).alias("priority"),
        *[steps[name].alias(name) for name in V.PLAN_STEPS],
        scoring.dependencies(by_category).alias("dependencies"),
        strings(V.PREREQUISITES).alias("prerequisites"),
        scoring.risks(complexity, findings).alias("risks"),
        strings(V.MITIGATIONS).alias("mitigation_strategies"),
        days.alias("duration_days"),
        scoring.phases(days, steps).alias("phases"),
    )


def plan_summary(plans: DataFrame, key: str = "path") -> DataFrame:
    return plans.select(
        key, "priority", "duration_days",
        *[F.size(name).alias(name) for name in V.PLAN_STEPS],
        F.size("risks").alias("risks_identified"),
    )
