"""Scores and planning values as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintmill import fixed_values as V
from lintmill.functions.classify import first_hit
from lintmill.functions.text import present, strings


def complexity_score(code_cells: Column, errors: Column, warns: Column, spark: Column, platform: Column) -> Column:
    size = first_hit([(code_cells > limit, points) for limit, points in V.CELL_POINTS], 0)
    return (
        size + errors * 2 + warns
        + F.when(spark, 2).otherwise(0)
        + F.when(platform, 1).otherwise(0)
    ).cast("long")


def complexity_class(score: Column) -> Column:
    return first_hit([(score >= limit, level) for limit, level in V.COMPLEXITY_LEVELS], "low")


def effort_hours(complexity: Column, findings: Column, code_cells: Column) -> Column:
    base = first_hit([(complexity == k, v) for k, v in V.BASE_HOURS.items()], V.UNKNOWN_HOURS)
    return F.round(base + findings * F.lit(0.5) + code_cells * F.lit(0.2), 1)


def priority(complexity: Column, errors: Column) -> Column:
    return (
        F.when((errors > 5) | (complexity == "high"), "high")
        .when((errors > 0) | (complexity == "medium"), "medium")
        .otherwise("low")
    )


def duration_days(complexity: Column, findings: Column) -> Column:
    base = first_hit([(complexity == k, v) for k, v in V.BASE_DAYS.items()], V.UNKNOWN_DAYS)
    return (base + F.when(findings > 10, 2).when(findings > 5, 1).otherwise(0)).cast("int")


def dependencies(counts: dict[str, Column]) -> Column:
    """``counts`` gives the number of findings per category."""
    items = [F.when(counts[c] > 0, F.lit(text)) for c, text in V.CATEGORY_DEPENDENCIES]
    return present(*items, *[F.lit(t) for t in V.COMMON_DEPENDENCIES])


def _risk(item: tuple[str, str, str]) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(("risk", "impact", "probability"), item)])


def risks(complexity: Column, findings: Column) -> Column:
    return present(
        F.when(complexity == "high", _risk(V.COMPLEXITY_RISK)),
        F.when(findings > 10, _risk(V.VOLUME_RISK)),
        *[_risk(r) for r in V.COMMON_RISKS],
    )


def phases(days: Column, steps: dict[str, Column]) -> Column:
    def share(parts: int) -> Column:
        return F.greatest(F.lit(1), F.floor(days / parts).cast("int"))

    def phase(name: str, length: Column, tasks: Column) -> Column:
        return F.struct(F.lit(name).alias("phase"), length.alias("duration_days"), tasks.alias("tasks"))

    return F.array(
        phase("Preparation", share(4), steps["preparation_steps"]),
        phase("Code Changes", share(2), strings(V.CODE_CHANGE_TASKS)),
        phase("Testing", share(4), steps["testing_steps"]),
        phase("Deployment", F.lit(1), steps["deployment_steps"]),
    )


def default_advice(findings: Column) -> Column:
    return F.when(findings == 0, strings(V.CLEAN_FILE_ADVICE)).otherwise(strings(V.DEFAULT_ADVICE))


def file_advice(complexity: Column, findings: Column, prio: Column, doubtful: Column, failed: Column) -> Column:
    """Advice for one file; NULL inputs mean the part was not computed."""
    items = present(
        F.when(complexity == "high", F.lit(V.REC_COMPLEXITY)),
        F.when(findings > 10, F.lit(V.REC_VOLUME)),
        F.when(prio == "high", F.lit(V.REC_PRIORITY)),
        F.when(doubtful > 0, F.lit(V.REC_CONFIDENCE)),
        F.when(failed > 0, F.lit(V.REC_VALIDATION)),
    )
    return F.when(F.size(items) > 0, items).otherwise(strings(V.REC_DEFAULT))


def portfolio_advice(high: Column, risk_level: Column, failures: Column) -> Column:
    level = F.lit(None).cast("string")
    for name, text in V.FINAL_RISK.items():
        level = F.when(risk_level == name, F.lit(text)).otherwise(level)
    return present(
        F.when(high > 0, F.format_string(V.FINAL_PRIORITY_FORMAT, high)),
        level,
        F.when(failures > 0, F.format_string(V.FINAL_VALIDATION_FORMAT, failures)),
        *[F.lit(t) for t in V.FINAL_COMMON],
    )
