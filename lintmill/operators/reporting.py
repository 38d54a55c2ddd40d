"""Per-file reports, portfolio numbers and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill import fixed_values as V
from lintmill.functions import scoring
from lintmill.operators.planning import plan_summary


# --- per file ---------------------------------------------------------------

def change_types(mods: DataFrame) -> DataFrame:
    kind = F.coalesce("change_type", F.lit("unknown")).alias("change_type")
    return mods.groupBy("file_path", kind).agg(F.count(F.lit(1)).alias("modifications"))


def mod_summary(mods: DataFrame) -> DataFrame:
    confidence = F.coalesce("confidence_level", F.lit(0.0))
    return mods.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("total_modifications"),
        # summed as decimals, so that the order of rows does not matter
        F.round(F.avg(confidence.cast("decimal(10,6)")), 2).cast("double").alias("average_confidence"),
        F.count_if(confidence >= 0.8).alias("high_confidence_changes"),
        F.count_if(F.coalesce("confidence_level", F.lit(1.0)) < 0.7).alias("low_confidence_changes"),
    )


def validation_summary(validations: DataFrame) -> DataFrame:
    valid = F.coalesce("is_valid", F.lit(False))
    return validations.groupBy("path").agg(
        F.count(F.lit(1)).alias("total_validations"),
        F.count_if(valid).alias("passed_validations"),
        F.sum("issues_found").alias("total_issues"),
        F.sum("warnings").alias("total_warnings"),
        F.array_join(F.sort_array(F.collect_set("validation_type")), ",").alias("validation_types"),
        F.count_if(~F.coalesce("is_valid", F.lit(True))).alias("failed_validations"),
        F.when(F.min(valid), "passed").otherwise("failed").alias("overall_status"),
    )


def file_report(
    files: DataFrame, analysis: DataFrame, plans: DataFrame, mods: DataFrame, validations: DataFrame
) -> DataFrame:
    """One row per file; missing parts show in the status columns.

    Every side has at most one row per path before the joins.
    """
    def status(marker: str, missing: str) -> Column:
        return F.when(F.col(marker).isNull(), missing).otherwise("completed")

    kinds = mods.groupBy(F.col("file_path").alias("path")).agg(*[
        F.count_if(F.col("change_type") == kind).alias(f"{kind}_changes")
        for kind in ("replace", "insert", "delete", "modify")
    ])
    joined = (
        files.select("path", "filename", "cell_count", "code_cell_count")
        .join(analysis.drop("cell_count", "code_cell_count", "any_spark", "any_platform", "score"), "path", "left")
        .join(plan_summary(plans), "path", "left")
        .join(mod_summary(mods).withColumnRenamed("file_path", "path"), "path", "left")
        .join(kinds, "path", "left")
        .join(validation_summary(validations), "path", "left")
    )
    return joined.withColumns({
        "analysis_status": status("complexity", "not_completed"),
        "plan_status": status("priority", "not_completed"),
        "modifications_status": status("total_modifications", "no_modifications_needed"),
        "validation_status": status("total_validations", "not_completed"),
        "recommendations": scoring.file_advice(
            F.col("complexity"), F.col("findings"), F.col("priority"),
            F.col("low_confidence_changes"), F.col("failed_validations"),
        ),
    })


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that have no analysis yet; all of them, not one at a time."""
    return files.join(done.select("path").distinct(), "path", "left_anti")


def finished(files: DataFrame, done: DataFrame) -> DataFrame:
    return files.join(done.select("path").distinct(), "path", "left_semi")


def first_pending(files: DataFrame, done: DataFrame, order: str) -> DataFrame:
    return pending(files, done).orderBy(order).limit(1)


def progress(files: DataFrame, done: DataFrame) -> DataFrame:
    """One row: total, processed, remaining and percentage."""
    total = files.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = done.agg(F.count_distinct("path").alias("processed")).select(total.alias("total"), "processed")
    share = F.when(F.col("total") > 0, F.col("processed") / F.col("total") * 100).otherwise(0.0)
    return counted.select(
        "total", "processed", (F.col("total") - F.col("processed")).alias("remaining"),
        share.alias("percentage"), (F.col("processed") >= F.col("total")).alias("complete"),
    )


# --- portfolio ----------------------------------------------------------------

def _per(total: Column, n: Column) -> Column:
    return total / F.greatest(n, F.lit(1))


def _or_zero(column: Column, zero=0) -> Column:
    return F.coalesce(column, F.lit(zero))


def statistics(analysis: DataFrame, mods: DataFrame, validations: DataFrame) -> DataFrame:
    """One row; every table is reduced to one row before they meet.

    ``analysis`` has a row for every file, with or without findings.
    """
    parts = {
        "a": analysis.agg(F.struct(
            F.count(F.lit(1)).alias("files"),
            _or_zero(F.sum("code_cell_count")).cast("long").alias("code_cells"),
            _or_zero(F.sum("findings")).alias("findings"),
            _or_zero(F.sum("effort_hours"), 0.0).alias("effort"),
            *[F.count_if(F.col("complexity") == c).alias(c) for c in ("low", "medium", "high")],
        )),
        "m": mods.agg(F.struct(F.count(F.lit(1)).alias("mods"))),
        "v": validations.agg(F.struct(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.coalesce("is_valid", F.lit(False))).alias("passed"),
        )),
    }
    row = analysis.sparkSession.range(1).select(*[df.scalar().alias(name) for name, df in parts.items()])
    n = F.col("a.files")
    return row.select(
        n.alias("total_files"), F.col("a.code_cells").alias("total_code_cells"),
        F.col("a.findings").alias("total_findings"),
        F.round(_per(F.col("a.findings"), n), 1).alias("findings_per_file"),
        F.col("a.low").alias("low_files"), F.col("a.medium").alias("medium_files"),
        F.col("a.high").alias("high_files"),
        F.round("a.effort", 1).alias("total_effort_hours"),
        F.col("m.mods").alias("total_modifications"),
        F.round(_per(F.col("m.mods"), n), 1).alias("modifications_per_file"),
        F.col("v.total").alias("total_validations"), F.col("v.passed").alias("passed_validations"),
        F.round(_per(F.col("v.passed"), F.col("v.total")) * 100, 1).alias("success_rate"),
    )


def complexity_distribution(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy("complexity").agg(F.count(F.lit(1)).alias("files"))


def priority_distribution(plans: DataFrame) -> DataFrame:
    return plans.groupBy("priority").agg(F.count(F.lit(1)).alias("files"))


def high_priority(plans: DataFrame, key: str = "path") -> DataFrame:
    return plans.filter("priority = 'high'").select(key)


def risk(plans: DataFrame, validations: DataFrame) -> DataFrame:
    """One row: overall risk level and what it is made of."""
    failures = validations.agg(
        F.count_if(~F.coalesce("is_valid", F.lit(True))).alias("n")
    ).scalar()
    at_risk = (F.col("priority") == "high") | (F.size("risks") > 3)
    counted = plans.agg(
        F.count_if(at_risk).alias("high_risk_files"), F.count(F.lit(1)).alias("_plans")
    ).withColumn("_share", _per(F.col("high_risk_files"), F.col("_plans")) * 100)
    return counted.select(
        F.when(F.col("_share") > 50, "high").when(F.col("_share") > 25, "medium")
        .otherwise("low").alias("overall_risk_level"),
        "high_risk_files", failures.alias("validation_failures"),
        F.round("_share", 1).alias("risk_percentage"),
    )


def timeline(plans: DataFrame) -> DataFrame:
    """One row: days of work and calendar days with some work done in parallel."""
    factor = F.lit(V.PARALLEL_FACTOR).cast("double")
    days = F.greatest(F.lit(1).cast("long"), F.floor(F.col("total_effort_days") * factor).cast("long"))
    return (
        plans.agg(_or_zero(F.sum(F.coalesce("duration_days", F.lit(1)))).alias("total_effort_days"))
        .withColumn("estimated_calendar_days", days)
        .withColumn("recommended_timeline", F.format_string(V.TIMELINE_FORMAT, "estimated_calendar_days"))
    )


def final_report(stats: DataFrame, plans: DataFrame, risks: DataFrame, times: DataFrame) -> DataFrame:
    """One row of scalar fields; details stay in their own tables."""
    high = plans.agg(F.count_if(F.col("priority") == "high").alias("n"))
    row = stats.sparkSession.range(1).select(
        *[_one_struct(df).scalar().alias(name) for name, df in (("s", stats), ("r", risks), ("t", times))],
        high.scalar().alias("high_priority_files"),
    )
    flat = row.select("s.*", "r.*", "t.*", "high_priority_files")
    return flat.withColumns({
        "executive_summary": executive_summary(),
        "recommendations": scoring.portfolio_advice(
            F.col("high_priority_files"), F.col("overall_risk_level"), F.col("validation_failures")
        ),
    })


def _one_struct(df: DataFrame) -> DataFrame:
    return df.select(F.struct(*df.columns).alias("s"))


def executive_summary() -> Column:
    return F.format_string(
        V.EXECUTIVE_FORMAT, F.col("total_files"), F.col("total_findings"),
        F.col("total_effort_hours"), F.col("estimated_calendar_days"),
    )


def run_summary(
    files: DataFrame, analysis: DataFrame, plans: DataFrame, mods: DataFrame,
    validations: DataFrame, converted: DataFrame,
) -> DataFrame:
    """One row of table sizes; success means that every file was analysed."""
    tables = {
        "total_files": files, "analysis_results": analysis, "migration_plans": plans,
        "code_modifications": mods, "validation_results": validations, "converted_files": converted,
    }
    row = files.sparkSession.range(1).select(*[
        df.agg(F.count(F.lit(1)).alias("n")).scalar().alias(name) for name, df in tables.items()
    ])
    return row.withColumn("success", F.col("analysis_results") >= F.col("total_files"))


def first_errors(errors: DataFrame, n: int = 3) -> DataFrame:
    """The first errors of a run, for display."""
    return errors.orderBy("seq").limit(n)
