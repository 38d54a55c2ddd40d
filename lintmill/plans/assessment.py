"""A whole assessment: findings and sources in, result tables out.

Stages are functions from DataFrames to DataFrames. Tables that several stages
read are written once to the shared folder, when first asked for.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.functions.rewrite import Rule
from lintmill.operators import apply, matching, modify, planning, reporting, validate
from lintmill.operators import findings as finding_ops
from lintmill.session import materialize

FILE_COLUMNS = ["path", "filename", "file_type", "cell_count", "code_cell_count"]
MATCHERS = {"contains": matching.match_contains, "basename": matching.match_basename, "path": matching.match_path}


class Assessment:
    """Tables of one run over Python files (``files``, ``lines``), notebooks
    (``notebooks``, ``cells``) or both."""

    def __init__(
        self,
        findings: DataFrame,
        files: DataFrame | None = None,
        lines: DataFrame | None = None,
        notebooks: DataFrame | None = None,
        cells: DataFrame | None = None,
        *,
        match: str = "contains",
        parse: bool = True,
        rules: str = "compat",
        emit_noop: bool = True,
        extra: dict[str, Rule] | None = None,
    ):
        self._parsed = findings
        self.match, self.parse = match, parse
        self.rewriting = {"rules": rules, "emit_noop": emit_noop, "extra": extra}
        self.lines, self.cells = lines, cells
        corpora = [df.select(*FILE_COLUMNS) for df in (files, notebooks) if df is not None]
        self._corpus = reduce(DataFrame.unionByName, corpora)

    @cached_property
    def source(self) -> DataFrame:
        """Lines as rewriting reads them, numbered within their notebook once; ``lines`` are read as given."""
        sources = []
        if self.lines is not None:
            sources.append(matching.python_source(self.lines))
        if self.cells is not None:
            sources.append(materialize(matching.notebook_source(self.cells), "source"))
        return reduce(DataFrame.unionByName, sources)

    @cached_property
    def findings(self) -> DataFrame:
        return materialize(self._parsed, "findings")

    @cached_property
    def files(self) -> DataFrame:
        """Names and cell counts of all files, without their contents."""
        return materialize(self._corpus, "files")

    @cached_property
    def targets(self) -> DataFrame:
        """The files that findings mean, under the name that ``pairs`` gives them."""
        named = self.files.withColumn("filename", F.col("path")) if self.match == "path" else self.files
        return materialize(matching.matched_files(self.pairs, named), "targets")

    @cached_property
    def pairs(self) -> DataFrame:
        """Which lint path means which file name."""
        return materialize(MATCHERS[self.match](self.findings, self.files), "pairs")

    @cached_property
    def analysis(self) -> DataFrame:
        totals = finding_ops.finding_totals(self.findings)
        per_file = matching.totals_per_file(totals, self.pairs, self.targets)
        return materialize(finding_ops.analyse_files(self.files, per_file), "analysis")

    @property
    def plans(self) -> DataFrame:
        return planning.plan(self.analysis)

    @cached_property
    def modifications(self) -> DataFrame:
        driven = modify.from_findings(self.findings, self.pairs, self.targets, self.source, **self.rewriting)
        kind = self.findings.schema["seq"].dataType
        return materialize(driven.unionByName(modify.proactive(self.source, kind)), "modifications")

    @cached_property
    def checked(self) -> DataFrame:
        return materialize(validate.check(self.modifications, parse=self.parse), "checked")

    @property
    def issues(self) -> DataFrame:
        return validate.issues(self.checked)

    @property
    def validation_rows(self) -> DataFrame:
        """As ``validations``, not stored: for one reader, who works out only the columns that are read."""
        return validate.validations(self.files, self.checked)

    @cached_property
    def validations(self) -> DataFrame:
        return materialize(self.validation_rows, "validations")

    @property
    def conversions(self) -> DataFrame:
        return apply.conversions(self.files, self.modifications)

    @property
    def file_report(self) -> DataFrame:
        return reporting.file_report(
            self.files, self.analysis, self.plans, self.modifications, self.validations
        )

    @property
    def statistics(self) -> DataFrame:
        return reporting.statistics(self.analysis, self.modifications, self.validations)

    @property
    def risk(self) -> DataFrame:
        return reporting.risk(self.plans, self.validations)

    @property
    def timeline(self) -> DataFrame:
        return reporting.timeline(self.plans)

    @cached_property
    def final_report(self) -> DataFrame:
        # one row each; read back, as a subquery cannot hold others
        rows = {name: materialize(getattr(self, name), name) for name in ("statistics", "risk", "timeline")}
        return reporting.final_report(rows["statistics"], self.plans, rows["risk"], rows["timeline"])

    @property
    def run_summary(self) -> DataFrame:
        converted = self.conversions.filter("status = 'converted'")
        return reporting.run_summary(
            self.files, self.analysis, self.plans, self.modifications, self.validations, converted
        )

    def tables(self) -> dict[str, DataFrame]:
        """The tables a run writes, by name."""
        return {
            "analysis_results": self.analysis,
            "migration_plans": self.plans,
            "code_modifications": self.modifications,
            "validation_results": self.validations,
            "validation_issues": self.issues,
            "converted_files": self.conversions,
            "file_reports": self.file_report,
            "final_report": self.final_report,
            "run_summary": self.run_summary,
        }


def assess(findings: DataFrame, *corpus: DataFrame, **options) -> Assessment:
    return Assessment(findings, *corpus, **options)


def python_files(lines: DataFrame) -> DataFrame:
    """File rows from a lines table whose ``path`` is also the file name."""
    return lines.select("path").distinct().select(
        "path", F.col("path").alias("filename"), F.lit("python").alias("file_type"),
        F.lit(0).alias("cell_count"), F.lit(0).alias("code_cell_count"),
    )


def notebook_files(cells: DataFrame) -> DataFrame:
    """Notebook rows, with cell counts, from a cells table."""
    return cells.groupBy("path").agg(
        F.count(F.lit(1)).cast("int").alias("cell_count"),
        F.count_if(F.col("cell_type") == "code").cast("int").alias("code_cell_count"),
    ).select(
        "path", F.col("path").alias("filename"), F.lit("notebook").alias("file_type"),
        "cell_count", "code_cell_count",
    )
