"""Proposing modifications from findings and from the code itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill import fixed_values as V
from lintmill.functions import classify
from lintmill.functions.rewrite import Rule, catalog_config, needs_catalog_config, rewrite
from lintmill.functions.text import strip
from lintmill.operators import matching
from lintmill.operators.skew import chunk_of


def _order(proactive: int, finding: Column, cell: Column, line: Column) -> Column:
    """Sorts finding-driven modifications by input order, then the proactive ones."""
    return F.struct(
        F.lit(proactive).alias("proactive"), finding.alias("finding"),
        cell.cast("int").alias("cell"), line.cast("int").alias("line"),
    )


def order_chunk(mods: DataFrame) -> Column:
    """Bounded groups of neighbouring modifications, for ordered sums."""
    finding = mods.schema["seq"].dataType["finding"].dataType
    return F.struct(
        F.col("seq.proactive").alias("proactive"),
        chunk_of(F.col("seq.finding"), finding).alias("finding"),
        F.col("seq.cell").alias("cell"),
        F.floor(F.col("seq.line") / 65_536).alias("line"),
    )


def _assemble(df: DataFrame, seq: Column, **columns: Column) -> DataFrame:
    none = F.lit(False)
    return df.select(
        seq.alias("seq"), F.col("path").alias("file_path"),
        columns["cell_index"].cast("int").alias("cell_index"),
        columns["line_number"].cast("int").alias("line_number"),
        F.lit("replace").alias("change_type"),
        columns["original"].alias("original_code"), columns["modified"].alias("modified_code"),
        columns["reason"].alias("reason"), columns["issue_type"].alias("issue_type"),
        columns["confidence"].alias("confidence_level"),
        F.lit(True).alias("requires_testing"), none.alias("breaking_change"),
        none.alias("documentation_needed"),
    )


def from_findings(
    findings: DataFrame, pairs: DataFrame, files: DataFrame, source: DataFrame, *,
    rules: str = "compat", prefix: str = V.NAME_PREFIX, emit_noop: bool = True,
    extra: dict[str, Rule] | None = None,
) -> DataFrame:
    """Modifications of the source lines that findings point at."""
    clean = F.col("_clean")
    new = rewrite(clean, F.col("category"), F.col("message"), rules, prefix, extra)
    # The rewritten text is compared with the line as it stands, indentation
    # included, so an untouched indented line counts as changed. Exploding a
    # one-element array stores the costly rewrite, in compiled code; the filter
    # reads it and does not evaluate it again.
    before = F.col("line") if emit_noop else clean
    changed = (
        matching.finding_lines(findings, pairs, files, source)
        .withColumn("_clean", strip(F.col("line")))
        .withColumn("_new", F.explode(F.array(new))).filter(F.col("_new") != before)
        .withColumn("_new", strip(F.col("_new")))
    )
    none = F.lit(None)
    return _assemble(
        changed, _order(0, F.col("seq"), none, none),
        cell_index=F.col("cell_index"), line_number=F.col("place"),
        original=clean, modified=F.col("_new"),
        reason=F.concat(F.lit("Fix "), F.col("category"), F.lit(" issue: "), F.col("message")),
        issue_type=F.when(F.col("kind") == "python", F.col("category")).otherwise(F.col("issue_type")),
        confidence=classify.confidence(F.col("message")),
    )


def proactive(source: DataFrame, finding_type="bigint") -> DataFrame:
    """Modifications that need no finding."""
    clean, scores = F.col("_clean"), V.PROACTIVE_CONFIDENCE
    hits = source.filter(needs_catalog_config(F.col("line"))).withColumn("_clean", strip(F.col("line")))
    return _assemble(
        hits, _order(1, F.lit(None).cast(finding_type), F.col("cell_index"), F.col("place")),
        cell_index=F.col("cell_index"), line_number=F.col("place"),
        original=clean, modified=catalog_config(clean),
        reason=F.lit(V.PROACTIVE_REASON), issue_type=F.lit("proactive"),
        confidence=F.when(F.col("kind") == "python", scores["python"]).otherwise(scores["notebook"]),
    )
