"""Named queries over the test tables: each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill import fixed_values as V
from lintmill.catalog import views
from lintmill.functions import checks, classify, rewrite as rules
from lintmill.functions.text import clean_utf8, is_code, split_lines, strip
from lintmill.operators import advice, apply, lineage, matching, modify, planning, reporting, validate
from lintmill.operators import findings as found
from lintmill.plans.assessment import Assessment, assess, notebook_files, python_files
from lintmill.session import materialize, scratch_path
from lintmill.sources import archives, readers
from lintmill.streaming import ingest
from lintmill.streaming.maintained import MaintainedTotals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _findings(spark, sf) -> DataFrame:
    return found.parse_findings(views.lint(spark, sf))


def _notebook_findings(spark, sf) -> DataFrame:
    return found.parse_findings(views.notebook_lint(spark, sf))


def _code(spark, sf) -> DataFrame:
    return views.code(spark, sf).select("path", "line_no", "line")


def _stored_code(spark, sf) -> DataFrame:
    """Lines as a run reads them: for its file names, its source and where changes are applied."""
    return materialize(_code(spark, sf), "lines")


def _analysis(spark, sf) -> DataFrame:
    """Analysis per lint path, from the log alone."""
    return found.analyse(found.finding_totals(_findings(spark, sf)))


def _plans(spark, sf) -> DataFrame:
    return planning.plan(_analysis(spark, sf), "file_path")


def _run(spark, sf, parse: bool = False, **options) -> Assessment:
    """Python files and notebooks assessed together."""
    lines, cells = _stored_code(spark, sf), views.cells(spark, sf)
    findings = _findings(spark, sf).unionByName(_notebook_findings(spark, sf))
    return assess(
        findings, python_files(lines), lines, notebook_files(cells), cells, parse=parse, **options
    )


def _python_run(spark, sf, **options) -> Assessment:
    lines = _stored_code(spark, sf)
    return assess(_findings(spark, sf), python_files(lines), lines, parse=False, **options)


def _notebook_run(spark, sf) -> Assessment:
    cells = views.cells(spark, sf)
    return assess(
        _notebook_findings(spark, sf), notebooks=notebook_files(cells), cells=cells,
        match="basename", parse=False,
    )


def _flat(mods: DataFrame) -> DataFrame:
    rest = [c for c in mods.columns if c != "seq"]
    return mods.select(
        F.col("seq.proactive").alias("proactive"), F.col("seq.finding").alias("finding_seq"), *rest
    )


# --- sources -----------------------------------------------------------------

@query
def file_metrics(spark, sf):
    lines = split_lines(F.col("content"))
    return views.files(spark, sf).select(
        "path", F.size(lines).alias("line_count"),
        F.size(F.filter(lines, is_code)).alias("code_line_count"),
    )


@query
def notebook_metrics(spark, sf):
    return notebook_files(views.cells(spark, sf)).select("path", "cell_count", "code_cell_count")


@query
def input_summary(spark, sf):
    return found.input_summary(python_files(_code(spark, sf)), _findings(spark, sf))


@query
def findings_per_file(spark, sf):
    return found.findings_per_file(_findings(spark, sf))


@query
def converted_names(spark, sf):
    python = python_files(_code(spark, sf))
    books = notebook_files(views.cells(spark, sf))
    return python.unionByName(books).select("filename", apply.converted_name().alias("converted"))


@query
def run_summary(spark, sf):
    return _run(spark, sf).run_summary


@query
def notebook_scan(spark, sf):
    """Every turn as a notebook of one cell in JSON, its source a list or plain text."""
    text = F.when(
        F.col("turn") % 2 == 0,
        F.to_json(F.struct(F.array(F.struct(F.lit("code").alias("cell_type"), split_lines(F.col("text")).alias("source"))).alias("cells"))),
    ).otherwise(
        F.to_json(F.struct(F.array(F.struct(F.lit("code").alias("cell_type"), F.col("text").alias("source"))).alias("cells")))
    )
    path = F.concat(F.lit("nb/"), "conv_id", F.lit("_"), "turn", F.lit(".ipynb"))
    raw = views.table(spark, sf, "conversations").select(path.alias("path"), text.alias("content"))
    cells = readers.notebook_cells(readers.parse_notebooks(raw))
    return cells.select("path", "cell_index", "cell_type", F.posexplode("source").alias("line_no", "line"))


@query
def archive_scan(spark, sf):
    """Documents packed into zip archives, whose members are read back."""
    folder = scratch_path(spark, "archives")
    archives.pack(views.files(spark, sf), folder, per_archive=100)
    found = readers.scan_archive(spark, folder)
    return found.select(F.substring_index("path", "!/", -1).alias("path"), "line_count", "code_line_count")


@query
def decode_bytes(spark, sf):
    """Whole documents as bytes with invalid ones put around them, read leniently."""
    broken = F.concat(F.unhex(F.lit("C3")), F.encode("text", "UTF-8"), F.unhex(F.lit("F09F")))
    return views.table(spark, sf, "documents").select("doc_id", clean_utf8(broken).alias("text"))


# --- findings ------------------------------------------------------------------

@query
def lint_admit(spark, sf):
    return views.lint(spark, sf).filter(found.admitted(F.col("raw"))).select("seq", "raw")


@query
def lint_parse(spark, sf):
    return _findings(spark, sf)


@query
def lint_severity(spark, sf):
    return _findings(spark, sf).select("seq", "severity")


@query
def lint_category(spark, sf):
    return _findings(spark, sf).select("seq", "category", "tag")


@query
def issue_defaults(spark, sf):
    partly = _findings(spark, sf).select(
        "seq", "file_path",
        F.when(F.col("seq") % 3 != 0, F.col("line_number")).alias("line_number"),
        F.when(F.col("seq") % 5 != 0, F.col("severity")).alias("severity"),
        F.when(F.col("seq") % 7 != 0, F.col("message")).alias("message"),
    )
    return found.with_defaults(partly, found.FINDING_DEFAULTS)


@query
def sev_counts(spark, sf):
    return found.severity_counts(_findings(spark, sf))


@query
def cat_counts(spark, sf):
    return found.category_counts(_findings(spark, sf))


@query
def findings_nested(spark, sf):
    nested = found.findings_arrays(_findings(spark, sf))
    return nested.select(
        "file_path", "chunk", F.size("findings").alias("findings"),
        F.array_join(F.transform("findings", lambda f: f["seq"].cast("string")), ",").alias("seqs"),
    )


@query
def top3_by_category(spark, sf):
    return found.category_summary(_findings(spark, sf))


@query
def top3_plan(spark, sf):
    return found.planning_summary(_findings(spark, sf))


def _analysis_history(spark, sf) -> DataFrame:
    """One analysis per lint path and run; a run takes in 20 findings of the log."""
    findings = _findings(spark, sf).withColumn("run", F.floor(F.col("seq") / 20).cast("long"))
    return findings.groupBy("file_path", "run").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "error").alias("errors")
    )


@query
def latest_analysis(spark, sf):
    return found.latest_per(_analysis_history(spark, sf), ["file_path"], "run")


@query
def first_analysis(spark, sf):
    return found.first_per(_analysis_history(spark, sf), ["file_path"], "run")


# --- scores and plans ------------------------------------------------------------

@query
def complexity(spark, sf):
    return _analysis(spark, sf).select(
        "file_path", "findings", "errors", "warnings", "any_spark", "any_platform", "score", "complexity"
    )


@query
def effort(spark, sf):
    return _analysis(spark, sf).select("file_path", "complexity", "findings", "effort_hours")


@query
def priority(spark, sf):
    return _plans(spark, sf).select("file_path", "priority")


@query
def duration(spark, sf):
    return _plans(spark, sf).select("file_path", "duration_days")


@query
def dependencies(spark, sf):
    return _plans(spark, sf).select("file_path", F.posexplode("dependencies").alias("pos", "dependency"))


@query
def risks(spark, sf):
    return _plans(spark, sf).select("file_path", F.posexplode("risks").alias("pos", "_r")).select(
        "file_path", "pos", "_r.*"
    )


@query
def phases(spark, sf):
    return _plans(spark, sf).select("file_path", F.posexplode("phases").alias("pos", "_p")).select(
        "file_path", "pos", "_p.phase", "_p.duration_days", F.array_join("_p.tasks", "; ").alias("tasks")
    )


@query
def plan_summary(spark, sf):
    return planning.plan_summary(_plans(spark, sf), "file_path")


@query
def plan_lists(spark, sf):
    lists = [*V.PLAN_STEPS, "prerequisites", "mitigation_strategies"]
    items = F.explode(F.array(*[
        F.struct(F.lit(name).alias("list"), F.col(name).alias("items")) for name in lists
    ]))
    return _plans(spark, sf).select("file_path", "priority", items.alias("_l")).groupBy(
        "priority", "_l.list", F.array_join("_l.items", "; ").alias("items")
    ).agg(F.count(F.lit(1)).alias("files"))


@query
def advice_default(spark, sf):
    from lintmill.functions.scoring import default_advice

    return _run_analysis(spark, sf).select(
        "path", F.posexplode(default_advice(F.col("findings"))).alias("pos", "advice")
    )


def _run_analysis(spark, sf) -> DataFrame:
    return _run(spark, sf).analysis


@query
def advice_lines(spark, sf):
    return views.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(advice.advice_lines(F.col("text"))).alias("pos", "line")
    )


@query
def section_parse(spark, sf):
    return advice.sections(views.advice(spark, sf))


# --- lineage ------------------------------------------------------------------------

def _lineage(spark, sf) -> DataFrame:
    return lineage.edges(views.statements(spark, sf).select("file", "code"))


@query
def lineage_statements(spark, sf):
    return lineage.statements(views.statements(spark, sf))


@query
def lineage_edges(spark, sf):
    return lineage.listing(_lineage(spark, sf))


@query
def lineage_preview(spark, sf):
    """Previews of whole documents taken as statements."""
    return views.table(spark, sf, "documents").select(
        "doc_id", lineage.preview(F.col("text")).alias("preview")
    )


@query
def lineage_filter(spark, sf):
    return lineage.choose(_lineage(spark, sf), table="main.s.t3")


@query
def lineage_options(spark, sf):
    return lineage.options(_lineage(spark, sf))


@query
def lineage_nodes(spark, sf):
    return lineage.nodes(_lineage(spark, sf))


@query
def lineage_graph_edges(spark, sf):
    return lineage.graph_edges(_lineage(spark, sf))


@query
def lineage_counts(spark, sf):
    return lineage.counts(_lineage(spark, sf))


# --- matching -------------------------------------------------------------------------

@query
def match_contains(spark, sf):
    return matching.match_contains(_findings(spark, sf), python_files(_code(spark, sf)))


@query
def match_basename(spark, sf):
    return matching.match_basename(_findings(spark, sf), python_files(_code(spark, sf)))


@query
def match_path(spark, sf):
    """Findings and files of several folders: of some files there is a copy that the log names in full."""
    names = python_files(_code(spark, sf)).select("filename")
    files = names.select(F.explode(F.array(
        F.concat(F.lit("lib/"), "filename"), F.concat(F.lit("deep/src/x"), "filename"),
        F.when(F.col("filename").endswith("0.py"), F.concat(F.lit("src/x"), "filename")),
    )).alias("path")).filter("path is not null")
    return matching.match_path(_findings(spark, sf), files).withColumnRenamed("filename", "path")


@query
def file_basic(spark, sf):
    return _run_analysis(spark, sf).select(
        "path", "cell_count", "code_cell_count", "findings", "errors", "warnings", "complexity", "effort_hours"
    )


@query
def issue_line(spark, sf):
    lines, findings = _code(spark, sf), _findings(spark, sf)
    files = python_files(lines)
    pairs = matching.match_contains(findings, files)
    source = matching.python_source(lines)
    return matching.finding_lines(findings, pairs, files, source).select(
        "seq", "path", "line_number", "line"
    )


@query
def cell_spans(spark, sf):
    return matching.cell_spans(views.cells(spark, sf))


@query
def cell_locate(spark, sf):
    cells, findings = views.cells(spark, sf), _notebook_findings(spark, sf)
    books = notebook_files(cells)
    pairs = matching.match_basename(findings, books)
    return matching.finding_cells(findings, pairs, books, cells).select(
        "seq", "path", "line_number", "cell_index", "cell_line"
    )


@query
def first_match_line(spark, sf):
    run = _python_run(spark, sf)
    mods = run.modifications.withColumnRenamed("file_path", "path")
    return _flat(matching.first_matching_line(_code(spark, sf), mods)).select(
        "proactive", "finding_seq", "path", "line_number", "first_line"
    )


@query
def mods_by_file(spark, sf):
    run = _run(spark, sf)
    picked = run.files.select(F.col("path").alias("file_path"))
    return _flat(run.modifications.join(picked, "file_path", "left_semi")).select(
        "file_path", "proactive", "finding_seq", "cell_index", "line_number", "modified_code"
    )


# --- rewrite rules ----------------------------------------------------------------------

def _rewritten(spark, sf, rule) -> DataFrame:
    """Every code line through one rule, with a message that asks for full names
    on odd lines."""
    asked = F.when(F.col("line_no") % 2 == 1, f"names {V.THREE_PART_HINT}").otherwise("other")
    line = strip(F.col("line"))
    return _code(spark, sf).select("path", "line_no", rule(line, asked).alias("rewritten"))


@query
def rw_spark(spark, sf):
    return _rewritten(spark, sf, rules.spark_rule)


@query
def rw_sql(spark, sf):
    return _rewritten(spark, sf, rules.sql_rule)


@query
def rw_sql_safe(spark, sf):
    return _rewritten(spark, sf, rules.sql_rule_safe)


@query
def rw_sql_text(spark, sf):
    """The general rule on every line of every document."""
    hint = F.lit(V.THREE_PART_HINT)
    lines = views.files(spark, sf).select(
        "path", F.posexplode(split_lines(F.col("content"))).alias("pos", "line")
    )
    return lines.select("path", "pos", rules.general_rule(strip(F.col("line")), hint).alias("rewritten"))


@query
def rw_imports(spark, sf):
    return _rewritten(spark, sf, rules.imports_rule)


@query
def rw_platform(spark, sf):
    return _rewritten(spark, sf, rules.platform_rule)


@query
def rw_general(spark, sf):
    return _rewritten(spark, sf, rules.general_rule)


@query
def rw_proactive(spark, sf):
    return _flat(modify.proactive(matching.python_source(_code(spark, sf)))).select(
        "file_path", "line_number", "original_code", "modified_code", "confidence_level"
    )


@query
def mod_confidence(spark, sf):
    return _findings(spark, sf).select("seq", classify.confidence(F.col("message")).alias("confidence"))


@query
def modifications(spark, sf):
    return _flat(_run(spark, sf).modifications)


@query
def modifications_changed(spark, sf):
    """Without modifications that change nothing but white space."""
    return _flat(_python_run(spark, sf, emit_noop=False).modifications)


# --- validation ----------------------------------------------------------------------------

def _messages(spark, sf, column: str) -> DataFrame:
    run = _run(spark, sf)
    return _flat(run.checked.select("seq", "file_path", F.posexplode(column).alias("pos", "issue")))


@query
def bracket_check(spark, sf):
    """Bracket balance of every line of every document."""
    lines = views.files(spark, sf).select(
        "path", F.posexplode(split_lines(F.col("content"))).alias("pos", "line")
    )
    return lines.select("path", "pos", F.array_join(checks.bracket_issues(F.col("line")), "; ").alias("issues"))


@query
def syntax_parse(spark, sf):
    code = _code(spark, sf)
    return code.select("path", "line_no", checks.parse_error(strip(F.col("line"))).isNull().alias("parses"))


@query
def compat_issues(spark, sf):
    return _messages(spark, sf, "compat_issues")


@query
def compat_warnings(spark, sf):
    return _messages(spark, sf, "compat_warnings")


@query
def logic_issues(spark, sf):
    return _messages(spark, sf, "logic_issues")


@query
def validations(spark, sf):
    return _run(spark, sf).validations.withColumns({
        "recommendations": F.array_join("recommendations", "; "),
        "next_steps": F.array_join("next_steps", "; "),
    })


@query
def validations_parsed(spark, sf):
    """Validation rows with the parse check included."""
    return _run(spark, sf, parse=True).validations.select("path", "validation_type", "is_valid", "issues_found")


@query
def validation_summary(spark, sf):
    return reporting.validation_summary(_run(spark, sf).validation_rows)


@query
def top3_validation_issues(spark, sf):
    return validate.top_issues(_run(spark, sf).issues).select("file_path", "validation_type", "rank", "issue")


@query
def validation_text(spark, sf):
    run = _run(spark, sf)
    return validate.detail_text(run.validation_rows, run.issues)


# --- applying ---------------------------------------------------------------------------------

@query
def apply_lines(spark, sf):
    run = _python_run(spark, sf)
    return apply.apply_at_position(run.lines, run.modifications)


@query
def apply_fold(spark, sf):
    run = _python_run(spark, sf)
    return apply.apply_in_order(run.lines, run.modifications)


@query
def apply_fold_cells(spark, sf):
    run = _notebook_run(spark, sf)
    lines = matching.cell_lines(views.cells(spark, sf))
    return apply.apply_in_order(lines, run.modifications, ["path", "cell_index"], apply.CELL_TYPES)


def _mixed_kinds(mods):
    """Modifications as replacements, insertions and deletions by turns."""
    kinds = F.array(*[F.lit(k) for k in apply.PYTHON_TYPES])
    return mods.withColumn("change_type", F.element_at(kinds, (F.col("line_number") % 3 + 1).cast("int")))


@query
def apply_fold_kinds(spark, sf):
    run = _python_run(spark, sf)
    return apply.apply_in_order(run.lines, _mixed_kinds(run.modifications))


@query
def converted_fold(spark, sf):
    run = _python_run(spark, sf)
    folded = apply.fold(run.lines, _mixed_kinds(run.modifications))
    return apply.converted_lines(run.files, folded).drop("path")


@query
def apply_cells(spark, sf):
    run = _notebook_run(spark, sf)
    lines = matching.cell_lines(views.cells(spark, sf))
    return apply.apply_at_position(lines, run.modifications, ["path", "cell_index"], first_line=0)


@query
def conversions(spark, sf):
    return _run(spark, sf).conversions


@query
def converted_content(spark, sf):
    run = _python_run(spark, sf)
    return apply.converted_lines(run.files, apply.apply_at_position(run.lines, run.modifications)).drop("path")


@query
def converted_cells(spark, sf):
    run = _notebook_run(spark, sf)
    cells = views.cells(spark, sf)
    applied = apply.apply_at_position(
        matching.cell_lines(cells), run.modifications, ["path", "cell_index"], first_line=0
    )
    return apply.converted_cells(cells, applied).withColumn("source", F.array_join("source", "\n"))


# --- reports --------------------------------------------------------------------------------------

def _done(spark, sf) -> DataFrame:
    """Files a former run dealt with: those that the log names."""
    pairs = matching.match_contains(_findings(spark, sf), python_files(_code(spark, sf)))
    return pairs.select(F.col("filename").alias("path"))


@query
def pending_files(spark, sf):
    return reporting.pending(python_files(_code(spark, sf)), _done(spark, sf)).select("path")


@query
def done_files(spark, sf):
    return reporting.finished(python_files(_code(spark, sf)), _done(spark, sf)).select("path")


@query
def first_pending(spark, sf):
    return reporting.first_pending(python_files(_code(spark, sf)), _done(spark, sf), "path").select("path")


@query
def progress(spark, sf):
    return reporting.progress(python_files(_code(spark, sf)), _done(spark, sf))


@query
def change_types(spark, sf):
    return reporting.change_types(_run(spark, sf).modifications)


@query
def mod_summary(spark, sf):
    return reporting.mod_summary(_run(spark, sf).modifications)


@query
def file_report(spark, sf):
    return _run(spark, sf).file_report.withColumn("recommendations", F.array_join("recommendations", "; "))


@query
def file_recommendations(spark, sf):
    return _run(spark, sf).file_report.select(
        "path", F.posexplode("recommendations").alias("pos", "recommendation")
    )


@query
def portfolio_stats(spark, sf):
    return _run(spark, sf).statistics


@query
def complexity_dist(spark, sf):
    return reporting.complexity_distribution(_analysis(spark, sf))


@query
def priority_dist(spark, sf):
    return reporting.priority_distribution(_plans(spark, sf))


@query
def high_priority(spark, sf):
    return reporting.high_priority(_plans(spark, sf), "file_path")


@query
def portfolio_risk(spark, sf):
    return _run(spark, sf).risk


@query
def portfolio_timeline(spark, sf):
    return _run(spark, sf).timeline


@query
def final_report(spark, sf):
    return _run(spark, sf).final_report.drop("recommendations", "executive_summary")


@query
def final_recommendations(spark, sf):
    return _run(spark, sf).final_report.select(
        F.posexplode("recommendations").alias("pos", "recommendation")
    )


@query
def exec_summary(spark, sf):
    return _run(spark, sf).final_report.select("executive_summary")


@query
def riskiest_files(spark, sf):
    """The flagship question: which files carry the most migration risk?"""
    return _analysis(spark, sf).withColumn(
        "priority", planning.scoring.priority(F.col("complexity"), F.col("errors"))
    ).select(
        "file_path", "findings", "errors", "score", "complexity", "effort_hours", "priority"
    ).orderBy(F.desc("score"), "file_path")


# --- streaming ----------------------------------------------------------------------------------------

def _event_stream(spark, sf) -> DataFrame:
    schema = views.table(spark, sf, "events").schema
    reader = spark.readStream.schema(schema)
    if any(f.endswith("/events.parquet") for f in spark.read.parquet(f"{sf}/events.parquet").inputFiles()):
        return reader.option("pathGlobFilter", "events.parquet").parquet(sf)  # the table is one file
    return reader.parquet(f"{sf}/events.parquet")


def _log_stream(spark, sf) -> DataFrame:
    return spark.sql(views.LINT, events=_event_stream(spark, sf))


@query
def lint_stream(spark, sf):
    """Findings taken in as a stream and read back."""
    root = scratch_path(spark, "lint-stream")
    ingest.write_findings(_log_stream(spark, sf), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")


@query
def severity_stream(spark, sf):
    """Running counts kept by a stream, read back."""
    root = scratch_path(spark, "severity-stream")
    ingest.write_severity_counts(_log_stream(spark, sf), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return ingest.latest_counts(spark, f"{root}/out")


@query
def incremental_lineage(spark, sf):
    """Lineage of newly arrived code, each piece processed once."""
    root = scratch_path(spark, "incremental")
    code = spark.sql(views.STMT, events=_event_stream(spark, sf)).select("file", "code")
    ingest.process_new_files(code, lineage.edges, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("file", "operation", "table", "preview")


def _changing_findings(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All findings, and what a second batch brings: two files of each job change, one goes."""
    columns = ["file_path", "category", "severity", "line_number", "seq"]
    findings = _findings(spark, sf).select(*columns)
    changed = findings.filter("(file_path like '%4.py' or file_path like '%5.py') and seq % 3 > 0")
    changed = changed.withColumn("line_number", F.when(F.col("seq") % 2 == 0, F.col("line_number") + 3).otherwise(F.col("line_number")))
    # files that change are announced as well, as some have no finding left
    gone = findings.filter("file_path like '%2.py' or file_path like '%4.py' or file_path like '%5.py'").select("file_path").distinct()
    rows = changed.withColumn("dropped", F.lit(False)).unionByName(
        gone.withColumn("dropped", F.lit(True)), allowMissingColumns=True)
    return findings, rows


def _maintained(spark, sf, keys) -> DataFrame:
    sums = {"errors": (F.col("severity") == "error").cast("long"), "warnings": (F.col("severity") == "warning").cast("long")}
    kept = MaintainedTotals(spark, scratch_path(spark, "maintained"), "file_path", keys, sums, ["line_number", "seq"])
    for batch, rows in enumerate(_changing_findings(spark, sf)):
        kept.apply(rows, batch)
    return kept.read()


@query
def incremental_totals(spark, sf):
    """Totals per file after files changed and went, from signed changes."""
    return _maintained(spark, sf, ["file_path"])


@query
def incremental_categories(spark, sf):
    """Totals per category over all files, kept the same way."""
    return _maintained(spark, sf, ["category"])
