"""SQL that computes the same results as the queries, for an independent engine.

Written against the tables, not against the library: rules are spelled out again
as SQL, containment is a plain join, orders are plain windows.
"""

from __future__ import annotations

from lintmill import fixed_values as V
from lintmill.catalog import views

S, W = V.S, V.W


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def values(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def parsed(source: str) -> str:
    m = "lower(message)"
    number = "CASE WHEN regexp_full_match(trim(p[{i}]), '[0-9]+') THEN CAST(trim(p[{i}]) AS INT) ELSE 0 END"
    return f"""
SELECT seq, trim(p[1]) AS file_path, {number.format(i=2)} AS line_number, {number.format(i=3)} AS column_number,
  'compatibility' AS issue_type,
  CASE WHEN {m} LIKE '%error%' THEN 'error' WHEN {m} LIKE '%warning%' THEN 'warning'
       WHEN {m} LIKE '%info%' THEN 'info' ELSE 'warning' END AS severity,
  message, '' AS code_snippet, '' AS suggested_fix,
  CASE WHEN {m} LIKE '%spark%' THEN 'spark' WHEN {m} LIKE '%sql%' THEN 'sql' WHEN {m} LIKE '%import%' THEN 'imports'
       WHEN {m} LIKE '%databricks%' THEN 'databricks' ELSE 'general' END AS category,
  regexp_extract(message, '\\[([^\\]]+)\\]', 1) AS tag
FROM (SELECT seq, string_split(raw, ':') AS p, trim(regexp_replace(raw, '^[^:]*:[^:]*:[^:]*:', '')) AS message
      FROM {source} WHERE contains(raw, ':') AND regexp_matches(lower(raw), 'error|warning|info'))
WHERE len(p) >= 4"""


# --- rewrite rules as SQL ------------------------------------------------------

READ = rf"spark\.read\.table\([\"''']({W}+)[\"''']\)".replace("'''", "''")
SAVE = rf"saveAsTable\([\"''']({W}+)[\"''']\)".replace("'''", "''")
READ_OPEN = READ[: -len(r"\)")]
SAVE_OPEN = SAVE[: -len(r"\)")]


def rw_spark(x: str) -> str:
    def one(pattern):
        name = f"regexp_extract({x}, '{pattern}', 1)"
        return f"replace({x}, concat('\"', {name}, '\"'), concat('\"main.default.', {name}, '\"'))"

    return (f"CASE WHEN regexp_matches({x}, '{READ}') THEN {one(READ)} "
            f"WHEN regexp_matches({x}, '{SAVE}') THEN {one(SAVE)} ELSE {x} END")


def rw_sql(x: str) -> str:
    return (f"CASE WHEN upper({x}) LIKE '%SELECT%' AND upper({x}) LIKE '%FROM%' "
            f"THEN regexp_replace({x}, '(?i)FROM{S}+({W}+)', 'FROM main.default.\\1', 'g') "
            f"WHEN upper({x}) LIKE '%CREATE TABLE%' "
            f"THEN regexp_replace({x}, '(?i)CREATE{S}+TABLE{S}+({W}+)', 'CREATE TABLE main.default.\\1', 'g') "
            f"ELSE {x} END")


def rw_sql_safe(x: str) -> str:
    # A name is whole if no word character or dot follows; lines here hold one FROM.
    return (f"CASE WHEN upper({x}) LIKE '%SELECT%' AND upper({x}) LIKE '%FROM%' "
            f"THEN regexp_replace({x}, '(?i)FROM{S}+({W}+)($|[^\\p{{L}}\\p{{N}}_.])', 'FROM main.default.\\1\\2', 'g') "
            f"WHEN upper({x}) LIKE '%CREATE TABLE%' "
            f"THEN regexp_replace({x}, '(?i)(CREATE{S}+TABLE{S}+)({W}+)($|[^\\p{{L}}\\p{{N}}_.])', '\\1main.default.\\2\\3', 'g') "
            f"ELSE {x} END")


def rw_imports(x: str) -> str:
    return (f"CASE WHEN contains({x}, 'from pyspark.sql import SparkSession') THEN concat({x}, chr(10), '# Configure for Unity Catalog') "
            f"WHEN contains({x}, 'import databricks') THEN concat({x}, chr(10), '# Note: Some databricks features may need UC updates') "
            f"ELSE {x} END")


def rw_platform(x: str) -> str:
    return (f"CASE WHEN contains({x}, 'dbutils.fs') THEN "
            f"concat('# TODO: Review file path for Unity Catalog compatibility', chr(10), {x}) ELSE {x} END")


def rw_general(x: str, message: str) -> str:
    asked = (f"lower({message}) LIKE '%should use three-part naming%' "
             f"AND (upper({x}) LIKE '%FROM%' OR upper({x}) LIKE '%JOIN%')")
    parts = [f"WHEN lower({x}) LIKE '%hive\\_metastore%' ESCAPE '\\' THEN replace({x}, 'hive_metastore', 'main')"]
    for pattern, replacement in [
        (f"(?i)FROM{S}+({W}+)", "FROM main.default.\\1"),
        (f"(?i)JOIN{S}+({W}+)", "JOIN main.default.\\1"),
        (f"(?i)table\\([\"'']({W}+)[\"'']", "table(''main.default.\\1''"),
        (f"(?i)saveAsTable\\([\"'']({W}+)[\"'']", "saveAsTable(''main.default.\\1''"),
    ]:
        parts.append(f"WHEN {asked} AND regexp_matches({x}, '{pattern}') "
                     f"THEN regexp_replace({x}, '{pattern}', '{replacement}', 'g')")
    for name, test in [
        ("event_log", f"upper({x}) LIKE '%FROM%'"), ("performance_metrics", f"upper({x}) LIKE '%FROM%'"),
        ("user_profiles", f"upper({x}) LIKE '%JOIN%'"), ("analytics_summary", f"contains({x}, 'saveAsTable')"),
    ]:
        parts.append(f"WHEN contains({x}, '{name}') AND {test} THEN replace({x}, '{name}', 'main.default.{name}')")
    # Names in these lines occur only inside the calls, so the calls are rewritten in place.
    rest = x
    for call in (r"spark\.read\.table\(", r"saveAsTable\("):
        rest = f"regexp_replace({rest}, '({call}[\"''])({W}+)([\"''])', '\\1main.default.\\2\\3', 'g')"
    return "CASE " + " ".join(parts) + f" ELSE {rest} END"


def rewrite(x: str, category: str, message: str) -> str:
    return (f"CASE {category} WHEN 'spark' THEN {rw_spark(x)} WHEN 'sql' THEN {rw_sql(x)} "
            f"WHEN 'imports' THEN {rw_imports(x)} WHEN 'databricks' THEN {rw_platform(x)} "
            f"ELSE {rw_general(x, message)} END")


def confidence(message: str) -> str:
    m = f"lower({message})"
    return (f"CASE WHEN {m} LIKE '%table reference%' OR {m} LIKE '%spark.sql%' THEN CAST(0.9 AS DOUBLE) "
            f"WHEN {m} LIKE '%import%' OR {m} LIKE '%databricks%' OR {m} LIKE '%configuration%' THEN CAST(0.7 AS DOUBLE) "
            f"ELSE CAST(0.5 AS DOUBLE) END")


def occurrences(x: str, char: str) -> str:
    return f"(length({x}) - length(replace({x}, '{char}', '')))"


def brackets(x: str) -> str:
    tests = [("(", ")", "Mismatched parentheses"), ("[", "]", "Mismatched brackets"), ("{", "}", "Mismatched braces")]
    items = ", ".join(
        f"CASE WHEN {occurrences(x, a)} <> {occurrences(x, b)} THEN '{m}' END" for a, b, m in tests
    )
    return f"list_filter([{items}], lambda i: i IS NOT NULL)"


# --- scores as SQL ----------------------------------------------------------------

def totals(source: str, key: str) -> str:
    cats = ", ".join(f"count(*) FILTER (category = '{c}') AS cat_{c}" for c in V.CATEGORIES)
    return f"""
SELECT {key}, count(*) AS findings, count(*) FILTER (severity = 'error') AS errors,
  count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, {cats},
  bool_or(category = 'spark') AS any_spark, bool_or(lower(message) LIKE '%databricks%') AS any_platform
FROM {source} GROUP BY {key}"""


def scored(source: str, cells: str = "0") -> str:
    return f"""
SELECT *, CAST(CASE complexity WHEN 'low' THEN 2.0 WHEN 'medium' THEN 8.0 ELSE 24.0 END AS DOUBLE) AS base_hours,
  round(CASE complexity WHEN 'low' THEN 2.0::DOUBLE WHEN 'medium' THEN 8.0::DOUBLE ELSE 24.0::DOUBLE END
    + findings * 0.5::DOUBLE + {cells} * 0.2::DOUBLE, 1) AS effort_hours,
  CASE WHEN errors > 5 OR complexity = 'high' THEN 'high' WHEN errors > 0 OR complexity = 'medium' THEN 'medium'
       ELSE 'low' END AS priority,
  CAST(CASE complexity WHEN 'low' THEN 1 WHEN 'medium' THEN 3 ELSE 7 END
    + CASE WHEN findings > 10 THEN 2 WHEN findings > 5 THEN 1 ELSE 0 END AS INT) AS duration_days,
  3 + CASE WHEN complexity = 'high' THEN 1 ELSE 0 END + CASE WHEN findings > 10 THEN 1 ELSE 0 END AS n_risks
FROM (SELECT *, CASE WHEN score >= 8 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS complexity
  FROM (SELECT *, CAST(CASE WHEN {cells} > 20 THEN 3 WHEN {cells} > 10 THEN 2 WHEN {cells} > 5 THEN 1 ELSE 0 END
    + 2 * errors + warnings + CASE WHEN any_spark THEN 2 ELSE 0 END
    + CASE WHEN any_platform THEN 1 ELSE 0 END AS BIGINT) AS score FROM {source}))"""


COUNTED = ["findings", "errors", "warnings", "infos", *[f"cat_{c}" for c in V.CATEGORIES]]
_zeroed = ", ".join(f"coalesce(t.{c}, 0) AS {c}" for c in COUNTED)
_summed = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTED)

# One alternative per quote style; a literal ends at the first quote of its style.
_QUOTES = ('"""', "''''''", '"', "''")
_EXEC = (r"(?i)execute\s*\(\s*[frub]*\s*(?:" + "|".join(rf"{x}([\s\S]*?){x}" for x in _QUOTES) + ")")
_WRITE = r'(?i)\b(INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+([`\[\]"\w.]+)'

_cell_key = "(conv_id + 3 * turn + i) % 6"
_advice = "', '".join

CTES = f"""
WITH lint AS ({views.LINT.format(events="events")}),
nlint AS ({views.NOTEBOOK_LINT.format(events="events")}),
issues AS ({parsed("lint")}),
nissues AS ({parsed("nlint")}),
allissues AS (SELECT * FROM issues UNION ALL SELECT * FROM nissues),
code AS (SELECT path, line_no, line FROM ({views.CODE.format(lineitem="lineitem")})),
stmt AS ({views.STMT.format(events="events")}),
docs AS ({views.FILES.format(documents="documents")}),
doclines AS (SELECT path, CAST(i - 1 AS INT) AS pos, l[i] AS line FROM (
  SELECT path, string_split(content, chr(10)) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM docs)),
advice AS ({views.ADVICE.format(conversations="conversations")}),
cells AS (SELECT concat('nb_', conv_id, '.ipynb') AS path, CAST(turn AS INT) AS cell_index,
  CASE WHEN role = 'assistant' THEN 'code' ELSE 'markdown' END AS cell_type,
  string_split(text, chr(10)) AS l, conv_id, turn FROM conversations),
celllines AS (SELECT path, cell_index, cell_type, CAST(i AS INT) AS place,
  concat({views.CELL_CODE.format(key=_cell_key)}, '  # ', l[i + 1]) AS line
  FROM (SELECT *, unnest(range(0, len(l))) AS i FROM cells)),
pyfiles AS (SELECT DISTINCT path, path AS filename, 'python' AS file_type, 0 AS cell_count, 0 AS code_cell_count FROM code),
nbfiles AS (SELECT path, path AS filename, 'notebook' AS file_type, CAST(count(*) AS INT) AS cell_count,
  CAST(count(*) FILTER (cell_type = 'code') AS INT) AS code_cell_count FROM cells GROUP BY path),
files AS (SELECT * FROM pyfiles UNION ALL SELECT * FROM nbfiles),
spans AS (SELECT path, cell_index, cell_type, n_lines, CAST(coalesce(sum(n_lines) OVER (PARTITION BY path ORDER BY cell_index
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_line
  FROM (SELECT *, CAST(CASE WHEN cell_type = 'code' THEN len(l) ELSE 0 END AS INT) AS n_lines FROM cells)),
source AS (SELECT path, 'python' AS kind, line_no AS line_number, 0 AS cell_index, line_no - 1 AS place, line FROM code
  UNION ALL SELECT c.path, 'notebook', CAST(s.start_line + c.place + 1 AS INT), c.cell_index, c.place, c.line
  FROM celllines c JOIN spans s ON c.path = s.path AND c.cell_index = s.cell_index WHERE c.cell_type = 'code'),
pairs AS (SELECT i.file_path, f.filename FROM (SELECT DISTINCT file_path FROM allissues) i
  JOIN (SELECT DISTINCT filename FROM files) f ON contains(i.file_path, f.filename)),
located AS (SELECT i.*, s.path, s.kind, s.cell_index, s.place, s.line, {strip("s.line")} AS clean
  FROM allissues i JOIN pairs p ON i.file_path = p.file_path JOIN files f ON f.filename = p.filename
  JOIN source s ON s.path = f.path AND s.line_number = i.line_number),
mods AS (SELECT 0 AS proactive, seq AS finding_seq, path AS file_path, cell_index, place AS line_number,
    'replace' AS change_type, clean AS original_code, {strip("new")} AS modified_code,
    concat('Fix ', category, ' issue: ', message) AS reason,
    CASE WHEN kind = 'python' THEN category ELSE issue_type END AS issue_type,
    {confidence("message")} AS confidence_level, true AS requires_testing, false AS breaking_change,
    false AS documentation_needed, kind
  FROM (SELECT *, {rewrite("clean", "category", "message")} AS new FROM located) WHERE new <> line
  UNION ALL
  SELECT 1, NULL, path, cell_index, place, 'replace', {strip("line")},
    replace({strip("line")}, '.enableHiveSupport()', '.config("spark.sql.catalog.spark_catalog", "unity")'),
    'Proactive Unity Catalog configuration', 'proactive',
    CASE WHEN kind = 'python' THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END, true, false, false, kind
  FROM source WHERE contains(line, 'SparkSession.builder') AND contains(line, 'enableHiveSupport')),
analysis AS ({scored("(" + totals("issues", "file_path") + ")")}),
filetotals AS (SELECT f.path, f.cell_count, f.code_cell_count, {_zeroed},
    coalesce(t.any_spark, false) AS any_spark, coalesce(t.any_platform, false) AS any_platform
  FROM files f LEFT JOIN (SELECT p.filename, {_summed}, bool_or(any_spark) AS any_spark, bool_or(any_platform) AS any_platform
    FROM ({totals("allissues", "file_path")}) x JOIN pairs p ON x.file_path = p.file_path GROUP BY p.filename) t
  ON f.filename = t.filename),
fileanalysis AS ({scored("filetotals", "code_cell_count")}),
checked AS (SELECT *, {brackets("modified_code")} AS syntax_issues,
  list_concat(list_concat(
    CASE WHEN contains(modified_code, 'spark.sql(') AND contains(upper(modified_code), 'FROM ')
      THEN list_transform(list_filter(regexp_extract_all(modified_code, '(?i)FROM{S}+({W}+)', 1), lambda n: n NOT IN ('dual', 'values')),
        lambda n: concat('Table ''', n, ''' should use three-part naming')) ELSE [] END,
    CASE WHEN contains(modified_code, 'spark.read.table(')
      THEN list_transform(regexp_extract_all(modified_code, '{READ}', 1),
        lambda n: concat('Table ''', n, ''' should use catalog.schema.table format')) ELSE [] END),
    CASE WHEN contains(lower(modified_code), 'hive_metastore')
      THEN ['Direct hive_metastore references should be updated'] ELSE [] END) AS compat_issues,
  list_filter([CASE WHEN contains(modified_code, 'dbutils.fs') THEN 'File system operations may need path updates for Unity Catalog' END,
    CASE WHEN contains(modified_code, 'enableHiveSupport') THEN 'Consider updating Spark configuration for Unity Catalog' END,
    CASE WHEN contains(upper(modified_code), 'USE ') THEN 'USE database statements may need catalog prefix' END],
    lambda i: i IS NOT NULL) AS compat_warnings,
  list_filter([CASE WHEN contains(original_code, 'read.table') AND contains(modified_code, 'read.table')
      AND len(regexp_extract_all(original_code, 'read\\.table\\(["'']({W}+)["'']\\)'))
       <> len(regexp_extract_all(modified_code, 'read\\.table\\(["'']({W}+\\.{W}+\\.{W}+)["'']\\)'))
      THEN 'Table reference count mismatch between original and modified code' END,
    CASE WHEN contains(upper(original_code), 'SELECT') AND contains(upper(modified_code), 'SELECT')
      AND len(regexp_extract_all(original_code, '(?i)\\b(SELECT|FROM|WHERE|GROUP|ORDER)\\b'))
       <> len(regexp_extract_all(modified_code, '(?i)\\b(SELECT|FROM|WHERE|GROUP|ORDER)\\b'))
      THEN 'SQL query structure may have been altered' END], lambda i: i IS NOT NULL) AS logic_issues
  FROM mods),
modsums AS (SELECT file_path, CAST(sum(len(syntax_issues)) AS BIGINT) AS s, CAST(sum(len(compat_issues)) AS BIGINT) AS c,
  CAST(sum(len(logic_issues)) AS BIGINT) AS l, CAST(sum(len(compat_warnings)) AS BIGINT) AS w FROM checked GROUP BY file_path),
vcounts AS (SELECT f.path, k.rank, k.validation_type,
    coalesce(CASE k.rank WHEN 1 THEN s WHEN 2 THEN c ELSE l END, 0) AS issues_found,
    CASE WHEN k.rank = 2 THEN coalesce(w, 0) ELSE 0 END AS warnings
  FROM files f CROSS JOIN (VALUES (1, 'syntax'), (2, 'compatibility'), (3, 'logic')) k(rank, validation_type)
  LEFT JOIN modsums m ON m.file_path = f.path),
vissues AS (SELECT file_path, k.validation_type, proactive, finding_seq, cell_index, line_number,
    unnest(CASE k.rank WHEN 1 THEN syntax_issues WHEN 2 THEN compat_issues ELSE logic_issues END) AS issue,
    unnest(range(0, len(CASE k.rank WHEN 1 THEN syntax_issues WHEN 2 THEN compat_issues ELSE logic_issues END))) AS pos
  FROM checked CROSS JOIN (VALUES (1, 'syntax'), (2, 'compatibility'), (3, 'logic')) k(rank, validation_type)),
topissues AS (SELECT * FROM (SELECT file_path, validation_type, issue, CAST(row_number() OVER (PARTITION BY file_path, validation_type
    ORDER BY proactive, finding_seq, cell_index, line_number, pos) AS INT) AS rank FROM vissues) WHERE rank <= 3),
vsum AS (SELECT path, count(*) AS total_validations, count(*) FILTER (issues_found = 0) AS passed_validations,
    CAST(sum(issues_found) AS BIGINT) AS total_issues, CAST(sum(warnings) AS BIGINT) AS total_warnings,
    string_agg(validation_type, ',' ORDER BY validation_type) AS validation_types,
    count(*) FILTER (issues_found > 0) AS failed_validations,
    CASE WHEN sum(issues_found) = 0 THEN 'passed' ELSE 'failed' END AS overall_status FROM vcounts GROUP BY path),
modsum AS (SELECT file_path, count(*) AS total_modifications,
    -- exact half-up rounding of the mean, in whole millionths
    CAST((2 * sum(CAST(round(confidence_level * 1000000) AS BIGINT)) + 10000 * count(*)) // (20000 * count(*)) AS DOUBLE) / 100 AS average_confidence,
    count(*) FILTER (confidence_level >= 0.8::DOUBLE) AS high_confidence_changes,
    count(*) FILTER (confidence_level < 0.7::DOUBLE) AS low_confidence_changes FROM mods GROUP BY file_path),
filereport AS (SELECT a.path, f.filename, a.cell_count, a.code_cell_count, {", ".join(f"a.{c}" for c in COUNTED)},
    a.complexity, a.effort_hours, a.priority, a.duration_days,
    4 AS preparation_steps, 4 AS code_changes, 4 AS testing_steps, 4 AS deployment_steps, a.n_risks AS risks_identified,
    m.total_modifications, m.average_confidence, m.high_confidence_changes, m.low_confidence_changes,
    m.total_modifications AS replace_changes,
    CASE WHEN m.file_path IS NOT NULL THEN CAST(0 AS BIGINT) END AS insert_changes, CASE WHEN m.file_path IS NOT NULL THEN CAST(0 AS BIGINT) END AS delete_changes,
    CASE WHEN m.file_path IS NOT NULL THEN CAST(0 AS BIGINT) END AS modify_changes,
    v.total_validations, v.passed_validations, v.total_issues, v.total_warnings, v.validation_types,
    v.failed_validations, v.overall_status, 'completed' AS analysis_status, 'completed' AS plan_status,
    CASE WHEN m.file_path IS NULL THEN 'no_modifications_needed' ELSE 'completed' END AS modifications_status,
    'completed' AS validation_status,
    list_filter([CASE WHEN a.complexity = 'high' THEN {q(V.REC_COMPLEXITY)} END,
      CASE WHEN a.findings > 10 THEN {q(V.REC_VOLUME)} END, CASE WHEN a.priority = 'high' THEN {q(V.REC_PRIORITY)} END,
      CASE WHEN m.low_confidence_changes > 0 THEN {q(V.REC_CONFIDENCE)} END,
      CASE WHEN v.failed_validations > 0 THEN {q(V.REC_VALIDATION)} END], lambda i: i IS NOT NULL) AS recs
  FROM fileanalysis a JOIN files f ON a.path = f.path LEFT JOIN modsum m ON m.file_path = a.path JOIN vsum v ON v.path = a.path),
reported AS (SELECT * EXCLUDE (recs), CASE WHEN len(recs) > 0 THEN recs ELSE {values(V.REC_DEFAULT)} END AS recs FROM filereport),
stats AS (SELECT
    (SELECT count(*) FROM files) AS total_files, (SELECT CAST(sum(code_cell_count) AS BIGINT) FROM files) AS total_code_cells,
    (SELECT CAST(sum(findings) AS BIGINT) FROM fileanalysis) AS total_findings,
    round((SELECT sum(findings) FROM fileanalysis) / greatest((SELECT count(*) FROM files), 1), 1) AS findings_per_file,
    (SELECT count(*) FROM fileanalysis WHERE complexity = 'low') AS low_files,
    (SELECT count(*) FROM fileanalysis WHERE complexity = 'medium') AS medium_files,
    (SELECT count(*) FROM fileanalysis WHERE complexity = 'high') AS high_files,
    round((SELECT sum(effort_hours) FROM fileanalysis), 1) AS total_effort_hours,
    (SELECT count(*) FROM mods) AS total_modifications,
    round((SELECT count(*) FROM mods) / greatest((SELECT count(*) FROM files), 1), 1) AS modifications_per_file,
    (SELECT count(*) FROM vcounts) AS total_validations,
    (SELECT count(*) FROM vcounts WHERE issues_found = 0) AS passed_validations,
    round((SELECT count(*) FROM vcounts WHERE issues_found = 0) / greatest((SELECT count(*) FROM vcounts), 1) * 100, 1) AS success_rate),
riskrow AS (SELECT CASE WHEN share > 50 THEN 'high' WHEN share > 25 THEN 'medium' ELSE 'low' END AS overall_risk_level,
    high_risk_files, (SELECT count(*) FROM vcounts WHERE issues_found > 0) AS validation_failures, round(share, 1) AS risk_percentage
  FROM (SELECT count(*) FILTER (priority = 'high' OR n_risks > 3) AS high_risk_files,
    count(*) FILTER (priority = 'high' OR n_risks > 3) / greatest(count(*), 1) * 100 AS share FROM fileanalysis)),
times AS (SELECT total_effort_days, greatest(1, CAST(floor(total_effort_days * 0.7::DOUBLE) AS BIGINT)) AS estimated_calendar_days
  FROM (SELECT CAST(sum(duration_days) AS BIGINT) AS total_effort_days FROM fileanalysis)),
timerow AS (SELECT *, concat(estimated_calendar_days, ' days with parallel execution') AS recommended_timeline FROM times),
finalrow AS (SELECT stats.*, riskrow.*, timerow.*, (SELECT count(*) FROM fileanalysis WHERE priority = 'high') AS high_priority_files
  FROM stats, riskrow, timerow),
done AS (SELECT DISTINCT filename AS path FROM pairs WHERE filename LIKE '%.py'),
statements AS (SELECT seq, file, concat({", ".join(f"regexp_extract(code, '{_EXEC}', {g})" for g in (1, 2, 3, 4))}) AS statement
  FROM stmt),
writes AS (SELECT file, statement, unnest(regexp_extract_all(statement, '{_WRITE}', 1)) AS op,
    unnest(regexp_extract_all(statement, '{_WRITE}', 2)) AS target FROM statements),
lineage AS (SELECT file, upper(op) AS operation, trim(target, '`"[]') AS "table",
    replace(substring(statement, 1, 120), chr(10), ' ') AS preview FROM writes),
history AS (SELECT file_path, CAST(floor(seq / 20) AS BIGINT) AS run, count(*) AS findings,
    count(*) FILTER (severity = 'error') AS errors FROM issues GROUP BY 1, 2),
ranked AS (SELECT file_path, category, seq, line_number, severity, message,
    row_number() OVER (PARTITION BY file_path, category ORDER BY seq) AS rank,
    count(*) OVER (PARTITION BY file_path, category) AS total,
    min(seq) OVER (PARTITION BY file_path, category) AS first_seq FROM issues),
steps AS (SELECT doc, section, pos, step FROM (
    SELECT doc, pos, heading, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos) AS section,
      {strip("regexp_replace(line, '^[0-9.\\-]+', '')")} AS step, line
    FROM (SELECT doc, pos, trim(line) AS line, CASE WHEN upper(line) LIKE '%PREPARATION%' THEN 'preparation_steps'
        WHEN upper(line) LIKE '%CODE%' AND upper(line) LIKE '%CHANGE%' THEN 'code_changes'
        WHEN upper(line) LIKE '%TESTING%' THEN 'testing_steps' WHEN upper(line) LIKE '%DEPLOYMENT%' THEN 'deployment_steps' END AS heading
      FROM advice))
  WHERE heading IS NULL AND section IS NOT NULL AND regexp_matches(line, '^[-0-9]') AND step <> '')
"""

MOD_COLUMNS = """proactive, finding_seq, file_path, cell_index, line_number, change_type, original_code, modified_code,
reason, issue_type, confidence_level, requires_testing, breaking_change, documentation_needed"""


def _plan_lists() -> str:
    lists = {**V.PLAN_STEPS, "prerequisites": V.PREREQUISITES, "mitigation_strategies": V.MITIGATIONS}
    rows = ", ".join(f"({q(name)}, {q('; '.join(items))})" for name, items in lists.items())
    return (f"SELECT priority, k.list, k.items, count(*) AS files FROM analysis "
            f"CROSS JOIN (VALUES {rows}) k(list, items) GROUP BY ALL")


def _empty_sections() -> str:
    rows = ", ".join(f"({q(name)}, {values(items)})" for name, items in V.EMPTY_SECTION_STEPS.items())
    return f"""SELECT doc, section, pos, step FROM steps UNION ALL
SELECT d.doc, k.section, -1, unnest(k.steps) FROM (SELECT DISTINCT doc FROM advice) d CROSS JOIN (VALUES {rows}) k(section, steps)
WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.doc = d.doc AND s.section = k.section)"""


def _with_pos(source: str, items: str, name: str, keys: str) -> str:
    return (f"SELECT {keys}, CAST(i - 1 AS INT) AS pos, l[i] AS {name} FROM (SELECT {keys}, l, unnest(range(1, len(l) + 1)) AS i "
            f"FROM (SELECT {keys}, {items} AS l FROM {source}))")


def _messages(column: str) -> str:
    return (f"SELECT proactive, finding_seq, file_path, CAST(i - 1 AS INT) AS pos, {column}[i] AS issue "
            f"FROM (SELECT *, unnest(range(1, len({column}) + 1)) AS i FROM checked)")


def _ruled(expression: str) -> str:
    return (f"SELECT path, line_no, {expression} AS rewritten FROM (SELECT path, line_no, {strip('line')} AS x, "
            f"CASE WHEN line_no % 2 = 1 THEN 'names should use three-part naming' ELSE 'other' END AS msg FROM code)")


_not_null = "lambda i: i IS NOT NULL"
_dependencies = ("list_filter([" + ", ".join(
    f"CASE WHEN cat_{c} > 0 THEN {q(t)} END" for c, t in V.CATEGORY_DEPENDENCIES
) + ", " + ", ".join(q(t) for t in V.COMMON_DEPENDENCIES) + f"], {_not_null})")


def _risk(item) -> str:
    return "{'risk': %s, 'impact': %s, 'probability': %s}" % tuple(q(i) for i in item)


_risks = (f"list_filter([CASE WHEN complexity = 'high' THEN {_risk(V.COMPLEXITY_RISK)} END, "
          f"CASE WHEN findings > 10 THEN {_risk(V.VOLUME_RISK)} END, "
          + ", ".join(_risk(r) for r in V.COMMON_RISKS) + f"], {_not_null})")

_phase_rows = ", ".join([
    f"(0, 'Preparation', 4, {q('; '.join(V.PLAN_STEPS['preparation_steps']))})",
    f"(1, 'Code Changes', 2, {q('; '.join(V.CODE_CHANGE_TASKS))})",
    f"(2, 'Testing', 4, {q('; '.join(V.PLAN_STEPS['testing_steps']))})",
    f"(3, 'Deployment', 1000000, {q('; '.join(V.PLAN_STEPS['deployment_steps']))})",
])

_final_advice = f"""list_filter([
  CASE WHEN high_priority_files > 0 THEN concat('Prioritize ', high_priority_files, ' high-priority notebooks for immediate migration') END,
  CASE overall_risk_level WHEN 'high' THEN {q(V.FINAL_RISK['high'])} WHEN 'medium' THEN {q(V.FINAL_RISK['medium'])} END,
  CASE WHEN validation_failures > 0 THEN concat('Address ', validation_failures, ' validation failures before proceeding') END,
  {", ".join(q(t) for t in V.FINAL_COMMON)}], {_not_null})"""

_section = "upper(category)"
_summary = f"""SELECT file_path, string_agg(block, chr(10) ORDER BY first_seq) AS summary FROM (
  SELECT file_path, category, first_seq, concat(chr(10), {_section}, ' Issues (', total, '):', chr(10),
    string_agg(concat('  - Line ', line_number, ': [', severity, '] ', message), chr(10) ORDER BY rank),
    CASE WHEN total > 3 THEN concat(chr(10), '  ... and ', total - 3, ' more issues') ELSE '' END) AS block
  FROM ranked WHERE rank <= 3 GROUP BY file_path, category, first_seq, total) GROUP BY file_path"""
_plan_text = f"""SELECT file_path, string_agg(block, chr(10) ORDER BY first_seq) AS summary FROM (
  SELECT file_path, category, first_seq, concat(chr(10), {_section}, ':', chr(10),
    string_agg(concat('  - [', severity, '] ', message), chr(10) ORDER BY rank)) AS block
  FROM ranked WHERE rank <= 3 GROUP BY file_path, category, first_seq) GROUP BY file_path"""

_detail = """SELECT path, string_agg(block, chr(10) ORDER BY rank) AS detail FROM (
  SELECT v.path, v.rank, concat(chr(10), upper(v.validation_type), ' Validation:', chr(10), '  Status: ',
    CASE WHEN issues_found = 0 THEN 'PASSED' ELSE 'FAILED' END, chr(10), '  Issues: ', issues_found, chr(10), '  Warnings: ', warnings,
    coalesce((SELECT concat(chr(10), '  Issues Found:', chr(10), string_agg(concat('    - ', t.issue), chr(10) ORDER BY t.rank))
      FROM topissues t WHERE t.file_path = v.path AND t.validation_type = v.validation_type HAVING count(*) > 0), '')) AS block
  FROM vcounts v) GROUP BY path"""

_validation_advice = "CASE " + " ".join(
    f"WHEN validation_type = '{kind}' AND {'' if ok else 'NOT '}(issues_found = 0) THEN {q('; '.join(items))}"
    for (kind, ok), items in V.VALIDATION_ADVICE.items()
) + " END"

_first_new = """SELECT file_path, cell_index, line_number, arg_min(modified_code, o) AS new FROM (
  SELECT *, row_number() OVER (PARTITION BY file_path, cell_index, line_number ORDER BY proactive, finding_seq) AS o FROM mods)
  GROUP BY file_path, cell_index, line_number"""
_applied = f"""SELECT c.path, c.line_no, coalesce(w.new, c.line) AS line, w.new IS NOT NULL AS applied
  FROM code c LEFT JOIN ({_first_new}) w ON w.file_path = c.path AND w.line_number = c.line_no - 1"""
_applied_cells = f"""SELECT c.path, c.cell_index, c.place AS line_no, coalesce(w.new, c.line) AS line, w.new IS NOT NULL AS applied
  FROM celllines c LEFT JOIN ({_first_new}) w ON w.file_path = c.path AND w.cell_index = c.cell_index AND w.line_number = c.place
  WHERE c.cell_type = 'code'"""



def _fold(source: str, keys: list[str], kind: str, mods: str) -> str:
    """Modifications one after the other, each on the first line that holds its code; lines as a list."""
    key, match = ", ".join(keys), " AND ".join(f"s.{k} = o.{k}" for k in keys)
    new = "{'no': l[hit].no, 'text': new, 'applied': true}"
    return f"""WITH RECURSIVE edits AS (
      SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY proactive, finding_seq, cell_index, line_number) AS k
      FROM (SELECT file_path AS path, * EXCLUDE (file_path), {kind} AS kind_of, {strip("original_code")} AS code, modified_code AS new FROM mods
        WHERE {mods})),
    step AS (
      SELECT {key}, 0::BIGINT AS k, list({{'no': line_no, 'text': line, 'applied': false}} ORDER BY line_no) AS l FROM {source} GROUP BY {key}
      UNION ALL
      SELECT {key}, k, CASE WHEN hit IS NULL OR hit = 0 THEN l WHEN kind_of = 'delete' THEN l[:hit - 1] || l[hit + 1:]
        WHEN kind_of = 'insert' THEN l[:hit - 1] || [{new}] || l[hit:] ELSE l[:hit - 1] || [{new}] || l[hit + 1:] END
      FROM (SELECT {", ".join(f"s.{k}" for k in keys)}, o.k, s.l, o.kind_of, o.new,
          list_position(list_transform(s.l, lambda x: contains({strip("x.text")}, o.code)), true) AS hit
        FROM step s JOIN edits o ON {match} AND o.k = s.k + 1)),
    folded AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY k DESC) = 1)
    SELECT {key}, x.no AS line_no, CAST(row_number() OVER (PARTITION BY {key}, x.no ORDER BY i) - 1 AS INT) AS part, x.text AS line, x.applied
    FROM (SELECT {key}, unnest(l) AS x, unnest(range(len(l))) AS i FROM folded)"""


_not_python = "'^(CREATE TABLE|JOIN|FROM) '"
_mixed = "CASE line_number % 3 WHEN 0 THEN 'replace' WHEN 1 THEN 'insert' ELSE 'delete' END"
_folded_kinds = _fold("code", ["path"], _mixed, "kind = 'python'")
_code_cells = "(SELECT path, cell_index, place AS line_no, line FROM celllines WHERE cell_type = 'code')"

_header_rows = ", ".join(f"({i}, {q(line)})" for i, line in enumerate(V.PYTHON_HEADER))


def _after_changes(key: str) -> str:
    """Counted anew over the findings that are left once files changed and went."""
    moves = "(file_path LIKE '%4.py' OR file_path LIKE '%5.py')"
    return f"""SELECT {key}, count(*) AS n, count(*) FILTER (severity = 'error') AS errors,
      count(*) FILTER (severity = 'warning') AS warnings, CAST(min(line) AS INT) AS least_line_number,
      CAST(max(line) AS INT) AS greatest_line_number, min(seq) AS least_seq, max(seq) AS greatest_seq
      FROM (SELECT *, line_number + CASE WHEN {moves} AND seq % 2 = 0 THEN 3 ELSE 0 END AS line FROM issues
            WHERE file_path NOT LIKE '%2.py' AND NOT ({moves} AND seq % 3 = 0)) GROUP BY 1"""


_exec = V.EXECUTIVE_FORMAT

_BODIES = {
    "file_metrics": f"""SELECT path, CAST(len(string_split(content, chr(10))) AS INT) AS line_count,
      CAST(len(list_filter(string_split(content, chr(10)), lambda l: {strip("l")} <> '' AND NOT starts_with({strip("l")}, '#'))) AS INT)
      AS code_line_count FROM docs""",
    "archive_scan": f"""SELECT path, CAST(len(lines) AS INT) AS line_count,
      CAST(len(list_filter(lines, lambda l: {strip("l")} <> '' AND NOT starts_with({strip("l")}, '#'))) AS INT) AS code_line_count
      FROM (SELECT path, string_split(regexp_replace(coalesce(content, ''), '\\r\\n?', chr(10), 'g'), chr(10)) AS lines FROM docs)""",
    "notebook_metrics": "SELECT path, cell_count, code_cell_count FROM nbfiles",
    "input_summary": """SELECT (SELECT count(*) FROM pyfiles) AS files, count(*) AS findings,
      count(DISTINCT file_path) AS files_with_findings FROM issues""",
    "findings_per_file": "SELECT file_path, count(*) AS findings FROM issues GROUP BY file_path",
    "converted_names": """SELECT filename, CASE WHEN file_type = 'python' THEN concat(replace(filename, '.py', ''), '_unity_catalog.py')
      ELSE concat(replace(filename, '.ipynb', ''), '_unity_catalog.ipynb') END AS converted FROM files""",
    "run_summary": """SELECT (SELECT count(*) FROM files) AS total_files, (SELECT count(*) FROM files) AS analysis_results,
      (SELECT count(*) FROM files) AS migration_plans, (SELECT count(*) FROM mods) AS code_modifications,
      (SELECT count(*) FROM vcounts) AS validation_results, (SELECT count(DISTINCT file_path) FROM mods) AS converted_files, true AS success""",
    "notebook_scan": """SELECT concat('nb/', conv_id, '_', turn, '.ipynb') AS path, 0 AS cell_index, 'code' AS cell_type,
      CAST(i - 1 AS INT) AS line_no, l[i] AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l,
      unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations)""",
    "decode_bytes": "SELECT doc_id, text FROM documents",
    "lint_admit": "SELECT seq, raw FROM lint WHERE contains(raw, ':') AND regexp_matches(raw, '(?i)error|warning|info')",
    "lint_parse": "SELECT * FROM issues",
    "lint_severity": "SELECT seq, severity FROM issues",
    "lint_category": "SELECT seq, category, tag FROM issues",
    "issue_defaults": """SELECT seq, file_path, CASE WHEN seq % 3 <> 0 THEN line_number ELSE 0 END AS line_number,
      CASE WHEN seq % 5 <> 0 THEN severity ELSE '' END AS severity, CASE WHEN seq % 7 <> 0 THEN message ELSE '' END AS message,
      0 AS column_number, '' AS issue_type, '' AS code_snippet, '' AS suggested_fix, '' AS category FROM issues""",
    "sev_counts": "SELECT file_path, severity, count(*) AS findings FROM issues GROUP BY ALL",
    "cat_counts": "SELECT file_path, category, count(*) AS findings FROM issues GROUP BY ALL",
    "findings_nested": """SELECT file_path, CAST(floor(place / 1000) AS BIGINT) AS chunk, CAST(count(*) AS INT) AS findings,
      string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS seqs
      FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY seq) - 1 AS place FROM issues) GROUP BY 1, 2""",
    "top3_by_category": _summary,
    "top3_plan": _plan_text,
    "latest_analysis": """SELECT file_path, run, findings, errors FROM history
      QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY run DESC) = 1""",
    "first_analysis": """SELECT file_path, run, findings, errors FROM history
      QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY run) = 1""",
    "complexity": "SELECT file_path, findings, errors, warnings, any_spark, any_platform, score, complexity FROM analysis",
    "effort": "SELECT file_path, complexity, findings, effort_hours FROM analysis",
    "priority": "SELECT file_path, priority FROM analysis",
    "duration": "SELECT file_path, duration_days FROM analysis",
    "dependencies": _with_pos("analysis", _dependencies, "dependency", "file_path"),
    "risks": f"""SELECT file_path, pos, r.risk, r.impact, r.probability FROM ({_with_pos("analysis", _risks, "r", "file_path")})""",
    "phases": f"""SELECT file_path, k.pos, k.phase, CAST(greatest(1, duration_days // k.parts) AS INT) AS duration_days, k.tasks
      FROM analysis CROSS JOIN (VALUES {_phase_rows}) k(pos, phase, parts, tasks)""",
    "plan_summary": """SELECT file_path, priority, duration_days, 4 AS preparation_steps, 4 AS code_changes, 4 AS testing_steps,
      4 AS deployment_steps, n_risks AS risks_identified FROM analysis""",
    "plan_lists": _plan_lists(),
    "advice_default": _with_pos(
        "fileanalysis", f"CASE WHEN findings = 0 THEN {values(V.CLEAN_FILE_ADVICE)} ELSE {values(V.DEFAULT_ADVICE)} END", "advice", "path"),
    "advice_lines": _with_pos("conversations", f"""list_transform(list_filter(string_split(text, chr(10)),
      lambda l: {strip("l")} <> '' AND NOT starts_with({strip("l")}, '#')), lambda l: {strip("trim(l, '- ')")})[1:5]""",
        "line", "conv_id, turn"),
    "section_parse": _empty_sections(),
    "lineage_statements": "SELECT * FROM statements",
    "lineage_edges": "SELECT * FROM lineage",
    "lineage_preview": "SELECT doc_id, replace(substring(text, 1, 120), chr(10), ' ') AS preview FROM documents",
    "lineage_filter": "SELECT * FROM lineage WHERE \"table\" = 'main.s.t3'",
    "lineage_options": "SELECT DISTINCT 'file' AS kind, file AS id FROM lineage UNION ALL SELECT DISTINCT 'table', \"table\" FROM lineage",
    "lineage_nodes": """SELECT DISTINCT 'file' AS kind, file AS id, '#e5e7eb' AS color FROM lineage
      UNION ALL SELECT DISTINCT 'table', "table", '#ffedd5' FROM lineage""",
    "lineage_graph_edges": """SELECT file AS src, "table" AS dst, operation AS label, CASE operation WHEN 'INSERT INTO' THEN '#10b981'
      WHEN 'UPDATE' THEN '#f59e0b' WHEN 'DELETE FROM' THEN '#ef4444' ELSE '#6366f1' END AS color FROM lineage""",
    "lineage_counts": """SELECT count(*) AS write_statements, count(DISTINCT file) AS files, count(DISTINCT "table") AS tables FROM lineage""",
    "match_contains": "SELECT file_path, filename FROM pairs WHERE filename LIKE '%.py'",
    "match_basename": """SELECT i.file_path, f.filename FROM (SELECT DISTINCT file_path FROM issues) i
      JOIN pyfiles f ON regexp_extract(i.file_path, '[^/]*$') = f.filename""",
    "match_path": """WITH placed AS (SELECT concat(d, filename) AS path FROM pyfiles, (VALUES ('lib/'), ('deep/src/x')) t(d)
      UNION ALL SELECT concat('src/x', filename) FROM pyfiles WHERE filename LIKE '%0.py'),
      meant AS (SELECT l.file_path, p.path, 2 * least(len(string_split(l.file_path, '/')), len(string_split(p.path, '/')))
        + CAST(l.file_path = p.path AS INT) AS score FROM (SELECT DISTINCT file_path FROM issues) l JOIN placed p
        ON l.file_path = p.path OR ends_with(p.path, concat('/', l.file_path)) OR ends_with(l.file_path, concat('/', p.path)))
      SELECT file_path, path FROM meant QUALIFY score = max(score) OVER (PARTITION BY file_path)""",
    "file_basic": """SELECT path, cell_count, code_cell_count, findings, errors, warnings, complexity, effort_hours FROM fileanalysis""",
    "issue_line": "SELECT seq, path, line_number, line FROM located WHERE kind = 'python'",
    "cell_spans": "SELECT *, start_line + n_lines AS end_line FROM spans",
    "cell_locate": """SELECT i.seq, s.path, i.line_number, s.cell_index, CAST(i.line_number - 1 - s.start_line AS INT) AS cell_line
      FROM nissues i JOIN spans s ON s.path = i.file_path AND s.cell_type = 'code'
      AND s.start_line <= i.line_number - 1 AND i.line_number - 1 < s.start_line + s.n_lines""",
    "first_match_line": """SELECT proactive, finding_seq, path, line_number, min(line_no) AS first_line FROM (
      SELECT m.proactive, m.finding_seq, m.file_path AS path, m.line_number, c.line_no FROM mods m JOIN code c
      ON c.path = m.file_path AND contains(c.line, m.original_code)) GROUP BY ALL""",
    "mods_by_file": "SELECT file_path, proactive, finding_seq, cell_index, line_number, modified_code FROM mods",
    "rw_spark": _ruled(rw_spark("x")),
    "rw_sql": _ruled(rw_sql("x")),
    "rw_sql_safe": _ruled(rw_sql_safe("x")),
    "rw_sql_text": f"""SELECT path, pos, {rw_general("x", "'should use three-part naming'")} AS rewritten
      FROM (SELECT path, pos, {strip("line")} AS x FROM doclines)""",
    "rw_imports": _ruled(rw_imports("x")),
    "rw_platform": _ruled(rw_platform("x")),
    "rw_general": _ruled(rw_general("x", "msg")),
    "rw_proactive": """SELECT file_path, line_number, original_code, modified_code, confidence_level FROM mods
      WHERE proactive = 1 AND kind = 'python'""",
    "mod_confidence": f"SELECT seq, {confidence('message')} AS confidence FROM issues",
    "modifications": f"SELECT {MOD_COLUMNS} FROM mods",
    "modifications_changed": f"""SELECT {MOD_COLUMNS} FROM mods WHERE kind = 'python' AND (proactive = 1 OR original_code <> modified_code)""",
    "bracket_check": f"SELECT path, pos, array_to_string({brackets('line')}, '; ') AS issues FROM doclines",
    "compat_issues": _messages("compat_issues"),
    "compat_warnings": _messages("compat_warnings"),
    "logic_issues": _messages("logic_issues"),
    "validations": f"""SELECT path, validation_type, issues_found = 0 AS is_valid, issues_found, warnings,
      CASE WHEN rank = 1 THEN issues_found ELSE 0 END AS syntax_errors, CASE WHEN rank = 2 THEN issues_found ELSE 0 END AS compatibility_issues,
      CAST(0 AS BIGINT) AS performance_warnings, {_validation_advice} AS recommendations, '' AS next_steps FROM vcounts""",
    # Worked out by hand per template: bare SQL (CREATE TABLE, JOIN, a rewritten FROM) is no Python; all others compile.
    "syntax_parse": f"SELECT path, line_no, NOT regexp_matches({strip('line')}, {_not_python}) AS parses FROM code",
    "validations_parsed": f"""SELECT path, validation_type, issues_found + coalesce(n, 0) = 0 AS is_valid,
      issues_found + coalesce(n, 0) AS issues_found
      FROM vcounts v LEFT JOIN (SELECT file_path, 'syntax' AS kind_of, count(*) AS n FROM mods
        WHERE regexp_matches({strip('modified_code')}, {_not_python}) GROUP BY file_path) p
      ON p.file_path = v.path AND p.kind_of = v.validation_type""",
    "validation_summary": "SELECT * FROM vsum",
    "top3_validation_issues": "SELECT file_path, validation_type, rank, issue FROM topissues",
    "validation_text": _detail,
    "apply_lines": _applied,
    "apply_fold": _fold("code", ["path"], "change_type", "kind = 'python'"),
    "apply_fold_kinds": _folded_kinds,
    "apply_fold_cells": _fold(_code_cells, ["path", "cell_index"], "change_type", "kind = 'notebook'"),
    "converted_fold": f"""WITH a AS ({_folded_kinds}), n AS (SELECT path, count(*) AS lines FROM code GROUP BY path),
      c AS (SELECT path FROM a JOIN n USING (path) GROUP BY path, lines HAVING bool_or(applied) OR count(*) < lines
        UNION SELECT path FROM n WHERE path NOT IN (SELECT path FROM a))
      SELECT concat(replace(path, '.py', ''), '_unity_catalog.py') AS converted_path, 0 AS part, k.line_no, k.line, 0 AS sub
      FROM c CROSS JOIN (VALUES {_header_rows}) k(line_no, line)
      UNION ALL SELECT concat(replace(path, '.py', ''), '_unity_catalog.py'), 1, line_no, line, part FROM a WHERE path IN (SELECT path FROM c)""",
    "apply_cells": _applied_cells,
    "conversions": """SELECT f.path, CASE WHEN file_type = 'python' THEN concat(replace(filename, '.py', ''), '_unity_catalog.py')
      ELSE concat(replace(filename, '.ipynb', ''), '_unity_catalog.ipynb') END AS converted_path, filename,
      coalesce(total_modifications, 0) AS modifications_applied,
      CASE WHEN total_modifications IS NULL THEN 'no_modifications_needed' ELSE 'converted' END AS status
      FROM files f LEFT JOIN modsum m ON m.file_path = f.path""",
    "converted_content": f"""WITH a AS ({_applied}), c AS (SELECT DISTINCT path FROM a WHERE applied)
      SELECT concat(replace(path, '.py', ''), '_unity_catalog.py') AS converted_path, 0 AS part, k.line_no, k.line
      FROM c CROSS JOIN (VALUES {_header_rows}) k(line_no, line)
      UNION ALL SELECT concat(replace(path, '.py', ''), '_unity_catalog.py'), 1, line_no, line FROM a WHERE path IN (SELECT path FROM c)""",
    "converted_cells": f"""WITH a AS ({_applied_cells}), c AS (SELECT DISTINCT path FROM a WHERE applied)
      SELECT path, 0 AS cell_index, 'markdown' AS cell_type, {q(chr(10).join(V.NOTEBOOK_HEADER))} AS source FROM c
      UNION ALL SELECT l.path, l.cell_index + 1, l.cell_type, string_agg(coalesce(a.line, l.line), chr(10) ORDER BY l.place)
      FROM celllines l LEFT JOIN a ON a.path = l.path AND a.cell_index = l.cell_index AND a.line_no = l.place
      WHERE l.path IN (SELECT path FROM c) GROUP BY l.path, l.cell_index, l.cell_type""",
    "pending_files": "SELECT path FROM pyfiles WHERE path NOT IN (SELECT path FROM done)",
    "done_files": "SELECT path FROM pyfiles WHERE path IN (SELECT path FROM done)",
    "first_pending": "SELECT min(path) AS path FROM pyfiles WHERE path NOT IN (SELECT path FROM done)",
    "progress": """SELECT total, processed, total - processed AS remaining, processed / total * 100 AS percentage,
      processed >= total AS complete FROM (SELECT (SELECT count(*) FROM pyfiles) AS total, (SELECT count(*) FROM done) AS processed)""",
    "change_types": "SELECT file_path, change_type, count(*) AS modifications FROM mods GROUP BY ALL",
    "mod_summary": "SELECT * FROM modsum",
    "file_report": "SELECT * EXCLUDE (recs), array_to_string(recs, '; ') AS recommendations FROM reported",
    "file_recommendations": _with_pos("reported", "recs", "recommendation", "path"),
    "portfolio_stats": "SELECT * FROM stats",
    "complexity_dist": "SELECT complexity, count(*) AS files FROM analysis GROUP BY complexity",
    "priority_dist": "SELECT priority, count(*) AS files FROM analysis GROUP BY priority",
    "high_priority": "SELECT file_path FROM analysis WHERE priority = 'high'",
    "portfolio_risk": "SELECT * FROM riskrow",
    "portfolio_timeline": "SELECT * FROM timerow",
    "final_report": "SELECT * FROM finalrow",
    "final_recommendations": _with_pos("finalrow", _final_advice, "recommendation", "1 AS one").replace("1 AS one, ", ""),
    "exec_summary": f"SELECT printf({q(_exec)}, total_files, total_findings, total_effort_hours, estimated_calendar_days) AS executive_summary FROM finalrow",
    "riskiest_files": "SELECT file_path, findings, errors, score, complexity, effort_hours, priority FROM analysis",
    "lint_stream": "SELECT * FROM issues",
    "severity_stream": "SELECT file_path, severity, count(*) AS findings FROM issues GROUP BY ALL",
    "incremental_lineage": "SELECT * FROM lineage",
    "incremental_totals": _after_changes("file_path"),
    "incremental_categories": _after_changes("category"),
}


def _whole(body: str) -> str:
    if body.startswith("WITH RECURSIVE "):
        return CTES.replace("WITH", "WITH RECURSIVE", 1) + ", " + body[len("WITH RECURSIVE "):]
    if body.startswith("WITH "):
        return CTES + ", " + body[len("WITH "):]
    return CTES + body


ORACLE: dict[str, str] = {name: _whole(body) for name, body in _BODIES.items()}
