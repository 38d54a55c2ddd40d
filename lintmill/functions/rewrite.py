"""Rewrite rules: each turns a stripped line into its rewritten form.

A rule takes ``(line, message, prefix)`` columns/values and returns a column.
``rules="compat"`` reproduces the published behaviour, which prefixes the first
part of a dotted name as well; ``rules="safe"`` leaves dotted names alone, so
that rewriting twice changes nothing more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintmill import fixed_values as V
from lintmill.functions.text import has, has_any_case, quote_replacement, swap

Rule = Callable[[Column, Column, str], Column]

_WHOLE = V.W + r"++(?!\.)"  # a name with no dot behind it


def _prefix_names(line: Column, pattern: str, lead: str, prefix: str) -> Column:
    return F.regexp_replace(line, f"(?i){pattern}", f"{lead}{quote_replacement(prefix)}$1")


def spark_rule(line: Column, message: Column, prefix: str = V.NAME_PREFIX) -> Column:
    read = F.regexp_extract(line, V.READ_CALL, 1)
    name = F.when(read != "", read).otherwise(F.regexp_extract(line, V.SAVE_CALL, 1))
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    target = F.concat(F.lit(f'"{prefix}'), name, F.lit('"'))
    return F.when(name != "", swap(line, quoted, target)).otherwise(line)


def sql_rule(line: Column, message: Column, prefix: str = V.NAME_PREFIX) -> Column:
    reads = has_any_case(line, "SELECT") & has_any_case(line, "FROM")
    return (
        F.when(reads, _prefix_names(line, V.FROM_NAME, "FROM ", prefix))
        .when(has_any_case(line, "CREATE TABLE"), _prefix_names(line, V.CREATE_NAME, "CREATE TABLE ", prefix))
        .otherwise(line)
    )


def sql_rule_safe(line: Column, message: Column, prefix: str = V.NAME_PREFIX) -> Column:
    reads = has_any_case(line, "SELECT") & has_any_case(line, "FROM")
    create = F.regexp_replace(
        line,
        rf"(?i)(CREATE{V.S}+TABLE{V.S}+(?:IF{V.S}+NOT{V.S}+EXISTS{V.S}+)?)(?!IF{V.S})({_WHOLE})",
        f"$1{quote_replacement(prefix)}$2",
    )
    return (
        F.when(reads, _prefix_names(line, rf"FROM{V.S}+({_WHOLE})", "FROM ", prefix))
        .when(has_any_case(line, "CREATE TABLE"), create)
        .otherwise(line)
    )


def imports_rule(line: Column, message: Column, prefix: str = V.NAME_PREFIX) -> Column:
    chain = F
    for statement, note in V.IMPORT_NOTES:
        chain = chain.when(has(line, statement), F.concat(line, F.lit(note)))
    return chain.otherwise(line)


def platform_rule(line: Column, message: Column, prefix: str = V.NAME_PREFIX) -> Column:
    return F.when(has(line, V.FILESYSTEM_CALL), F.concat(F.lit(V.FILESYSTEM_NOTE), line)).otherwise(line)


def _prefix_quoted(line: Column, call: str, prefix: str) -> Column:
    """Prefix, in either quote style, every name the call pattern finds."""
    def both(acc: Column, name: Column) -> Column:
        for q in ("'", '"'):
            acc = swap(acc, F.concat(F.lit(q), name, F.lit(q)), F.concat(F.lit(q + prefix), name, F.lit(q)))
        return acc

    return F.aggregate(F.regexp_extract_all(line, F.lit(call), 1), line, both)


def spark_rule_safe(line: Column, message: Column, prefix: str = V.NAME_PREFIX) -> Column:
    """Qualifies every plain name in read and save calls, in either quote style."""
    return _prefix_quoted(_prefix_quoted(line, V.READ_CALL, prefix), V.SAVE_CALL, prefix)


def _general(line: Column, message: Column, prefix: str, from_name: str, join_name: str) -> Column:
    calls = [
        (from_name, "FROM ", ""),
        (join_name, "JOIN ", ""),
        (V.TABLE_CALL_OPEN, "table('", "'"),
        (V.SAVE_CALL_OPEN, "saveAsTable('", "'"),
    ]
    asked = has(F.lower(message), V.THREE_PART_HINT) & (
        has_any_case(line, "FROM") | has_any_case(line, "JOIN")
    )
    rule = F.when(has(F.lower(line), V.LEGACY_CATALOG), swap(line, V.LEGACY_CATALOG, V.CATALOG_NAME))
    for pattern, lead, tail in calls:
        fixed = F.regexp_replace(line, f"(?i){pattern}", f"{lead}{quote_replacement(prefix)}$1{tail}")
        rule = rule.when(asked & line.rlike(f"(?i){pattern}"), fixed)
    for name, context, ignore_case in V.NAMED_TABLES:
        near = has_any_case(line, context) if ignore_case else has(line, context)
        rule = rule.when(has(line, name) & near, swap(line, name, prefix + name))
    read = F.when(
        has(line, "spark.read.table("), _prefix_quoted(line, V.READ_CALL_OPEN, prefix)
    ).otherwise(line)
    saved = F.when(
        has(line, "saveAsTable("), _prefix_quoted(read, V.SAVE_CALL_OPEN, prefix)
    ).otherwise(read)
    return rule.otherwise(saved)


def general_rule(line: Column, message: Column, prefix: str = V.NAME_PREFIX) -> Column:
    return _general(line, message, prefix, V.FROM_NAME, V.JOIN_NAME)


def general_rule_safe(line: Column, message: Column, prefix: str = V.NAME_PREFIX) -> Column:
    return _general(line, message, prefix, rf"FROM{V.S}+({_WHOLE})", rf"JOIN{V.S}+({_WHOLE})")


COMPAT_RULES: dict[str, Rule] = {
    "spark": spark_rule,
    "sql": sql_rule,
    "imports": imports_rule,
    "databricks": platform_rule,
}
SAFE_RULES: dict[str, Rule] = {**COMPAT_RULES, "spark": spark_rule_safe, "sql": sql_rule_safe}


def rewrite(
    line: Column,
    category: Column,
    message: Column,
    rules: str = "compat",
    prefix: str = V.NAME_PREFIX,
    extra: dict[str, Rule] | None = None,
) -> Column:
    """Dispatch a stripped line to the rule of its category.

    ``extra`` adds rules for further categories or replaces existing ones.
    """
    chosen = {"compat": COMPAT_RULES, "safe": SAFE_RULES}[rules] | (extra or {})
    fallback = (extra or {}).get(
        V.DEFAULT_CATEGORY, general_rule_safe if rules == "safe" else general_rule
    )
    chain = F
    for name, rule in chosen.items():
        if name != V.DEFAULT_CATEGORY:
            chain = chain.when(category == name, rule(line, message, prefix))
    return chain.otherwise(fallback(line, message, prefix))


def named_table_rule(pairs: list[tuple[str, str]]) -> Rule:
    """A rule of one's own: qualify ``name`` on lines that hold ``context``."""
    def rule(line: Column, message: Column, prefix: str = V.NAME_PREFIX) -> Column:
        chain = F
        for name, context in pairs:
            chain = chain.when(has(line, name) & has(line, context), swap(line, name, prefix + name))
        return chain.otherwise(line)

    return rule


def needs_catalog_config(line: Column) -> Column:
    return has(line, V.SESSION_BUILDER) & has(line, V.HIVE_SUPPORT)


def catalog_config(line: Column) -> Column:
    return swap(line, V.HIVE_SUPPORT_CALL, V.CATALOG_CONFIG_CALL)
