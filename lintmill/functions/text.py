"""Text helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintmill import fixed_values as V


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode whitespace (plain ``trim`` only drops spaces)."""
    return F.btrim(text, F.lit(V.SPACES))


def strip_chars(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def is_code(line: Column) -> Column:
    """The first visible character exists and does not start a comment."""
    return line.rlike(rf"^{V.S}*[^{V.WS}#]")


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def has(text: Column, word: str) -> Column:
    return F.contains(text, F.lit(word))


def has_any_case(text: Column, word: str) -> Column:
    return F.contains(F.upper(text), F.lit(word.upper()))


def quote_replacement(text: str) -> str:
    """Escape text for use as a regex replacement."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def swap(text: Column, old: str | Column, new: str | Column) -> Column:
    old = F.lit(old) if isinstance(old, str) else old
    new = F.lit(new) if isinstance(new, str) else new
    return F.replace(text, old, new)


def strings(values: list[str]) -> Column:
    if not values:
        return F.expr("cast(array() as array<string>)")
    return F.array(*[F.lit(v) for v in values])


def present(*items: Column) -> Column:
    """Array of the given columns without the NULL ones."""
    return F.array_compact(F.array(*items))


def clean_utf8(content: Column) -> Column:
    """Bytes to text; invalid bytes are dropped, real U+FFFD characters kept."""
    kept = "\U0010fffe"  # a code point that never stands for a character
    text = F.replace(content.cast("string"), F.lit("�"), F.lit(kept))
    valid = F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))
    return F.replace(valid, F.lit(kept), F.lit("�"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
