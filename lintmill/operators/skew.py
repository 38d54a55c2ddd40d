"""Joins and ordered sums that hold when one key owns much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintmill.session import materialize

HOT_ROWS = 1_000_000  # rows of one key that one task may take in a join
CHUNK = 65_536        # rows of one key that one window group may hold
SALTS = 16


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread_by: str, salts: int = SALTS
) -> DataFrame:
    """Inner join that cuts every key of ``big`` into ``salts`` parts.

    For a ``small`` side of few or narrow rows, which is repeated per part.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def spread_join(
    big: DataFrame,
    other: DataFrame,
    keys: list[str],
    spread_by: str,
    counts: DataFrame,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join that cuts only the hot keys of ``big`` into parts.

    ``counts`` tells the rows per key of ``big`` (columns: keys and ``n``). Keys
    above ``hot_rows`` are cut into as many parts as needed, and only their rows
    in ``other`` are repeated, so every task sees a bounded share of ``big``.
    Spark decides how to join the list of hot keys, which has at most one entry
    for every ``hot_rows`` rows. ``spread_by`` varies within a key.
    """
    hot = counts.filter(F.col("n") > hot_rows).select(
        *keys, F.ceil(F.col("n") / hot_rows).cast("int").alias("_parts")
    )
    parts = F.coalesce("_parts", F.lit(1))
    left = big.join(hot, keys, "left").withColumn(
        "_part", F.pmod(F.xxhash64(spread_by), parts).cast("int")
    )
    right = other.join(hot, keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    return left.drop("_parts").join(right.drop("_parts"), [*keys, "_part"]).drop("_part")


def grid_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_by: str | list[str],
    right_by: str | list[str],
    left_counts: DataFrame,
    right_counts: DataFrame,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join for keys that may be hot on both sides.

    Each side of a key is cut into parts of about ``hot_rows`` rows by its own count
    (``left_counts``, ``right_counts``: keys and ``n``), r and c of them. The r x c cells
    are dealt separately, and every part of one side meets every part of the other
    exactly once, so a task takes about ``hot_rows`` rows of each side for a cell. Keys
    that are hot on neither side make one cell and are not repeated; a row is
    repeated once for every part of the other side. ``left_by`` and ``right_by`` vary
    within a key; rows equal in them stay together. Counts are worked out at once:
    without hot keys this is a plain join, and neither side moves for its parts.
    """
    def parts(counts: DataFrame, name: str) -> DataFrame:
        return counts.filter(F.col("n") > hot_rows).select(*keys, F.ceil(F.col("n") / hot_rows).cast("int").alias(name))

    hot = materialize(parts(left_counts, "_rows").join(parts(right_counts, "_columns"), keys, "full"), "hot")
    if hot.isEmpty():
        return left.join(right, keys)
    n_rows, n_columns = F.coalesce("_rows", F.lit(1)), F.coalesce("_columns", F.lit(1))

    def own(by: str | list[str], n: Column) -> Column:
        return F.pmod(F.xxhash64(*([by] if isinstance(by, str) else by)), n).cast("int")

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    one = left.join(hot, keys, "left").withColumn("_row", own(left_by, n_rows)).withColumn("_column", every(n_columns))
    two = right.join(hot, keys, "left").withColumn("_column", own(right_by, n_columns)).withColumn("_row", every(n_rows))
    cut = ("_rows", "_columns")
    return one.drop(*cut).join(two.drop(*cut), [*keys, "_row", "_column"]).drop("_row", "_column")


def chunk_of(position: Column, kind: T.DataType, size: int = CHUNK) -> Column:
    """Groups neighbouring positions, at most ``size`` integers to a group.

    Of a struct, the last field is grouped and the others are kept.
    """
    if isinstance(kind, T.StructType):
        kept = [position[f.name].alias(f.name) for f in kind.fields[:-1]]
        last = kind.fields[-1]
        return F.struct(*kept, chunk_of(position[last.name], last.dataType, size).alias(last.name))
    return F.floor(position / size)


def running_total(
    df: DataFrame, keys: list[str], position: str, value: str, name: str, chunk: Column | None = None
) -> DataFrame:
    """Sum of ``value`` over earlier rows of the key (the row itself left out).

    ``position`` is unique within the key. Rows are cut into chunks of positions
    and the chunk totals summed, so no window group holds more of a key than one
    chunk or one row per chunk.
    """
    return _two_level(
        df, keys, position, name, chunk,
        within=lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        total=F.sum(value),
        carried=lambda w: F.sum("_total").over(w.rowsBetween(Window.unboundedPreceding, -1)),
        combine=lambda inner, before: (
            F.coalesce(inner, F.lit(0)) + F.coalesce(before, F.lit(0))
        ).cast("long"),
    )


def carry_forward(
    df: DataFrame, keys: list[str], position: str, value: str, name: str, chunk: Column | None = None
) -> DataFrame:
    """Last non-NULL ``value`` at or before each row of the key."""
    return _two_level(
        df, keys, position, name, chunk,
        within=lambda w: F.last(value, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
        total=F.max_by(value, F.when(F.col(value).isNotNull(), F.col(position))),
        carried=lambda w: F.last("_total", ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1)
        ),
        combine=lambda inner, before: F.coalesce(inner, before),
    )


def _two_level(df, keys, position, name, chunk, within, total, carried, combine) -> DataFrame:
    if chunk is None:
        chunk = chunk_of(F.col(position), df.schema[position].dataType)
    chunked = df.withColumn("_chunk", chunk)
    inner = chunked.withColumn(
        "_inner", within(Window.partitionBy(*keys, "_chunk").orderBy(position))
    )
    totals = chunked.groupBy(*keys, "_chunk").agg(total.alias("_total"))
    before = (
        totals.withColumn("_before", carried(Window.partitionBy(*keys).orderBy("_chunk")))
        .filter("_before is not null").select(*keys, "_chunk", "_before")
    )
    return (
        inner.join(before, [*keys, "_chunk"], "left")
        .withColumn(name, combine(F.col("_inner"), F.col("_before")))
        .drop("_chunk", "_inner", "_before")
    )


def first_rows(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key, with their rank in column ``rank``.

    Spark limits each key to ``n`` rows per task before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
