"""Matching findings to files, lines and cells.

Findings are first reduced to the spots they point at, (file_path, line_number).
Spots are matched to files, lines and cells; the findings themselves move once,
when the matched spots are attached to them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.functions.text import base_name, strip
from lintmill.operators.containment import finder, first_hits, hits
from lintmill.operators.skew import HOT_ROWS, grid_join, running_total, spread_join
from lintmill.session import materialize


_TAIL, _SLOTS, _SHORT = 3, 1024, -1
NAMES = 4 << 20  # characters of file names that one automaton holds, some 50 bytes each


def length_index(codes: DataFrame, code: str, keys: list[str]) -> DataFrame:
    """Per key, the lengths codes have by a hash of their last characters.

    A map of at most 1025 entries, each with the lengths that occur, so its size
    does not grow with the number of codes.
    """
    tail = F.when(
        F.length(code) >= _TAIL, F.pmod(F.xxhash64(F.right(code, F.lit(_TAIL))), F.lit(_SLOTS))
    ).otherwise(_SHORT).cast("int")
    per_tail = codes.groupBy(*keys, tail.alias("_tail")).agg(F.collect_set(F.length(code)).alias("_lengths"))
    return per_tail.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_tail", "_lengths"))).alias("_index")
    )


def pieces(df: DataFrame, text: str, index: Column, name: str) -> DataFrame:
    """One row per substring of ``text`` that may equal an indexed code.

    Only substrings that end like a code and have the length of such a code are
    cut out. A substring that occurs twice may come twice.
    """
    end, n = F.col("_end"), F.col("_n")
    last = F.substring(F.col(text), end - _TAIL + 1, F.lit(_TAIL))
    tail = F.when(end >= _TAIL, F.pmod(F.xxhash64(last), F.lit(_SLOTS)).cast("int")).otherwise(-2)
    none = F.expr("cast(array() as array<int>)")
    lengths = F.concat(F.coalesce(index[tail], none), F.coalesce(index[F.lit(_SHORT)], none))
    return (
        df.withColumn("_end", F.explode(F.sequence(F.lit(0), F.length(text))))
        .withColumn("_n", F.explode(lengths))
        .filter((n <= end) & ((n > 0) | (end == 0)))
        .withColumn(name, F.substring(F.col(text), end - n + 1, n))
        .drop("_end", "_n")
    )


def match_contains(paths: DataFrame, names: DataFrame, most: int = NAMES) -> DataFrame:
    """Pairs (file_path, filename) where the lint path contains the file name.

    Both sides are made distinct first. Names of at most ``most`` characters in all are
    compiled into an automaton that reads each path once, where it lies. Beyond that
    paths are cut into the substrings that may be file names, so the containment test
    becomes an equi join: no path is compared with a name it does not hold.
    """
    lint = paths.select("file_path").distinct()
    known = materialize(names.select("filename").distinct(), "names")
    size = known.agg(F.sum(F.length("filename"))).first()[0] or 0
    if size > most:
        index = length_index(known, "filename", []).scalar()
        cut = pieces(lint.withColumn("_index", index), "file_path", F.col("_index"), "filename").drop("_index")
        return _pairs(cut, known).distinct()
    held = [n for n in known.toArrow()["filename"].to_pylist() if n is not None]  # ``most`` characters

    def read(batches):
        find = finder(held)
        for batch in batches:
            found = [(path, name) for path in batch["file_path"].to_pylist() if path is not None for name in find(path)]
            yield pa.RecordBatch.from_pydict({
                "file_path": pa.array([p for p, _ in found], pa.string()), "filename": pa.array([n for _, n in found], pa.string())})

    return lint.mapInArrow(read, "file_path string, filename string")


def match_basename(paths: DataFrame, names: DataFrame) -> DataFrame:
    """Exact match on the last path segment."""
    lint = paths.select("file_path").distinct().withColumn("filename", base_name(F.col("file_path")))
    return _pairs(lint, names.select("filename").distinct())


def _endings(path: Column) -> Column:
    """A path and what is left of it below each of its folders."""
    parts = F.split(path, "/")
    whole = F.sequence(F.lit(1), F.size(parts))
    return F.transform(whole, lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def match_path(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs (file_path, filename) of lint paths and files, where ``filename`` is the file's whole path.

    One of the two ends with the other, from a folder's edge on; a leading ``./`` of
    the lint path does not count. Of several files, those that share most folders
    with the lint path are meant, and an equal path before all others. For corpora
    of several folders, where names such as ``utils.py`` occur in many of them. Each
    side is cut only at its folders, so pairs grow with paths and files alone.
    """
    lint = paths.select("file_path").distinct().withColumn("_given", F.regexp_replace("file_path", r"^(\./)+", ""))
    known = files.select(F.col("path").alias("filename")).distinct()
    inner = lint.withColumn("filename", F.explode(_endings(F.col("_given")))).join(known, "filename")
    outer = known.withColumn("_given", F.explode(_endings(F.col("filename")))).join(lint, "_given")
    shared = F.least(F.size(F.split("_given", "/")), F.size(F.split("filename", "/")))
    found = (
        inner.select("file_path", "_given", "filename").union(outer.select("file_path", "_given", "filename"))
        .filter("_given <> '' and filename <> ''").distinct()
        .select("file_path", "filename", (2 * shared + (F.col("_given") == F.col("filename")).cast("int")).alias("_rank"))
    )
    best = found.groupBy("file_path").agg(F.max("_rank").alias("_rank"))
    return found.join(best, ["file_path", "_rank"]).select("file_path", "filename")


def _pairs(named: DataFrame, known: DataFrame) -> DataFrame:
    counts = _count(named, ["filename"])
    joined = spread_join(named, known, ["filename"], "file_path", counts)
    return joined.select("file_path", "filename")


def _count(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def matched_files(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """The files (path, filename) that some lint path means."""
    names = pairs.select("filename").distinct()
    return files.select("path", "filename").join(names, "filename", "left_semi")


def totals_per_file(totals: DataFrame, pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Totals per lint path to totals per file ``path``.

    Totals are summed per file name before the files that share a name take
    part, so there are never more joined rows than pairs plus files.
    """
    flags = ("any_spark", "any_platform")
    numbers = [c for c in totals.columns if c not in ("file_path", *flags)]
    per_name = totals.join(pairs, "file_path").groupBy("filename").agg(
        *[F.sum(c).alias(c) for c in numbers], *[F.max(c).alias(c) for c in flags]
    )
    named = files.select("path", "filename")
    return spread_join(named, per_name, ["filename"], "path", _count(named, ["filename"])).drop("filename")


def spots(findings: DataFrame) -> DataFrame:
    """Distinct places findings point at, with the number of findings ``n``."""
    return _count(findings, ["file_path", "line_number"])


def spot_files(places: DataFrame, pairs: DataFrame, files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Spots with the ``path`` of every file they belong to.

    A path of many spots may mean many files, and a name of many files may be meant by
    many spots, so both joins are cut on both sides.
    """
    spot = places.drop("n")
    meant = grid_join(spot, pairs, ["file_path"], "line_number", "filename",
                      _count(spot, ["file_path"]), _count(pairs, ["file_path"]), hot_rows)
    named = files.select("path", "filename")
    return grid_join(named, meant, ["filename"], "path", ["file_path", "line_number"],
                     _count(named, ["filename"]), _per_name(spot, pairs), hot_rows).drop("filename")


def _per_name(spot: DataFrame, pairs: DataFrame) -> DataFrame:
    """How many spots mean each file name, from the spots of each path: the join itself is not made."""
    per_path = _count(spot, ["file_path"]).withColumnRenamed("n", "_n")
    return pairs.join(per_path, "file_path").groupBy("filename").agg(F.sum("_n").alias("n"))


def _files_per_path(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """How many files a lint path means, with equal names counted as often as they occur."""
    per_name = _count(files, ["filename"]).withColumnRenamed("n", "_n")
    return pairs.join(per_name, "filename").groupBy("file_path").agg(F.sum("_n").alias("n"))


def attach(
    findings: DataFrame, matched: DataFrame, places: DataFrame, pairs: DataFrame, files: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Findings with what their spot was matched to, one row per match.

    A spot may have many findings and mean many files. It has at most as many
    matches as its path has files, so matches need not be counted.
    """
    many = _files_per_path(pairs, files).filter(F.col("n") > hot_rows)
    matches = places.drop("n").join(many, "file_path")
    return grid_join(findings, matched, ["file_path", "line_number"], "seq", "path", places, matches, hot_rows)


def finding_lines(
    findings: DataFrame, pairs: DataFrame, files: DataFrame, source: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Findings with the source line they point at; those outside the file drop out.

    ``source`` comes from :func:`python_source` and/or :func:`notebook_source`.
    """
    places = materialize(spots(findings), "spots")
    meant = spot_files(places, pairs, files, hot_rows).join(source, ["path", "line_number"])
    return attach(findings, meant, places, pairs, files, hot_rows)


def cell_spans(cells: DataFrame) -> DataFrame:
    """Where each code cell starts and ends among its notebook's code lines."""
    counted = cells.select(
        "path", "cell_index", "cell_type",
        F.when(F.col("cell_type") == "code", F.size("source")).otherwise(0).alias("n_lines"),
    )
    spans = running_total(counted, ["path"], "cell_index", "n_lines", "start_line")
    return spans.withColumn("end_line", F.col("start_line") + F.col("n_lines"))


def spot_cells(placed: DataFrame, spans: DataFrame, bucket: int = 64) -> DataFrame:
    """Spots with the code cell and the 0-based line in it that they mean.

    Spans are listed under every bucket of lines they touch, so a spot meets at
    most ``bucket`` spans. Spots outside every code cell drop out.
    """
    first, last = F.col("start_line"), F.col("end_line") - 1
    per_bucket = (
        spans.filter("cell_type = 'code' and n_lines > 0")
        .withColumn("_bucket", F.explode(F.sequence(F.floor(first / bucket), F.floor(last / bucket))))
        .groupBy("path", "_bucket")
        .agg(F.collect_list(F.struct("cell_index", "start_line", "end_line")).alias("_spans"))
    )
    spot = F.col("line_number") - 1
    asked = placed.filter(spot >= 0).withColumn("_bucket", F.floor(spot / bucket))
    hit = F.filter("_spans", lambda s: (s["start_line"] <= spot) & (spot < s["end_line"]))
    return (
        asked.join(per_bucket, ["path", "_bucket"])
        .withColumn("_hit", F.get(hit, F.lit(0))).filter("_hit is not null")
        .withColumn("cell_index", F.col("_hit.cell_index"))
        .withColumn("cell_line", (spot - F.col("_hit.start_line")).cast("int"))
        .drop("_bucket", "_spans", "_hit")
    )


def finding_cells(findings: DataFrame, pairs: DataFrame, notebooks: DataFrame, cells: DataFrame) -> DataFrame:
    """Findings with notebook ``path``, ``cell_index`` and ``cell_line``."""
    places = materialize(spots(findings), "spots")
    placed = spot_files(places, pairs, notebooks)
    return attach(findings, spot_cells(placed, cell_spans(cells)), places, pairs, notebooks)


def cell_lines(cells: DataFrame) -> DataFrame:
    """One row per line of a code cell; ``line_no`` counts from 0."""
    return (
        cells.filter("cell_type = 'code'")
        .select("path", "cell_index", F.posexplode("source").alias("line_no", "line"))
    )


def python_source(lines: DataFrame) -> DataFrame:
    """Lines as rewriting reads them: (path, kind, line_number, cell_index, place, line).

    ``line_number`` is what findings give, ``place`` the 0-based line in the cell
    or file.
    """
    return lines.select(
        "path", F.lit("python").alias("kind"), F.col("line_no").alias("line_number"),
        F.lit(0).alias("cell_index"), (F.col("line_no") - 1).alias("place"), "line",
    )


def notebook_source(cells: DataFrame) -> DataFrame:
    """Code cell lines, numbered through the notebook."""
    starts = running_total(
        cells.filter("cell_type = 'code'").withColumn("_n", F.size("source")),
        ["path"], "cell_index", "_n", "_start",
    )
    return starts.select("path", "cell_index", "_start", F.posexplode("source").alias("place", "line")).select(
        "path", F.lit("notebook").alias("kind"),
        (F.col("_start") + F.col("place") + 1).cast("int").alias("line_number"),
        "cell_index", "place", "line",
    )


def code_hits(texts: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """Which texts contain which codes, within each key: (keys, text, code).

    ``texts`` holds distinct (keys, text), ``codes`` distinct (keys, code).
    """
    return hits(texts, codes, keys)


def first_matching_line(lines: DataFrame, mods: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each modification with ``first_line``, where its original code first occurs.

    Modifications found nowhere drop out. Lines are read once, past the codes of
    their file.
    """
    keys = keys or ["path"]
    texts = lines.select(*keys, "line_no", strip(F.col("line")).alias("text"))
    wanted = mods.withColumn("code", strip(F.col("original_code")))
    codes = _count(wanted, [*keys, "code"])
    first = first_hits(texts, codes, keys, "line_no").withColumnRenamed("line_no", "first_line")
    return spread_join(wanted, first, [*keys, "code"], "seq", codes).drop("code")
