"""Structured Streaming: take in logs and files as they arrive."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lintmill.operators.findings import parse_findings, severity_counts
from lintmill.sources.paths import known_store
from lintmill.streaming.log_source import LogSource

log = logging.getLogger(__name__)


def lint_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines ``(seq, raw)`` of log files that appear in a folder, whatever their names.

    Path patterns, and stores that Arrow does not know, are left to Spark's own stream,
    which hides names that start with ``_`` or ``.``; a warning says so. It cannot number
    rows, so ``seq.row`` is then filled in per batch.
    """
    if known_store(folder):
        spark.dataSource.register(LogSource)
        return spark.readStream.format("lint_logs").load(folder)
    log.warning("streamed by Spark, without names that start with _ or '.': %s", folder)
    place = F.struct(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"),
        F.lit(None).cast("bigint").alias("row"),
    )
    return spark.readStream.format("text").load(folder).select(place.alias("seq"), F.col("value").alias("raw"))


def write_findings(raw: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parse log lines batch by batch until all present input is read.

    Each batch writes its own folder below ``out``; a retried batch overwrites it.
    """
    numbered = raw.schema["seq"].dataType.typeName() == "struct"

    def save(lines: DataFrame, batch: int) -> None:
        if numbered:
            row = F.coalesce(F.col("seq.row"), F.monotonically_increasing_id())
            lines = lines.withColumn("seq", F.col("seq").withField("row", row))
        parse_findings(lines).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return (
        raw.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def write_severity_counts(raw: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep running counts per file and severity in a table.

    Each batch writes the counts that changed under its own batch folder; a
    batch that is retried overwrites itself. State grows with files times
    severities. Read back with :func:`latest_counts`.
    """
    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return (
        severity_counts(parse_findings(raw)).writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint).outputMode("update")
        .trigger(availableNow=True).start()
    )


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    written = spark.read.parquet(out)
    return written.groupBy("file_path", "severity").agg(F.max_by("findings", "batch").alias("findings"))


def process_new_files(
    files: DataFrame, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Run ``stage`` once on every file that appears; nothing is done twice.

    The checkpoint remembers which files were seen; a retried batch overwrites
    its own folder.
    """
    def run(batch_files: DataFrame, batch: int) -> None:
        stage(batch_files).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return (
        files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
