"""Session helpers."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "lintmill", **conf) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the given one."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="lintmill-")


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder name under the shared folder named by spark.checkpoint.dir.

    A local session that names none gets a temporary folder; a cluster must
    name one, as executors have to reach it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For tables that several later steps read: each is computed once, and a lost
    executor costs no more than its own tasks.
    """
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
