"""Blocks of documents, and the exchange of names between them.

Documents are written once as a bucketed table whose rows carry a block number.
A block sends its distinct names to name buckets; each bucket answers with one
value per name and block; the answers meet their block again. Texts stay where
they are: the bucketed table joins by block without a shuffle. What travels is
packed arrays, one row for each block and bucket, and a name that owns a third
of all rows is still sent once by each block.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintmill.session import scratch_path

BUCKET_BYTES = 16 << 20  # text for each name bucket
MAX_BUCKETS = 1 << 16
MIN_BITS, MAX_BITS = 11, 15  # a block has at most 2**bits documents

SENT = "block long, bucket int, blob binary"


@dataclass
class Blocks:
    """``table`` has block, uid, text and row (a struct of the other columns)."""

    table: DataFrame
    buckets: int
    rows: int
    bits: int  # a document's block is its uid without these lowest bits


def write_blocks(docs: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> Blocks:
    """Write documents as blocks below spark.checkpoint.dir.

    Every row gets a ``uid`` of its own, so null and repeated ids do no harm, and
    all columns but the text travel in one struct, so their names clash with
    nothing. ``drop`` lists columns that a result will replace.
    """
    spark = docs.sparkSession
    found = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text).cast("long"))).first()
    rows, size = found[0], found[1] or 0
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(4 * math.sqrt(rows + 1)))))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in drop]
    keyed = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(f"`{text}`").alias("text"),
        F.struct(*others, F.lit(None).cast("boolean").alias("llm_end")).alias("row"),
    ).withColumn("block", F.shiftright("uid", bits))
    table = write_bucketed(keyed, "block")
    buckets = min(MAX_BUCKETS, size // BUCKET_BYTES + 1)
    return Blocks(table, int(buckets), rows, bits)


def write_bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write a table in buckets of a key below spark.checkpoint.dir: joins on the key leave it in place."""
    spark = df.sparkSession
    name = f"llm_{key}_{uuid.uuid4().hex}"
    (
        df.write.format("parquet").bucketBy(_partitions(spark), key)
        .option("path", scratch_path(spark, key)).option("compression", "zstd").saveAsTable(name)
    )
    return spark.table(name)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_columns(df: DataFrame, without: set[str] = frozenset()) -> list:
    """The documents' own columns, out of the struct."""
    names = [f.name for f in df.schema["row"].dataType.fields if f.name != "llm_end" and f.name not in without]
    return [F.col(f"row.`{n}`").alias(n) for n in names]


def with_row(df: DataFrame, columns: str) -> T.StructType:
    """The documents' own columns, whatever their names, and further ones."""
    return T.StructType([df.schema["row"], *T.StructType.fromDDL(columns).fields])


def edges(names: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of the sorted names begins and ends."""
    starts = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(names, starts), len(names))


def sent_rows(block: int, names: np.ndarray, parts: list[np.ndarray], buckets: int) -> pa.Table:
    """One row per bucket; its blob holds that bucket's slice of every part."""
    at = edges(names, buckets)
    full = np.flatnonzero(np.diff(at))
    blobs = [b"".join(p[at[b]:at[b + 1]].tobytes() for p in parts) for b in full]
    return pa.table({
        "block": pa.array(np.full(len(full), block, np.int64)),
        "bucket": pa.array(full.astype(np.int32)), "blob": pa.array(blobs, pa.binary()),
    })


def ordered(table: pa.Table) -> list[bytes]:
    """Blobs of one block's answers, by bucket."""
    at = np.argsort(table["bucket"].to_numpy(), kind="stable")
    blobs = table["blob"].to_pylist()
    return [blobs[i] for i in at]


def exchange(sent: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Let each bucket answer what blocks sent: one blob back for every blob."""

    def reply(key, table: pa.Table) -> pa.Table:
        out = answer(table["blob"].to_pylist())
        return table.set_column(2, "blob", pa.array(out, pa.binary()))

    return sent.groupBy("bucket").applyInArrow(lambda key, t: reply(key, t.select(["block", "bucket", "blob"])), SENT)


def shared_flags(kind: str, width: int) -> Callable[[list[bytes]], list[bytes]]:
    """An answer that says which names more than one block has sent, a bit each."""

    def answer(blobs: list[bytes]) -> list[bytes]:
        counts = [len(b) // width for b in blobs]
        keys = np.concatenate([np.frombuffer(b, kind) for b in blobs])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        shared = np.zeros(len(keys), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        cuts = np.cumsum(counts)[:-1]
        return [np.packbits(x).tobytes() for x in np.split(shared, cuts)]

    return answer


def flags_of(names: np.ndarray, buckets: int, blobs: list[bytes]) -> np.ndarray:
    """The bits that came back for the sorted names a block sent."""
    counts = [n for n in np.diff(edges(names, buckets)) if n]
    if not counts:
        return np.zeros(0, bool)
    return np.concatenate([
        np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)) for n, b in zip(counts, blobs, strict=True)
    ]).astype(bool)
