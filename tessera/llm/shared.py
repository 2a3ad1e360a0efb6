"""Helpers all operators use: scratch data in the cluster's shared folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few short columns may be broadcast (about 64 MB at most).
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Environment of Python workers: arrays over 4 MB have pages of their own, Arrow's buffers are allocated like numpy's.
ALLOCATION = {"MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "16777216", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Bytes of an Arrow batch, instead of Spark's 64 MB.
BATCH, _BATCH = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and driver and executors are one
    process (tests), a temporary folder, which is then also set; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def lean(spark: SparkSession) -> None:
    """Python workers give freed arrays back to the system at once, so those of one stage do not weigh on the next, and get
    Arrow batches of a few MB. Must come before the first Python function of a plan; a setting of the user's own stays."""
    for name, value in ALLOCATION.items():
        spark.sparkContext.environment.setdefault(name, value)
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, BATCH)


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, so that later work neither repeats them nor depends on an executor."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows (df should be cut() first) and, where a row's size in bytes is
    not fixed and so given, so many bytes; else as it is, so that Spark shuffles it."""
    if df.limit(rows + 1).count() > rows:
        return df
    return F.broadcast(df) if size is None or (df.agg(F.sum(size)).head()[0] or 0) <= most else df


def partitions(spark: SparkSession, total_bytes: int, each: int = 48 << 20) -> int:
    """Shuffle partitions for so many bytes: at least the session's number, more as the data grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // each))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0


def runs(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of a string column with about `most` bytes; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end - at
        at = end


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one struct, so that their names cannot clash with those an operator adds."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("__rest")] if rest else []))


def unpacked(rows: DataFrame, columns: list[str], *added: str) -> DataFrame:
    """The columns that `packed` was given, in their order, and those added."""
    return rows.select(*(c if c in ("doc_id", "text") else F.col(f"__rest.`{c}`").alias(c) for c in columns), *added)
